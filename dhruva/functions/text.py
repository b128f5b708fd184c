"""Text functions as Spark columns. Only NFC needs Python; everything else stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Punctuation that counts as a blank (fixed values).
PUNCTUATION = "।॥?!,.:;\\-_()\\[\\]{}'\"‘’“”/\\\\"
# All that separates words: blanks, line ends and the separators among the control characters (fixed values).
BLANK = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
# Two notions of a word boundary, both needed: with combining marks as letters, and without.
MARK_WORD, PLAIN_WORD = r"\p{L}\p{N}\p{M}_", r"\p{L}\p{N}_"
#: Decimal digits of all scripts, each run zero to nine.
DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")

# Mode words (fixed values).
MODES = {
    "metro": ("metro", "मेट्रो"),
    "bus": ("buses", "bus", "बसें", "बसों", "बस"),
    "rail": ("railway", "train", "rail", "railgadi", "local", "रेलवे", "ट्रेन", "रेल", "लोकल"),
    "mrts": ("mrts", "एमआरटीएस"),
    "walking": ("walking", "पैदल"),
}
# What a timing question asks for; the first kind with a word in the text wins (fixed values).
INFORMATION = {
    "last_service": ("आखिरी", "अंतिम", "aakhiri", "aakhri", "akhri", "last"),
    "first_service": ("पहली", "पहला", "सबसे पहले", "pehli", "pehla", "pehle", "first"),
    "frequency": ("अंतराल", "gap", "frequency"),
    "scheduled_departure": ("अगली", "अगला", "next", "agla"),
    "timetable": ("समय-सारणी", "समय सारणी", "timetable", "शुरू", "बंद", "shuru", "band"),
    "availability": ("उपलब्ध", "मिलती", "है क्या", "available", "milti", "hai kya"),
}
# Accessibility features (fixed values).
ACCESSIBILITY = {"wheelchair": ("व्हीलचेयर", "wheelchair"), "lift": ("लिफ्ट", "lift", "एलिवेटर")}
# Details of a station; the first with a word in the text wins (fixed values).
STATION_DETAIL = {
    "nearby_bus": ("बस स्टॉप", "बस अड्डे", "बस अड्डा", "बस स्टेशन", "bus stop", "bus stand", "bus station", "bus terminal"),
    "address": ("पता", "address"),
    "platforms": ("प्लेटफॉर्म", "platform"),
    "water": ("पीने", "peene"),
    "office": ("कार्यालय", "office"),
    "entry": ("प्रवेश", "entry"),
}
# Kinds of complaint; the first with a word in the text wins (fixed values).
COMPLAINT = {
    "cleanliness": ("सफाई", "गंदा", "गंदगी", "safai", "ganda", "gandagi"),
    "water": ("पानी", "paani", "pani"),
    "food": ("भोजन", "खाना", "khana", "food"),
    "staff": ("कर्मचारी", "व्यवहार", "staff", "behaviour"),
    "safety": ("सुरक्षा", "safety"),
    "coach_facility": ("कोच", "खिड़की", "coach", "khidki"),
}
# Cues of the goals of a question; each is a pattern between mark-aware word boundaries. The words are our own choice.
GOALS = {
    "first_and_last_service": "first|last|pehli|pehla|aakhiri|aakhri|पहली|पहला|आखिरी|आख़िरी|अंतिम",
    "service_frequency": "frequency|headway|how often|kitni der|कितनी देर",
    "scheduled_departure": "departures?|schedules?|timetables?|kitne baje|कितने बजे",
    "fare_calculation": "fares?|price|kiraya|kiraye|किराया|किराये",
    "station_accessibility": "wheelchair|lift|ramp|व्हीलचेयर|लिफ्ट",
    "station_facilities": "parking|toilet|पार्किंग|शौचालय",
    "ticketing_and_passes": "pass|ticket|token|टिकट|पास|टोकन",
    "route_stop_sequence": "all stops|list of stops|stop list|sabhi stop|सभी स्टॉप",
    "route_stop_membership": "stops? at|rukti|rukta|रुकती|रुकता",
    "nearest_transport": "nearest|closest|nazdeek|नज़दीक|नजदीक",
    "interchange_transfer": "transfer|interchange|badalna|बदलना",
    "realtime_status_query": "live|late|delay|kahan|कहाँ",
    "point_to_point_route": "routes?|kaise|jaane|pahunchna|कैसे|जाने|पहुँचना",
    "mode_availability": "available|chal rahi|chalti|चल रही|चलती",
}


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalised(text: Column | str) -> Column:
    """NFC, lower case, punctuation as blanks, runs of blanks as one, trimmed. Null stays null."""
    spaced = F.regexp_replace(F.lower(nfc(text)), f"[{PUNCTUATION}]+", " ")
    return F.trim(F.regexp_replace(spaced, f"[{BLANK}]+", " "))


def ascii_digits(text: Column | str) -> Column:
    return F.translate(text, DIGITS, "0123456789" * (len(DIGITS) // 10))


def has_word(text: Column, pattern: str, marks: bool = True) -> Column:
    """Is there a match of ``pattern`` between word boundaries? ``marks``: combining marks belong to words."""
    word = MARK_WORD if marks else PLAIN_WORD
    return text.rlike(f"(?<![{word}])(?:{pattern})(?![{word}])")


def first_kind(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The first key of ``table`` with a phrase anywhere in the text, in the table's order; null for none."""
    hits = (F.when(_any(text, words), F.lit(kind)) for kind, words in table.items())
    return F.coalesce(*hits)


def first_enum(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """As ``first_kind``, but phrases must be whole words."""
    return F.coalesce(*(F.when(has_word(text, "|".join(words)), F.lit(kind)) for kind, words in table.items()))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def modes(text: Column) -> Column:
    """Requested modes; a rail word before "station" names a place, and "metro train" is a metro."""
    place = r"(?:" + "|".join(MODES["rail"]) + r")\s+(?:station|स्टेशन)"
    owned = r"(?:metro|mrts|मेट्रो|एमआरटीएस)\s+(?:\S+\s+){0,2}(?:train|ट्रेन)"
    bare = F.regexp_replace(text, f"{place}|{owned}", " ")
    found = [F.when(has_word(bare if m == "rail" else text, "|".join(words)), F.lit(m)) for m, words in MODES.items()]
    return F.array_compact(F.array(*found))


def one_edit(word: Column, known: list[str]) -> Column:
    """Known words that are exactly one substitution, insertion or deletion away."""
    return F.filter(F.array(*map(F.lit, known)), lambda k: F.levenshtein(word, k, 1) == 1)


def qualifier(name: Column | str) -> tuple[Column, Column]:
    """A name's part before the first comma and the qualifier after it (null without one)."""
    parts = F.split(name, ",", 2)
    rest = F.trim(F.try_element_at(parts, F.lit(2)))
    return F.trim(F.element_at(parts, 1)), F.when(rest != "", rest)
