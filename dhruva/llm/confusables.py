"""Problem 2: one consistent form for text that looks the same on screen.

Steps: drop characters that show nothing, unify full-width forms and kinds of single blank, decompose, pick one
script for the letters of each token, compose again (NFC).

Script choice follows the resolved script sets of the token's letters: a letter that has a look-alike in another
alphabet may stand for any script in its set, other letters only for their own. If the sets have a script in
common, the token is spelled in it (Latin first), which covers mixed tokens ("Poluvоkkam") and whole-script
look-alikes ("М84"); if they have none, every look-alike letter takes its Latin shape. The choice depends only
on how the token looks, so two texts get equal forms exactly when they look the same.

Which letters look like Latin ones comes from the published list of confusable characters, which the ICU library
that Spark brings along carries: ``latin_shapes`` reads it once on the driver and the table travels to the workers.
A few letters are given here, for use without a session and as the first choice among letters of one shape.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.session import materialise

# Letters shaped like Latin ones (fixed values), script by script, each paired with its Latin shape.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХԜԚҮԌаеорсухѕіјһԁԛԝѵүӏԀ", "ABESIJKMHOPCTXWQYGaeopcyxsijhdqwvyld"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov"),
    "Armenian": ("Օօ", "Oo"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJLMPRSTVWZ"),
}
# Characters that show nothing beyond category Cf (fixed values): joiners, fillers, selectors, tags.
SHOWS_NOTHING = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0xE0000, 0xE0FFF),
]
# Category Cf, but drawn: prefixed signs of Arabic, Syriac and Kaithi (fixed values).
DRAWN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


@lru_cache(maxsize=1)
def _plain_table() -> dict[int, str | None]:
    """Code point to replacement for everything but letters: invisibles, blanks, full-width forms."""
    table: dict[int, str | None] = {}
    # Blanks, format characters and full-width forms lie in the first planes and among the tags, which are listed.
    for cp in range(0x20000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs" and cp != 0x1680 and ch != " ":
            table[cp] = " "
        elif kind == "Cf" and cp not in DRAWN_FORMAT:
            table[cp] = None
        elif 0xFF00 <= cp <= 0xFFEF and unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            table[cp] = unicodedata.normalize("NFKC", ch)
    for first, last in SHOWS_NOTHING:
        table.update(dict.fromkeys(range(first, last + 1)))
    return table


@lru_cache(maxsize=1)
def _to_replace() -> str:
    """The characters that the table replaces, as ranges of a pattern."""
    ranges: list[list[int]] = []
    for cp in sorted(_plain_table()):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_GAP = r"\s!-/:-@\[-`{-~।॥"


@lru_cache(maxsize=20_000)
def _script(ch: str) -> str:
    """Script of a letter by the first word of its Unicode name."""
    return unicodedata.name(ch, "?").split(" ")[0].capitalize()


@dataclass(frozen=True)
class Shapes:
    """Letters shaped like Latin ones, both ways, and the letters of the scripts they belong to as ranges of a pattern."""

    to_latin: dict[int, str]
    from_latin: dict[str, dict[str, str]]
    letters: str

    @classmethod
    def of(cls, table: dict[str, tuple[str, str]]) -> Shapes:
        """``table``: per script its letters and, in the same order, their Latin shapes; the first of equal shapes is preferred."""
        to_latin = {ord(a): b for own, latin in table.values() for a, b in zip(own, latin)}
        from_latin = {script: {b: a for a, b in reversed(list(zip(own, latin)))} for script, (own, latin) in table.items()}
        ranges, last = [], -2
        for cp in range(0x370, 0x20000):
            if unicodedata.category(chr(cp))[0] == "L" and _script(chr(cp)) in table:
                if cp == last + 1:
                    ranges[-1][1] = cp
                else:
                    ranges.append([cp, cp])
                last = cp
        return cls(to_latin, from_latin, "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges))


@lru_cache(maxsize=1)
def latin_shapes(spark: SparkSession) -> Shapes:
    """All letters that the published list of confusables, as ICU has it, gives the shape of one Latin letter.

    Only letters of other alphabets: compatibility forms (bold, script, full-width ...) look different or are unified before.
    """
    icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = "".join(map(chr, (*range(65, 91), *range(97, 123))))
    shape: dict[str, list[str]] = {}
    for ch, skeleton in zip(latin, icu.getSkeleton("\n".join(latin)).split("\n")):
        shape.setdefault(skeleton, []).append(ch)
    letters = [c for c in map(chr, range(0x370, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c) and _script(c) not in ("Latin", "Cjk", "Hangul", "?")]
    table = {script: list(zip(*pairs)) for script, pairs in LOOK_ALIKES.items()}
    known = {a for own, _ in LOOK_ALIKES.values() for a in own}
    for ch, skeleton in zip(letters, icu.getSkeleton("\n".join(letters)).split("\n")):
        if skeleton in shape and ch not in known:
            # Capital I and small l have one shape: a letter keeps its case.
            like = [x for x in shape[skeleton] if x.isupper() == ch.isupper()] or shape[skeleton]
            table.setdefault(_script(ch), []).append((ch, like[-1]))
    return Shapes.of({script: ("".join(a for a, _ in pairs), "".join(b for _, b in pairs)) for script, pairs in table.items()})


_in_use: Shapes | None = None


def shapes_in_use() -> Shapes:
    global _in_use
    if _in_use is None:
        _in_use = Shapes.of(LOOK_ALIKES)
    return _in_use


def with_shapes(spark: SparkSession, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (a function over batches) for workers, with the session's look-alike letters."""
    shapes = latin_shapes(spark)

    def there(batches: Iterator) -> Iterator:
        use_shapes(shapes)
        return run(batches)

    return there


def use_shapes(shapes: Shapes) -> None:
    global _in_use
    _in_use = shapes


@lru_cache(maxsize=4)
def _patterns(letters: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Anything to be looked at, a letter of a script that has look-alikes of Latin letters, a token (without blanks or punctuation) with one."""
    return re.compile(f"[{_to_replace()}{letters}]"), re.compile(f"[{letters}]"), re.compile(f"[^{_GAP}]*[{letters}][^{_GAP}]*")


def resolved_scripts(token: str) -> set[str] | None:
    """Scripts in which the whole (decomposed) token can be spelled; None if it has no letters."""
    shapes = shapes_in_use()
    common: set[str] | None = None
    for ch in token:
        if not ch.isalpha():
            continue
        latin = shapes.to_latin.get(ord(ch), ch)
        own = {_script(ch)} | ({"Latin"} if latin != ch else set())
        if latin.isascii():
            own |= {s for s, letters in shapes.from_latin.items() if latin in letters} | {"Latin"}
        common = own if common is None else common & own
    return common


def _spell(match: re.Match) -> str:
    token, shapes = match.group(), shapes_in_use()
    scripts = resolved_scripts(token) or set()
    if "Latin" in scripts or not scripts:
        return token.translate(shapes.to_latin)
    script = next((s for s in shapes.from_latin if s in scripts), "")
    letters = shapes.from_latin.get(script, {})
    # Letters of the token's own script stay as they are, those of others are spelled in it.
    return "".join(c if _script(c) == script else letters.get(shapes.to_latin.get(ord(c), c), c) for c in token)


def one_form(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, an empty text stays empty."""
    if text is None or text.isascii() and text.isprintable():
        return text
    anything, letter, token = _patterns(shapes_in_use().letters)
    if anything.search(text):
        text = text.translate(_plain_table())
        if letter.search(text):
            text = token.sub(_spell, unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text)


def consistent_form(spark: SparkSession, texts: str) -> Column:
    """``one_form`` as a column."""
    shapes = latin_shapes(spark)

    @F.pandas_udf(T.StringType())
    def form(texts: pd.Series) -> pd.Series:
        use_shapes(shapes)
        return texts.map(one_form, na_action="ignore")

    return form(texts)


def look_alike_pairs(items: DataFrame, group: str = "corpus", key: str = "key", text: str = "text") -> DataFrame:
    """Rows ``(group, key_a, key_b)``: different keys of a group whose texts differ but look the same.

    Null keys and texts take no part; empty texts equal only empty ones; repeated rows count once. Texts are first
    reduced to classes (one per distinct text), only classes whose form has a second text are joined, and their
    members are looked up by class: exact copies, however many, never meet each other.
    """
    members = _members(items, group, key, text)
    classes = members.select("g", "f", "t").distinct()
    pairs = classes.alias("x").join(classes.alias("y"), ["g", "f"]).where("x.t < y.t").select("g", F.col("x.t").alias("tx"), F.col("y.t").alias("ty"))
    left = members.select("g", F.col("t").alias("tx"), F.col("k").alias("kx"))
    right = members.select("g", F.col("t").alias("ty"), F.col("k").alias("ky"))
    found = pairs.join(left, ["g", "tx"]).join(right, ["g", "ty"]).where("kx != ky")
    return found.select(F.col("g").alias(group), F.least("kx", "ky").alias("key_a"), F.greatest("kx", "ky").alias("key_b")).distinct()


def _members(items: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """``(g, k, t, f)``: keys with digests of their text and its form, where the form has several texts. Each text is normalised once."""
    rows = items.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    rows = rows.select("g", "k", F.unhex(F.md5("t")).alias("t"), F.unhex(F.md5(consistent_form(items.sparkSession, "t"))).alias("f"))
    rows = materialise(rows, "forms")
    torn = rows.groupBy("g", "f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select("g", "f")
    return materialise(rows.join(torn, ["g", "f"], "left_semi").distinct(), "torn")


def look_alike_classes(items: DataFrame, group: str = "corpus", key: str = "key", text: str = "text") -> DataFrame:
    """``(group, key, class, texts, keys)``: the same without pairs, one row per key whose text looks like another.

    ``class`` is the least key of all that look the same, ``texts`` how many different texts they have, ``keys`` how
    many keys; no pair is ever made, so a form that a third of all rows share stays linear.
    """
    members = _members(items, group, key, text)
    sums = members.groupBy("g", "f").agg(F.min("k").alias("class"), F.count_distinct("t").alias("texts"), F.count_distinct("k").alias("keys"))
    return members.select("g", "k", "f").distinct().join(sums, ["g", "f"]).select(F.col("g").alias(group), F.col("k").alias(key), "class", "texts", "keys")


class _Gaps(dict):
    """Characters to blanks unless they are letters, marks or numbers; filled as characters turn up."""

    def __missing__(self, cp: int) -> int:
        self[cp] = out = cp if unicodedata.category(chr(cp))[0] in "LMN" else 32
        return out


_GAPS = _Gaps()


def words(text: str | None) -> list[str]:
    """Words of a text's consistent form in lower case; anything but letters, marks and numbers counts as a blank."""
    return one_form(text).lower().translate(_GAPS).split() if text else []
