"""Problem 1: freely typed values mapped to the entries of a reference list.

Every word, in Devanagari or Latin letters, is reduced to a skeleton in which the usual spellings of one sound agree.
Distinct skeletons are joined with the reference vocabulary by edit distance: both sides list what is left when up
to two characters are deleted (long words: their pieces), equal remains meet, and the distance of those few pairs is
computed. The corrected words of a value are then compared by soft TF-IDF with every entry that can reach the
threshold: words of an entry are taken in order of weight until those left are too light to reach it without them,
so a value that has none of these leading words cannot mean the entry.

The vocabulary holds, for each word of an entry: its skeleton, its spellings in the entry's aliases, and for words
that occur in several entries ("Nagar", "Junction") their abbreviations. Aliases of one short word are codes and
match only exactly. A word typed in two halves meets the vocabulary as the pair of neighbours, an entry typed in
one word as the entry without blanks.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.llm.confusables import one_form, with_shapes
from dhruva.session import materialise

# Romanisation of Devanagari (fixed values); aspirates in capitals so that they stay one letter.
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "kKgGncCjJntTdDntTdDnpPbBmyrllvsssh"))
_NUKTA = {"D": "rh", "P": "f", "K": "k", "g": "g"}
_VOWELS = dict(zip("अआइईउऊऋएऐऑओऔ", "aaiiuureeooo"))
_SIGNS = dict(zip("ािीुूृेैॉोौ", "aiiuureeooo"))
# Latin spellings of one sound (fixed values), applied in this order.
_SOUNDS = (("oo", "u"), ("ee", "i"), ("aa", "a"), ("ay", "e"), ("w", "v"), ("z", "j"))
# Words that place a name but do not name it: "near ...", "opposite ...", "... ke paas", "gate no 2".
NOISE = frozenset("near nr opp opposite ke ka ki paas pass gate no number num the at of behind के पास का की गेट नंबर सामने".split())

#: A word in this many entries is a common one: it tells related entries apart but does not name a place.
COMMON = 3
#: Least soft TF-IDF score; scores this close are a tie, which means no decision.
THRESHOLD, TIE = 0.75, 1e-6
#: A value must prove at least this part of an entry's squared weights to reach THRESHOLD: entry words that are not typed
#: weigh half, so the score is at most sqrt(m / (m + (1 - m) / 2)) where m is the part that is typed.
PROOF = THRESHOLD**2 / (2 - THRESHOLD**2)
#: Rows of remains of the vocabulary (a hash and a form each) up to which they are sent to every executor; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Words up to this length meet by their remains, longer ones by their pieces, which grow with the length only.
LONG = 24
_ASPIRATE, _DOUBLE = re.compile(r"([bcdgjkpst])h"), re.compile(r"(.)\1+")


def _romanised(word: str) -> str:
    out, i = [], 0
    while i < len(word):
        ch, i = word[i], i + 1
        if ch in _CONSONANTS:
            sound = _CONSONANTS[ch]
            if word[i : i + 1] == "़":
                sound, i = _NUKTA.get(sound, sound), i + 1
            out.append(sound)
            nxt = word[i : i + 1]
            if nxt in _SIGNS and nxt:
                out.append(_SIGNS[nxt])
                i += 1
            elif nxt == "्":
                i += 1
            else:
                out.append("a")
        elif ch in _VOWELS:
            out.append(_VOWELS[ch])
        elif ch in "ंँ":
            out.append("n")
        elif ch.isalnum():
            out.append(ch)
    return "".join(out).lower()


def skeleton(word: str) -> str:
    """A word's sounds: one script, no aspirates, no lengths, no doubles, no final a."""
    if any("ऀ" <= c <= "ॿ" for c in word):
        word = _romanised(word)
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    word = _DOUBLE.sub(r"\1", _ASPIRATE.sub(r"\1", word))
    return word[:-1] if len(word) > 3 and word.endswith("a") else word


def spellings(word: str) -> list[str]:
    """The forms in which a word is looked for: its skeleton and, marked by "~", the Latin letters as they stand.

    A slip may create or destroy what the skeleton folds ("epe" to "ee"); then the letters are nearer.
    """
    return [skeleton(word), f"~{word}"] if len(word) > 4 and word.isascii() else [skeleton(word)]


_DOTTED = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:[\p{L}\p{N}]\.){2,}[\p{L}\p{N}]?(?![\p{L}\p{M}\p{N}])")
_GAP = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def typed_words(value: str | None) -> list[str]:
    """Words of a value in lower case; dotted initials are one word."""
    text = one_form(value or "").lower()
    return _GAP.sub(" ", _DOTTED.sub(lambda m: m.group().replace(".", ""), text)).split()


def osa(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; ``most`` + 1 if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [0], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _letters(words: Sequence[str]) -> np.ndarray:
    flat = np.array(words, dtype=np.str_)
    return flat.view(np.uint32).reshape(len(flat), -1)


def osa_many(a: Sequence[str], b: Sequence[str], most: int = 2) -> np.ndarray:
    """``osa`` of many pairs at once: all pairs go through the diagonals near the main one together."""
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    out = np.full(len(la), most + 1, np.int32)
    near = np.flatnonzero(np.abs(la - lb) <= most)
    near = near[np.argsort(la[near], kind="stable")]
    start = 0
    while start < len(near):
        # Pairs of like length together, in blocks of bounded size.
        count = 1 << 16
        while count > 1 and count * (la[near[min(start + count, len(near)) - 1]] + 1) > 1 << 21:
            count //= 2
        rows = near[start : start + count]
        out[rows] = _band([a[i] for i in rows], [b[i] for i in rows], la[rows], lb[rows], most)
        start += count
    return out


def _band(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, most: int) -> np.ndarray:
    x, y = _letters(a), _letters(b)
    n, far, width = len(a), most + 1, 2 * most + 1
    y = np.pad(y, ((0, 0), (0, max(0, x.shape[1] + most - y.shape[1]))))
    row = np.tile(np.where(np.arange(width) >= most, np.arange(width) - most, far), (n, 1)).astype(np.int32)
    out, before = row[np.arange(n), np.clip(lb - la + most, 0, width - 1)], None
    for i in range(1, int(la.max(initial=0)) + 1):
        new = np.full((n, width), far, np.int32)
        for k in range(width):
            j = i + k - most
            if j < 0:
                continue
            if j == 0:
                new[:, k] = min(i, far)
                continue
            v = row[:, k] + (x[:, i - 1] != y[:, j - 1])
            if k + 1 < width:
                v = np.minimum(v, row[:, k + 1] + 1)
            if k:
                v = np.minimum(v, new[:, k - 1] + 1)
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                v = np.where(swap, np.minimum(v, before[:, k] + 1), v)
            new[:, k] = np.minimum(v, far)
        before, row = row, new
        done = la == i
        out[done] = row[done, (lb - la + most)[done]]
    return out


# -- the reference list ---------------------------------------------------------------------------


def _entry_forms(key_type: str, key: str, name: str, aliases: str):
    """Rows (entry, position, form, kind) that one entry adds to the vocabulary, before words are counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for entry, canonical, others in zip(pdf[key], pdf[name], pdf[aliases]):
                own = typed_words(canonical)
                if not own:
                    continue
                roots = [skeleton(w) for w in own]
                out += [(entry, w, form, root, "word") for w, root in zip(own, roots) for form in spellings(w)]
                if len(own) > 1:
                    out.append((entry, "", skeleton("".join(own)), "", "glued"))
                for alias in others if others is not None else ():
                    spelt = typed_words(alias)
                    if len(spelt) == len(own) and not (len(spelt) == 1 and len(spelt[0]) <= 6 and spelt[0] not in own and osa(skeleton(spelt[0]), roots[0], 2) > 2):
                        out += [(entry, w, form, root, "spelling") for w, root in zip(spelt, roots) for form in spellings(w)]
                    elif len(spelt) == 1 and len(spelt[0]) <= 6:
                        out.append((entry, spelt[0], spelt[0], "", "code"))
                    elif spelt:
                        out.append((entry, "", skeleton("".join(spelt)), "", "glued"))
            yield pd.DataFrame(out, columns=["entry_id", "raw", "form", "word", "kind"]).astype({"entry_id": pdf[key].dtype})

    return run, f"entry_id {key_type}, raw string, form string, word string, kind string"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _abbreviations(words: pd.Series) -> pd.Series:
    """An abbreviation of a word: two to five of its letters in order, its first among them; their skeletons."""

    def short(w: str) -> list[str]:
        # Distinct runs of n letters so far: however long the word, there are no more than letters allow.
        runs: list[set[str]] = [{""}, set(), set(), set(), set()]
        for c in w[1:]:
            for n in (4, 3, 2, 1):
                runs[n] |= {r + c for r in runs[n - 1]}
        return sorted({skeleton(w[0] + r) for n in range(1, 5) if n + 1 < len(w) for r in runs[n]})

    return words.map(short)


def _vocabulary(ref: DataFrame, key: str, name: str, aliases: str) -> tuple[DataFrame, DataFrame]:
    """(forms, entries): what typed words are compared with, and each entry's words with their weights.

    ``entries(entry_id, word, worth, w2, total, upto)``: squared weight, sum over the entry, sum over its words up to this, lightest first.
    """
    rows = ref.select(key, name, aliases).where(F.col(key).isNotNull()).distinct()
    key_type = ref.schema[key].dataType.simpleString()
    run, schema = _entry_forms(key_type, key, name, aliases)
    raw = materialise(rows.mapInPandas(with_shapes(ref.sparkSession, run), schema), "vocabulary")
    n = max(1, raw.select("entry_id").distinct().count())
    counts = raw.where("kind = 'word'").groupBy("word").agg(F.count_distinct("entry_id").alias("df"), F.min("raw").alias("raw"))
    counts = counts.select("word", "df", "raw", F.log(1 + n / F.col("df")).alias("worth"))
    none = F.lit(None).cast(key_type)

    words = raw.where("kind = 'word'").select("form", "word").distinct()
    # A spelling that stands for several words is left out unless one of them is clearly meant by it.
    spelt = raw.where("kind = 'spelling' and form != ''").groupBy("form", "word").count()
    spelt = spelt.groupBy("form").agg(F.max_by("word", "count").alias("word"), F.max("count").alias("top"), F.sum("count").alias("all"))
    spelt = spelt.where("top > 0.7 * all").select("form", "word").join(words.select("form"), "form", "left_anti")
    short = counts.where(F.col("df") >= COMMON).select("word", F.explode(_abbreviations("raw")).alias("form"))
    short = short.groupBy("form").agg(F.min("word").alias("word"), F.count_distinct("word").alias("n")).where("n = 1 and length(form) > 1")
    short = short.select("form", "word").join(words.select("form"), "form", "left_anti").join(spelt.select("form"), "form", "left_anti")
    by_word = words.withColumn("kind", F.lit("word")).union(spelt.withColumn("kind", F.lit("word"))).union(short.withColumn("kind", F.lit("short")))
    by_word = by_word.join(counts, "word").select("form", "word", none.alias("entry_id"), F.when((F.col("df") >= COMMON) & (F.col("kind") == "word"), "common").otherwise(F.col("kind")).alias("kind"), "worth")
    by_entry = raw.where("kind in ('code', 'glued')").select("form", F.lit("").alias("word"), "entry_id", "kind", F.lit(0.0).alias("worth")).distinct()
    per_entry = raw.where("kind = 'word'").select("entry_id", "word").distinct().join(counts, "word").select("entry_id", "word", "worth", (F.col("worth") * F.col("worth")).alias("w2"))
    w = Window.partitionBy("entry_id")
    return by_word.union(by_entry), per_entry.select("*", F.sum("w2").over(w).alias("total"), F.sum("w2").over(w.orderBy("worth", "word")).alias("upto"))


# -- joins by edit distance ------------------------------------------------------------------------


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _edits(word: str) -> int:
    """Edits allowed in a word of this length."""
    n = len(word.lstrip("~"))
    return 0 if n < 4 else 1 if n < 6 else 2


def signatures(words: Sequence[str], moved: bool) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of like length with hashes of what is left of each when up to ``_edits`` letters are deleted, one row per word.

    Longer words than LONG have hashes of their fifths instead: two edits leave one fifth whole, moved by two letters at
    most. ``moved``: fifths as in words of like length, at all such places. All hashes of a length come from prefix
    hashes of all its words together; equal ones are only candidates.
    """
    groups: dict[tuple[int, int], list[str]] = defaultdict(list)
    for w in words:
        groups[len(w), _edits(w)].append(w)
    with np.errstate(over="ignore"):
        for (n, e), alike in groups.items():
            step = max(1, (1 << 22) // (n + 1))
            for start in range(0, len(alike), step):
                part = alike[start : start + step]
                yield part, np.stack(list(_hashes(part, n, e, moved)), 1).view(np.int64)


def _hashes(words: list[str], n: int, e: int, moved: bool) -> Iterator[np.ndarray]:
    x = _letters(words).astype(np.uint64) if n else np.zeros((len(words), 0), np.uint64)
    prefix, power = np.zeros((len(words), n + 1), np.uint64), np.ones(n + 1, np.uint64)
    for i in range(n):
        prefix[:, i + 1] = prefix[:, i] * _BASE + x[:, i] + np.uint64(1)
        power[i + 1] = power[i] * _BASE
    cut = lambda a, b: prefix[:, b] - prefix[:, a] * power[b - a]
    if n <= LONG + 2 * moved:
        yield prefix[:, n]
        for i in range(n if e else 0):
            yield prefix[:, i] * power[n - 1 - i] + cut(i + 1, n)
            for j in range(i + 1, n if e > 1 else 0):
                yield prefix[:, i] * power[n - i - 2] + cut(i + 1, j) * power[n - j - 1] + cut(j + 1, n)
    if n > LONG - 2 * moved:
        for m in range(max(LONG + 1, n - 2), n + 3) if moved else (n,):
            for i in range(5):
                size = (i + 1) * m // 5 - i * m // 5
                for at in range(i * m // 5 - 2, i * m // 5 + 3) if moved else (i * m // 5,):
                    if at >= 0 and at + size <= n:
                        yield (cut(at, at + size) ^ np.uint64(m * 8 + i + 1)) * _MIX


def _signed(df: DataFrame, column: str, moved: bool) -> DataFrame:
    """``(column, rest)``: each word with its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, found in signatures(batch.column(0).to_pylist(), moved):
                ends = pa.array(np.arange(len(words) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[column, "rests"])

    return df.select(column).mapInArrow(run, f"{column} string, rests array<bigint>").select(column, F.explode("rests").alias("rest"))


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(osa_many(a.tolist(), b.tolist()), dtype="int32")


def _size_edits(c: str) -> str:
    """Edits allowed in a form of this length, as SQL."""
    return f"case when length(ltrim('~', {c})) < 4 then 0 when length(ltrim('~', {c})) < 6 then 1 else 2 end"


def near_forms(units: DataFrame, forms: DataFrame) -> DataFrame:
    """``(unit, form, d)`` of all pairs of ``units(unit, width)`` and ``forms(form, kind)`` within the edits that the form's length allows.

    Units of width 2, two neighbours in one, are looked for among words only: longer ones than any word are near none.
    """
    spark = units.sparkSession
    there = materialise(_signed(forms.select("form").where("form != ''").distinct(), "form", False).distinct(), "remains")
    there = F.broadcast(there) if there.count() <= BROADCAST_ROWS else there
    longest = forms.agg(F.max(F.length("form")), F.max(F.when(F.col("kind") == "word", F.length("form")))).first()
    # A unit that is longer by more than two letters than the longest form is near none. Many remains come from few rows:
    # an explicit number of partitions is not coalesced.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    here = units.where(F.length("unit") <= F.when(F.col("width") == 1, longest[0] or 0).otherwise(longest[1] or 0) + 2).select("unit").repartition(parts, "unit").distinct()
    met = _signed(here, "unit", True).join(there, "rest").select("unit", "form").distinct()
    return met.withColumn("d", _distance("unit", "form")).where(f"d <= {_size_edits('form')}")


def match_words(units: DataFrame, forms: DataFrame) -> DataFrame:
    """``units(unit, code, width)`` with each form near enough: ``(unit, word, entry_id, kind, worth, sim)``, the best per target."""
    exact = forms.where("kind in ('short', 'code')")
    fuzzy = forms.where("kind not in ('short', 'code')")
    met = near_forms(units, fuzzy).join(fuzzy, "form").where("kind != 'glued' or d <= 1")
    near = met.select("unit", "word", "entry_id", "kind", "worth", (1 - F.col("d") / (2.0 * F.length("form"))).alias("sim"))
    short = units.join(exact.where("kind = 'short'"), F.col("unit") == F.col("form")).select("unit", "word", "entry_id", "kind", "worth", F.lit(0.95).alias("sim"))
    code = units.join(exact.where("kind = 'code'"), F.col("code") == F.col("form")).select("unit", "word", "entry_id", "kind", "worth", F.lit(1.0).alias("sim"))
    return near.union(short).union(code).groupBy("unit", "word", "entry_id", "kind", "worth").agg(F.max("sim").alias("sim"))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of each value and pairs of neighbours: (value, pos, width, unit, code, n, noise)."""
    for pdf in batches:
        out = []
        for value in pdf["value"]:
            words = typed_words(value)
            roots = [skeleton(w) for w in words]
            n = len(words)
            out += [(value, i, 1, r, w, n, w in NOISE or w.isdecimal() and len(w) < 3) for i, (w, r) in enumerate(zip(words, roots))]
            out += [(value, i, 1, form, "", n, False) for i, w in enumerate(words) for form in spellings(w)[1:]]
            out += [(value, i, 2, skeleton(words[i] + words[i + 1]), "", n, False) for i in range(n - 1)]
        yield pd.DataFrame(out, columns=["value", "pos", "width", "unit", "code", "n", "noise"])


def soft_tfidf(entry: list[tuple[float, str]], hits: list[tuple[int, int, str, bool, float, float]], free: list[tuple[int, bool]], top: float) -> tuple[float, float, bool]:
    """Soft TF-IDF of a value and an entry, the part of it that typed words prove, and whether all words were typed.

    ``entry``: (weight, word); ``hits``: (pos, width, word, common, weight, sim) of corrected words; ``free``: (pos, noise)
    of the typed words. Entry words that are not typed weigh half; common words alone name an entry only if they are all
    it has. Typed words that stand for a common word of other entries contradict the entry; unknown words weigh as
    much as the rarest; noise weighs nothing.
    """
    by_word, by_pos = defaultdict(list), defaultdict(list)
    for pos, width, word, common, weight, sim in hits:
        by_word[word].append((sim, -width, pos, common))
        by_pos[pos].append((width, word, common, weight))
    used: set[int] = set()
    dot = norm_e = norm_q = 0.0
    complete, named = True, False
    for weight, word in sorted(entry, reverse=True):
        options = [o for o in by_word.get(word, ()) if o[2] not in used and (o[1] == -1 or o[2] + 1 not in used)]
        if not options:
            norm_e += weight * weight / 2
            complete = False
            continue
        sim, width, pos, common = max(options)
        named = named or not common
        used.update(range(pos, pos - width))
        dot += sim * weight * weight
        norm_e += weight * weight
        norm_q += weight * weight
    if not named and not complete:
        return 0.0, 0.0, False
    own = {w for _, w in entry}
    for pos, noise in free:
        if pos in used or noise:
            continue
        others = [(common, weight) for width, w, common, weight in by_pos.get(pos, ()) if width == 1 and w and w not in own]
        if any(common for common, _ in others):
            return 0.0, 0.0, False
        repeated = any(w in own for _, w, _, _ in by_pos.get(pos, ()))
        norm_q += 0.0 if repeated else max([weight for _, weight in others], default=top) ** 2
    return (dot / (norm_e * norm_q) ** 0.5 if dot else 0.0), dot, complete


def candidates(by_word: DataFrame, entries: DataFrame) -> DataFrame:
    """``(value, entry_id)`` of all pairs whose common words are heavy enough for THRESHOLD.

    An entry is looked up by its leading words: lighter ones follow until they weigh less than PROOF of the entry. What a
    value then proves, leading words met and all the others, must reach PROOF.
    """
    lead = entries.where(F.col("upto") >= PROOF * F.col("total") - TIE)
    light = entries.groupBy("entry_id").agg(F.sum(F.when(F.col("upto") < PROOF * F.col("total") - TIE, F.col("w2")).otherwise(0.0)).alias("light"))
    lead = lead.join(light, "entry_id").select("entry_id", "word", "w2", "light", "total")
    met = by_word.select("value", "word").distinct().join(lead, "word").groupBy("value", "entry_id")
    sums = met.agg(F.sum("w2").alias("m"), F.first("light").alias("light"), F.first("total").alias("total"))
    return sums.where(F.col("m") + F.col("light") >= PROOF * F.col("total") - TIE).select("value", "entry_id")


def map_values(values: DataFrame, ref: DataFrame, value: str = "value", key: str = "entry_id", name: str = "canonical_name", aliases: str = "aliases") -> DataFrame:
    """``(value, entry_id, score, fits)`` for every distinct value of ``values``; ``entry_id`` null where it means no entry.

    Null, blank and meaningless values mean none, nor does one that fits several entries equally well: ``fits`` is the
    number of entries that do, 0 for none. Reference rows without key or name are ignored, aliases may be null.
    Values are compared once however often they occur, and whole, however long. A value that is an entry's code or the
    entry written in one word goes by that alone.
    """
    key_type = ref.schema[key].dataType.simpleString()
    forms, entries = _vocabulary(ref, key, name, aliases)
    forms, entries = materialise(forms, "forms"), materialise(entries, "entries")
    n = entries.select("entry_id").distinct().count()
    distinct = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    parts = materialise(distinct.mapInPandas(with_shapes(values.sparkSession, _units), "value string, pos int, width int, unit string, code string, n int, noise boolean"), "units")
    # Codes count only where they are the whole value.
    typed = parts.select("unit", F.when((F.col("n") == 1), F.col("code")).otherwise("").alias("code"), "width").where("unit != ''").groupBy("unit", "code").agg(F.min("width").alias("width"))
    matches = materialise(match_words(typed, forms), "matches")

    hits = parts.where("unit != ''").join(matches, "unit")
    hits = hits.where("(width = 1 or kind = 'word') and (kind != 'code' or n = 1) and (kind != 'glued' or width = 1)")
    whole = hits.where("kind in ('code', 'glued')").where("n = 1 or kind = 'glued'")
    by_word = hits.where("word != ''").withColumn("common", F.col("kind").isin("common", "short"))
    words = entries.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("worth", "word"))).alias("words"))
    found = by_word.groupBy("value").agg(F.collect_list(F.struct("pos", "width", "word", "common", "worth", "sim")).alias("hits"))
    free = parts.where("width = 1 and not startswith(unit, '~')").groupBy("value").agg(F.collect_list(F.struct("pos", "noise")).alias("free"))
    pairs = candidates(by_word, entries).join(words, "entry_id").join(found, "value").join(free, "value")
    top = math.log(1 + n)
    # Lists of plain values: structs would become one object each.
    flat = [F.col(c) for c in "words.worth words.word hits.pos hits.width hits.word hits.common hits.worth hits.sim free.pos free.noise".split()]

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("proof", T.DoubleType()), T.StructField("complete", T.BooleanType())]))
    def score(ww: pd.Series, wo: pd.Series, hp: pd.Series, hw: pd.Series, ho: pd.Series, hc: pd.Series, hv: pd.Series, hs: pd.Series, fp: pd.Series, fn: pd.Series) -> pd.DataFrame:
        lists = (zip(*(c.tolist() for c in row)) for row in zip(hp, hw, ho, hc, hv, hs))
        out = [soft_tfidf(list(zip(a.tolist(), b.tolist())), list(h), list(zip(c.tolist(), d.tolist())), top) for a, b, h, c, d in zip(ww, wo, lists, fp, fn)]
        return pd.DataFrame(out, columns=["score", "proof", "complete"])

    scored = pairs.select("value", "entry_id", score(*flat).alias("s")).select("value", "entry_id", "s.*")
    scored = scored.union(whole.select("value", "entry_id", "sim", F.lit(0.0), F.lit(True))).where(F.col("score") >= THRESHOLD)
    scored = scored.groupBy("value", "entry_id").agg(F.max(F.struct("score", "proof", "complete")).alias("s"))
    best = scored.groupBy("value").agg(F.max(F.struct("s", "entry_id")).alias("b"), F.collect_list("s").alias("all"))
    # A tie: another entry scores as high, or, where words of the best are missing, the typed words prove it as well.
    rivals = F.filter("all", lambda x: (x["score"] >= F.col("b.s.score") - TIE) | ~F.col("b.s.complete") & (x["proof"] >= F.col("b.s.proof") - TIE))
    best = best.withColumn("fits", F.size(rivals))
    sure = F.col("fits") == 1
    best = best.select("value", F.when(sure, F.col("b.entry_id")).alias("entry_id"), F.when(sure, F.col("b.s.score")).alias("score"), "fits")
    return distinct.join(best, "value", "left").select("value", F.col("entry_id").cast(key_type).alias("entry_id"), "score", F.coalesce("fits", F.lit(0)).alias("fits"))
