import itertools
import math
import random

import pytest

from dhruva.llm import confusables, overlap
from dhruva.llm.confusables import look_alike_classes, look_alike_pairs, one_form, resolved_scripts, words
from dhruva.llm.overlap import cosine_pairs, cross_split_overlaps


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Poluvоkkam", "Poluvokkam", True), ("М84", "M84", True), ("Mосква", "Москва", True), ("Яndeх", "Яndex", True), ("Ｗｅｓｔ　１", "West 1", True), ("é", "é", True), ("ड़", "ड़", True),
        ("a​­﻿b", "ab", True), ("a\xa0b c d", "a b c d", True), ("e‍́", "é", True), ("Ᾱ", "Ā", True), ("कि‌", "कि", True),
        ("West", "west", False), ("a  b", "a b", False), ("café", "cafe", False), ("ड़", "ड", False), ("१", "1", False), ("a.", "a", False), ("а", "б", False), ("क", "ख", False), ("²", "2", False), ("ﬁ", "fi", False), (" a", "a", False),
    ],
)
def test_looks_the_same(a, b, same):
    assert (one_form(a) == one_form(b)) is same
    assert one_form(one_form(a)) == one_form(a)


def test_scripts():
    assert "Latin" in resolved_scripts("сор") and "Cyrillic" in resolved_scripts("cop") and resolved_scripts("84") is None
    assert resolved_scripts("Яn") == set()
    assert one_form(None) is None and one_form("") == ""
    assert words("Ｂａs! вы-ход। ड़ा") == ["bas", "вы", "ход", "ड़ा"] or words("ड़ा") == ["ड़ा"]


def test_published_look_alikes(spark, monkeypatch):
    monkeypatch.setattr(confusables, "_in_use", None)
    confusables.use_shapes(confusables.latin_shapes(spark))
    for a, b in (("ρ", "p"), ("ո", "n"), ("ց", "g"), ("ӏ", "l"), ("Ӏ", "I"), ("Ԁ", "d"), ("ꓟ", "M"), ("Ьus", "bus"), ("ꓐus", "Bus"), ("mеtrо", "metro"), ("κόσμoς", "κόσμος")):
        assert one_form(a) == one_form(b), (a, b)
    for a, b in (("κόσμος", "κόομος"), ("ж", "x"), ("я", "r"), ("बस", "बस़"), ("٣", "3"), ("𝐌", "M"), ("д", "d"), ("ԁ", "D")):
        assert one_form(a) != one_form(b), (a, b)
    for text in ("κόσμος", "Москва", "तिरुवनमियूर", "திருவான்மியூர்", "مرحبا"):
        assert one_form(text) == text
    assert all(one_form(one_form(chr(c))) == one_form(chr(c)) for c in confusables.latin_shapes(spark).to_latin)


def test_look_alike_pairs_edges(spark):
    rows = [("c", "1", "M84"), ("c", "2", "М84"), ("c", "3", "M84"), ("c", "4", "m84"), ("d", "1", "М84"), ("c", None, "М84"), ("c", "5", None), ("c", "1", "M84"), ("c", "6", ""), ("c", "7", "​"), ("c", "1", "М84"), ("c", "8", "x" * 100_000 + "а"), ("c", "9", "x" * 100_000 + "a")]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "corpus string, key string, text string, t string, f string")
    got = sorted(map(tuple, look_alike_pairs(df).collect()))
    # Key 1 comes with both texts, so it looks like 2 and like 3.
    assert got == [("c", "1", "2"), ("c", "1", "3"), ("c", "2", "3"), ("c", "6", "7"), ("c", "8", "9")]
    assert look_alike_pairs(df.limit(0)).count() == 0
    classes = {(r["corpus"], r["key"]): (r["class"], r["texts"], r["keys"]) for r in look_alike_classes(df).collect()}
    assert classes == {("c", "1"): ("1", 2, 3), ("c", "2"): ("1", 2, 3), ("c", "3"): ("1", 2, 3), ("c", "6"): ("6", 2, 2), ("c", "7"): ("6", 2, 2), ("c", "8"): ("8", 2, 2), ("c", "9"): ("8", 2, 2)}
    assert look_alike_classes(df.limit(0)).count() == 0


def test_hot_group_of_copies_makes_no_pairs(spark):
    df = spark.range(20_000).selectExpr("'c' as corpus", "cast(id as string) as key", "if(id = 7, 'М84', 'M84') as text")
    assert look_alike_pairs(df).count() == 19_999


def _vectors(rnd, n):
    vocabulary = [rnd.getrandbits(62) for _ in range(40)]
    out = set()
    while len(out) < n:
        out.add(tuple(sorted(rnd.sample(vocabulary[: rnd.choice((12, 40))], rnd.randint(1, 12)))))
    return [(i, list(v)) for i, v in enumerate(sorted(out))]


@pytest.mark.parametrize("weighting, threshold", [("unit", 8 / 9), ("unit", 0.6), ("idf", 0.7), ("idf", 0.95)])
def test_cosine_join_equals_brute_force(spark, weighting, threshold):
    rows = _vectors(random.Random(len(weighting)), 400)
    left, right = rows[:250], rows[150:]
    frame = lambda r: spark.createDataFrame(r, "vid long, terms array<long>")
    everything = {i: t for i, t in rows}
    df: dict[int, int] = {}
    for t in everything.values():
        for b in {x & ((1 << overlap.BITS) - 1) for x in t}:
            df[b] = df.get(b, 0) + 1
    weight = lambda x: 1.0 if weighting == "unit" else math.log(1 + len(everything) / df[x & ((1 << overlap.BITS) - 1)])
    norm = {i: math.sqrt(sum(weight(x) ** 2 for x in t)) for i, t in everything.items()}
    want = {}
    for (i, a), (j, b) in itertools.product(left, right):
        cos = sum(weight(x) ** 2 for x in set(a) & set(b)) / (norm[i] * norm[j])
        if cos >= threshold - 1e-9:
            want[i, j] = cos
    got = {(r["l"], r["r"]): r["cosine"] for r in cosine_pairs(frame(left), frame(right), threshold, weighting).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_overlaps_edges(spark):
    base = "alpha beta gamma delta epsilon"
    rows = [
        ("a", base, "Train"), ("b", base.upper() + "!", " test "), ("c", "alpha beta gamma delta", "dev"), ("d", "alpha beta gamma", "val"), ("e", base, None), ("f", None, "train"), ("g", "", "test"), ("h", "...", "train"),
        ("i", "...", "test"), ("a", base, "train"), ("a", base, "test"), ("j", "αlpha", "other"), (None, base, "test"), ("k", "w " + "long" * 50_000, "training"), ("l", "long" * 50_000 + " W", "validation"),
    ]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "id string, text string, split string, vid string, l int, train boolean")
    got = {(r["train_id"], r["eval_id"], r["eval_split"]): round(r["shared"], 6) for r in cross_split_overlaps(df, "id", "text", "split").collect()}
    assert got == {("a", "b", "test"): 1.0, ("a", "c", "validation"): 0.8, ("k", "l", "validation"): 1.0}
    assert cross_split_overlaps(df.limit(0), "id", "text", "split").count() == 0
    with pytest.raises(ValueError):
        cosine_pairs(df, df, 0.5, "other")


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(500):
        w = rnd.sample(vocabulary[: rnd.choice((10, 60))], rnd.randint(3, 10))
        rows.append((f"r{i}", " ".join(w), rnd.choice(["train", "test", "val"])))
    df = spark.createDataFrame(rows, "id string, text string, split string")
    want = set()
    for (i, a, s), (j, b, t) in itertools.product(rows, rows):
        if s == "train" and t != "train":
            x, y = set(a.split()), set(b.split())
            if len(x & y) * 5 >= 4 * len(x | y):
                want.add((i, j))
    assert {(r["train_id"], r["eval_id"]) for r in cross_split_overlaps(df, "id", "text", "split").collect()} == want and want
