import itertools
import random

import pytest
from pyspark.sql import functions as F

from dhruva.llm import canonical_names
from dhruva.llm.canonical_names import _vocabulary, map_values, osa, osa_many, skeleton
from dhruva.llm.grouped_splits import assign_splits, components, family_key
from dhruva.llm.mixing import _fill, choose, mix_sources
from dhruva.llm.overlap import split_name
from tests.llm.brute import all_scores

RATIOS = {"train": 0.7, "validation": 0.12, "test": 0.18}


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, shape):
    rnd = random.Random(1)
    name = lambda i: f"n{i:04d}"
    edges = {"random": [(name(rnd.randrange(300)), name(rnd.randrange(300))) for _ in range(200)], "path": [(name(i * 37 % 101), name((i + 1) * 37 % 101)) for i in range(100)], "star": [(name(50), name(i)) for i in range(100)]}[shape]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == union_find(edges)


def test_related_records_stay_together_in_given_shares(spark):
    rnd = random.Random(2)
    rows = [(i, f"a{rnd.randrange(3_000)}" if rnd.random() < 0.9 else None, f"s{rnd.randrange(9_000)}" if rnd.random() < 0.2 else None, "x") for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, author string, source string, split string")
    out = assign_splits(df, ["author", "source"], RATIOS, row_key="id")
    got = out.records.select("id", "author", "source", "component", "split").collect()
    assert len(got) == len(rows) and out.quarantine.count() == 0
    for key in ("author", "source"):
        seen = {}
        for r in got:
            if r[key] is not None:
                assert seen.setdefault(r[key], r["split"]) == r["split"]
    shares = {s: sum(r["split"] == s for r in got) / len(got) for s in RATIOS}
    big = max(sum(1 for _ in g) for _, g in itertools.groupby(sorted(r["component"] for r in got)))
    assert all(abs(shares[s] - RATIOS[s]) < 0.02 + (big / len(got) if big / len(got) > 0.1 else 0) for s in RATIOS)
    # A second batch keeps what is placed and puts the rest anew.
    more = spark.createDataFrame([(20_000 + i, f"a{i}", None, "x") for i in range(3_500)], df.schema)
    again = assign_splits(more, ["author", "source"], RATIOS, state=out.state, row_key="id")
    before = {r["author"]: r["split"] for r in got if r["author"]}
    assert all(before.get(r["author"], r["split"]) == r["split"] for r in again.records.collect())


def test_conflicting_merges(spark):
    state = spark.createDataFrame([("k=a", "1", "train"), ("k=b", "2", "test"), ("k=c", "3", "train")], "node string, component string, split string")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None), (4, None, None), (4, None, None)], "id long, k string, other string")
    out = assign_splits(df, ["k", "other"], RATIOS, state=state, row_key="id")
    got = {r["id"]: r["split"] for r in out.records.collect()}
    assert got[1] is None and got[2] is None and got[3] == "train" and got[4] in RATIOS and out.records.count() == 5
    assert {r["node"] for r in out.quarantine.collect()} == {"k=a", "k=b", "other=x"}
    assert [tuple(r["splits"]) for r in out.quarantine.limit(1).collect()] == [("test", "train")]
    whole = assign_splits(df, ["k", "other"], RATIOS, state=state, row_key="id", conflicts="reassign").records
    assert len({r["split"] for r in whole.where("other = 'x'").collect()}) == 1 and whole.where("split is null").count() == 0
    assert assign_splits(df.limit(0), ["k"], RATIOS).records.count() == 0
    with pytest.raises(ValueError):
        assign_splits(df, ["k"], RATIOS, conflicts="other")


def test_family_and_split_names(spark):
    df = spark.createDataFrame([(" Route_Query : 007 ", "x"), ("7", " Ticketing"), ("7", None), (None, "x"), ("x", "y"), ("a:0", "y")], "f string, i string")
    assert [r[0] for r in df.select(family_key("f", "i")).collect()] == ["route_query:7", "ticketing:7", None, None, None, "a:0"]
    s = spark.createDataFrame([(" TRAIN",), ("training",), ("Dev ",), ("val ",), ("test",), ("holdout",), (None,)], "s string")
    assert [r[0] for r in s.select(split_name("s")).collect()] == ["train", "train", "validation", "validation", "test", None, None]


REF = [
    (1, "Bitajavu Bridge", ["बितजवु ब्रिज", "BIB"]), (2, "Bitajavu Railway Station", None), (3, "Kelurupet", []), (4, "Malochupet Bridge", ["Malo Bridge"]), (5, "Rokhadogarh Bridge", ["ROB", "R​OB"]),
    (6, "Retolunur Market", ["ROB"]), (7, None, ["x"]), (None, "Ghost", []), (8, "Dhamuka Market", ["धमुक मार्केट"]), (9, "Gapatha Market", []), (10, "Hetapapet Railway Station", []), (11, "Jitudho Railway Station", []),
]


def test_map_values(spark):
    want = {
        "Bitajavu Bridge": 1, "bridge, BITAJAVU": 1, "beetajaavu brdg": 1, "बितजवु ब्रिज": 1, "बितजवु bridge": 1, "near Bitajavu Bridge gate no 2": 1, "Вitаjavu Вridge": 1, "bitajavubridge": 1, "b.i.b.": 1, "bib": 1,
        "bita javu bridge": 1, "Bitajavu rly stn": 2, "bitajavu": None, "Bitajavu Market": None, "kelurupet": 3, "Kelruupet": 3, "kelurupet ke paas": 3, "kelu rupet": 3, "rob": None, "rokhadogarh": 5, "": None, "  ": None, "?": None, "bridge": None,
        "unknown stop": None, "0000": None, "धमुक मार्केट": 8, "Gapatha mkt": 9, "Rokhadogarh Bridge Rokhadogarh Bridge": 5, "x " * 3_000: None,
    }
    df = spark.createDataFrame([(v, 1, "e") for v in [*want, "kelurupet", None]], "value string, entry_id int, unit string")
    ref = spark.createDataFrame(REF, "entry_id long, canonical_name string, aliases array<string>")
    got = {r["value"]: r["entry_id"] for r in map_values(df, ref).collect()}
    assert got == want
    assert {r["entry_id"] for r in map_values(df, ref.limit(0)).collect()} == {None}
    assert map_values(df.limit(0), ref).count() == 0


def test_entries_are_ranked_without_their_rarest_word(spark):
    ref = spark.createDataFrame([(1, "Zorbex Lake Garden", None), (2, "Lake View", None), (3, "Garden Row", None), (4, "Tamarindseedprocessingworkshop", None), (5, "Abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz Hall", None)], "entry_id long, canonical_name string, aliases array<string>")
    want = {
        "Lake Garden": 1, "lake": None, "Tamarindseedprocesingworkshop": 4, "Tamarindseedprocesisngworkshop": 4, "Tamarindseedproecssignworkshop": 4, "Tamarindsedprocesingworkshop": 4, "Tamarinseedpocesingworkshop": 4, "Tmrinseedprocesingworkop": None,
        "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyabcdefghijklmnopqrstuvwxyz hall": 5, "z" * 100_000: None,
    }
    got = {r["value"]: r["entry_id"] for r in map_values(spark.createDataFrame([(v,) for v in want], "value string"), ref).collect()}
    assert got == want


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_map_values_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(canonical_names, "BROADCAST_ROWS", bound)
    rnd = random.Random(8)
    pool = ["".join(rnd.choice("aeiou") if i % 2 else rnd.choice("bdgklmnprst") for i in range(rnd.randint(3, 9))) for _ in range(30)]
    names = {" ".join(rnd.sample(pool[:6], 1) + rnd.sample(pool, rnd.randint(0, 3))) for _ in range(60)}
    ref = spark.createDataFrame([(i, n, [n.replace(" ", ""), "".join(w[0] for w in n.split())]) for i, n in enumerate(sorted(names))], "entry_id long, canonical_name string, aliases array<string>")

    def slip(w):
        for _ in range(rnd.choice((0, 0, 1, 2))):
            i = rnd.randrange(len(w))
            w = rnd.choice((w[:i] + w[i + 1 :], w[:i] + rnd.choice("aeioubdg") + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :])) or w
        return w

    values = set()
    for n in sorted(names) * 3:
        w = [slip(x) for x in n.split()]
        rnd.shuffle(w)
        values.add(" ".join(w[: rnd.randint(1, len(w))] + rnd.sample([*pool, "near", "7"], rnd.choice((0, 0, 1)))))
    got = {r["value"]: (r["entry_id"], r["fits"]) for r in map_values(spark.createDataFrame([(v,) for v in values], "value string"), ref).collect()}
    forms, entries = _vocabulary(ref, "entry_id", "canonical_name", "aliases")
    want = all_scores(values, forms.collect(), entries.collect())
    assert got == want and sum(e is not None for e, _ in want.values()) > 50 and any(n > 1 for _, n in want.values())


def test_words_alike():
    words = ["".join(random.Random(i).choices("abc", k=i % 9)) for i in range(400)] + ["x" * 3_000, "x" * 2_999 + "y", ""]
    others = words[7:] + words[:7]
    assert osa_many(words, others).tolist() == [osa(a, b, 2) for a, b in zip(words, others)]
    assert skeleton("गिमोरिक्कम") == skeleton("gimorikkam") == skeleton("Geemorikkaam".lower())
    assert osa("abcd", "abdc", 2) == 1 and osa("abcd", "ab", 1) == 2 and osa("", "", 0) == 0


def test_mix(spark):
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choice(["stop", "bus", "metro", "gate"]) for _ in range(rnd.randint(5, 60)))
    rows = [(i, s, text()) for i, s in enumerate(["a"] * 900 + ["b"] * 150 + ["c"] * 20 + ["other"] * 50 + [None] * 10)] + [(9_000, "a", None), (9_001, "a", ""), (0, "a", rnd)]
    rows = [(i, s, t if not isinstance(t, random.Random) else rows[0][2]) for i, s, t in rows]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, tokens int")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("d", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    total = 20_000
    mix = mix_sources(docs, goals, total=total)
    shares = {r["source"]: r for r in mix.shares.collect()}
    assert shares["a"]["status"] == shares["b"]["status"] == "met" and shares["c"]["status"] == "too_small" and shares["d"]["status"] == "absent" and shares["other"]["status"] == "no_target"
    assert abs(shares["a"]["share_of_target_total"] - 0.5) < 0.01 and abs(shares["b"]["share_of_target_total"] - 0.3) < 0.01
    chosen = mix.selection.collect()
    assert len({r["id"] for r in chosen}) == len(chosen)
    most = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r["copies"] <= most[r["source"]] for r in chosen)
    assert {r["copies"] for r in chosen if r["source"] == "c"} == {2} and sum(r["source"] == "c" for r in chosen) == 20
    assert not {9_000, 9_001} & {r["id"] for r in chosen}
    again = mix_sources(docs, goals, total=total).selection.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))
    assert sorted(map(tuple, mix_sources(docs, goals, total=total, seed=2).selection.collect())) != sorted(map(tuple, chosen))
    default = mix_sources(docs, goals).shares.where("source in ('a', 'b')").collect()
    assert all(abs(r["share_of_target_total"] - r["target_share"]) < 0.01 for r in default)
    # No source passes its share, and one that is short has no document that would still fit.
    for r in mix.shares.where("target_share > 0").collect():
        assert r["selected_tokens"] <= r["target_share"] * total + 1e-6
    twice = spark.createDataFrame([(1, "a", "bus stop"), (1, None, None), (1, "a", "bus"), (2, "a", "metro gate"), (None, "a", "gate")], "doc_id long, source string, text string")
    assert {r["id"]: r["copies"] for r in mix_sources(twice, goals.where("source = 'a'"), total=100).selection.collect()} == {1: 1, 2: 1}
    empty = mix_sources(docs.limit(0), goals)
    assert empty.selection.count() == 0 and {r["status"] for r in empty.shares.where("target_share > 0 and source is not null").collect()} == {"absent"}


def test_choice_of_sizes():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 8))]
        budget, enough = rnd.randint(0, 120), rnd.choice((0, 3))
        sums = [sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n)]
        best = max(x for x in sums if x <= budget)
        got = sum(sizes[i] for i in choose(sizes, budget, enough))
        assert got <= budget and (got >= budget - enough or got == best)
    assert sum([10**9, 3 * 10**9][i] for i in choose([10**9, 3 * 10**9], 3 * 10**9 + 5, 10**7)) == 3 * 10**9


def test_filling_follows_the_ranking(spark):
    rnd = random.Random(9)
    rows = [(i, s, rnd.choice((1, 2, 5, 9, 30, 400)), {"a": 5_000.0, "b": 77.0, "c": 3.0}[s], rnd.random()) for i in range(900) for s in ("a" if i % 3 else "b", "c")]
    rows = [(10 * i + "abc".index(s), s, t, rest, q) for i, s, t, rest, q in rows]
    drawn = spark.createDataFrame(rows, "id long, source string, tokens long, rest double, q double")
    got = {r["id"] for r in _fill(drawn, {s: (b, b) for s, b in (("a", 5_000.0), ("b", 77.0), ("c", 3.0))}).collect()}
    want, left = set(), {"a": 5_000, "b": 77, "c": 3}
    for i, s, t, _, q in sorted(rows, key=lambda r: (r[4], r[0])):
        if t <= left[s]:
            left[s] -= t
            want.add(i)
    assert got == want
