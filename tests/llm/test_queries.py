"""Every query over its whole tables at the smallest scale, against SQL, brute force or the public library."""

import itertools
from collections import Counter, defaultdict

import pytest

from dhruva.llm import confusables, queries
from dhruva.llm.canonical_names import _vocabulary
from dhruva.llm.grouped_splits import family_key
from dhruva.llm.overlap import split_name
from tests.compare import connect, same
from tests.llm.brute import all_scores, groups


@pytest.fixture
def run(spark, sf):
    return lambda name: queries.QUERIES[name](spark, sf).collect()


@pytest.fixture
def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture
def shapes(spark, monkeypatch):
    monkeypatch.setattr(confusables, "_in_use", confusables.latin_shapes(spark))


@pytest.fixture(scope="module")
def sizes(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


def test_typed_names(spark, run, table, shapes):
    forms, entries = (x.collect() for x in _vocabulary(table("reviewed_name_aliases_v1"), "entry_id", "canonical_name", "aliases"))
    typed = {(r["id"], i): v for r in table("chennai_case_study").collect() if r["id"] is not None for i, v in enumerate(r["aliases"] or ())}
    means = all_scores({v for v in typed.values() if v is not None}, forms, entries)
    want = {(*k, means[v][0] if v is not None and means[v][0] is not None else -1) for k, v in typed.items()}
    assert {tuple(r) for r in run("p1_found")} == want
    times = Counter(v for v in typed.values() if v is None or means[v][0] is None)
    assert {r["value"]: (r["typed"], r["fits"]) for r in run("p1_unmatched")} == {v: (n, means[v][1] if v is not None else 0) for v, n in times.items()}


def test_look_alikes(run, table, shapes):
    texts = defaultdict(set)
    for r in table("hindi_intents").select("id", "text").collect():
        texts["intents", r["id"]].add(r["text"])
    for name, key in (("station_aliases", "station_key"), ("reviewed_name_aliases_v1", "entry_id")):
        for r in table(name).collect():
            for i, a in enumerate(r["aliases"] or ()):
                texts["aliases", f"{name}/{r[key]}/{i}"].add(a)
    forms = defaultdict(set)
    for (corpus, key), all_ in texts.items():
        for t in all_:
            if key is not None and t is not None:
                forms[corpus, confusables.one_form(t)].add((key, t))
    want = {(c, *sorted((a, b))) for (c, _), keys in forms.items() for (a, s), (b, t) in itertools.combinations(keys, 2) if s != t and a != b}
    assert {tuple(r) for r in run("p2_found")} == want and want
    classes = {(c, k): (min(x for x, _ in keys), len({t for _, t in keys}), len({x for x, _ in keys})) for (c, _), keys in forms.items() if len({t for _, t in keys}) > 1 for k, _ in keys}
    assert {(r["corpus"], r["key"]): (r["class"], r["texts"], r["keys"]) for r in run("p2_classes")} == classes


def test_splits(run, table):
    rows = run("p3_splits")
    assert len(rows) == table("hindi_intents").count() and all(r["split"] in queries.RATIOS for r in rows)
    recorded, given = defaultdict(set), defaultdict(set)
    for r in rows:
        if r["family"]:
            given[r["family"]].add(r["split"])
            if r["recorded"]:
                recorded[r["family"]].add(r["recorded"])
    assert all(len(s) == 1 for s in given.values())
    assert all(given[f] == s for f, s in recorded.items() if len(s) == 1)
    largest = max(Counter(r["family"] for r in rows if r["family"]).values()) / len(rows)
    shares = Counter(r["split"] for r in rows)
    assert all(abs(shares[s] / len(rows) - x) < 0.02 + largest for s, x in queries.RATIOS.items())


def test_splits_of_a_second_batch(run):
    rows = run("p3_batches")
    assert {r["batch"] for r in rows} == {1, 2} and all(r["split"] or r["batch"] == 2 for r in rows)
    first, every = (groups([((n, r["id"]), r["family"], r["twin"]) for n, r in enumerate(rows) if r["batch"] <= upto]) for upto in (1, 2))
    splits, before = defaultdict(set), defaultdict(set)
    for n, r in enumerate(rows):
        key = n, r["id"]
        if r["batch"] == 1:
            splits[first[key]].add(r["split"])
            before[every[key]].add(r["split"])
    assert all(len(s) == 1 for s in splits.values())
    # What joins components of different splits is quarantined, everything else goes with what was there.
    seen = {}
    for n, r in enumerate(rows):
        if r["batch"] == 2:
            known = before[every[n, r["id"]]]
            assert (r["split"] is None) == (len(known) > 1)
            assert r["split"] is None or seen.setdefault(every[n, r["id"]], r["split"]) == r["split"] and (not known or known == {r["split"]})


def test_overlaps(run, table, shapes):
    rows = [(r["id"], set(confusables.words(r["text"])), r["s"], r["source"]) for r in table("hindi_intents").withColumn("s", split_name("split")).collect() if r["id"] and r["s"]]
    train, evals = [r for r in rows if r[2] == "train" and r[1]], [r for r in rows if r[2] != "train" and r[1]]
    hits = {(a, b, t, len(x & y) / len(x | y)) for a, x, _, _ in train for b, y, t, _ in evals if a != b and 5 * len(x & y) >= 4 * len(x | y)}
    assert {tuple(r) for r in run("p5_found")} == {tuple(sorted((a, b))) for a, b, _, _ in hits} and hits
    want = defaultdict(lambda: [0, 0, 0])
    for b, t in {(b, t) for _, b, t, _ in hits}:
        of = [x for a, c, s, x in hits if (c, s) == (b, t)]
        for source in {r[3] for r in rows if r[0] == b}:
            n = want[t, source]
            n[0], n[1], n[2] = n[0] + 1, n[1] + len(of), n[2] + (max(of) == 1)
    assert {(r["split"], r["source"]): [r["questions"], r["links"], r["exact"]] for r in run("p5_report")} == dict(want)


def test_ids_of_every_document(run, sizes):
    assert {r["doc_id"]: r["ids"] for r in run("p7_ids")} == sizes
    assert {r["doc_id"] for r in run("p9_found")} == {k for k, v in sizes.items() if len(v) > 1_000}


def test_mix(run, table, sizes):
    source = {r["doc_id"]: r["source"] for r in table("documents").select("doc_id", "source").collect()}
    goals = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table("mix_targets").collect()}
    held = {s: sum(len(sizes[d]) for d, x in source.items() if x == s) for s in goals}
    total = max(min(held[s] * n / x for s, (x, n) in goals.items() if held[s]), 0.5 * sum(held.values()))
    chosen = run("p8_mix")
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    got = Counter()
    for r in chosen:
        assert r["tokens"] == len(sizes[r["doc_id"]]) > 0 and source[r["doc_id"]] == r["source"] and 1 <= r["copies"] <= goals[r["source"]][1]
        got[r["source"]] += r["tokens"] * r["copies"]
    shares = {r["source"]: r for r in run("p8_shares")}
    assert shares.keys() == goals.keys() | set(source.values())
    for s, (x, n) in goals.items():
        want = x * total
        assert got[s] == shares[s]["selected_tokens"] <= want + 1e-6
        status = "absent" if not held[s] else "too_small" if held[s] * n < want - 0.5 else "met" if want - got[s] <= max(1, 0.005 * want) else "documents_too_large"
        assert shares[s]["status"] == status
        if status == "documents_too_large":
            # A document with a copy left that would still fit has not been passed over.
            used = {r["doc_id"]: r["copies"] for r in chosen}
            whole = int(min(want, held[s] * n) // held[s])
            assert not any(used.get(d, 0) <= whole and used.get(d, 0) < n and 0 < len(sizes[d]) <= want - got[s] for d, y in source.items() if y == s)


def test_pieces(run, sizes):
    pieces = defaultdict(list)
    for r in run("p9_pieces"):
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == {k for k, v in sizes.items() if len(v) > 1_000}
    for doc, rows in pieces.items():
        rows.sort(key=lambda r: r["piece"])
        ids, end = sizes[doc], 0
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        for r in rows:
            first, n = r["first_token"], r["n_tokens"]
            assert n == len(r["tokens"]) <= 1_000 and r["tokens"] == ids[first : first + n] and first == max(0, end - 50)
            end = first + n
        assert end == len(ids)


def test_families_in_every_spelling(table):
    rows = table("hindi_intents").select("family_id", family_key("family_id", "intent").alias("k")).where("k is not null").collect()
    assert all(":" in r["k"] and not r["k"].split(":")[1].startswith("0") or r["k"].endswith(":0") for r in rows) and rows
