import base64
import random

import numpy as np
import pytest
import tiktoken

from dhruva.llm import bpe
from dhruva.llm.chunking import KINDS, LIMIT, OVERLAP, boundaries, cut, split_oversized
from dhruva.llm.encoding import RANKS, encode_corpus, token_counts

SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


def random_texts(seed, n, alphabet="  \n\t\r abcé'stre12३का़ं\x1c\x1f\x85‍\xa0　.!?|漢😀²Ⅷ½一٣   _-"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def test_equals_public_library(reference):
    encoder = bpe.ByteBPE(RANKS)
    texts = random_texts(1, 4_000) + ["a" * 20_000, "का" * 5_000, " " * 999, "\n" * 999, "<|endoftext|>", "x<|endoftext|>y", "don't DON'T we'll", "", "\x00"]
    assert [ids(x) for x in encoder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert encoder.encode([None, ""]) == [b"", b""]


def test_one_by_one_equals_lock_step(reference):
    encoder = bpe.ByteBPE(RANKS)
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"abcdenrst\xe0\xa4\x95\x80") for _ in range(rnd.randint(2, 64))) for _ in range(500)]
    many = encoder.merge_many(words, 64)
    assert [ids(x) for x in many] == [encoder.merge_one(w) for w in words]


def test_cache_that_overflows_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    encoder = bpe.ByteBPE(RANKS)
    for seed in range(5):
        texts = random_texts(seed, 100)
        assert [ids(x) for x in encoder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_encode_corpus_edges(spark, reference):
    rows = [(1, None, "c"), (2, "", "c"), (3, "hello world", "c"), (3, "hello world", "c"), (4, "नमस्ते " * 30_000, "c"), (None, "x", "c"), (5, "<|endoftext|>", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(((i, reference.encode_ordinary(t or "")) for i, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == want
    counts = token_counts(df, ["doc_id", "ids"])
    assert sorted(r["tokens"] for r in counts.collect()) == sorted(len(t) for _, t in want)
    assert encode_corpus(df.limit(0)).count() == 0


def pieces_of(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in split_oversized(df, **more).collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece"]) for k, v in out.items()}


def test_pieces_cover_share_and_fit(spark, reference):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdekhirst") for _ in range(rnd.randint(2, 9)))
    prose = "\n\n".join("\n".join(" ".join(word() for _ in range(30)) + "." for _ in range(4)) for _ in range(40))
    texts = [None, "", "short", prose, "क" * 3_000, "".join(rnd.choice("abcdefgh") for _ in range(9_000)), prose.replace("\n", " ").replace(".", ""), "😀" * 900]
    got = pieces_of(spark, texts)
    assert sorted(got) == [i for i, t in enumerate(texts) if t and len(reference.encode_ordinary(t)) > LIMIT]
    for i, pieces in got.items():
        whole = reference.encode_ordinary(texts[i])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            assert p["tokens"] == whole[p["first_token"] : p["first_token"] + p["n_tokens"]] and 0 < p["n_tokens"] <= LIMIT
            assert p["text"] in texts[i] and len(reference.encode_ordinary(p["text"])) <= LIMIT
        for a, b in zip(pieces, pieces[1:]):
            assert b["first_token"] == a["first_token"] + a["n_tokens"] - OVERLAP and a["tokens"][-OVERLAP:] == b["tokens"][:OVERLAP]
        assert pieces[0]["first_token"] == 0 and pieces[-1]["first_token"] + pieces[-1]["n_tokens"] == len(whole)
    assert {p["cut"] for p in got[3]} <= {"paragraph", "line", "end"}
    assert {p["cut"] for p in got[6]} <= {"word", "end"}


def test_an_edit_moves_only_pieces_around_it(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdekhirst") for _ in range(6)) for _ in range(8_000)]
    changed = words[:1_500] + ["inserted", "words", "here"] + words[1_500:]
    got = pieces_of(spark, [" ".join(words), " ".join(changed)])
    a, b = ({p["text"] for p in got[k]} for k in (0, 1))
    assert len(a - b) <= 4 and len(a & b) >= len(a) // 2


def test_boundaries_and_bad_limits(spark):
    encoder = bpe.load(RANKS)
    text = "One two. Three\nfour\n\nfive"
    tokens = np.frombuffer(encoder.encode([text])[0], "<i4")
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(encoder.token_bytes[tokens])))
    kinds = {int(e): KINDS[k] for e, k in zip(ends, boundaries(text, ends))}
    assert kinds[8] == "sentence" and kinds[15] == "line" and kinds[21] == "paragraph" and kinds[3] == "word"
    quoted = "He left.”\u00a0Then!') no.x  \r\n\t\r\nend।"
    every = boundaries(quoted, np.arange(len(quoted.encode()) + 1))
    offset = lambda part: len(quoted[: quoted.index(part)].encode())
    assert [KINDS[every[k]] for k in (offset("\u00a0"), offset(" no"), offset("x"), offset("\t"), offset("end"), len(every) - 1)] == ["sentence", "sentence", "character", "line", "paragraph", "sentence"]
    assert cut(tokens, boundaries(text, ends)) == [(0, len(tokens), 6)]
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], "doc_id long, text string"), limit=100, overlap=50)
