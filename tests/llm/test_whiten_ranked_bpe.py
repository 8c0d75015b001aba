"""Whitening, ranked search and byte pairs against plain versions, and on odd and empty tables."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from verdict.llm import bpe, queries, ranked, whiten
from verdict.llm.queries import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Whitening


def plain_whitening(vectors, k):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    return deviation, centred @ components[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(700, 40)) * np.geomspace(1, 40, 40) + 7).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = whiten.whiten(df).toPandas().sort_values(["vec_id", "component"])
    deviation, whitened, explained = plain_whitening(v.astype(float), 32)
    assert len(got) == 700 * 32
    assert got["deviation"].tolist() == np.repeat(np.array(deviation), 32).tolist()
    mine = got["whitened"].to_numpy().reshape(700, 32)
    mine = mine * np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine - whitened).max() < 1e-8
    assert np.abs(got["explained"].to_numpy()[:32] / explained - 1).max() < 1e-10
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9 and set(got["n"]) == {700}


def test_whitening_of_flat_dimensions(spark):
    """Dimensions that are constant or sums of others have no component."""
    rng = np.random.default_rng(6)
    a = rng.integers(-50, 50, size=(200, 3))
    rows = [(i, [float(x), float(y), float(z), 3.0, float(x + y)]) for i, (x, y, z) in enumerate(a.tolist())]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got["component"].max() == 3 and len(got) == 600
    assert got["identity_error"].iloc[0] < 1e-8
    assert abs(got[got["vec_id"] == 0]["explained"].sum() - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as n", "4 as component")
    got = whiten.whiten(df).toPandas()
    assert sorted(got["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 1, 1, 8, 8] and set(got["n"]) == {4}
    for empty in (df.limit(0), df.filter("vec_id = 1"), df.filter("vec_id = 2")):
        assert whiten.whiten(empty).count() == 0
    far = whiten.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["deviation"]) for r in far) == [(1, None), (2, None), (3, 0)]


def test_deviations_beyond_long(spark):
    middle = whiten.Centre(4, [0, 0])
    got = middle.deviations(np.array([[1, 2], [1 << 29, 0], [1 << 40, 0]])).to_pylist()
    assert got == [16 * 5, 16 << 58, None]


def test_whitening_query(spark, sf_dir):
    got = queries.op11_whitening(spark, sf_dir).toPandas()
    vectors = [r["embedding"] for r in table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()]
    deviation, whitened, explained = plain_whitening(vectors, 32)
    got = got.sort_values(["vec_id", "component"])
    assert got["deviation"].tolist() == np.repeat(np.array(deviation), 32).tolist()
    mine = got["whitened"].to_numpy().reshape(-1, 32)
    assert np.abs(np.abs((mine * whitened).mean(axis=0)) - 1).max() < 1e-6
    assert got["identity_error"].iloc[0] < 1e-9


# Ranked search


def plain_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in found]


def plain_ranking(docs, items, k=20):
    bags = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    bags = [b for b in bags if b[1]]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, b in bags:
            m = 75 + (25 * sum(b.values()) * n_docs) // total
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in plain_terms(text) if t in b)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("salted", [False, True])
def test_search_matches_all_scores(spark, monkeypatch, salted):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Größe", "ß", "naïve", "X1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(600)]
    docs += [(1000 + i, docs[3][1]) for i in range(50)] + [(7, docs[9][1]), (None, "w1 w2"), (None, None), (2000, " .,-")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(30)] + [(3, "w1 w1 w5"), (50, None), (51, "none here"), (None, "w3")]
    for name, value in {"SHARD": 3_000, "MOST": 40, "ITEMS": 8, "SEEDS": 2, "STEP": 3, **({"BROADCAST": 0, "SALTS": 3} if salted else {})}.items():
        monkeypatch.setattr(ranked, name, value)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(ranked.search(ranked.index(df), spark.createDataFrame(items, "item_id long, text string"))) == plain_ranking(docs, items)


def test_search_of_odd_and_empty_tables(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "the quick brown fox"), (2, "der die das"), (2, ""), (4, "x" * 150_000)]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "2 as term", "3 as shard", "4 as times")
    assert found(ranked.search(ranked.index(odd_docs), asked)) == plain_ranking(docs, items)
    assert ranked.search(ranked.index(odd_docs.limit(0)), asked).count() == 0
    assert ranked.search(ranked.index(odd_docs), asked.limit(0)).count() == 0


def test_intervals_are_pruned():
    """Where few documents hold the terms, few intervals are bounded."""
    n = 4096
    docs = np.concatenate([np.arange(0, n, 64), np.arange(5, n, 512)])
    lists = ranked.Lists(np.array([0, n // 64, len(docs)]), docs, np.arange(len(docs)) % 7 + np.repeat([1, 100], [n // 64, n // 512]), n)
    seen = []
    plain = lists.greatest
    lists.greatest = lambda *a: seen.append(len(a[1])) or plain(*a)
    got = lists.search(np.array([0, 1]), np.array([1, 2]), 3, 1)
    assert sorted(got[1].tolist())[-1] >= 200 and sum(seen) < 200


# Byte pairs


def odd_texts():
    rng = random.Random(1)
    one = ["  ", "\n", "\t", "'s", "'", "'ll", "re", "x", "é", "1", "²", "!", "　", "\x85", "\x1c", "a", " "]
    texts = [None, "", " ", "  \n\n  a", "a  's", "a   're b", "<|endoftext|>", "x" * 30_000, "ab" * 900, "aaaa" * 40 + "b" * 77 + "é" * 100]
    texts += ["".join(rng.choice("ACGT") for _ in range(3_000)), "".join(chr(rng.randrange(1, 0xD800)) for _ in range(2_000))]
    texts += ["".join(rng.choice(one) for _ in range(rng.randrange(30))) for _ in range(1_500)]
    return texts + ["".join(rng.choice("aetion") for _ in range(rng.randrange(1, 700))) for _ in range(150)]


def test_pieces_and_merges_match_the_library(library):
    own, texts = bpe.Coder(RANKS, PATTERN), odd_texts()
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t or "") for t in texts]
    assert own.decode(ids) == [(t or "").encode() for t in texts]
    assert own.encode([]) == [] and own.decode([]) == []
    with pytest.raises(ValueError):
        own.decode([np.array([50_256])])


def test_other_patterns_and_strides(library, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 1_000)
    monkeypatch.setattr(bpe, "KNOWN", 40)
    monkeypatch.setattr(bpe, "TOKENS", 97)
    other = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    plain = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    texts = odd_texts()[-400:] + ["ACGTTGCA" * 60]
    for pattern, library_ in ((PATTERN, library), (other, plain)):
        own = bpe.Coder(RANKS, pattern)
        ids = own.encode(texts)
        assert [x.tolist() for x in ids] == [library_.encode_ordinary(t) for t in texts]
        assert own.decode(ids) == [t.encode() for t in texts]


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_pair_query(spark, sf_dir, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_byte_pairs(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: digests(library, r["text"]) for r in docs}


def test_byte_pairs_of_odd_tables(spark, odd_docs, library):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = Counter(tuple(r) for r in bpe.round_trip(odd_docs, RANKS, PATTERN).collect())
    assert got == Counter((i, *digests(library, t)) for i, t in docs)
    tokens = bpe.encode(odd_docs, RANKS, PATTERN)
    texts = bpe.decode(tokens.withColumn("text", F.lit(1)), RANKS, PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["text"])) for r in texts) == Counter((i, (t or "").encode()) for i, t in docs)
    assert bpe.round_trip(odd_docs.limit(0), RANKS, PATTERN).count() == 0
