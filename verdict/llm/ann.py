"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Fit: a bounded sample (``SAMPLE`` distinct vectors, those of least hash) gives the mean and
``ROTATIONS`` learned rotations, each an iterative quantization from another random start. The
signs of the rotated vectors are the code. The Hamming radius is the quantile ``COVER`` of the
distances between vectors of the sample and their nearest others in it. In the whole table
the nearest lie closer than in a sample, so the radius errs to the wide side.

Search: equal vectors are one entry that carries its least ids, as many as a result can need.
Every entry is indexed. Entries and queries are cut into blocks by a hash, and each pair of
blocks is one task of bounded size: codes are split into 8-bit substrings, each with a table of
postings. Two codes within r of each other agree, in one of m substrings, up to
r // m bits (and in one of the first r % m + 1, else up to one bit less), so probing these
neighbours of every substring misses no code within the radius. Found codes are checked at full
length, and those within the radius are ranked by exact cosine. A query with too few codes in
the radius takes its nearest codes of the block beyond it. Best results of the blocks are merged
by a windowed rank per query. On data without structure, where even nearest neighbours lie at
a third of the code length, probing visits most of a block; then the code filter does the work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import stored

SAMPLE = 8_000
ROTATIONS = 4
ROUNDS = 30
COVER = 0.98
#: Entries, and queries, of a block.
BLOCK = 16_384

_NEAR8 = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Coder:
    """Mean and rotations of the codes, and the radius to search."""

    def __init__(self, mean: np.ndarray, rotations: np.ndarray, radius: int):
        self.mean, self.rotations, self.radius = mean, rotations, radius

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotations > 0, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, k: int) -> Coder:
    """A coder for unit vectors, from a sample of them."""
    mean = sample.mean(axis=0)
    x = sample - mean
    rng = np.random.default_rng(7)
    rotations = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ v
        rotations.append(r)
    coder = Coder(mean, np.concatenate(rotations, axis=1), 0)
    probes = sample[:500]
    scores = probes @ sample.T
    scores[np.arange(len(probes)), np.arange(len(probes))] = -2
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    codes = coder.codes(sample)
    distances = np.bitwise_count(codes[: len(probes), None, :] ^ codes[near]).sum(axis=2, dtype=np.int64)
    coder.radius = int(np.quantile(distances, COVER)) if distances.size else codes.shape[1] * 8
    return coder


class Postings:
    """For each substring of the codes, entries ordered by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.starts = np.stack([np.searchsorted(np.sort(column), np.arange(257)) for column in codes.T])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every entry whose code is at most radius away, by the pigeonhole principle."""
        m = self.codes.shape[1]
        reach, extra = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            most = reach if j <= extra else reach - 1
            if most < 0:
                break
            values = np.flatnonzero(_NEAR8[code[j]] <= most)
            a, b = self.starts[j][values], self.starts[j][values + 1]
            sizes = b - a
            at = np.repeat(a - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            seen[self.order[at, j]] = True
            if seen.all():
                break
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64) <= radius]

    def nearest(self, code: np.ndarray, k: int) -> np.ndarray:
        away = np.bitwise_count(self.codes ^ code).sum(axis=1, dtype=np.int64)
        return np.flatnonzero(away <= np.partition(away, k - 1)[k - 1]) if len(away) > k else np.arange(len(away))


def distinct_vectors(embeddings: DataFrame, keep: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(v, ids, n): valid vectors as doubles, their least ``keep`` ids, and how many they are.

    Vectors that are null, empty, all zero, or hold null or non-finite components are left out,
    and so are rows without id. Ids are cut to the least ones inside every task before the shuffle.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))

    def first(frames):
        for pdf in frames:
            keys = pdf["v"].map(lambda x: np.asarray(x).tobytes())
            groups = pdf.assign(k=keys).groupby("k", sort=False)
            ids = groups["id"].agg(lambda s: sorted(set(s))[:keep])
            yield pd.DataFrame({"v": groups["v"].first().to_numpy(), "ids": ids.to_numpy(), "n": groups.size().to_numpy()})

    local = rows.mapInPandas(first, "v array<double>, ids array<bigint>, n long")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return local.groupBy("v").agg(least.alias("ids"), F.sum("n").alias("n"))


def sample_of(entries: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` unit vectors, those of least hash."""
    rows = entries.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(most).toPandas()
    return unit(np.stack(rows["v"].to_numpy())) if len(rows) else np.empty((0, 1))


def nearest(embeddings: DataFrame, is_query, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets is_query, the k rows of greatest cosine.

    The row itself is no candidate. Ties go to the smaller id. With fewer candidates all are
    returned. Invalid vectors (see distinct_vectors) neither ask nor answer; repeated rows of
    one id count once. All vectors must have one length. Other columns are not read. An empty
    table gives an empty result.
    """
    spark = embeddings.sparkSession
    entries = stored(distinct_vectors(embeddings, k + 1, vector, key), "entries")
    sample = sample_of(entries, SAMPLE)
    coder = spark.sparkContext.broadcast(fit(sample, k) if len(sample) else None)
    asked = stored(
        distinct_queries(embeddings.filter(is_query), vector, key), "queries"
    )
    blocks, parts = (max(1, -(-df.count() // BLOCK)) for df in (entries, asked))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    left = entries.select(deal(blocks, "v").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "v", "ids")
    right = asked.select(deal(parts, "id").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")

    def search(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(found) and len(wanted):
            fitted = coder.value
            x, q = np.stack(found["v"].to_numpy()), np.stack(wanted["v"].to_numpy())
            ids, norms = found["ids"].to_list(), np.linalg.norm(x, axis=1)
            postings, codes = Postings(fitted.codes(x / norms[:, None])), fitted.codes(unit(q))
            for one, code, vec in zip(wanted["id"].to_list(), codes, q, strict=True):
                near = postings.within(code, fitted.radius)
                if len(near) <= k:
                    near = postings.nearest(code, k + 1)
                scores = (x[near] @ vec) / (norms[near] * np.linalg.norm(vec))
                if len(near) > k + 1:
                    cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    near, scores = near[scores >= cut], scores[scores >= cut]
                best = sorted((-s, i) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for i in ids[n] if i != one)[:k]
                out["query_id"] += [one] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [-s for s, _ in best]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    by = ("block", "part")
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)")
    return hits.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct_queries(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v) of valid query rows, one for each id."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    return valid.filter(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["id"])
