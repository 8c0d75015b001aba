"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are learned on a bounded sample. A pair of
centroids is a cell of their product grid, and every vector lies in one cell. From a vector the
cells are visited in the order of the multi-sequence: by the sum of both squared distances. How
many have to be visited is learned: vectors of the sample are moved, in random directions, to
exactly the threshold cosine, and the number of cells is the quantile ``RECALL`` of the place
at which the moved vector's cell comes up. Pairs closer than the threshold need fewer.

Every vector goes to its own cell as a member and to the visited cells as a visitor, and the pairs
of a cell are verified by exact cosine in blocks. Only counts leave a block, and as many edges
as it has vectors: those of a spanning forest of its links. Large cells are cut into blocks,
so no task holds a hot cell whole. Equal vectors are one entry with a count. A pair found from
one side only counts for both.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.ann import distinct_vectors, sample_of, unit
from verdict.llm.common import components, stored

SAMPLE = 8_000
RECALL = 0.9995
#: Vectors a cell should hold on average, and those of a block.
CELL = 128
BLOCK = 2_048
#: Centroids of a half at most; cells beyond their square grow instead.
MOST_CENTROIDS = 256


def lloyd(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(11)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin(distances(x, centers), axis=1)
        for j in range(k):
            if (own == j).any():
                centers[j] = x[own == j].mean(axis=0)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :], 0)


def multi_sequence(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cells (i, j) in the order of a[i] + b[j]; the heap only ever holds the border of those visited."""
    p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, out, border = [(a[p[0]] + b[q[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((int(p[i]), int(q[j])))
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(p) and n[1] < len(q) and n not in border:
                border.add(n)
                heapq.heappush(heap, (a[p[n[0]]] + b[q[n[1]]], *n))
    return out


class Grid:
    """Codebooks of both halves and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float):
        half = sample.shape[1] // 2
        k = int(np.clip(round((rows / CELL) ** 0.5), 1, min(MOST_CENTROIDS, len(sample))))
        self.half, self.k, self.cells = half, k, 1
        self.left, self.right = lloyd(sample[:, :half].copy(), k), lloyd(sample[:, half:].copy(), k)
        probes = sample[:2_000]
        rng = np.random.default_rng(13)
        aside = rng.normal(size=probes.shape)
        aside = unit(aside - (aside * probes).sum(axis=1)[:, None] * probes)
        moved = threshold * probes + (1 - threshold**2) ** 0.5 * aside
        home = self.homes(moved)
        a, b = self.away(probes)
        at = a[np.arange(len(home)), home // k] + b[np.arange(len(home)), home % k]
        places = [int((x[:, None] + y[None, :] <= d).sum()) for x, y, d in zip(a, b, at, strict=True)]
        self.cells = int(np.quantile(places, RECALL, method="higher"))

    def away(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.left), distances(x[:, self.half :], self.right)

    def homes(self, x: np.ndarray) -> np.ndarray:
        a, b = self.away(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.away(x)
        return [[i * self.k + j for i, j in multi_sequence(p, q, self.cells)] for p, q in zip(a, b, strict=True)]


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a bipartite link matrix, then each column, the least index of its component."""
    rows, columns = linked.shape
    r, c = np.arange(rows), np.full(columns, rows + columns)
    while True:
        new_c = np.where(linked, r[:, None], rows + columns).min(axis=0, initial=rows + columns)
        new_r = np.minimum(r, np.where(linked, new_c[None, :], rows + columns).min(axis=1, initial=rows + columns))
        if (new_r == r).all() and (new_c == c).all():
            return np.concatenate((r, c))
        r, c = new_r, new_c


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Rows are linked if the cosine of their vectors, in double precision, is at least the
    threshold. n_links counts other rows linked directly, component_id is the least id that links
    reach, kept marks it. Vectors that are null, empty, all zero, or hold null or non-finite
    components link with nothing and stay. Equal vectors are linked. Rows without id have
    a null component, link with nothing and are kept. Repeated rows count as other rows. All
    vectors must have one length. Other columns are not read. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    entries = stored(distinct_vectors(embeddings, 1, vector, key).select(F.col("ids")[0].alias("id"), "v", "n"), "entries")
    sample = sample_of(entries, SAMPLE)
    grid = spark.sparkContext.broadcast(Grid(sample, entries.count(), threshold) if len(sample) else None)

    def place(frames):
        for pdf in frames:
            x = unit(np.stack(pdf["v"].to_numpy()))
            yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "v": list(x), "home": grid.value.homes(x), "visits": grid.value.visits(x)})

    placed = entries.mapInPandas(place, "id long, n long, v array<double>, home int, visits array<int>")
    placed = stored(placed, "placed")
    visited = placed.select(F.explode("visits").alias("cell"))
    size = lambda df, name: df.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).cast("int").alias(name))
    cut = size(placed.select(F.col("home").alias("cell")), "a").join(size(visited, "b"), "cell")
    # Cells are at most MOST_CENTROIDS squared, three integers each.
    cut = F.broadcast(cut.coalesce(1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.withColumn("cell", F.col("home")).join(cut, "cell").select("cell", deal("a").alias("i"), every("b").alias("j"), "id", "n", "v", "visits")
    visitors = placed.withColumn("cell", F.explode("visits")).join(cut, "cell").select("cell", deal("b").alias("j"), every("a").alias("i"), F.col("id").alias("id"), F.col("n").alias("n"), F.col("v").alias("v"), F.col("home").alias("home"))

    def compare(y: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not (len(x) and len(y)):
            return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        mine, theirs = x["id"].to_numpy(), y["id"].to_numpy()
        linked = np.stack(x["v"].to_numpy()) @ np.stack(y["v"].to_numpy()).T >= threshold
        linked &= mine[:, None] != theirs[None, :]
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked, mine, theirs = linked[np.ix_(rows, columns)], mine[rows], theirs[columns]
        homes, at = np.unique(x["home"].to_numpy()[rows], return_inverse=True)
        back = np.stack([np.isin(homes, v) for v in y["visits"].to_numpy()[columns]]) if len(columns) else np.empty((0, 0), bool)
        n_mine = linked @ y["n"].to_numpy()[columns]
        n_theirs = x["n"].to_numpy()[rows] @ (linked & ~back[:, at].T) if len(columns) else np.empty(0, np.int64)
        ids = np.concatenate((mine, theirs))
        root = ids[forest(linked)] if len(ids) else ids
        return pd.DataFrame({"id": ids, "n": np.concatenate((n_mine, n_theirs)), "root": root}).astype("int64")

    by = ("cell", "i", "j")
    found = members.groupBy(*by).cogroup(visitors.groupBy(*by)).applyInPandas(compare, "id long, n long, root long")
    found = stored(found, "found")
    label = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    entry = entries.join(counts, "id", "left").join(label, "id", "left")
    links = F.coalesce(F.col("n_"), F.lit(0)) + F.col("same") - 1
    entry = entry.select(F.transform("v", lambda x: x).alias("v"), entries["n"].alias("same"), counts["n"].alias("n_"), F.coalesce("component", "id").alias("component"))
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.when(F.col(key).isNotNull(), F.transform(F.col(vector), lambda x: x.cast("double"))).alias("v"))
    out = rows.join(entry, "v", "left")
    return out.select(
        "vec_id",
        F.coalesce(links, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
