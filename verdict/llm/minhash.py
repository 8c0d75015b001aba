"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds its distinct shingles, as 64-bit hashes. Its sketch has ``COORDINATES``
bins. In round i every shingle is hashed to a bin and a value in [i, i + 1), and each bin keeps
its least value; rounds go on until every bin is filled. The second half of the rounds sends
all shingles to one fixed bin each, so all bins fill however small the set is. Coordinates agree
with probability equal to the Jaccard similarity, as in MinHash, but one pass over the set
fills many of them, and they concentrate more tightly.

Sketches are cut into ``BANDS`` bands; documents that agree in a whole band share a bucket.
A pair at similarity 0.8 shares none of 45 bands of 7 coordinates with a probability of
(1 - 0.8^7)^45 = 2.5e-5, and a component has to lose every one of its connecting pairs.

Buckets are never expanded into all pairs. Documents of equal sets are one class first. Each
bucket compares its least member with the others; links that hold on the full sets merge
components, which settles most buckets. Before these sets are read, pairs whose sketches
agree in fewer than 60 % are dropped: at a similarity of 0.8 that lies 9 standard deviations away.
Buckets that still hold several components are put together where they share documents. The
documents of such a neighbourhood are cut into blocks, and every two blocks are one task of bounded
size, which multiplies the matrices of their sets and gives back the edges of a spanning
forest of the links only. So every pair that shares a bucket is verified or known to be connected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import components, mix, names, stored, text_slices

COORDINATES = 315
ROWS = 7
BANDS = COORDINATES // ROWS
#: Share of equal coordinates below which a pair is not looked at further.
PLAUSIBLE = 0.6
#: Sets of fewer shingles reach a similarity of 0.8 with no other set.
LEAST = 4
#: Documents of a block, and columns of its matrix multiplied at once.
BLOCK = 512
COLUMNS = 4_096
#: Bits of the filter that keeps texts without candidates from being shingled again.
FILTER_BITS = 1 << 26
#: Bytes of text worked on at once inside a task.
CHUNK = 1_500_000

_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<bigint>, sketch binary"
_SETS = "id long, shingles array<bigint>"


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after the other, each sorted, and where each begins."""
    words = [t.encode("utf-8", "surrogatepass").translate(_UPPER).split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(sizes.sum(), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    codes, kinds = pd.factorize(flat)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))[codes] if len(kinds) else np.empty(0, np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    sets = []
    for a, n in zip(starts[:-1], sizes, strict=True):
        k = min(width, n)
        if not k:
            sets.append(np.empty(0, np.uint64))
            continue
        total = hashes[a : a + n - k + 1]
        for i in range(1, k):
            total = mix(total ^ np.uint64(i)) + hashes[a + i : a + i + n - k + 1]
        sets.append(np.unique(mix(total ^ np.uint64(k << 8))))
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), bounds


def sketch_sets(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sketch of each set, one row of COORDINATES words; sets without members stay empty."""
    t, n = COORDINATES, len(bounds) - 1
    out = np.full(n * t, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    open_ = np.diff(bounds) > 0
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values ^ mix(np.full(1, i + 1, np.uint64)))
        place = np.uint64(i - t) if i >= t else (h >> np.uint64(32)) % np.uint64(t)
        value = np.uint64(i << 54) | (mix(h) >> np.uint64(10))
        np.minimum.at(out, owner * t + np.asarray(place).astype(np.int64), value)
        left = open_ & (out.reshape(n, t) == _EMPTY).any(axis=1)
        if not left.all():
            keep = left[owner]
            values, owner, open_ = values[keep], owner[keep], left
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    cut = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), (len(sketch), BANDS))
    for i in range(ROWS):
        key = mix(key ^ cut[:, :, i])
    return key.view(np.int64)


def _sketcher(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1), CHUNK):
                values, bounds = shingle_sets(texts, width)
                sketch = sketch_sets(values, bounds)
                keys = band_keys(sketch)
                zero = np.zeros(1, np.uint64)
                one, two = (np.cumsum(np.concatenate((zero, mix(v))), dtype=np.uint64) for v in (values, ~values))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[a:b],
                        pa.array(np.diff(bounds)),
                        pa.array((one[bounds[1:]] - one[bounds[:-1]]).view(np.int64)),
                        pa.array((two[bounds[1:]] - two[bounds[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))),
                        pa.array([row.tobytes() for row in sketch.astype(np.uint8)], pa.binary()),
                    ],
                    names=names(_SKETCH),
                )

    return run


def sketches(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (set_a, set_b), band keys and sketch."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketcher(width), _SKETCH)


def _wanted(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with two bits for each id. Its size is fixed; a full one only lets more through."""
    h = F.xxhash64("id")
    bits = ids.select(F.explode(F.array(h, F.shiftrightunsigned(h, 26))).alias("h")).select(F.expr(f"h & {FILTER_BITS - 1}").alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("word")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of all documents in ids, and of some more."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_wanted(ids))

    def run(batches):
        words = wanted.value
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.ones(len(h), bool)
            for shift in (0, 26):
                bit = (h >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
                hit &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            batch = batch.filter(pa.array(hit))
            for a, b, texts in text_slices(batch.column(1), CHUNK):
                values, bounds = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=names(_SETS),
                )

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(run, _SETS)


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal coordinates of two sketches."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, COORDINATES) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Edges of a spanning forest of the links between documents of different components."""
        ids, component = pdf["id"].to_numpy(), pdf["component"].to_numpy()
        none = pd.DataFrame({"src": [], "dst": []}).astype("int64")
        if (component == component[0]).all():
            return none
        sizes = pdf["shingles"].map(len).to_numpy()
        values, columns, many = np.unique(np.concatenate(pdf["shingles"].to_list()), return_inverse=True, return_counts=True)
        # A shingle of one document is common to no two.
        place = np.cumsum(many > 1) - 1
        rows, shared = np.repeat(np.arange(len(ids)), sizes), many[columns] > 1
        rows, columns = rows[shared], place[columns[shared]]
        common = np.zeros((len(ids), len(ids)), np.float32)
        by = np.argsort(columns, kind="stable")
        rows, columns = rows[by], columns[by]
        for low in range(0, int((many > 1).sum()), COLUMNS):
            a, b = np.searchsorted(columns, (low, low + COLUMNS))
            part = np.zeros((len(ids), COLUMNS), np.float32)
            part[rows[a:b], columns[a:b] - low] = 1
            common += part @ part.T
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        linked &= component[:, None] != component[None, :]
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
            if (least == label).all():
                break
            label = least
        moved = label != np.arange(len(ids))
        return pd.DataFrame({"src": ids[moved], "dst": ids[label[moved]]}) if moved.any() else none

    return run


def _neighbourhoods(docs: DataFrame, open_: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (src, dst) between components within the buckets of open_ (key, id, component)."""
    first = open_.groupBy("key").agg(F.min("id").alias("dst"))
    area = components(open_.join(first, "key").select(F.col("id").alias("src"), "dst")).withColumnRenamed("component", "area")
    sizes = area.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = area.join(sizes, "area").withColumn("block", block).join(open_.select("id", "component").distinct(), "id")
    placed = stored(placed, "areas")
    sets = sets_of(docs, placed.select("id"), width)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.join(sets, "id").select("area", "id", "component", "shingles", "block", other)
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.groupBy("area", "i", "j").applyInPandas(_compare(percent), "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, ...).

    Words are what ASCII white space separates, with A-Z lowered. Two documents are linked if
    100 * |A and B| >= percent * |A or B|, for percent of 80 and more. A document with fewer words
    than a shingle has its whole sequence as one; null, empty and blank texts have empty sets and
    link with nothing. component_id is the least doc_id that links reach, kept marks it. Rows
    without doc_id link with nothing, have a null component and are kept. Repeated rows give a
    row each. Other columns are not read. An empty table gives an empty result.
    """
    table = stored(sketches(docs, width), "sketches")
    classed = table.filter("n_shingles > 0 and doc_id is not null")
    of_set = ["set_a", "set_b", "n_shingles"]
    classes = classed.groupBy(*of_set).agg(F.min("doc_id").alias("rep"))
    reps = table.filter(F.col("n_shingles") >= LEAST).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key", F.col("a").alias("leader"))
    members = stored(rows.join(shared, "key").select("key", "id", "leader").distinct(), "members")
    inside = members.select(F.col("id").alias("doc_id")).distinct()
    sketch = stored(table.join(inside, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "sketch").dropDuplicates(["id"]), "member-sketches")

    pairs = members.filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    links = _verified(docs, sketch, pairs, width, percent)
    label = stored(components(links), "components").withColumnRenamed("id", "of")
    named = members.join(label, members["id"] == label["of"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    open_ = stored(named.join(several, "key", "left_semi"), "open")
    more = _neighbourhoods(docs, open_, width, percent)
    # Components found so far are edges to their least members.
    known = label.select(F.col("of").alias("src"), F.col("component").alias("dst"))
    label = stored(components(known.unionByName(more)), "components")

    own = table.join(classes, of_set, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"))
    own = own.join(label, own["rep"] == label["id"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _verified(docs: DataFrame, sketch: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that are links on their full sets, as (src, dst)."""
    a, b = (sketch.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    near = pairs.join(a, "a").join(b, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = stored(near.filter(F.pandas_udf(agreement, "double")("sa", "sb") >= PLAUSIBLE).select("a", "b"), "plausible")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(sets_of(docs, ids, width), "sets")
    x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = near.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    linked = both.filter(f"100 * common >= {percent} * (size(sa) + size(sb) - common)")
    return stored(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
