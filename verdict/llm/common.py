"""Scratch tables, connected components and hashes shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.session import give_back, small_batches  # noqa: F401

#: Words of the contracts: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only in local mode where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="verdict-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to a new folder of the shared scratch space and read back: lineage ends here,
    and an executor's loss costs no more than the task that was running."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{what}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> int:
    """How many scratch tables there are."""
    return len(_made)


def clear_scratch(spark: SparkSession, first: int = 0, keep: int = 0) -> None:
    """Remove the scratch tables from number ``first`` on but for the last ``keep``; results that read them must be written before."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    last = max(first, len(_made) - keep)
    for name in _made[first:last]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _made[first:last]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (src, dst): the smallest id that can be reached.

    Alternating large-star and small-star steps: each hangs the neighbours of a node below the
    smallest of them, so paths shrink until every node hangs at its component's least id. Minima
    combine before the shuffle, and no adjacency list is collected. Null ends are ignored.
    """
    now = stored(
        edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        near = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(near, "src")
        now = stored(
            small.select("src", F.col("m").alias("dst"))
            .unionByName(small.filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")))
            .distinct(),
            "edges",
        )
        before, mark = mark, _mark(now)
        if mark == before:
            break
    leaves = now.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return leaves.unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Two equal edge sets have the same mark, different ones practically never."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64("dst", "src"))).first())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: rows of fold 0 are held out of every training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def names(schema: str) -> list[str]:
    """Column names of a schema written as ``name type, name type``, whose types hold no comma."""
    return [field.split()[0] for field in schema.split(",")]


def slices(sizes: np.ndarray, most: int):
    """Ranges of rows whose sizes add up to at most ``most``, or single rows that exceed it."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def text_parts(column: pa.Array, most: int):
    """(begin, end, part) of an Arrow column, at most ``most`` bytes or one text at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, most):
        yield a, b, column[a:b]
    give_back()


def text_slices(column: pa.Array, most: int):
    """(begin, end, texts) of an Arrow column, at most ``most`` bytes or one text at a time."""
    for a, b, part in text_parts(column, most):
        yield a, b, part.to_pylist()
