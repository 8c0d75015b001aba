"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its id and text. A source that takes r times its size takes each
document floor(r) times, and those whose hash lies below a threshold once more. The threshold
is found without sorting: tokens are summed by source and the top 12 bits of the hash,
running sums over those 4,096 buckets show in which bucket the budget ends, and only that bucket is
summed again by its next 12 bits, until the bits are used up. Whole buckets below the end are
taken, and documents of the last bucket if that comes nearer to the budget. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST = 3
BITS = 12
LEVELS = 4


def doc_hash(column: str = "doc_id", text: str = "text"):
    """48 bits of the MD5 of id and text, so that only equal documents share it."""
    whole = F.concat(F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of the total by weight, at most ``most`` times a source's size.

    Sources in order of code points, null last, take the weights in turn. What exceeds a
    source's limit goes to the others by weight, until none is above: with sources in order of
    limit by weight, one level of tokens a unit of weight serves all that are not full.
    One row per source is all that meets in one task.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("i", F.expr("row_number() over (order by source nulls last) - 1")).withColumn("w", weight)
    order = "order by source_size / w, i"
    run = ranked.selectExpr(
        "source", "source_size", "w", f"sum(source_size) over () as total",
        f"coalesce(sum({most} * source_size) over ({order} rows between unbounded preceding and 1 preceding), 0) as full",
        f"sum(w) over ({order} rows between current row and unbounded following) as rest",
        "source_size / w as ratio", "i",
    )
    # The level at which this source and all later ones are the ones that are not full.
    run = run.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    level = F.expr(f"(min(case when level * w <= {most} * source_size then struct(ratio, i, level) end) over ()).level")
    target = F.when(F.col("at").isNull(), most * F.col("source_size")).otherwise(F.least(F.col("at") * F.col("w"), most * F.col("source_size")))
    return run.withColumn("at", level).select("source", "source_size", target.cast("double").alias("target"))


def _marked(docs: DataFrame, weights: tuple, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of each row, and (s, source_size, target, whole, mark) of each source:
    documents are taken ``whole`` times, and once more where their hash lies below the mark."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), doc_hash().alias("h")), "sizes")
    goal = targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)
    goal = goal.withColumn("whole", F.least(F.floor(ratio), F.lit(most))).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    # taken: tokens of all buckets below the end; at: the bits fixed so far of the bucket where the budget ends.
    goal = stored(goal.withColumn("at", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "goal")
    for level in range(LEVELS):
        shift = 48 - BITS * (level + 1)
        inside = sizes.join(goal.select(F.col("source").alias("s"), "at"), sizes["source"].eqNullSafe(F.col("s")))
        inside = inside.filter(F.shiftright("h", shift + BITS) == F.col("at")) if level else inside
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = buckets.withColumn("upto", F.expr("sum(tokens) over (partition by source order by bucket)"))
        ends = running.join(goal.select(F.col("source").alias("s"), "budget", "below"), running["source"].eqNullSafe(F.col("s")))
        over = F.col("below") + F.col("upto") > F.col("budget")
        ends = ends.groupBy("s").agg(
            F.min(F.when(over, F.col("bucket"))).alias("end"),
            F.max("bucket").alias("last"),
            F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("more"),
        )
        goal = goal.join(ends, goal["source"].eqNullSafe(ends["s"]), "left").select(
            "source", "source_size", "target", "whole", "budget",
            # No bucket exceeds the budget: the end lies behind all of them.
            F.coalesce("end", F.col("last") + 1, F.shiftleft("at", BITS)).alias("at"),
            (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"),
        )
        goal = stored(goal, "goal")
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", "whole", "budget", "at", "below")
    last = sizes.join(goal.select("s", F.col("at").alias("a")), sizes["source"].eqNullSafe(F.col("s")) & (F.col("h") == F.col("a"))).groupBy("s").agg(F.sum("size").alias("tie"))
    nearer = F.col("below") + F.col("tie") - F.col("budget") <= F.col("budget") - F.col("below")
    goal = goal.join(last.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
    goal = stored(goal.select("s", "source_size", "target", "whole", (F.col("at") + F.coalesce(nearer, F.lit(False)).cast("long")).alias("mark")), "goal")
    return sizes, goal


def _copies(most: int):
    return F.col("whole") + (F.col("h") < F.col("mark")).cast("long") * (F.col("whole") < most).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, source, text).

    size counts runs of other than ASCII white space; a null text has none. taken is size times
    the copies the mix takes, 0 to ``most``. Null sources are a source. Rows of one id, or none, are
    taken or left each by its own text; repeated rows are taken or left together. Other columns are not
    read. An empty table gives an empty result.
    """
    sizes, goal = _marked(docs, weights, most)
    out = sizes.join(goal, sizes["source"].eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(most)).cast("long").alias("taken"))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(row, copies): each row of docs as a struct, and how often the mix takes it; see mix."""
    _, goal = _marked(docs, weights, most)
    goal = goal.select("s", "whole", "mark")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), doc_hash().alias("h"))
    joined = rows.join(goal, rows["source"].eqNullSafe(F.col("s")))
    return joined.select("row", _copies(most).alias("copies"))
