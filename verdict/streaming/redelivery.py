"""Trying parked messages again once the plans they name are there.

A message that cannot be run is stored as a dead letter with its reason. ``redeliver`` takes dead letters whose reason a later plan
table may do away with, routes them by the plans it is given, and runs those that can be run now. Every round has a number of its own: its
outcomes are written first and its log of messages last, and only rounds with a log count. So a round that was
cut off is written again by the next call, and a message that ran is never run again. A message is tried ``most`` times.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators.outcomes import DEAD, require_checks, route_messages, score_unchecked
from verdict.plans.model import NO_INPUTS, UNKNOWN_STEP, Plan
from verdict.plans.routing import UNKNOWN_PLAN
from verdict.sources.compaction import Store
from verdict.sources.results import OUTCOME_SCHEMA, read_outcomes, stamp

#: Reasons that lie with the plans and not with the message.
RETRIED = (UNKNOWN_PLAN, UNKNOWN_STEP, NO_INPUTS)

KEY = ["batch_id", "result_id"]
_LOG = "batch_id INT, result_id BIGINT, ran BOOLEAN"


def _rounds(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the rounds whose log is complete."""
    store = Store(spark, f"{out}/rounds")
    numbers = [int(n.removeprefix("round=")) for n in store.names() if n.startswith("round=")]
    return sorted(n for n in numbers if "_SUCCESS" in store.names(f"round={n}"))


def read_rounds(spark: SparkSession, out: str) -> DataFrame:
    """Every try so far: the message's batch and row, the round, and whether it ran."""
    paths = [f"{out}/rounds/round={n}" for n in _rounds(spark, out)]
    if not paths:
        return spark.createDataFrame([], f"{_LOG}, round INT")
    return spark.read.schema(f"{_LOG}, round INT").option("basePath", f"{out}/rounds").parquet(*paths)


def parked(spark: SparkSession, out: str, reasons: Iterable[str] = RETRIED, most: int = 3) -> DataFrame:
    """Dead letters still to be tried: (batch_id, result_id, value)."""
    dead = read_outcomes(spark, f"{out}/outcomes").filter((F.col("kind") == DEAD) & F.col("reason").isin(*reasons))
    tried = read_rounds(spark, out).groupBy(*KEY).agg(F.bool_or("ran").alias("ran"), F.count("*").alias("tries"))
    settled = tried.filter(F.col("ran") | (F.col("tries") >= most)).select(*KEY)
    return dead.join(settled, KEY, "left_anti").select(*KEY, F.col("body").alias("value"))


def redeliver(
    spark: SparkSession,
    out: str,
    plans: Iterable[Plan],
    registry: dict,
    reasons: Iterable[str] = RETRIED,
    most: int = 3,
    sample: DataFrame | None = None,
) -> int:
    """Try the parked messages of ``out`` by these plans; returns the number of the round, or -1 where there was nothing to try."""
    plans = list(plans)
    require_checks(plans, registry, sample)
    waiting = parked(spark, out, reasons, most)
    if waiting.isEmpty():
        return -1
    number = max(_rounds(spark, out), default=-1) + 1
    routed = route_messages(waiting, plans, registry).withColumn("ran", F.col("reason").isNull())
    able = routed.filter("ran").select("value")
    stamp(score_unchecked(able, plans, registry)).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/redelivered/round={number}")
    routed.select(*KEY, "ran").write.mode("overwrite").parquet(f"{out}/rounds/round={number}")
    return number


def read_redelivered(spark: SparkSession, out: str) -> DataFrame:
    """The outcomes of all rounds that were completed."""
    paths = [f"{out}/redelivered/round={n}" for n in _rounds(spark, out)]
    schema = f"{OUTCOME_SCHEMA}, round INT"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{out}/redelivered").parquet(*paths)
