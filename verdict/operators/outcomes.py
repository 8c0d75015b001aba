"""From message bodies to one table of outcomes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions import settled
from verdict.operators.envelope import decode_messages
from verdict.operators.records import RESULT_COLUMNS
from verdict.operators.scoring import Scorer, require_smoke
from verdict.plans import model
from verdict.plans.model import Plan, plan_rows
from verdict.plans.routing import route, route_split, route_written
from verdict.plans.runner import MANY_PLANS, stored_answers

ACCEPTED = "accepted"
REJECTED = "rejected"
DEAD = "dead"
EMPTY = "empty"


def route_messages(
    messages: DataFrame, plans: Iterable[Plan], registry: dict, body: str = "value"
) -> DataFrame:
    """Decode message bodies and attach the steps of their plans."""
    plans = list(plans)
    decoded, table = decode_messages(messages, body), plan_rows(plans, registry)
    if len(plans) <= MANY_PLANS:
        return route_written(decoded, table.to_pylist())
    rows = messages.sparkSession.createDataFrame(table)
    return route(decoded, F.broadcast(rows)) if table.nbytes <= model.PLAN_BYTES else route_split(decoded, rows)


def fit_broadcast(plans: Iterable[Plan], registry: dict) -> bool:
    """Whether the plans are few enough to be sent to every task."""
    return plan_rows(plans, registry).nbytes <= model.PLAN_BYTES


def require_checks(
    plans: Iterable[Plan], registry: dict, sample: DataFrame | None = None
) -> None:
    """Run the required checks of all classifiers the plans use, before any data."""
    used = {step.name for p in plans for step in p.steps}
    require_smoke(sample, [s for n, s in registry.items() if n in used and isinstance(s, Scorer)])


def score_messages(
    messages: DataFrame,
    plans: Iterable[Plan],
    registry: dict,
    body: str = "value",
    sample: DataFrame | None = None,
) -> DataFrame:
    """Check the classifiers that require it on ``sample``, then see ``score_unchecked``."""
    plans = list(plans)
    require_checks(plans, registry, sample)
    return score_unchecked(messages, plans, registry, body)


def score_unchecked(
    messages: DataFrame, plans: Iterable[Plan], registry: dict, body: str = "value"
) -> DataFrame:
    """Every message to one row per stored answer, or to one row where there is none.

    ``kind`` is accepted (the result columns are filled), rejected (``reason`` names the
    broken rule, ``body`` is the answer), dead (the message could not be run: its reason
    and body) or empty (ran, but its plan stores nothing). ``first`` marks one row per
    message. All of it is one narrow pass over the messages.
    """
    plans = list(plans)
    routed = route_messages(messages, plans, registry, body)
    reported = routed.withColumn(
        "_body", F.when(F.col("reason").isNotNull(), F.col(body).cast("string"))
    )
    checked = stored_answers(reported, plans, registry, carry=["_body"])
    kind = f"""CASE WHEN reason IS NOT NULL THEN '{DEAD}' WHEN _nth IS NULL THEN '{EMPTY}'
      WHEN reject IS NULL THEN '{ACCEPTED}' ELSE '{REJECTED}' END"""
    marked = checked.withColumn("kind", F.expr(settled(kind)))
    return marked.selectExpr(
        "kind",
        "coalesce(_nth, 0) = 0 AS first",
        "plan",
        f"CASE WHEN kind = '{REJECTED}' THEN reject ELSE reason END AS reason",
        f"CASE WHEN kind = '{REJECTED}' THEN answer_json ELSE _body END AS body",
        *[f"CASE WHEN kind = '{ACCEPTED}' THEN {c} END AS {c}" for c in RESULT_COLUMNS],
    )


def results(outcomes: DataFrame) -> DataFrame:
    """Accepted rows, with the row id and time where the outcomes were stored."""
    extra = [c for c in ("batch_id", "result_id", "stored_at") if c in outcomes.columns]
    return outcomes.filter(F.col("kind") == ACCEPTED).select(*extra, *RESULT_COLUMNS)


def rejects(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("kind") == REJECTED).select(
        "plan", "reason", F.col("body").alias("answer")
    )


def dead_messages(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("kind") == DEAD).select("plan", "reason", "body")


def count_outcomes(outcomes: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Messages completed and failed, and rows stored and rejected."""
    return outcomes.groupBy(*by).agg(*outcome_counts())


def outcome_counts() -> list[Column]:
    dead = F.col("kind") == DEAD
    return [
        F.count_if(F.col("first") & ~dead).alias("completed"),
        F.count_if(dead).alias("failed"),
        F.count_if(F.col("kind") == ACCEPTED).alias("stored"),
        F.count_if(F.col("kind") == REJECTED).alias("rejected"),
    ]
