"""Messages: one JSON object per row with the plan to run and its open input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions import settled
from verdict.functions.variants import described, is_falsy, pick, with_strict_variant

BAD_MESSAGE = "bad_message"
MISSING_PLAN = "missing_plan"


def encode_messages(corpus: DataFrame, plan: str | Column) -> DataFrame:
    """Corpus rows (id, comment, label) to message bodies in one column ``value``."""
    plan = F.lit(plan) if isinstance(plan, str) else plan
    fields = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("comment").cast("string").alias("comment"),
        F.col("label").cast("string").alias("label"),
    )
    return corpus.select(F.to_json(F.struct(plan.alias("plan"), fields.alias("input"))).alias("value"))


def decode_messages(messages: DataFrame, body: str = "value") -> DataFrame:
    """Add ``plan``, ``input`` and ``reason``; reason is null for a usable message.

    Bodies may be text or bytes. An empty or missing input is null ("no input").
    """
    text = f"CAST({body} AS STRING)"
    whole = f"CASE WHEN is_valid_utf8({text}) THEN {text} END"
    return (
        with_strict_variant(messages, whole, "_message")
        .withColumn("_message", F.expr(pick("_message", "plan", "input")))
        .withColumns(
            {
                "_plan": F.expr(described("_message.plan")),
                "_input": F.expr(described("_message.input")),
            }
        )
        .withColumns(
            {
                "plan": F.expr(settled(f"CASE WHEN NOT {is_falsy('_plan')} THEN _plan.text END")),
                "input": F.expr(
                    settled(f"CASE WHEN NOT {is_falsy('_input')} THEN _message.input END")
                ),
                "reason": F.expr(
                    settled(
                        f"CASE WHEN _message IS NULL THEN '{BAD_MESSAGE}' "
                        f"WHEN {is_falsy('_plan')} THEN '{MISSING_PLAN}' END"
                    )
                ),
            }
        )
        .drop("_message", "_plan", "_input")
    )


def take_messages(messages: DataFrame, n: int) -> DataFrame:
    """At most n messages, whichever come first."""
    return messages.limit(n)
