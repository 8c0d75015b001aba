"""Messages to plans, and plans to step invocations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.functions import literal, settled

UNKNOWN_PLAN = "unknown_plan"

#: Plan names that are looked at for being frequent, and names the sketch of them keeps track of.
FREQUENT, TRACKED = 256, 10_000


def route(messages: DataFrame, plan_table: DataFrame) -> DataFrame:
    """Attach the steps of the named plan and complete ``reason``.

    One left join serves both sides: rows with a null reason are to be run, the others
    are dead letters. No message is lost and none is read twice.
    """
    return _with_reason(messages.join(plan_table, "plan", "left"))


def route_written(messages: DataFrame, plan_rows: list[dict]) -> DataFrame:
    """``route`` for a few plans, written into the expression.

    Nothing is broadcast, which would be a job of its own in every batch of a stream.
    """

    def text(value: str | None) -> str:
        return "CAST(NULL AS STRING)" if value is None else literal(value)

    def array(values: list[str], kind: str) -> str:
        return f"CAST(array({', '.join(values)}) AS array<{kind}>)"

    def steps(plan: dict) -> str:
        made = [f"named_struct('name', {text(s['name'])}, 'inputs', {array(list(map(text, s['inputs'])), 'string')})" for s in plan["steps"]]
        return array(made, "struct<name:string,inputs:array<string>>")

    def of_plan(value) -> str:
        return "CASE " + " ".join(f"WHEN plan = {literal(p['plan'])} THEN {value(p)}" for p in plan_rows) + " END"

    found = {"steps": steps, "problem": lambda p: text(p["problem"]), "problem_no_input": lambda p: text(p["problem_no_input"])}
    if not plan_rows:
        nothing = {"steps": "array<struct<name:string,inputs:array<string>>>", "problem": "string", "problem_no_input": "string"}
        return _with_reason(messages.withColumns({c: F.expr(f"CAST(NULL AS {kind})") for c, kind in nothing.items()}))
    return _with_reason(messages.withColumns({c: F.expr(of_plan(value)) for c, value in found.items()}))


def _with_reason(joined: DataFrame) -> DataFrame:
    reason = f"""coalesce(reason, CASE WHEN steps IS NULL THEN '{UNKNOWN_PLAN}' END,
      CASE WHEN input IS NULL THEN problem_no_input ELSE problem END)"""
    return joined.withColumn("reason", F.expr(settled(reason))).drop("problem", "problem_no_input")


def route_split(messages: DataFrame, plan_table: DataFrame, parts: int | None = None) -> DataFrame:
    """``route`` for plans that are too many to broadcast, whatever share of the messages one plan has.

    Messages that are dead already, those without plan among them, are left out of the join. A sketch counts the plans
    of the others in one pass; a plan with more messages than an even share of a quarter of a task is spread over as many
    salts as it has such shares, and its row of the plan table is repeated for each.
    """
    spark = messages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    alive = messages.filter("reason IS NULL AND plan IS NOT NULL")
    top = alive.agg(F.expr(f"approx_top_k(plan, {FREQUENT}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    share = max(1.0, (top["n"] or 0) / (4 * parts))
    salts = [(item["item"], int(-(-item["count"] // share))) for item in top["top"] or () if item["count"] > share]
    salts = F.broadcast(spark.createDataFrame(salts, "plan string, salts int"))
    spread = F.coalesce(F.col("salts"), F.lit(1))
    # Row numbers deal the messages of a plan out evenly, even where all their bodies are equal.
    salted = alive.join(salts, "plan", "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), spread).cast("int"))
    repeated = plan_table.join(salts, "plan", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), spread - 1)))
    joined = salted.drop("salts").join(repeated.drop("salts"), ["plan", "_salt"], "left").drop("_salt")
    routed = _with_reason(joined)
    nothing = {c.name: F.lit(None).cast(c.dataType) for c in routed.schema if c.name not in messages.columns}
    dead = messages.filter("NOT (reason IS NULL AND plan IS NOT NULL)").withColumns(nothing)
    return routed.unionByName(dead.select(routed.columns))


def runnable(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("reason").isNull())


def dead_letters(routed: DataFrame, body: str = "value") -> DataFrame:
    return routed.filter(F.col("reason").isNotNull()).select(
        "plan", "reason", F.col(body).cast("string").alias("body")
    )


def expand_steps(routed: DataFrame) -> DataFrame:
    """One row per step a message is to run: adds position, step, inputs."""
    others = [c for c in routed.columns if c != "steps"]
    return routed.select(*others, F.posexplode("steps").alias("position", "_step")).select(
        *others, "position", F.col("_step.name").alias("step"), F.col("_step.inputs").alias("inputs")
    )


def unknown_steps(invocations: DataFrame, step_table: DataFrame) -> DataFrame:
    """Invocations whose step is not registered."""
    return invocations.join(step_table, "step", "left_anti")


def message_outcomes(routed: DataFrame) -> DataFrame:
    """Add ``completed``: false as soon as one step of the message fails."""
    return routed.withColumn("completed", F.col("reason").isNull())
