"""Run any number of plans: the plans are rows, and the code grows with the longest plan only.

``run_plans`` writes every plan into one expression, which is quickest for a few. Here a plan's steps, bound to the
positions they refer to, come to its messages with a join on the plan's name, and one projection for each position does
what the row's own step asks for. Results gather in an array of the row, so a look-up of an earlier result, the latest of
its name or those a template names, is an element of that array, and the fan-in of a store step is a transform over its inputs
in listed order. Nothing is shuffled but what the join moves, which is nothing while the plans are small.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions import literal, settled
from verdict.functions.variants import strict_variant, with_strict_variant
from verdict.operators.records import count_accepted
from verdict.operators.scoring import Scorer, answer_object, echo_answer, open_input
from verdict.plans.model import DEFAULT_INPUT, PLAN_BYTES, Binding, Plan, PlanProblem, resolve
from verdict.plans.steps import EchoStep, StoreStep

_PIECE = pa.struct([("position", pa.int32()), ("text", pa.string())])
_INPUT = pa.struct([("position", pa.int32()), ("pieces", pa.list_(_PIECE))])
_STEPS = pa.list_(pa.struct([("name", pa.string()), ("inputs", pa.list_(_INPUT))]))


def _input(bound: Binding) -> dict:
    pieces = [{"position": p, "text": None} if isinstance(p, int) else {"position": None, "text": p} for p in bound.pieces]
    return {"position": bound.position, "pieces": pieces}


def binding_table(spark: SparkSession, plans: Iterable[Plan], registry: dict) -> DataFrame:
    """plan, with_input, without_input: the bound steps of each plan, null where its messages cannot finish."""

    def bound(plan: Plan, has_input: bool):
        try:
            found = resolve(plan, registry, has_input)
        except PlanProblem:
            return None
        return [{"name": step.name, "inputs": [_input(b) for b in inputs]} for step, inputs in zip(plan.steps, found, strict=True)]

    plans = list(plans)
    table = pa.table(
        {
            "plan": pa.array([p.name for p in plans], pa.string()),
            "with_input": pa.array([bound(p, True) for p in plans], _STEPS),
            "without_input": pa.array([bound(p, False) for p in plans], _STEPS),
        }
    )
    rows = spark.createDataFrame(table)
    return F.broadcast(rows) if table.nbytes <= PLAN_BYTES else rows


def _json(position: str) -> str:
    """The result at a position as text; the message input has position -1."""
    return f"to_json(get(_results, {position} + 1))"


def _text(bound: str) -> str:
    pieces = f"transform({bound}.pieces, p -> if(p.position IS NULL, p.text, {_json('p.position')}))"
    return f"if({bound}.position IS NOT NULL, {_json(f'{bound}.position')}, array_join({pieces}, ''))"


def _variant(bound: str) -> str:
    return f"CASE WHEN {bound}.position IS NOT NULL THEN get(_results, {bound}.position + 1) ELSE {strict_variant(_text(bound))} END"


def _names(names: Iterable[str]) -> str:
    return ", ".join(literal(n) for n in sorted(names))


def run_many_plans(routed: DataFrame, plans: Iterable[Plan], registry: dict) -> DataFrame:
    """``run_plans`` for plans that are too many for one expression: the same columns, row by row."""
    plans = list(plans)
    used = {step.name for p in plans for step in p.steps if step.name in registry}
    scorers = {n: registry[n] for n in sorted(used) if isinstance(registry[n], Scorer)}
    echoes = [n for n in used if isinstance(registry[n], EchoStep)]
    stores = [n for n in used if isinstance(registry[n], StoreStep)]
    if unknown := used - {*scorers, *echoes, *stores}:
        raise TypeError(f"step {sorted(unknown)[0]} is of no known type")

    df = routed.join(binding_table(routed.sparkSession, plans, registry), "plan", "left")
    steps = "CASE WHEN reason IS NULL THEN if(input IS NOT NULL, with_input, without_input) END"
    df = df.withColumns({"_steps": F.expr(settled(steps)), "_results": F.expr("array(input)")}).drop("with_input", "without_input")
    for k in range(max((len(p.steps) for p in plans), default=0)):
        df = df.withColumn("_step", F.expr(f"get(_steps, {k})")).withColumn("_first", F.expr("get(_step.inputs, 0)"))
        # Text of a template is a column of its own, as parsing looks at it more than once.
        df = df.withColumn("_given", F.expr(f"CASE WHEN _first.position IS NULL THEN {_text('_first')} END"))
        df = with_strict_variant(df, "_given", "_parsed")
        df = df.withColumn("_value", F.expr("CASE WHEN _first.position IS NOT NULL THEN get(_results, _first.position + 1) ELSE _parsed END"))
        choices = []
        if scorers:
            df = open_input(df, f"CASE WHEN _step.name IN ({_names(scorers)}) THEN _value END", "_in")
            verdicts = []
            for i, (name, scorer) in enumerate(scorers.items()):
                df = df.withColumn(f"_text{i}", F.expr(f"CASE WHEN _step.name = {literal(name)} THEN _in_chosen.text END"))
                df = scorer.add_verdict(df, f"_text{i}", f"_verdict{i}")
                verdicts.append(f"WHEN {literal(name)} THEN _verdict{i}")
            df = df.withColumn("_verdict", F.expr(f"CASE _step.name {' '.join(verdicts)} END"))
            answer = answer_object("_step.name", "_value", "_in", "_in_chosen", "_verdict")
            choices.append(f"WHEN _step.name IN ({_names(scorers)}) THEN {answer}")
        if echoes:
            choices.append(f"WHEN _step.name IN ({_names(echoes)}) THEN {echo_answer('_value')}")
        if stores:
            kept = count_accepted(f"transform(_step.inputs, i -> {_variant('i')})")
            summary = f"to_variant_object(named_struct('success', true, 'inserted_records', {kept}))"
            choices.append(f"WHEN _step.name IN ({_names(stores)}) THEN {summary}")
        result = f"CASE {' '.join(choices)} END" if choices else "CAST(NULL AS variant)"
        df = df.withColumn("_result", F.expr(result))
        df = df.select(*routed.columns, "_steps", F.expr("concat(_results, array(_result))").alias("_results"))

    names = f"concat(array({literal(DEFAULT_INPUT)}), transform(_steps, s -> s.name))"
    last = f"size(_names) - array_position(reverse(_names), n)"
    entries = f"transform(array_distinct(_names), n -> named_struct('key', n, 'value', to_json(get(_results, CAST({last} AS INT)))))"
    stored = f"filter(_steps, s -> s.name IN ({_names(stores)}))" if stores else "filter(_steps, s -> false)"
    finished = {
        "answers": f"CAST(flatten(transform({stored}, s -> transform(s.inputs, i -> {_variant('i')}))) AS array<variant>)",
        "results": f"map_from_entries(filter({entries}, e -> e.value IS NOT NULL))",
        "bound": f"""transform(_steps, (s, k) -> named_struct('position', k, 'step', s.name,
          'inputs', transform(s.inputs, i -> {_text('i')})))""",
    }
    df = df.withColumn("_names", F.expr(names))
    return df.select(*routed.columns, *[F.expr(settled(f"CASE WHEN reason IS NULL THEN {rule} END")).alias(name) for name, rule in finished.items()])
