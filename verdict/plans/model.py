"""Plan definitions and how the inputs of a step are bound.

Plans are configuration: a few short rows, known before any data is read. So the names
in them are resolved once, on the driver, to positions in the step list, and the data
rows only ever see column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from string import Formatter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_INPUT = "default_input"
INPUT_POSITION = -1

#: Size of all plans, in Arrow, up to which they are sent to every task that routes messages.
PLAN_BYTES = 64 << 20

UNKNOWN_STEP = "unknown_step"
BAD_TEMPLATE = "bad_template"
NO_INPUTS = "no_inputs"


@dataclass(frozen=True)
class Step:
    name: str | None
    inputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    name: str
    steps: tuple[Step, ...]

    def __post_init__(self):
        if not self.steps:
            raise ValueError(f"plan {self.name} has no steps")


def plan(name: str, *steps: str | Step | tuple) -> Plan:
    """``plan("AB", ("a", ["default_input"]), "b")``; a bare name has no inputs."""
    return Plan(
        name,
        tuple(
            s if isinstance(s, Step) else Step(s) if isinstance(s, str) else Step(s[0], tuple(s[1]))
            for s in steps
        ),
    )


class PlanProblem(ValueError):
    """Why no message of this plan can finish; ``code`` is the dead-letter reason."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Binding:
    """One input of a step: the result at a position, or text pieces around results."""

    position: int | None = None
    pieces: tuple[str | int, ...] = ()


def bind(text: str, known: dict[str, int]) -> Binding:
    """Bind one input.

    A finished result of that very name wins. Otherwise the input is a template:
    ``{name}`` stands for a result, doubled braces for a brace. An unknown name leaves
    the whole text as it is; anything else in braces is a malformed template.
    """
    if text in known:
        return Binding(position=known[text])
    pieces: list[str | int] = []
    try:
        for literal, name, spec, conversion in Formatter().parse(text):
            pieces.append(literal)
            if name is None:
                continue
            root = re.match(r"[^.\[]*", name).group()
            if root == "" or root.isdecimal():
                raise PlanProblem(BAD_TEMPLATE)
            if root not in known:
                return Binding(pieces=(text,))
            if name != root or spec or conversion not in (None, "s"):
                raise PlanProblem(BAD_TEMPLATE)
            pieces.append(known[root])
    except ValueError as error:
        raise error if isinstance(error, PlanProblem) else PlanProblem(BAD_TEMPLATE) from None
    return Binding(pieces=tuple(p for p in pieces if p != ""))


def resolve(plan: Plan, registry: dict, has_input: bool) -> list[list[Binding]]:
    """The bound inputs of every step, for messages with or without an input.

    Steps see the results of earlier steps only; of two earlier steps with one name,
    the later one. A name that has not run yet is just text.
    """
    known = {DEFAULT_INPUT: INPUT_POSITION} if has_input else {}
    bound = []
    for position, step in enumerate(plan.steps):
        bound.append([bind(text, known) for text in step.inputs])
        if step.name not in registry:
            raise PlanProblem(UNKNOWN_STEP)
        if registry[step.name].needs_input and not step.inputs:
            raise PlanProblem(NO_INPUTS)
        known[step.name] = position
    return bound


def problem(plan: Plan, registry: dict, has_input: bool) -> str | None:
    try:
        resolve(plan, registry, has_input)
    except PlanProblem as found:
        return found.code
    return None


_STEPS = pa.list_(pa.struct([("name", pa.string()), ("inputs", pa.list_(pa.string()))]))


def plan_table(spark: SparkSession, plans: Iterable[Plan], registry: dict) -> DataFrame:
    """One row per plan: its steps, and why its messages must fail, if they must.

    Plans are configuration the driver holds already. While they take ``PLAN_BYTES`` at most, message
    bodies stay where they are, whatever the session's threshold for broadcasts. ``route_split`` joins larger tables.
    """
    table = plan_rows(plans, registry)
    rows = spark.createDataFrame(table)
    return F.broadcast(rows) if table.nbytes <= PLAN_BYTES else rows


def plan_rows(plans: Iterable[Plan], registry: dict) -> pa.Table:
    """The rows of ``plan_table`` in the driver."""
    plans = list(plans)
    names = [p.name for p in plans]
    if len(set(names)) != len(names):
        raise ValueError("plan names must be unique")
    return pa.table(
        {
            "plan": pa.array(names, pa.string()),
            "steps": pa.array(
                [[{"name": s.name, "inputs": list(s.inputs)} for s in p.steps] for p in plans], _STEPS
            ),
            "problem": pa.array([problem(p, registry, True) for p in plans], pa.string()),
            "problem_no_input": pa.array([problem(p, registry, False) for p in plans], pa.string()),
        }
    )


def step_table(spark: SparkSession, registry: dict) -> DataFrame:
    """The registered step names, one per row."""
    return spark.createDataFrame(pa.table({"step": pa.array(list(registry), pa.string())}))


def read_plans(spark: SparkSession, path: str) -> list[Plan]:
    """Plans from JSON files, one object per file: name and steps.

    A step is an object {name, inputs} or a bare name. Missing files, plans without
    steps and repeated names are errors.
    """
    raw = spark.read.schema("name string, steps array<variant>").json(path, multiLine=True)

    def normal(step):
        bare = F.schema_of_variant(step) == "STRING"
        name = F.when(bare, F.try_variant_get(step, "$", "string")).otherwise(
            F.try_variant_get(step, "$.name", "string")
        )
        inputs = F.coalesce(
            F.try_variant_get(step, "$.inputs", "array<string>"), F.array().cast("array<string>")
        )
        return F.struct(name.alias("name"), inputs.alias("inputs"))

    rows = raw.select("name", F.transform("steps", normal).alias("steps")).collect()
    found = [
        Plan(r["name"], tuple(Step(s["name"], tuple(s["inputs"])) for s in r["steps"] or ()))
        for r in rows
    ]
    if len({p.name for p in found}) != len(found):
        raise ValueError("plan names must be unique")
    return found
