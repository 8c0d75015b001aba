"""Run plans over a table of messages: one pass, no shuffle.

A step adds one VARIANT column, and later steps read it, so answers never turn into
text and back between two steps. All plans share the pass: position k of every plan goes
to one column, and the plan name picks the expression per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.functions import literal, settled
from verdict.functions.variants import described, stored_text, strict_variant, without_bom
from verdict.operators.records import broken_in_output, check_answers, coerce_label, count_accepted
from verdict.operators.scoring import (
    MISSING_TEXT,
    VERDICT,
    Scorer,
    build_answer,
    echo_answer,
    echoed,
    input_error,
    open_input,
    verdict_error,
)
from verdict.plans.model import (
    DEFAULT_INPUT,
    INPUT_POSITION,
    Binding,
    Plan,
    PlanProblem,
    resolve,
)
from verdict.plans.relational import run_many_plans
from verdict.plans.steps import EchoStep, StoreStep

#: Plans above this number are read as rows rather than written into the expression; the results are the same.
MANY_PLANS = 16


def _result(position: int) -> str:
    return "input" if position == INPUT_POSITION else f"_r{position}"


def _text(binding: Binding) -> str:
    if binding.position is not None:
        return f"to_json({_result(binding.position)})"
    parts = [
        f"to_json({_result(p)})" if isinstance(p, int) else literal(p) for p in binding.pieces
    ]
    return f"concat({', '.join(parts)})" if parts else "''"


def _variant(binding: Binding) -> str:
    if binding.position is not None:
        return _result(binding.position)
    return strict_variant(_text(binding))


class _Input:
    """One input of one step, which may bind differently for messages without an input."""

    def __init__(self, with_input: Binding | None, without: Binding | None):
        self.with_input = with_input
        self.without = without

    @property
    def is_default(self) -> bool:
        """The message input itself; without one its name is left, which is not JSON."""
        return self.with_input == Binding(position=INPUT_POSITION) and self.without in (
            None,
            Binding(pieces=(DEFAULT_INPUT,)),
        )

    def _either(self, render) -> str:
        if self.without is None or self.with_input == self.without:
            return render(self.with_input)
        if self.with_input is None:
            return render(self.without)
        return f"if(input IS NOT NULL, {render(self.with_input)}, {render(self.without)})"

    def text(self) -> str:
        return self._either(_text)

    def variant(self) -> str:
        return "input" if self.is_default else self._either(_variant)


def _bound(plan: Plan, registry: dict) -> list[list[_Input]] | None:
    """The inputs per step, or None where no message of the plan can finish."""

    def attempt(has_input):
        try:
            return resolve(plan, registry, has_input)
        except PlanProblem:
            return None

    full, bare = attempt(True), attempt(False)
    if full is None and bare is None:
        return None
    return [
        [
            _Input(full[k][i] if full else None, bare[k][i] if bare else None)
            for i in range(len(step.inputs))
        ]
        for k, step in enumerate(plan.steps)
    ]


class _Compiled:
    """Plans whose messages can finish, with the inputs of their steps bound."""

    def __init__(self, plans: Iterable[Plan], registry: dict):
        self.plans = {p.name: p for p in plans}
        self.registry = registry
        found = {name: _bound(p, registry) for name, p in self.plans.items()}
        self.inputs = {name: i for name, i in found.items() if i is not None}
        self.live = list(self.inputs)

    def steps(self, kind: type, name: str | None = None):
        """(plan, position, step) of every step of a kind, of one plan or of all."""
        return [
            (n, k, self.registry[step.name])
            for n in ([name] if name else self.live)
            for k, step in enumerate(self.plans[n].steps)
            if isinstance(self.registry[step.name], kind)
        ]

    def active(self, names: Iterable[str]) -> str:
        """Whether the row is a message to be run through one of these plans."""
        if set(names) == set(self.live):
            return "reason IS NULL"
        return f"(reason IS NULL AND plan IN ({', '.join(literal(n) for n in sorted(names))}))"

    def by_plan(self, choices: dict[str, str]) -> str:
        """The choice of the row's plan, null for other plans."""
        if len(self.live) == 1:
            return next(iter(choices.values()))
        cases = " ".join(f"WHEN {literal(n)} THEN {choice}" for n, choice in choices.items())
        return f"CASE plan {cases} END"


def _score_input(routed: DataFrame, compiled: _Compiled) -> tuple[DataFrame, dict[str, str]]:
    """Run the classifiers of the message input, whatever their position in a plan.

    They come first and together: the input is opened once, each classifier runs once per
    message, and what they share, such as the lower-cased text, is computed once. Adds
    ``_in``, ``_in_chosen`` and a verdict column per classifier, which is returned by name.
    """
    direct: dict[str, set[str]] = {}
    for n, k, step in compiled.steps(Scorer):
        if compiled.inputs[n][k][0].is_default:
            direct.setdefault(step.name, set()).add(n)
    if not direct:
        return routed, {}
    texts = {}
    for users in direct.values():
        texts.setdefault(frozenset(users), f"_text{len(texts)}")
    df = open_input(routed, "input", "_in").withColumns(
        {
            text: F.expr(f"CASE WHEN {compiled.active(users)} THEN _in_chosen.text END")
            for users, text in texts.items()
        }
    )
    verdicts = {name: f"_verdict{i}" for i, name in enumerate(direct)}
    for name, users in direct.items():
        df = compiled.registry[name].add_verdict(df, texts[frozenset(users)], verdicts[name])
    return df, verdicts


def run_plans(routed: DataFrame, plans: Iterable[Plan], registry: dict) -> DataFrame:
    """Run every message with a null ``reason`` through its plan.

    Needs ``plan``, ``input`` and ``reason``. Adds, each null where not run:

    - ``answers``: array of VARIANT, all inputs of the plan's store steps in order
    - ``results``: map of step name to result as JSON text, the message input included
    - ``bound``: array of (position, step, inputs) with the inputs as text

    A column that is not selected afterwards costs nothing.
    """
    compiled = _Compiled(plans, registry)
    plans, inputs, live = compiled.plans, compiled.inputs, compiled.live

    df, verdicts = _score_input(routed, compiled)
    direct = {name: f"_direct{i}" for i, name in enumerate(verdicts)}
    if direct:
        df = df.withColumns(
            {
                direct[name]: F.expr(build_answer(name, "input", "_in", "_in_chosen", verdict))
                for name, verdict in verdicts.items()
            }
        )

    for k in range(max((len(plans[n].steps) for n in live), default=0)):
        at_k: dict[str, list[str]] = {}
        for n in live:
            if k < len(plans[n].steps):
                at_k.setdefault(plans[n].steps[k].name, []).append(n)
        outputs: dict[str, str] = {}
        for j, (name, users) in enumerate(at_k.items()):
            step = registry[name]
            if isinstance(step, Scorer):
                relayed = [n for n in users if not inputs[n][k][0].is_default]
                outputs |= {n: direct[name] for n in users if n not in relayed}
                if relayed:
                    at = f"_at{k}_{j}"
                    first = compiled.by_plan({n: inputs[n][k][0].variant() for n in relayed})
                    value = f"CASE WHEN {compiled.active(relayed)} THEN {first} END"
                    df = df.withColumn(f"{at}_value", F.expr(value))
                    df = open_input(df, f"{at}_value", at)
                    df = df.withColumn(f"{at}_text", F.col(f"{at}_chosen.text"))
                    df = step.add_verdict(df, f"{at}_text", f"{at}_verdict")
                    answer = build_answer(
                        name, f"{at}_value", at, f"{at}_chosen", f"{at}_verdict"
                    )
                    df = df.withColumn(f"{at}_answer", F.expr(answer))
                    outputs |= {n: f"{at}_answer" for n in relayed}
            elif isinstance(step, EchoStep):
                # The value is a column of its own first, as the answer looks at it twice.
                value = compiled.by_plan({n: inputs[n][k][0].variant() for n in users})
                df = df.withColumn(f"_echo{k}_{j}", F.expr(value))
                outputs |= {n: echo_answer(f"_echo{k}_{j}") for n in users}
            elif isinstance(step, StoreStep):
                outputs |= {n: _summary([a.variant() for a in inputs[n][k]]) for n in users}
            else:
                raise TypeError(f"step {name} is of no known type")
        df = df.withColumn(f"_r{k}", F.expr(compiled.by_plan(outputs)))

    answers, results, bound = {}, {}, {}
    for name in live:
        steps = plans[name].steps
        stored = [
            arg.variant() for _, k, _ in compiled.steps(StoreStep, name) for arg in inputs[name][k]
        ]
        answers[name] = f"CAST(array({', '.join(stored)}) AS array<variant>)"
        last = {DEFAULT_INPUT: INPUT_POSITION} | {step.name: k for k, step in enumerate(steps)}
        entries = ", ".join(f"{literal(key)}, to_json({_result(p)})" for key, p in last.items())
        results[name] = f"map_filter(map({entries}), (k, v) -> v IS NOT NULL)"
        texts = [", ".join(a.text() for a in inputs[name][k]) for k in range(len(steps))]
        rows = ", ".join(
            f"named_struct('position', {k}, 'step', {literal(step.name)}, "
            f"'inputs', CAST(array({texts[k]}) AS array<string>))"
            for k, step in enumerate(steps)
        )
        bound[name] = f"array({rows})"
    added = {
        "answers": ("array<variant>", answers),
        "results": ("map<string,string>", results),
        "bound": ("array<struct<position:int,step:string,inputs:array<string>>>", bound),
    }

    def finished(kind, choices):
        if not live:
            return f"CAST(NULL AS {kind})"
        return settled(f"CASE WHEN reason IS NULL THEN {compiled.by_plan(choices)} END")

    return df.select(
        *routed.columns,
        *[F.expr(finished(*how)).alias(column) for column, how in added.items()],
    )


def _summary(answers: list[str]) -> str:
    """Result of a store step: how many of its inputs are accepted."""
    kept = count_accepted(f"array({', '.join(answers)})")
    return f"to_variant_object(named_struct('success', true, 'inserted_records', {kept}))"


def bind_inputs(run: DataFrame, *carry: str) -> DataFrame:
    """One row per executed step with its inputs as they were bound, in listed order."""
    return run.select(*carry, F.inline("bound"))


def stored_answers(
    routed: DataFrame, plans: Iterable[Plan], registry: dict, carry: Iterable[str] = ()
) -> DataFrame:
    """One checked row per store input, or one row with a null ``_nth`` where there is none.

    Adds ``_nth``, ``reject``, ``answer_json`` and the result columns to plan, reason and
    the ``carry`` columns.
    """
    plans, carry = list(plans), list(carry)
    if len(plans) > MANY_PLANS:
        return stored_objects(routed, plans, registry, carry)
    compiled = _Compiled(plans, registry)
    scorers = _stored_scorers(compiled)
    if scorers is not None:
        return _direct_answers(routed, compiled, scorers, carry)
    return stored_objects(routed, plans, registry, carry)


def stored_objects(
    routed: DataFrame, plans: Iterable[Plan], registry: dict, carry: Iterable[str] = ()
) -> DataFrame:
    """``stored_answers`` for any plan: each answer is an object, checked key by key."""
    plans = list(plans)
    ran = (run_many_plans if len(plans) > MANY_PLANS else run_plans)(routed, plans, registry)
    rows = ran.select("plan", "reason", *carry, F.posexplode_outer("answers").alias("_nth", "answer"))
    return check_answers(rows).withColumn("answer_json", F.to_json("answer")).drop("answer")


def _stored_scorers(compiled: _Compiled) -> dict[str, list[str]] | None:
    """Per plan the classifiers of the message input it stores; None if it stores more."""
    stored: dict[str, list[str]] = {}
    for name in compiled.live:
        stored[name] = []
        for _, k, _ in compiled.steps(StoreStep, name):
            for bound in compiled.inputs[name][k]:
                source = bound.with_input.position if bound.with_input else None
                if source is None or source < 0 or bound.without not in (None, bound.with_input):
                    return None
                step = compiled.registry[compiled.plans[name].steps[source].name]
                if not isinstance(step, Scorer) or not compiled.inputs[name][source][0].is_default:
                    return None
                stored[name].append(step.name)
    return stored if any(stored.values()) else None


def _direct_answers(
    routed: DataFrame, compiled: _Compiled, stored: dict[str, list[str]], carry: list[str]
) -> DataFrame:
    """``stored_answers`` where all answers come from classifiers of the message input.

    Such answers are known field by field, so they need not become objects to be looked
    into again: the fields taken from the message are cleaned and checked once per
    message, and what differs per classifier is a name and a flag.
    """
    df, verdicts = _score_input(routed, compiled)
    df = df.withColumns(
        {
            "_id": F.expr(described("_in.id")),
            "_label": F.expr(described("_in.label")),
            "_error": F.expr(input_error("input", "_in_chosen")),
        }
    )
    # Both candidates for the text may hold U+FEFF, and dropping it may leave nothing.
    df = df.withColumns(
        {
            "_id": F.expr(without_bom("_id")),
            "_label": F.expr(without_bom("_label")),
            "_content": F.expr(without_bom("_in_chosen")),
        }
    )
    broken = f"""CASE WHEN _error IS NOT NULL THEN 'bad_flag'
      ELSE {broken_in_output("_id", "_content", "_label")} END"""
    df = df.withColumn("_broken", F.expr(broken))
    # The part of the answer a reject is reported with; not built for clean messages.
    unclean = " OR ".join(
        ["_broken IS NOT NULL", *[f"{verdict_error(v)} IS NOT NULL" for v in verdicts.values()]]
    )
    output = f"""CASE WHEN NOT ({unclean}) THEN NULL WHEN _error = '{MISSING_TEXT}' THEN input
      WHEN _error IS NULL THEN {echoed("_in", "_in_chosen")} END"""

    def rows(scorers):
        entries = ", ".join(
            f"named_struct('model', {literal(n)}, 'verdict', {verdicts[n]})" for n in scorers
        )
        row = f"struct<model:string,verdict:{VERDICT.simpleString()}>"
        return f"CAST(array({entries}) AS array<{row}>)"

    every = compiled.by_plan({plan: rows(scorers) for plan, scorers in stored.items()})
    flat = df.select(
        "plan",
        "reason",
        *carry,
        F.expr(stored_text("_id")).alias("record_id"),
        F.expr(stored_text("_content")).alias("comment"),
        F.expr(coerce_label("_label")).alias("label"),
        "_error",
        "_broken",
        F.expr(output).alias("_output"),
        F.posexplode_outer(F.expr(f"CASE WHEN reason IS NULL THEN {every} END")).alias(
            "_nth", "_row"
        ),
    ).withColumn("_failed", F.expr(f"coalesce(_error, {verdict_error('_row.verdict')})"))
    answer = f"""named_struct('error', _failed,
      'is_hate_speech', CASE WHEN _failed IS NULL THEN _row.verdict.flagged END,
      'model', _row.model,
      'output', CASE WHEN _failed IS NULL OR _failed = '{MISSING_TEXT}' THEN _output END,
      'success', _failed IS NULL)"""
    return flat.selectExpr(
        "plan",
        "reason",
        *carry,
        "_nth",
        "CASE WHEN _failed IS NOT NULL THEN 'bad_flag' ELSE _broken END AS reject",
        f"to_json({answer}) AS answer_json",
        "record_id",
        "comment",
        "label",
        "_row.model AS model",
        "_row.verdict.flagged AS flagged",
        "CAST(NULL AS STRING) AS input_ts",
    )
