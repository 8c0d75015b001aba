"""Plans: binding against a small model in plain Python, routing, running."""

import json
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from acceptance import inputs as given
from acceptance.inputs import PLANS, steps
from verdict.operators.envelope import decode_messages
from verdict.operators.outcomes import route_messages, score_messages
from verdict.plans import model
from verdict.plans.model import (
    BAD_TEMPLATE,
    NO_INPUTS,
    UNKNOWN_STEP,
    Binding,
    Plan,
    PlanProblem,
    Step,
    bind,
    plan,
    plan_table,
    problem,
    read_plans,
    step_table,
)
from verdict.plans.relational import run_many_plans
from verdict.plans.routing import expand_steps, message_outcomes, runnable, unknown_steps
from verdict.plans.runner import bind_inputs, run_plans, stored_answers, stored_objects
from verdict.operators.scoring import registry
from verdict.plans.steps import EchoStep


def render(binding, results):
    if binding.position is not None:
        return results[binding.position]
    return "".join(results[p] if isinstance(p, int) else p for p in binding.pieces)


def python_bind(text, values):
    """The same with Python's own templates; raises what they raise, bar unknown names."""
    if text in values:
        return values[text]
    try:
        return text.format(**values)
    except KeyError:
        return text


def test_binding_follows_python_templates():
    rng = random.Random(2)
    names = ["a", "b", "a b"]
    values = dict(zip(names, ["RA", "{RB}", "RAB"]))
    known = {name: i for i, name in enumerate(names)}
    pieces = ["{", "}", "{{", "}}", "a", "b", "{a}", "{b}", "{c}", "{a b}", " ", "x", "{}", "{0}", "a b", '"']
    seen = set()
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 5)))
        try:
            want = python_bind(text, values)
        except (ValueError, IndexError, AttributeError):
            want = PlanProblem
        try:
            got = render(bind(text, known), list(values.values()))
        except PlanProblem as found:
            assert found.code == BAD_TEMPLATE
            got = PlanProblem
        assert got == want, text
        seen.add(want is PlanProblem)
    assert seen == {True, False}


def test_formats_and_lookups_are_malformed():
    known = {"a": 0}
    for text in ("{a:>9}", "{a!r}", "{a.b}", "{a[0]}"):
        with pytest.raises(PlanProblem):
            bind(text, known)
    assert bind("{a!s}", known) == Binding(pieces=(0,))
    assert bind("{z.b:>9}", known) == Binding(pieces=("{z.b:>9}",))


def test_why_plans_cannot_finish():
    known = steps()
    assert problem(plan("p", ("lexicon_a", ["default_input"])), known, True) is None
    assert problem(plan("p", "lexicon_a"), known, True) == NO_INPUTS
    assert problem(plan("p", ("nowhere", ["x"])), known, True) == UNKNOWN_STEP
    assert problem(plan("p", ("echo", ["{"])), known, True) == BAD_TEMPLATE
    # Only with an input is the name known, and the rest of the template looked at.
    template = plan("p", ("echo", ["{default_input} {"]))
    assert problem(template, known, True) == BAD_TEMPLATE
    assert problem(template, known, False) is None
    # The first problem in step order counts.
    assert problem(plan("p", ("nowhere", ["x"]), ("echo", ["{"])), known, True) == UNKNOWN_STEP


def test_plans_need_steps():
    with pytest.raises(ValueError):
        Plan("p", ())


def test_read_plans(spark, tmp_path):
    (tmp_path / "one.json").write_text(
        json.dumps({"name": "One", "steps": [{"name": "a", "function": "a", "inputs": ["x", "y"], "timeout": 5}, "b"]}, indent=1)
    )
    (tmp_path / "two.json").write_text(json.dumps({"name": "Two", "steps": ["b"]}))
    found = {p.name: p for p in read_plans(spark, str(tmp_path))}
    assert found == {
        "One": Plan("One", (Step("a", ("x", "y")), Step("b"))),
        "Two": Plan("Two", (Step("b"),)),
    }
    (tmp_path / "three.json").write_text(json.dumps({"name": "Three", "steps": []}))
    with pytest.raises(ValueError):
        read_plans(spark, str(tmp_path))
    with pytest.raises(Exception):
        read_plans(spark, str(tmp_path / "missing"))


def test_plan_table_is_broadcast_by_its_size(spark):
    table = plan_table(spark, PLANS, steps())
    assert table.count() == len(PLANS)
    joined = spark.createDataFrame([("AB",)], "plan string").join(table, "plan", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.range(9).selectExpr("cast(id as string) as plan").join(table, "plan", "left")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError):
        plan_table(spark, [PLANS[0], PLANS[0]], steps())


def bodies(spark, messages):
    return spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m),) for m in messages], "value string")


def test_decoding(spark):
    cases = [
        ({"plan": "AB", "input": {"id": 1}}, ("AB", '{"id":1}', None)),
        ({"plan": "AB"}, ("AB", None, None)),
        ({"plan": "AB", "input": {}}, ("AB", None, None)),
        ({"input": {"id": 1}}, (None, '{"id":1}', "missing_plan")),
        ({"plan": "", "input": 1}, (None, "1", "missing_plan")),
        ({"plan": 0}, (None, None, "missing_plan")),
        ({"plan": 7}, ("7", None, None)),
        ([1], (None, None, "bad_message")),
        ("nonsense", (None, None, "bad_message")),
        ('{"plan":"AB"} {"plan":"AB"}', (None, None, "bad_message")),
    ]
    df = bodies(spark, [m for m, _ in cases]).withColumn("n", F.monotonically_increasing_id())
    rows = decode_messages(df).orderBy("n").select("plan", F.to_json("input"), "reason").collect()
    assert [tuple(r) for r in rows] == [want for _, want in cases]


def test_bytes_must_be_utf8(spark):
    df = spark.createDataFrame(
        [(bytearray(b'{"plan":"AB","input":"\xc3\xa9"}'),), (bytearray(b'{"plan":"AB","input":"\xff"}'),)], "value binary"
    )
    rows = decode_messages(df).select("reason", F.to_json("input")).collect()
    assert [tuple(r) for r in rows] == [(None, '"é"'), ("bad_message", None)]


ECHO = registry(EchoStep("echo"), EchoStep("other"), EchoStep("third"))


def run_model(steps_, message_input):
    """Results and bound inputs of a plan of echo steps, in plain Python."""
    results = {} if message_input is None else {"default_input": dump(message_input)}
    bound = []
    for name, inputs in steps_:
        values = [python_bind(text, results) for text in inputs]
        bound.append(values)
        try:
            answer = {"output": json.loads(values[0]), "success": True}
        except ValueError:
            answer = {"error": "invalid_json", "success": False}
        results[name] = dump(answer)
    return results, bound


def dump(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_runs_follow_the_model(spark):
    """Generated plans: forward references, repeated names, templates, no input; one pass."""
    rng = random.Random(4)
    names = list(ECHO)
    plans, want = [], {}
    for p in range(12):
        parts = []
        for _ in range(rng.randint(1, 4)):
            pool = [*names, "default_input", "text", "5", *("{%s}" % n for n in names), '["{{{echo}"]'.replace("{{{", "{"),
                    "[{default_input},{default_input}]", "{nobody}", "{{}}"]
            parts.append((rng.choice(names), [rng.choice(pool) for _ in range(rng.randint(1, 2))]))
        plans.append(plan(f"p{p}", *parts))
        for i, value in enumerate(({"id": "1", "x": [1, None]}, None)):
            want[(f"p{p}", i)] = run_model(parts, value)
    messages = [
        {"plan": p.name, "input": value} | {"n": i}
        for p in plans
        for i, value in enumerate(({"id": "1", "x": [1, None]}, None))
    ]
    df = bodies(spark, messages).withColumn("n", F.get_json_object("value", "$.n").cast("int"))
    run = run_plans(route_messages(df, plans, ECHO), plans, ECHO)
    got = {}
    for r in run.select("plan", "n", "reason", "results", "bound").collect():
        assert r["reason"] is None
        got[(r["plan"], r["n"])] = (r["results"], [b["inputs"] for b in r["bound"]])
    assert got == want


ODD_INPUTS = [
    {"id": "1", "comment": "what an idiot", "label": "1"},
    {"id": 2, "text": "you clown", "comment": "fine", "label": 0.5},
    {"id": "3", "text": "", "comment": "loser"},
    {"id": "4", "text": "﻿", "comment": "fine"},
    {"id": "﻿", "comment": "fine"},
    {"id": "5﻿5", "comment": "tr﻿ash trash", "label": "﻿1"},
    {"id": "6"},
    {"id": "7", "comment": {}},
    {"id": "8", "text": [], "comment": "stupid"},
    {"id": "9", "comment": 5, "label": True},
    {"id": "10", "comment": True, "label": [1]},
    {"id": [], "comment": "fine"},
    {"id": {"a": 1}, "comment": "fine"},
    {"id": 2**63, "comment": "fine"},
    {"id": "11", "comment": "fine", "label": {}},
    {"id": "12", "comment": "fine", "label": "nan", "timestamp": "2025"},
    {"comment": "fine"},
    "a text", [1], 5, True,
    {}, None, 0, "",
]


def test_both_ways_to_check_answers_agree(spark):
    """Fields checked once per message against whole answers checked key by key."""
    messages = [{"plan": "AB", "input": value} for value in ODD_INPUTS] + ["{", {"plan": "Nobody"}]
    routed = route_messages(bodies(spark, messages), PLANS[:1], steps()).withColumn(
        "n", F.monotonically_increasing_id()
    )
    stored = ["model", "record_id", "comment", "label", "flagged"]

    def rows(how):
        df = how(routed, PLANS[:1], steps(), carry=["n"])
        # A rejected answer is only reported, an accepted one only stored.
        out = []
        for r in df.collect():
            if r["_nth"] is None:
                out.append((r["n"], None, r["reason"]))
            elif r["reject"] is None:
                out.append((r["n"], r["_nth"], None, *[r[c] for c in stored]))
            else:
                out.append((r["n"], r["_nth"], r["reject"], r["answer_json"]))
        return sorted(out, key=repr)

    direct, general = rows(stored_answers), rows(stored_objects)
    assert direct == general
    assert {r[2] for r in direct if r[1] is not None} == {
        None, "bad_flag", "bad_output", "unbindable"
    }


def test_outcomes_of_odd_messages(spark):
    messages = [{"plan": "AB", "input": ODD_INPUTS[0]}, {"plan": "AB"}, {"plan": "Echo", "input": 1}, {"plan": "Broken", "input": 1}, "x"]
    rows = score_messages(bodies(spark, messages), PLANS, steps()).collect()
    kinds = sorted((r["kind"], r["first"], r["reason"]) for r in rows if r["kind"] != "accepted")
    assert kinds == [
        ("dead", True, "bad_message"), ("dead", True, "unknown_step"), ("empty", True, None),
        ("rejected", False, "bad_flag"), ("rejected", True, "bad_flag"),
    ]
    assert sum(r["first"] for r in rows) == len(messages)
    assert {r["body"] for r in rows if r["reason"] == "bad_message"} == {"x"}


def test_expanding_and_unknown_steps(spark):
    routed = route_messages(bodies(spark, [{"plan": "Broken", "input": 1}, {"plan": "AB", "input": 1}]), PLANS, steps())
    assert [r["step"] for r in expand_steps(runnable(routed)).orderBy("position").collect()] == [
        "lexicon_a", "lexicon_b", "store",
    ]
    found = unknown_steps(expand_steps(routed), step_table(spark, steps())).collect()
    assert [(r["plan"], r["step"], r["position"]) for r in found] == [("Broken", "nowhere", 1)]
    done = {r["plan"]: r["completed"] for r in message_outcomes(routed).collect()}
    assert done == {"Broken": False, "AB": True}


def test_no_plan_can_finish(spark):
    broken = [plan("Broken", ("nowhere", ["x"]))]
    df = bodies(spark, [{"plan": "Broken", "input": 1}])
    routed = route_messages(df, broken, steps())
    assert run_plans(routed, broken, steps()).first()["results"] is None
    assert [r["reason"] for r in score_messages(df, broken, steps()).collect()] == ["unknown_step"]


def test_names_may_hold_quotes(spark):
    odd = "it's \\ {x} \"q\""
    names = registry(EchoStep(odd))
    plans = [plan(odd, (odd, ["default_input"]), (odd, [odd]))]
    run = run_plans(route_messages(bodies(spark, [{"plan": odd, "input": [1]}]), plans, names), plans, names)
    inner = dump({"output": [1], "success": True})
    assert run.first()["results"][odd] == dump({"output": json.loads(inner), "success": True})
    assert bind_inputs(run).filter("position = 1").first()["inputs"] == [inner]


def test_classifier_fed_by_an_earlier_step(spark):
    fed = [plan("Fed", ("echo", ["default_input"]), ("lexicon_a", ['{{"id":"7","text":"an idiot"}}']),
                ("lexicon_b", ["echo"]), ("store", ["lexicon_a", "lexicon_b"]))]
    rows = score_messages(bodies(spark, [{"plan": "Fed", "input": {"id": "1", "text": "x"}}]), fed, steps()).collect()
    got = sorted((r["kind"], r["reason"], r["record_id"], r["model"], r["flagged"]) for r in rows)
    assert got == [("accepted", None, "7", "lexicon_a", True), ("rejected", "bad_flag", None, None, None)]


def test_a_plan_may_only_run_without_an_input(spark):
    plans = [plan("T", ("echo", ["{default_input} {"]), ("store", ["echo"]))]
    messages = bodies(spark, [{"plan": "T", "input": 1}, {"plan": "T"}])
    run = run_plans(route_messages(messages, plans, steps()), plans, steps())
    got = {r["reason"]: r["results"] for r in run.collect()}
    assert got["bad_template"] is None
    assert set(got[None]) == {"echo", "store"}
    assert json.loads(got[None]["store"]) == {"success": True, "inserted_records": 0}
    kinds = sorted(r["kind"] for r in score_messages(messages, plans, steps()).collect())
    assert kinds == ["dead", "rejected"]


def both_runs(routed, plans, steps):
    columns = ["id", "plan", "answers", "results", "bound"]
    for run in (run_plans, run_many_plans):
        out = run(runnable(routed), plans, steps).withColumn("id", F.try_variant_get("input", "$.id", "string"))
        out = out.withColumns({"answers": F.expr("transform(answers, a -> to_json(a))"), "results": F.expr("array_sort(map_entries(results))")})
        yield Counter(str(row) for row in out.select(*columns).collect())


def test_plans_as_rows_equal_plans_as_code(spark, sf_dir):
    routed = route_messages(given.mixed_messages(spark, sf_dir), given.PLANS, given.steps())
    code, rows = both_runs(routed, given.PLANS, given.steps())
    assert code == rows and code.total() > 50
    faulty = route_messages(given.faulty_messages(spark, sf_dir), given.FAULTY_PLANS, given.steps())
    code, rows = both_runs(faulty, given.FAULTY_PLANS, given.steps())
    assert code == rows and code.total() > 0


def test_odd_plans_as_rows(spark):
    """Repeated steps, templates of several results, relayed answers, stores of texts that are no JSON, bare inputs."""
    steps = given.steps() | registry(EchoStep("again"))
    plans = [
        plan("Relay", ("echo", ["default_input"]), ("lexicon_a", ["echo"]), ("echo", ["lexicon_a"]), ("store", ["echo", "lexicon_a", "text", "{echo}"])),
        plan("Braces", ("echo", ['{{"a": 1}}']), ("again", ["[{echo}, {default_input}]"]), ("store", ["again"]), ("store", ["store"])),
        plan("Bare", ("lexicon_b", ["default_input"]), ("echo", [""]), ("store", ["lexicon_b", "echo"])),
    ]
    inputs = ['{"id": "1", "comment": "an idiot"}', '{"text": "scum", "label": 1}', "{}", '"text"', "[1]", "null"]
    bodies = [(f'{{"plan": "{p.name}", "input": {i}}}',) for p in plans for i in inputs]
    routed = route_messages(spark.createDataFrame(bodies, "value string"), plans, steps)
    code, rows = both_runs(routed, plans, steps)
    assert code == rows and code.total() > 10


def test_code_does_not_grow_with_plans(spark, sf_dir):
    def size(plans):
        routed = route_messages(given.many_plan_messages(spark, sf_dir), plans, given.steps())
        started = time.perf_counter()
        planned = run_many_plans(routed, plans, given.steps())._jdf.queryExecution().optimizedPlan().toString()
        return len(re.sub(r"\[\[.*?\]\]|#\d+", "", planned)), time.perf_counter() - started

    few, many = size(given.MANY_PLANS[:750:50]), size(given.MANY_PLANS)
    assert many[0] < 1.3 * few[0]
    assert many[1] < few[1] + 5


def test_no_plans_as_rows(spark, sf_dir):
    routed = route_messages(given.messages(spark, sf_dir), [], given.steps())
    assert run_many_plans(routed, [], given.steps()).filter("results IS NOT NULL").count() == 0


def test_a_frequent_plan_is_spread(spark, sf_dir, monkeypatch):
    """Without broadcast: the same rows, no task with over twice the median, dead messages never shuffled."""
    plans = [*given.PLANS, *given.MANY_PLANS]
    many = given.many_plan_messages(spark, sf_dir).crossJoin(spark.range(20)).select("value")
    messages = many.unionByName(given.messages(spark, sf_dir).crossJoin(spark.range(30)).select("value")).repartition(8)
    columns = ["plan", "value", "reason", F.to_json("input").alias("input"), F.to_json(F.struct("steps")).alias("steps")]
    want = Counter(map(tuple, route_messages(messages, plans, given.steps()).select(*columns).collect()))
    monkeypatch.setattr(model, "PLAN_BYTES", 0)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        routed = route_messages(messages, plans, given.steps())
        assert Counter(map(tuple, routed.select(*columns).collect())) == want
        rows = routed.filter("reason IS NULL OR reason NOT IN ('bad_message', 'missing_plan')").groupBy(F.spark_partition_id().alias("p"))
        counts = sorted(r["count"] for r in rows.count().collect())
        assert len(counts) >= 14 and counts[-1] <= 2 * counts[len(counts) // 2]
        tree = routed._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\n[^\n]*\bExchange hashpartitioning\(plan", tree)) == 2 and "Union" in tree
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    empty = spark.createDataFrame([], "value string")
    assert route_messages(empty, plans, given.steps()).count() == 0
