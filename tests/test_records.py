"""Answer validation against an independent model of the rules in plain Python."""

import json
import random

from pyspark.sql import functions as F

from verdict.functions.variants import strict_variant
from verdict.operators.records import (
    REASONS,
    RESULT_COLUMNS,
    accepted,
    canonical_json,
    check_answer_texts,
    check_answers,
    count_accepted,
    insert_summary,
    rejected,
)

MISSING = object()
ODD = [None, True, False, 0, 1, 0.0, 2.5, "", "x", "true", "﻿", "a﻿b", {}, {"k": 1}, [], [0], 2**63, "7"]


def model_number(value):
    if value is None:
        return None
    if isinstance(value, str):
        try:
            number = float(value)
        except ValueError:
            return None
        return None if number != number else number
    return float(value)


def model_text(value):
    if isinstance(value, bool):
        return "1" if value else "0"
    return value if isinstance(value, str) or value is None else str(value)


def bindable(value):
    if isinstance(value, (dict, list)):
        return False
    return not isinstance(value, int) or -(2**63) <= value < 2**63


def model(text):
    """(reason, row) of one answer text."""
    try:
        value = json.loads(text.strip().replace("﻿", ""))
    except ValueError:
        return "invalid_json", None
    if not isinstance(value, dict):
        return "not_object", None
    if not isinstance(value.get("success"), bool):
        return "bad_success", None
    if not value.get("model"):
        return "missing_model", None
    if not isinstance(value.get("is_hate_speech"), bool):
        return "bad_flag", None
    out = value.get("output")
    if not out:
        return "bad_output", None
    if not isinstance(out, dict):
        return "output_not_object", None
    content = out.get("text") or out.get("comment")
    if not out.get("id") or not content:
        return "bad_output", None
    time = out.get("timestamp") or None
    if not all(bindable(v) for v in (out["id"], content, out.get("label"), value["model"], time)):
        return "unbindable", None
    row = (
        model_text(out["id"]), model_text(content), model_number(out.get("label")),
        model_text(value["model"]), value["is_hate_speech"], model_text(time),
    )
    return None, row


def random_answer(rng):
    def maybe(value, odds=0.12):
        return rng.choice([*ODD, MISSING]) if rng.random() < odds else value

    def known(pairs):
        return {k: v for k, v in pairs if v is not MISSING}

    output = known(
        [
            ("id", maybe("id-7")),
            ("comment", maybe("a comment")),
            ("text", maybe("", 0.3)),
            ("label", maybe(rng.choice(["1", "0.25", "abc", "1_0", 1, 0.5, None]), 0.2)),
            ("timestamp", maybe(rng.choice(["2025-01-06", MISSING]), 0.2)),
            ("extra", {"nested": [1]}),
        ]
    )
    answer = known(
        [
            ("success", maybe(rng.choice([True, False]))),
            ("model", maybe("m")),
            ("is_hate_speech", maybe(rng.choice([True, False]))),
            ("output", maybe(output)),
        ]
    )
    text = json.dumps(answer, ensure_ascii=rng.random() < 0.1)
    # An escaped U+FEFF survives the cleaning, a plain one does not.
    dirt = rng.random()
    if dirt < 0.05:
        return text + rng.choice([" x", "}", ",", text, "﻿]"])
    if dirt < 0.1:
        return rng.choice(["[%s]", '"%s"', "  ﻿%s\n", "﻿ %s", "\x1c%s ", " %s"]) % text
    return text


def checked(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    return check_answer_texts(df, "t")


def test_rules_follow_the_model(spark):
    rng = random.Random(11)
    texts = [random_answer(rng) for _ in range(5000)]
    want = [model(t) for t in texts]
    rows = checked(spark, texts).orderBy("n").collect()
    assert [r["reject"] for r in rows] == [reason for reason, _ in want]
    assert {reason for reason, _ in want} == {None, *REASONS}
    got = [tuple(r[c] for c in RESULT_COLUMNS) for r in rows if r["reject"] is None]
    assert got == [row for reason, row in want if reason is None]


def test_counting_inside_a_row_agrees(spark):
    rng = random.Random(12)
    texts = [random_answer(rng).strip().replace("﻿", "").replace("\\ufeff", "") for _ in range(600)]
    df = spark.createDataFrame([(i // 6, t) for i, t in enumerate(texts)], "n int, t string")
    arrays = df.groupBy("n").agg(F.collect_list("t").alias("ts")).withColumn(
        "vs", F.expr(f"transform(ts, t -> {strict_variant('t')})")
    )
    got = {r["n"]: r["k"] for r in arrays.select("n", F.expr(count_accepted("vs")).alias("k")).collect()}
    want = {n: sum(model(t)[0] is None for t in texts[6 * n : 6 * n + 6]) for n in range(100)}
    assert got == want


def test_split_loses_nothing(spark):
    rng = random.Random(13)
    both = checked(spark, [random_answer(rng) for _ in range(300)])
    assert accepted(both).count() + rejected(both).count() == 300


def test_summary(spark):
    good = '{"success":true,"model":"m","is_hate_speech":false,"output":{"id":1,"text":"t"}}'
    row = insert_summary(checked(spark, [good, "x", good])).first()
    assert row["inserted_records"] == 2
    assert json.loads(row["response"]) == {"success": True, "inserted_records": 2}
    empty = insert_summary(checked(spark, ["x"]).filter("n < 0")).first()
    assert json.loads(empty["response"]) == {"success": True, "inserted_records": 0}


def test_older_shape_is_rejected(spark):
    old = '{"ModelA": {"is_hate_speech": true}, "ModelB": {"is_hate_speech": false}}'
    assert checked(spark, [old]).first()["reject"] == "bad_success"


def test_canonical_text(spark):
    df = spark.createDataFrame([('  {"b" : [1, 2],\n "a": "x﻿y"} ',), ("{",)], "t string")
    assert [r["c"] for r in canonical_json(df, "t", "c").collect()] == ['{"a":"xy","b":[1,2]}', None]


def test_values_are_cleaned_where_no_text_was(spark):
    text = '{"success":true,"model":"m","is_hate_speech":true,"output":{"id":"1﻿2","text":"﻿","comment":"c"}}'
    df = spark.createDataFrame([(text,)], "t string").withColumn("answer", F.expr("parse_json(t)"))
    row = check_answers(df).first()
    assert (row["reject"], row["record_id"], row["comment"]) == (None, "12", "c")
