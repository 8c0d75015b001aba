"""The given tables as corpora and messages, and dirty variants of them.

Dirt follows from the document number by arithmetic, so the right answer is known
without the code under test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators.envelope import encode_messages
from verdict.operators.scoring import ColumnScorer, PandasScorer, lexicon, pandas_lexicon, registry
from verdict.plans.model import Plan, plan, read_plans
from verdict.plans.steps import EchoStep, StoreStep
from verdict.session import scratch_dir
from verdict.sources.corpus import labelled_documents

WORDS_A = ("idiot", "moron", "scum", "trash", "clown", "worthless")
WORDS_B = ("stupid", "pathetic", "loser", "disgusting", "trash")


def scorers():
    return [
        ColumnScorer("lexicon_a", flag=lexicon(WORDS_A)),
        ColumnScorer("lexicon_b", flag=lexicon(WORDS_B)),
    ]


def pandas_scorers():
    return [
        PandasScorer("lexicon_a", flag=pandas_lexicon(WORDS_A)),
        PandasScorer("lexicon_b", flag=pandas_lexicon(WORDS_B)),
    ]


def steps() -> dict:
    return registry(*scorers(), EchoStep("echo"), StoreStep("store"))


PLANS = (
    plan(
        "AB",
        ("lexicon_a", ["default_input"]),
        ("lexicon_b", ["default_input"]),
        ("store", ["lexicon_a", "lexicon_b"]),
    ),
    plan("Echo", ("echo", ["default_input"])),
    # A name used before it ran, a repeated step, templates with known and unknown names.
    plan(
        "Mixed",
        ("echo", ["lexicon_a"]),
        ("lexicon_a", ["default_input"]),
        ("echo", ['[{lexicon_a},"{{x}}"]']),
        ("echo", ["{nobody} {lexicon_a}"]),
        ("store", ["lexicon_a", "echo"]),
    ),
    plan("Broken", ("lexicon_a", ["default_input"]), ("nowhere", ["lexicon_a"])),
)


#: Each of the plans under 250 names.
COPIES = 250
MANY_PLANS = tuple(Plan(f"{p.name}_{i}", p.steps) for p in PLANS for i in range(COPIES))


def plans_from_files(spark: SparkSession) -> list[Plan]:
    """The plans, written to one file each and read back."""
    where = scratch_dir(spark, "plans")
    rows = [
        (p.name, [{"name": s.name, "inputs": list(s.inputs)} for s in p.steps]) for p in PLANS
    ]
    schema = "name string, steps array<struct<name: string, inputs: array<string>>>"
    spark.createDataFrame(rows, schema).write.option("maxRecordsPerFile", 1).json(where)
    return read_plans(spark, where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return labelled_documents(documents, table(spark, sf_dir, "labels"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without labels: (id, comment)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by text id: (id, label)."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("double").alias("label")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "props")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second corpus, without labels."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("text").alias("comment"),
        F.lit(None).cast("double").alias("label"),
    )


def number() -> Column:
    """The document number of a corpus row."""
    return F.col("id").cast("bigint")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message for plan AB."""
    return encode_messages(corpus(spark, sf_dir), "AB")


def routed_plan() -> Column:
    """Plans by document number, some of them unknown, broken, empty or absent."""
    return F.element_at(
        F.array(*[F.lit(p) for p in ("AB", "Echo", "Mixed", "Broken", "Nobody", "", None)]),
        (number() % 7 + 1).cast("int"),
    )


def many_plan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages, their plans under one of the many names by document number."""
    name = F.when(routed_plan() != "", F.concat(routed_plan(), F.lit("_"), number() % COPIES)).otherwise(routed_plan())
    return mixed_messages(spark, sf_dir, name)


def mixed_messages(spark: SparkSession, sf_dir: str, name: Column | None = None) -> DataFrame:
    """Messages for all plans; every thirteenth body is cut short or is no object."""
    rows = corpus(spark, sf_dir)
    body = F.to_json(
        F.struct(
            (routed_plan() if name is None else name).alias("plan"),
            F.struct("id", "comment", F.col("label").cast("string").alias("label")).alias("input"),
        )
    )
    damaged = (
        F.when(number() % 13 == 5, F.concat(body, F.lit(" and more")))
        .when(number() % 13 == 6, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return rows.select(damaged.alias("value"))


def input_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose input is an empty or odd JSON value by document number."""
    odd = ("{}", "[]", '""', "0", "0.0", "false", "null", "[0]", '" "', '{"id":null}')
    value = F.element_at(F.array(*[F.lit(v) for v in odd]), (number() % 11 + 1).cast("int"))
    return texts(spark, sf_dir).select(
        "id",
        F.when(
            number() % 11 == 10, F.to_json(F.struct(F.lit("AB").alias("plan"), F.col("id")))
        )
        .otherwise(F.concat(F.lit('{"plan":"AB","input":'), value, F.lit("}")))
        .alias("value"),
    )


#: Input times of some answers, as text and as a number.
TIME = "2025-03-01T08:00:00Z"
SECONDS = 1740816000

#: Plans none of whose messages can run; the last can run for messages without an input.
FAULTY_PLANS = (
    plan("NoInputs", "lexicon_a"),
    plan("Malformed", ("echo", ["{0}"])),
    plan("OnInput", ("echo", ["{default_input.id}"])),
)


def faulty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for the plans above by document number; every fourth has no input."""
    names = F.array(*[F.lit(p) for p in ("NoInputs", "Malformed", "OnInput", "OnInput")])
    given = F.when(number() % 4 != 3, F.struct("id", "comment"))
    body = F.struct(F.element_at(names, (number() % 4 + 1).cast("int")).alias("plan"), given.alias("input"))
    return texts(spark, sf_dir).select(F.to_json(body).alias("value"))


def faulty_scorers():
    """One that raises on texts with "scum", one that has no answer for texts with "clown"."""
    known = pandas_lexicon(WORDS_A)

    def raising(some):
        if some.str.contains("scum", regex=False).any():
            raise ValueError("scum")
        return known(some)

    def silent(some):
        return known(some).astype(object).where(~some.str.contains("clown", regex=False), None)

    return [PandasScorer("raising", flag=raising), PandasScorer("silent", flag=silent)]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer of lexicon_a per document as JSON text, half of them damaged or unusual."""
    rows = corpus(spark, sf_dir)
    r = number() % 22
    output = F.to_json(F.struct("id", "comment", "label"))
    good_flag = F.concat(
        F.lit('"is_hate_speech":'), lexicon(WORDS_A)(F.col("comment")).cast("string"), F.lit(",")
    )
    success = F.when(r == 2, '"true"').when(r == 9, "false").otherwise("true")
    model = F.when(r == 3, "").otherwise("lexicon_a")
    flag = F.when(r == 4, "").otherwise(good_flag)
    output = (
        F.when(r == 5, '"text"')
        .when(r == 6, F.to_json(F.struct(F.lit("").alias("id"), "comment", "label")))
        .when(r == 7, "{}")
        .when(
            r == 8, F.to_json(F.struct("id", "comment", F.array(F.lit(1)).alias("label")))
        )
        .when(
            r == 11,
            F.to_json(F.struct("id", F.col("comment").alias("text"), F.lit("other").alias("comment"), "label")),
        )
        .when(r == 12, F.to_json(F.struct("id", "comment", F.lit(True).alias("label"))))
        .when(r == 13, F.to_json(F.struct("id", "comment", F.lit(False).alias("label"))))
        .when(r == 14, F.to_json(F.struct("id", "comment", "label", F.lit(TIME).alias("timestamp"))))
        .when(r == 15, F.to_json(F.struct("id", "comment", "label", F.lit(SECONDS).alias("timestamp"))))
        .when(r == 16, F.to_json(F.struct("id", "comment", "label", F.lit(0).alias("timestamp"))))
        .otherwise(output)
    )
    whole = F.concat(
        F.lit('{"success":'), success, F.lit(',"model":"'), model, F.lit('",'), flag,
        F.lit('"output":'), output, F.lit("}"),
    )
    damaged = (
        F.when(r == 0, F.concat(whole, F.lit(" trailing")))
        .when(r == 1, F.concat(F.lit("  ﻿ \n"), whole))
        .when(r == 10, F.concat(F.lit("["), whole, F.lit("]")))
        .otherwise(whole)
    )
    return rows.select("id", damaged.alias("answer_text"))


# Label texts with the number each stands for, or None.
LABELS = (
    ("1", 1.0), (" 1 ", 1.0), ("1_000", 1000.0), ("1e3", 1000.0), (".5", 0.5), ("1.", 1.0),
    ("+1", 1.0), ("-0.25", -0.25), (" 7\n", 7.0), ("1e999", float("inf")), ("inf", float("inf")),
    ("-Infinity", float("-inf")), ("nan", None), ("1d", None), ("1f", None), ("0x10", None),
    ("1.0abc", None), ("1__0", None), ("_1", None), ("1e", None), (".", None), ("", None),
    ("abc", None),
)


def label_text() -> Column:
    return F.element_at(
        F.array(*[F.lit(text) for text, _ in LABELS]), (number() % len(LABELS) + 1).cast("int")
    )
