"""Classifier answers to result rows: clean, validate with a reason, coerce.

An answer is {success, model, is_hate_speech, output: {id, comment or text, label,
timestamp}}. The first rule it breaks names the reason; the other answers go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.functions import settled
from verdict.functions.text import clean_json_text, parse_number
from verdict.functions.variants import (
    described,
    is_boolean,
    is_falsy,
    is_object,
    is_unbindable,
    pick,
    stored_text,
    with_strict_variant,
    without_bom,
)

REASONS = (
    "invalid_json",
    "not_object",
    "bad_success",
    "missing_model",
    "bad_flag",
    "bad_output",
    "output_not_object",
    "unbindable",
)

RESULT_COLUMNS = ("record_id", "comment", "label", "model", "flagged", "input_ts")


def parse_answers(answers: DataFrame, text: str, into: str = "answer") -> DataFrame:
    """JSON text to VARIANT; null where the cleaned text is not exactly one JSON value."""
    cleaned = answers.withColumn("_clean", F.expr(clean_json_text(text)))
    return with_strict_variant(cleaned, "_clean", into).drop("_clean")


def canonical_json(answers: DataFrame, text: str, into: str) -> DataFrame:
    """Cleaned JSON written out again without spaces; null where invalid."""
    parsed = parse_answers(answers, text, "_parsed")
    return parsed.withColumn(into, F.to_json("_parsed")).drop("_parsed")


def coerce_label(seen: str) -> str:
    """A described label to double: text that is no number is null, booleans are 1 and 0."""
    return f"""CASE WHEN {seen}.kind = 'BOOLEAN' THEN if({seen}.text = 'true', 1.0D, 0.0D)
      ELSE {parse_number(f"{seen}.text")} END"""


# The rules run in stages, each a column of its own: a field is looked up and described
# once, and the generated code of each stage stays small.


def _opened(answer: str) -> str:
    top = pick(answer, "success", "model", "is_hate_speech", "output")
    return f"named_struct('is_json', {answer} IS NOT NULL, 'top', {top})"


def _looked_inside(opened: str) -> str:
    top = f"{opened}.top"
    inner = pick(f"{top}.output", "id", "text", "comment", "label", "timestamp")
    return f"""named_struct('is_json', {opened}.is_json, 'is_object', {top} IS NOT NULL,
      'success', {described(f"{top}.success")},
      'model', {described(f"{top}.model")},
      'flag', {described(f"{top}.is_hate_speech")},
      'output', {described(f"{top}.output")},
      'inner', {inner})"""


def _described_output(record: str) -> str:
    parts = ("id", "text", "comment", "label", "timestamp")
    fields = ", ".join(f"'{name}', {described(f'{record}.inner.{name}')}" for name in parts)
    return f"named_struct({fields})"


def _cleaned(record: str, output: str, drop_bom: bool = True) -> str:
    """The fields that are stored, and the content chosen among them."""

    def clean(seen):
        return without_bom(seen) if drop_bom else seen

    content = f"""if({is_falsy(clean(f"{output}.text"))},
      {clean(f"{output}.comment")}, {clean(f"{output}.text")})"""
    return f"""named_struct('model', {clean(f"{record}.model")},
      'output', {clean(f"{record}.output")},
      'id', {clean(f"{output}.id")},
      'content', {content},
      'label', {clean(f"{output}.label")},
      'timestamp', {clean(f"{output}.timestamp")})"""


def broken_in_output(ident: str, content: str, label: str) -> str:
    """The rule an output object breaks with its cleaned id, content and label, or null."""
    return f"""CASE WHEN {is_falsy(ident)} OR {is_falsy(content)} THEN 'bad_output'
      WHEN {is_unbindable(ident)} OR {is_unbindable(content)} OR {is_unbindable(label)}
      THEN 'unbindable' END"""


def _first_broken(record: str, cleaned: str) -> str:
    time = f"{cleaned}.timestamp"
    fields = broken_in_output(f"{cleaned}.id", f"{cleaned}.content", f"{cleaned}.label")
    return f"""coalesce(
      CASE WHEN NOT {record}.is_json THEN 'invalid_json'
        WHEN NOT {record}.is_object THEN 'not_object'
        WHEN NOT {is_boolean(f"{record}.success")} THEN 'bad_success'
        WHEN {is_falsy(f"{cleaned}.model")} THEN 'missing_model'
        WHEN NOT {is_boolean(f"{record}.flag")} THEN 'bad_flag'
        WHEN {is_falsy(f"{cleaned}.output")} THEN 'bad_output'
        WHEN NOT {is_object(f"{cleaned}.output")} THEN 'output_not_object' END,
      {fields},
      CASE WHEN {is_unbindable(f"{cleaned}.model")}
        OR ({is_unbindable(time)} AND NOT {is_falsy(time)}) THEN 'unbindable' END)"""


def count_accepted(answers: str) -> str:
    """How many of an array of answers break no rule."""
    return f"""size(filter(
      transform(
        transform(
          transform(transform({answers}, a -> {_opened("a")}), o -> {_looked_inside("o")}),
          r -> named_struct('record', r, 'output', {_described_output("r")})),
        p -> named_struct('record', p.record, 'cleaned', {_cleaned("p.record", "p.output")})),
      c -> {_first_broken("c.record", "c.cleaned")} IS NULL))"""


def check_answer_texts(answers: DataFrame, text: str) -> DataFrame:
    """``check_answers`` for answers that come as JSON text.

    Their text is cleaned before it is parsed, so a U+FEFF that was escaped stays.
    """
    parsed = parse_answers(answers, text, "_answer")
    return check_answers(parsed, "_answer", drop_bom=False).drop("_answer")


def check_answers(answers: DataFrame, answer: str = "answer", drop_bom: bool = True) -> DataFrame:
    """Add the result columns and ``reject``, the first broken rule or null.

    ``answer`` is a VARIANT that is null for text that was not JSON. U+FEFF is dropped
    from its fields. Nothing else is dropped and nothing is shuffled; callers split on
    ``reject``.
    """
    time = "_cleaned.timestamp"
    columns = {
        "reject": settled(_first_broken("_record", "_cleaned")),
        "record_id": stored_text("_cleaned.id"),
        "comment": stored_text("_cleaned.content"),
        "label": coerce_label("_cleaned.label"),
        "model": stored_text("_cleaned.model"),
        "flagged": "_record.flag.text = 'true'",
        "input_ts": f"CASE WHEN NOT {is_falsy(time)} THEN {stored_text(time)} END",
    }
    return (
        answers.withColumn("_opened", F.expr(_opened(answer)))
        .withColumn("_record", F.expr(_looked_inside("_opened")))
        .withColumn("_output", F.expr(_described_output("_record")))
        .withColumn("_cleaned", F.expr(_cleaned("_record", "_output", drop_bom)))
        .withColumns({name: F.expr(rule) for name, rule in columns.items()})
        .drop("_opened", "_record", "_output", "_cleaned")
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject").isNull()).select(*RESULT_COLUMNS)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject").isNotNull())


def insert_summary(checked: DataFrame) -> DataFrame:
    """One row: the answer of a multi-record insert call, absent fields left out."""
    counted = checked.agg(F.count_if(F.col("reject").isNull()).alias("inserted_records"))
    return counted.select(
        "inserted_records",
        F.to_json(
            F.struct(
                F.lit(True).alias("success"),
                F.col("inserted_records"),
                F.lit(None).cast("string").alias("error"),
            )
        ).alias("response"),
    )
