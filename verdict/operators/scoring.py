"""Text classifiers and the registry that names them.

A scorer adds one column ``struct<flagged: boolean, error: string>`` for a text column,
flagged being null for a null text. It never fails a job for one bad text: the error
lands in the row.
"""

from __future__ import annotations

import gc
import numbers
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from verdict.functions import literal
from verdict.functions.text import first_text
from verdict.functions.variants import described_text, is_falsy, pick
from verdict.session import give_back, small_batches

VERDICT = StructType(
    [StructField("flagged", BooleanType()), StructField("error", StringType())]
)

INVALID_INPUT = "invalid_input"
MISSING_TEXT = "missing_text"
NO_VERDICT = "no_verdict"


@dataclass(frozen=True, eq=False)
class Scorer:
    """A named classifier.

    ``check`` is a condition every row of a scored, labelled sample must meet.
    ``require_check`` makes ``require_smoke`` raise unless all of them do.
    """

    name: str
    check: Column | None = None
    require_check: bool = False

    needs_input = True

    def add_verdict(self, df: DataFrame, text: str, into: str) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class ColumnScorer(Scorer):
    """A classifier written as a Column expression; runs inside code generation."""

    flag: Callable[[Column], Column] = None

    def add_verdict(self, df, text, into):
        flagged = self.flag(F.col(text)).cast("boolean")
        return df.withColumn(
            into,
            F.struct(flagged.alias("flagged"), F.lit(None).cast("string").alias("error")),
        )


#: What the set-up functions of scorers made in this Python worker.
_ready: dict[str, object] = {}


def made_once(key: str, setup: Callable[[], object]) -> object:
    """What ``setup`` makes, made by the first call in this Python worker."""
    if key not in _ready:
        _ready[key] = setup()
    return _ready[key]


@dataclass(frozen=True, eq=False)
class PandasScorer(Scorer):
    """Any Python model: a function from a Series of texts to a Series of booleans.

    Only the text column travels to Python. Answers are booleans, 0 or 1, and null or NaN for
    no verdict; any other is an error of its text. When a batch fails, its halves are tried, and
    theirs, so that an error stays with the text that caused it, at a cost of two calls for
    each halving.

    ``setup`` makes what is costly to make, as a loaded model, once for each Python worker and
    not for each batch or task; ``flag`` then takes it before the texts. It may read a broadcast variable,
    so that a large model travels once to each executor and not with the code. When it fails, all texts of
    the worker get its error, and the next batch tries again.

    Batches are bounded by bytes, and a worker gives back what one has taken before it reads the next.
    """

    flag: Callable[..., pd.Series] = None
    setup: Callable[[], object] | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def add_verdict(self, df, text, into):
        given, setup, key = self.flag, self.setup, self.key

        def classify(texts):
            return given(texts) if setup is None else given(made_once(key, setup), texts)

        def flag(answer):
            if answer is None or answer is pd.NA or answer != answer:
                return None, None
            if isinstance(answer, (bool, np.bool_)) or (isinstance(answer, numbers.Number) and answer in (0, 1)):
                return bool(answer), None
            return None, "ValueError"

        def tried(texts):
            try:
                answers = pd.Series(classify(texts)).astype(object)
                if len(answers) != len(texts):
                    raise ValueError("one answer for each text")
                return [flag(answer) for answer in answers]
            except Exception as error:
                if len(texts) == 1:
                    return [(None, type(error).__name__)]
            middle = len(texts) // 2
            return tried(texts.iloc[:middle]) + tried(texts.iloc[middle:])

        def answered(texts: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"flagged": None, "error": None}, index=texts.index, dtype=object)
            present = texts.notna()
            known = texts[present]
            if len(known):
                try:
                    if setup is not None:
                        made_once(key, setup)
                    each = tried(known)
                except Exception as error:
                    each = [(None, type(error).__name__)] * len(known)
                out.loc[present, "flagged"] = [flagged for flagged, _ in each]
                out.loc[present, "error"] = [error for _, error in each]
            return out

        @F.pandas_udf(VERDICT)
        def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield answered(texts)
                del texts
                # A Series whose ``str`` was used refers to itself, so its texts stay until they are looked for.
                gc.collect()
                give_back()

        small_batches(df.sparkSession)
        return df.withColumn(into, verdicts(F.col(text)))


@dataclass(frozen=True, eq=False)
class ModelScorer(Scorer):
    """A fitted ``pyspark.ml`` transformer; a prediction of at least 0.5 flags the text."""

    transformer: object = None
    text_col: str = "text"
    prediction_col: str = "prediction"

    def add_verdict(self, df, text, into):
        kept = [c for c in df.columns if c != into]
        row = F.struct(*[F.col(c) for c in kept]).alias("_row")
        scored = self.transformer.transform(
            df.select(row, F.coalesce(F.col(text), F.lit("")).alias(self.text_col))
        )
        flagged = F.when(
            F.col(f"_row.{text}").isNotNull(), F.col(self.prediction_col) >= 0.5
        )
        no_error = F.lit(None).cast("string").alias("error")
        return scored.select(
            *[F.col(f"_row.{c}").alias(c) for c in kept],
            F.struct(flagged.alias("flagged"), no_error).alias(into),
        )


def lexicon(words: Iterable[str]) -> Callable[[Column], Column]:
    """Flag a text that holds one of the words, with no letter a-z right next to it.

    The plain search comes first: it works on bytes and rules most texts out, and the
    pattern is tried only where some word occurs at all.
    """
    words = tuple(words)
    pattern = rf"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"

    def flag(text: Column) -> Column:
        low = F.lower(text)
        occurs = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            occurs = occurs | F.contains(low, F.lit(word))
        return occurs & low.rlike(pattern)

    return flag


def pandas_lexicon(words: Iterable[str]) -> Callable[[pd.Series], pd.Series]:
    """The same rule over a pandas Series."""
    pattern = rf"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"

    def flag(texts: pd.Series) -> pd.Series:
        return texts.str.lower().str.contains(pattern, regex=True)

    return flag


def registry(*steps) -> dict:
    """Steps by name; a later one replaces an earlier one of the same name."""
    return {step.name: step for step in steps}


def add_verdicts(corpus: DataFrame, scorers: Iterable[Scorer]) -> DataFrame:
    """Run every scorer over every row: adds ``verdicts``, a struct with a field per scorer.

    ``corpus`` holds ``comment`` and may hold ``text``, which wins where it is not empty.
    A field is (model, success, flagged, error). All scorers share one projection.
    """
    scorers = list(scorers)
    candidates = [F.col(c) for c in ("text", "comment") if c in corpus.columns]
    df = corpus.withColumn("_text", first_text(*candidates))
    for i, scorer in enumerate(scorers):
        df = scorer.add_verdict(df, "_text", f"_v{i}")
    entries = []
    for i, scorer in enumerate(scorers):
        error = f"""coalesce(
          CASE WHEN _text IS NULL THEN '{MISSING_TEXT}' END, {verdict_error(f"_v{i}")})"""
        entries.append(
            F.struct(
                F.lit(scorer.name).alias("model"),
                F.expr(f"{error} IS NULL").alias("success"),
                F.expr(f"CASE WHEN {error} IS NULL THEN _v{i}.flagged END").alias("flagged"),
                F.expr(error).alias("error"),
            ).alias(f"v{i}")
        )
    return df.select(*corpus.columns, F.struct(*entries).alias("verdicts"))


def one_row_per_model(scored: DataFrame, carry: Iterable[str]) -> DataFrame:
    """One row per field of ``verdicts``, next to the ``carry`` columns.

    The array is made here: for one that is a column already the optimizer would infer a
    filter on its size, and evaluate the scorers once more to compute it.
    """
    names = scored.schema["verdicts"].dataType.names
    return scored.select(*carry, F.inline(F.array(*[F.col(f"verdicts.{n}") for n in names])))


def score_corpus(corpus: DataFrame, scorers: Iterable[Scorer], carry: Iterable[str] = ()) -> DataFrame:
    """Every row to every scorer in one pass: one answer row per (row, model).

    Only the ``carry`` columns go along, so a narrow result never drags the texts.
    No shuffle.
    """
    return one_row_per_model(add_verdicts(corpus, scorers), carry)


def verdict_error(verdict: str) -> str:
    """Why a text that was there has no flag, or null."""
    return f"coalesce({verdict}.error, CASE WHEN {verdict}.flagged IS NULL THEN '{NO_VERDICT}' END)"


def open_input(df: DataFrame, value: str, into: str) -> DataFrame:
    """Add what a scorer needs of its input, a VARIANT that is null for text not JSON.

    ``{into}`` is the input's fields; ``{into}_chosen`` describes the one to classify:
    ``text``, else ``comment``, null where neither says anything. Empty objects and
    arrays do say something here.
    """
    text, comment = f"{into}_a", f"{into}_b"
    chosen = f"""CASE WHEN NOT {is_falsy(text, empty_containers=False)} THEN {text}
      WHEN NOT {is_falsy(comment, empty_containers=False)} THEN {comment} END"""
    return (
        df.withColumn(into, F.expr(pick(value, "id", "text", "comment", "label")))
        .withColumns(
            {
                text: F.expr(described_text(f"{into}.text")),
                comment: F.expr(described_text(f"{into}.comment")),
            }
        )
        .withColumn(f"{into}_chosen", F.expr(chosen))
        .drop(text, comment)
    )


def input_error(value: str, chosen: str) -> str:
    """Why an input cannot be classified at all, or null."""
    return f"""CASE WHEN {value} IS NULL OR is_variant_null({value}) THEN '{INVALID_INPUT}'
      WHEN {chosen} IS NULL THEN '{MISSING_TEXT}' END"""


def echoed(opened: str, chosen: str) -> str:
    """What an answer repeats of its input: id, the chosen text and label, nothing else."""
    return f"""to_variant_object(named_struct(
      'id', {opened}.id, 'comment', {chosen}.value, 'label', {opened}.label))"""


def build_answer(name: str, value: str, opened: str, chosen: str, verdict: str) -> str:
    """The answer object of one scorer as VARIANT, from the columns of ``open_input``."""
    return answer_object(literal(name), value, opened, chosen, verdict)


def answer_object(model: str, value: str, opened: str, chosen: str, verdict: str) -> str:
    """The same for a scorer whose name is an expression."""

    def failed(code, more=""):
        return f"to_variant_object(named_struct('success', false, 'model', {model}, 'error', {code}{more}))"

    return f"""CASE
      WHEN {value} IS NULL OR is_variant_null({value}) THEN {failed(f"'{INVALID_INPUT}'")}
      WHEN {chosen} IS NULL THEN {failed(f"'{MISSING_TEXT}'", f", 'output', {value}")}
      WHEN {verdict_error(verdict)} IS NOT NULL THEN {failed(verdict_error(verdict))}
      ELSE to_variant_object(named_struct('success', true, 'model', {model},
        'is_hate_speech', {verdict}.flagged, 'output', {echoed(opened, chosen)})) END"""


def echo_answer(value: str) -> str:
    """Answer of the echo step; ``value`` is null for text that was not JSON."""
    return f"""CASE WHEN {value} IS NULL
      THEN to_variant_object(named_struct('success', false, 'error', 'invalid_json'))
      ELSE to_variant_object(named_struct('success', true, 'output', {value})) END"""


def smoke_check(sample: DataFrame, scorers: Iterable[Scorer]) -> DataFrame:
    """One row per scorer with ``passed``: its check over the scored, labelled sample.

    ``sample`` holds comment and label. No check counts as passed; a check that says
    nothing, as on an empty sample, does not.
    """
    scorers = list(scorers)
    scored = score_corpus(sample, scorers, carry=["label"])
    sums = []
    for i, s in enumerate(scorers):
        if s.check is not None:
            mine = F.col("model") == s.name
            sums.append(F.every(F.when(mine, s.check)).alias(f"_c{i}"))
    outcome = scored.agg(*sums) if sums else None
    rows = [
        F.struct(
            F.lit(s.name).alias("model"),
            (
                F.coalesce(F.col(f"_c{i}"), F.lit(False)) if s.check is not None else F.lit(True)
            ).alias("passed"),
        )
        for i, s in enumerate(scorers)
    ]
    base = outcome if outcome is not None else sample.sparkSession.range(1)
    return base.select(F.inline(F.array(*rows)))


def require_smoke(sample: DataFrame | None, scorers: Iterable[Scorer]) -> None:
    """Raise when a scorer that requires its check does not pass it."""
    needed = [s for s in scorers if s.require_check and s.check is not None]
    if not needed:
        return
    if sample is None:
        raise ValueError(f"no sample to check {', '.join(s.name for s in needed)} on")
    # One row per scorer, however large the sample.
    failed = [r["model"] for r in smoke_check(sample, needed).filter(~F.col("passed")).collect()]
    if failed:
        raise RuntimeError(f"check not passed: {', '.join(sorted(failed))}")
