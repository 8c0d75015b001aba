"""Scoring with classifiers whose expression may end a job, as a native or a fitted one can.

A failed pass is tried again scorer by scorer, then on halves of the texts by hash, and their halves, until the texts that fail are
alone; these get the error as their answer. Equal texts share a hash and a fate. Parts that went well are not
scored again. One text that fails costs about two more passes of its scorer and a few small jobs, so this is for faults that
are rare; a scorer that fails for every text fails soon, as no part of it ever goes well.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.functions.text import first_text
from verdict.operators.scoring import MISSING_TEXT, Scorer, score_corpus

#: Halvings of a failed part: texts that still fail together after these many share 40 bits of their hash.
DEEPEST = 40
#: Parts in a row that may fail without any that went well.
HOPELESS = 100


class _Hopeless(RuntimeError):
    pass


def fault_of(error: PySparkException) -> str | None:
    """The condition a row brought about, or None for an error of the cluster or of the program."""
    condition = error.getCondition()
    while condition in (None, "TASK_WRITE_FAILED", "FAILED_EXECUTE_UDF") and error.__cause__ is not None:
        error = error.__cause__
        condition = error.getCondition() if isinstance(error, PySparkException) else type(error).__name__
    if condition is None or condition.startswith(("INTERNAL_ERROR", "UNRESOLVED", "PATH_", "TABLE_")):
        return None
    return condition


def score_tolerant(corpus: DataFrame, scorers: Iterable[Scorer], path: str, carry: Iterable[str] = ()) -> DataFrame:
    """``score_corpus``, written below ``path`` and read back; texts that end a job are answered with their error.

    Raises what is no fault of a text, as a lost path, and what a scorer raises for every text it is tried on.
    """
    scorers, carry = list(scorers), list(carry)
    texts = first_text(*[F.col(c) for c in ("text", "comment") if c in corpus.columns])
    rows = corpus.withColumn("_hash", F.xxhash64(texts))
    written: list[str] = []
    failed = {s.name: 0 for s in scorers}

    def attempt(some: list[Scorer], depth: int, branch: int) -> str | None:
        """Write a part; the fault that ended it, or None."""
        part = rows.filter(F.expr(f"pmod(_hash, {1 << depth}) = {branch}")) if depth else rows
        out = f"{path}/{len(written)}-{depth}-{branch}-{some[0].name if len(some) == 1 else 'all'}"
        try:
            score_corpus(part, some, carry).write.mode("overwrite").parquet(out)
        except PySparkException as error:
            fault = fault_of(error)
            if fault is None:
                raise
            for s in some if len(some) == 1 else ():
                failed[s.name] += 1
                if failed[s.name] > HOPELESS:
                    raise _Hopeless(f"{s.name} fails for every text") from error
            return fault
        written.append(out)
        for s in some:
            failed[s.name] = 0
        return None

    def settle(scorer: Scorer, depth: int, branch: int) -> None:
        fault = attempt([scorer], depth, branch)
        if fault is None:
            return
        if depth == DEEPEST:
            # Texts that cannot be told apart: the answer is the error.
            part = rows.filter(F.expr(f"pmod(_hash, {1 << depth}) = {branch}"))
            out = f"{path}/{len(written)}-{scorer.name}-failed"
            error = F.when(texts.isNull(), MISSING_TEXT).otherwise(fault)
            answer = [F.lit(scorer.name).alias("model"), F.lit(False).alias("success"), F.lit(None).cast("boolean").alias("flagged"), error.alias("error")]
            part.select(*carry, *answer).write.mode("overwrite").parquet(out)
            written.append(out)
            return
        # Where a failed part holds one text, halving it further would only empty one side.
        inside = rows.filter(F.expr(f"pmod(_hash, {1 << depth}) = {branch}")).agg(F.min("_hash"), F.max("_hash")).first() if depth else (0, 1)
        if inside[0] == inside[1]:
            settle(scorer, DEEPEST, inside[0] % (1 << DEEPEST))
            return
        settle(scorer, depth + 1, branch)
        settle(scorer, depth + 1, branch + (1 << depth))

    if attempt(scorers, 0, 0) is not None:
        for scorer in scorers:
            settle(scorer, 0, 0)
    return corpus.sparkSession.read.schema(score_corpus(corpus, scorers, carry).schema).parquet(*written)
