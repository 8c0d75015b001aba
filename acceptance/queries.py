"""Queries by name; each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acceptance import inputs as given
from verdict.functions.text import reply_is_yes
from verdict.functions.variants import with_strict_variant
from verdict.operators import models, records
from verdict.operators.envelope import decode_messages, take_messages
from verdict.operators.evaluate import accuracy_by_model as accuracy
from verdict.operators.evaluate import row_correctness as correctness
from verdict.operators.evaluate import score_labelled
from verdict.operators.outcomes import (
    count_outcomes,
    dead_messages,
    rejects,
    results,
    route_messages,
    score_messages,
)
from verdict.operators.scoring import (
    ColumnScorer,
    ModelScorer,
    PandasScorer,
    add_verdicts,
    echo_answer,
    lexicon,
    one_row_per_model,
    score_corpus,
    smoke_check,
)
from verdict.operators.tolerant import score_tolerant
from verdict.plans.model import Plan, plan_rows, step_table
from verdict.plans.routing import dead_letters, expand_steps, message_outcomes, route_split, runnable, unknown_steps
from verdict.plans.relational import run_many_plans
from verdict.plans.runner import bind_inputs, run_plans
from verdict.session import prepare_session, scratch_dir
from verdict.sources.corpus import read_labelled_csv, read_large_csv, write_labelled_csv
from verdict.sources.message_stream import stream_bounded
from verdict.sources.messages import (
    peek_message,
    publish,
    read_message_file,
    read_messages,
    read_scorer_lines,
    stream_messages,
)
from verdict.sources.results import (
    RESULT_SCHEMA,
    append_results,
    create_results_table,
    merge_outcomes,
    read_outcomes,
)
from verdict.streaming.pipeline import accuracy_so_far, batch_totals, drain, score_stream
from verdict.streaming.redelivery import read_redelivered, redeliver

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Bytes of text of a CSV file that one task writes and several read.
CSV_BYTES = 384 << 20
#: Files that one task writes one after the other.
TASK_FILES = 500


def query(fn: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare_session(spark), sf_dir)

    QUERIES[fn.__name__] = prepared
    return fn


def _labelled_flags(spark, sf_dir):
    documents = given.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("comment")
    )
    labels = given.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("toxic").cast("double").alias("label")
    )
    return score_labelled(documents, labels, given.scorers(), "doc_id")


@query
def accuracy_by_model(spark, sf_dir):
    return accuracy(_labelled_flags(spark, sf_dir))


@query
def row_correctness(spark, sf_dir):
    return correctness(_labelled_flags(spark, sf_dir)).select(
        "doc_id", "label", "model", "flagged", "correct"
    )


def _fanout(spark, sf_dir, scorers):
    """Texts are scored where they are read; only their flags meet the labels."""
    scored = add_verdicts(given.texts(spark, sf_dir), scorers).select("id", "verdicts")
    return one_row_per_model(scored.join(given.labels(spark, sf_dir), "id", "left"), ["id", "label"])


@query
def score_fanout(spark, sf_dir):
    return _fanout(spark, sf_dir, given.scorers())


@query
def score_fanout_pandas(spark, sf_dir):
    return _fanout(spark, sf_dir, given.pandas_scorers())


@query
def score_faults(spark, sf_dir):
    """A scorer that raises and one without an answer spoil their own rows only."""
    return score_corpus(given.texts(spark, sf_dir), given.faulty_scorers(), carry=["id"])


@query
def score_native_faults(spark, sf_dir):
    """A native scorer that ends a job on one text: it answers with the error there and goes on elsewhere."""
    known = lexicon(given.WORDS_A)
    least = given.texts(spark, sf_dir).filter(F.contains("comment", F.lit("scum"))).agg(F.min("comment")).first()[0]
    fault = F.raise_error(F.lit("scum")).cast("boolean")
    raising = ColumnScorer("raising", flag=lambda c: F.when(c == F.lit(least), fault).otherwise(known(c)))
    where = scratch_dir(spark, "tolerant")
    return score_tolerant(given.texts(spark, sf_dir), [raising, given.scorers()[1]], where, carry=["id"])


@query
def score_fanout_model(spark, sf_dir):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    def model(words):
        pattern = f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"
        rule = f"SELECT *, CAST(lower(text) RLIKE '{pattern}' AS DOUBLE) AS prediction FROM __THIS__"
        return PipelineModel([SQLTransformer(statement=rule)])

    scorers = [
        ModelScorer("lexicon_a", transformer=model(given.WORDS_A)),
        ModelScorer("lexicon_b", transformer=model(given.WORDS_B)),
    ]
    return _fanout(spark, sf_dir, scorers)


@query
def score_fanout_loaded(spark, sf_dir):
    """Scorers whose pattern comes from a broadcast and is compiled once a worker."""
    import re

    def scorer(name, words):
        shared = spark.sparkContext.broadcast(words)
        return PandasScorer(
            name,
            setup=lambda: re.compile(rf"(?:^|[^a-z])(?:{'|'.join(shared.value)})(?:[^a-z]|$)"),
            flag=lambda pattern, texts: texts.str.lower().str.contains(pattern),
        )

    return _fanout(spark, sf_dir, [scorer("lexicon_a", given.WORDS_A), scorer("lexicon_b", given.WORDS_B)])


def _fitted(spark, sf_dir):
    """A model of the toxic label, fitted without fold 0, kept in files and loaded; and the rows it knows labels of."""
    where = scratch_dir(spark, "model")
    rows = given.corpus(spark, sf_dir).filter("label IS NOT NULL").withColumn("fold", models.fold("id"))
    models.save_model(models.fit_text_model(rows.filter("fold <> 0")), where)
    return models.load_scorer("fitted", where), rows


@query
def fitted_model_rows(spark, sf_dir):
    """Every document scored by a model fitted on labelled ones."""
    scorer, _ = _fitted(spark, sf_dir)
    return score_corpus(given.texts(spark, sf_dir), [scorer], carry=["id"])


@query
def fitted_model_quality(spark, sf_dir):
    """Labelled documents a fitted model scored, and whether it was right for nine of ten of those it was fitted on
    and for more than four of five of the others."""
    scorer, rows = _fitted(spark, sf_dir)
    scored = score_corpus(rows, [scorer], carry=["label", "fold"])
    right, fitted = (F.col("flagged") == (F.col("label") == 1)).cast("int"), F.col("fold") != 0
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if("success").alias("answered"),
        (F.avg(F.when(fitted, right)) >= 0.9).alias("fitted_well"),
        (F.avg(F.when(~fitted, right)) > 0.8).alias("held_out_well"),
    )


@query
def score_conversations(spark, sf_dir):
    return score_corpus(given.conversations(spark, sf_dir), given.scorers(), carry=["id"])


@query
def score_errors(spark, sf_dir):
    """Blank texts fall back to the comment; where that is blank too, an error answer."""
    n = given.number()
    rows = given.texts(spark, sf_dir).withColumns(
        {
            "text": F.when(n % 3 == 0, "").when(n % 3 == 1, F.lit(None)).otherwise(F.col("comment")),
            "comment": F.when(n % 9 != 0, F.when(n % 3 != 2, F.col("comment"))),
        }
    )
    return score_corpus(rows, given.scorers(), carry=["id"])


@query
def parse_reply(spark, sf_dir):
    replies = ("YES", " yes\n", "Yes ﻿", "YES.", "NO", "", None)
    reply = F.element_at(
        F.array(*[F.lit(r) for r in replies]), (F.col("doc_id") % len(replies) + 1).cast("int")
    )
    return given.table(spark, sf_dir, "documents").select("doc_id", reply_is_yes(reply).alias("yes"))


@query
def envelope_roundtrip(spark, sf_dir):
    return decode_messages(given.messages(spark, sf_dir)).select(
        "plan",
        "reason",
        *[
            F.try_variant_get("input", f"$.{name}", "string").alias(name)
            for name in ("id", "comment", "label")
        ],
    )


@query
def empty_input(spark, sf_dir):
    return decode_messages(given.input_messages(spark, sf_dir)).select(
        "id", "reason", F.col("input").isNotNull().alias("has_input"), F.to_json("input").alias("input")
    )


def _routed(spark, sf_dir):
    return route_messages(given.mixed_messages(spark, sf_dir), given.PLANS, given.steps())


def _input_id():
    return F.try_variant_get("input", "$.id", "string").alias("id")


@query
def routed_messages(spark, sf_dir):
    return runnable(_routed(spark, sf_dir)).select(
        _input_id(), "plan", F.size("steps").alias("n_steps")
    )


@query
def split_routed_messages(spark, sf_dir):
    """The same by the join for plans that are too many to broadcast."""
    plans = spark.createDataFrame(plan_rows(given.PLANS, given.steps()))
    routed = route_split(decode_messages(given.mixed_messages(spark, sf_dir)), plans)
    return runnable(routed).select(_input_id(), "plan", F.size("steps").alias("n_steps"))


@query
def dead_letter_rows(spark, sf_dir):
    return dead_letters(_routed(spark, sf_dir))


@query
def dead_letter_counts(spark, sf_dir):
    return dead_letters(_routed(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query
def faulty_plans(spark, sf_dir):
    """What stops messages of plans that cannot run, with and without an input."""
    routed = route_messages(given.faulty_messages(spark, sf_dir), given.FAULTY_PLANS, given.steps())
    return routed.groupBy("plan", "reason").agg(F.count("*").alias("n"))


@query
def expanded_steps(spark, sf_dir):
    """One row per step to run, of plans that were read from files."""
    plans = given.plans_from_files(spark)
    routed = route_messages(given.mixed_messages(spark, sf_dir), plans, given.steps())
    return expand_steps(runnable(routed)).select(
        _input_id(), "plan", "position", "step", F.array_join("inputs", "|").alias("inputs")
    )


@query
def unregistered_steps(spark, sf_dir):
    """Steps of decoded messages that name no registered step."""
    return unknown_steps(
        expand_steps(_routed(spark, sf_dir)), step_table(spark, given.steps())
    ).select(_input_id(), "plan", "position", "step")


@query
def bound_inputs(spark, sf_dir):
    """Inputs of every executed step, one row per input in listed order."""
    run = run_plans(runnable(_routed(spark, sf_dir)), given.PLANS, given.steps())
    steps = bind_inputs(run.withColumn("id", _input_id()), "id", "plan")
    return steps.select(
        "id", "plan", "position", "step", F.posexplode("inputs").alias("nth", "bound")
    )


@query
def plan_results(spark, sf_dir):
    """Every result of every message, the message input included."""
    run = run_plans(runnable(_routed(spark, sf_dir)), given.PLANS, given.steps())
    return run.select(_input_id(), "plan", F.explode("results").alias("step", "result"))


def _many(spark, sf_dir):
    routed = route_messages(given.many_plan_messages(spark, sf_dir), given.MANY_PLANS, given.steps())
    run = run_many_plans(runnable(routed), given.MANY_PLANS, given.steps())
    return run.withColumn("plan", F.substring_index("plan", "_", 1)).withColumn("id", _input_id())


@query
def many_plan_results(spark, sf_dir):
    """Every result of every message, its plan being one of a thousand."""
    return _many(spark, sf_dir).select("id", "plan", F.explode("results").alias("step", "result"))


@query
def many_bound_inputs(spark, sf_dir):
    steps = bind_inputs(_many(spark, sf_dir), "id", "plan")
    return steps.select("id", "plan", "position", "step", F.posexplode("inputs").alias("nth", "bound"))


@query
def many_plan_outcomes(spark, sf_dir):
    """Outcome rows of a thousand plans, without the bodies."""
    scored = score_messages(given.many_plan_messages(spark, sf_dir), given.MANY_PLANS, given.steps())
    return scored.withColumn("plan", F.substring_index("plan", "_", 1)).select(
        "kind", "first", "plan", "reason", "record_id", "label", "model", "flagged"
    )


@query
def message_outcome(spark, sf_dir):
    """Whether each message ran through; those that cannot be read have no id."""
    return message_outcomes(_routed(spark, sf_dir)).select(_input_id(), "plan", "completed")


@query
def mixed_plan_outcomes(spark, sf_dir):
    """Outcome rows of all plans together, without the bodies."""
    return _mixed_outcomes(spark, sf_dir).select(
        "kind", "first", "plan", "reason", "record_id", "label", "model", "flagged"
    )


def _mixed_outcomes(spark, sf_dir):
    return score_messages(given.mixed_messages(spark, sf_dir), given.PLANS, given.steps())


@query
def reported_rejects(spark, sf_dir):
    """Rejected answers of all plans with their reason."""
    return rejects(_mixed_outcomes(spark, sf_dir))


@query
def reported_dead_messages(spark, sf_dir):
    return dead_messages(_mixed_outcomes(spark, sf_dir))


@query
def outcome_counts(spark, sf_dir):
    """Messages completed and failed, rows stored and rejected, by plan."""
    return count_outcomes(_mixed_outcomes(spark, sf_dir), by=["plan"])


@query
def sanitize_json(spark, sf_dir):
    """Event properties with dirt around them, written out again."""
    n = F.col("event_id") % 5
    raw = (
        F.when(n == 0, F.concat(F.lit(" \t"), "props", F.lit("  \n")))
        .when(n == 1, F.concat(F.lit("﻿"), "props"))
        .when(n == 2, F.concat("props", F.lit(" trailing")))
        .when(n == 3, F.concat(F.col("props"), F.lit("﻿"), F.lit("]")))
        .otherwise(F.col("props"))
    )
    events = given.events(spark, sf_dir).select("event_id", raw.alias("raw"))
    return records.canonical_json(events, "raw", "clean").select("event_id", "clean")


def _checked(spark, sf_dir):
    return records.check_answer_texts(given.answers(spark, sf_dir), "answer_text")


@query
def reject_reasons(spark, sf_dir):
    return (
        records.rejected(_checked(spark, sf_dir))
        .groupBy(F.col("reject").alias("reason"))
        .agg(F.count("*").alias("n"))
    )


@query
def rejected_rows(spark, sf_dir):
    return records.rejected(_checked(spark, sf_dir)).select("id", F.col("reject").alias("reason"))


@query
def accepted_answers(spark, sf_dir):
    return records.accepted(_checked(spark, sf_dir))


@query
def insert_counts(spark, sf_dir):
    return records.insert_summary(_checked(spark, sf_dir))


@query
def coerce_label(spark, sf_dir):
    """Label texts carried through answers, each to the number that is stored."""
    rows = given.texts(spark, sf_dir)
    answer = F.struct(
        F.lit(True).alias("success"),
        F.lit("lexicon_a").alias("model"),
        F.lit(False).alias("is_hate_speech"),
        F.struct("id", "comment", given.label_text().alias("label")).alias("output"),
    )
    sent = rows.select(F.to_json(answer).alias("answer_text"))
    return records.accepted(records.check_answer_texts(sent, "answer_text")).select(
        "record_id", "label"
    )


@query
def result_rows(spark, sf_dir):
    """The stored rows of plan AB for the whole corpus."""
    return results(score_messages(given.messages(spark, sf_dir), given.PLANS[:1], given.steps()))


@query
def result_rows_pandas(spark, sf_dir):
    steps = given.steps() | {s.name: s for s in given.pandas_scorers()}
    return results(score_messages(given.messages(spark, sf_dir), given.PLANS[:1], steps))


@query
def result_accuracy(spark, sf_dir):
    """The evaluation over rows that went through the message pipeline."""
    return accuracy(
        results(score_messages(given.messages(spark, sf_dir), given.PLANS[:1], given.steps()))
    )


def _stored_twice(spark, sf_dir):
    """The results appended twice to a table; its files stay to be read, its name goes."""
    where = scratch_dir(spark, "results")
    table = "verdict_results_" + where.rsplit("-", 1)[1]
    create_results_table(spark, table, where)
    scored = score_messages(given.messages(spark, sf_dir), given.PLANS[:1], given.steps())
    try:
        for _ in range(2):
            append_results(results(scored), table)
    finally:
        spark.sql(f"DROP TABLE {table}")
    return spark.read.schema(RESULT_SCHEMA).parquet(where)


@query
def stored_results(spark, sf_dir):
    """The same rows appended to a results table twice and read back."""
    return _stored_twice(spark, sf_dir).select(*records.RESULT_COLUMNS)


@query
def stored_result_ids(spark, sf_dir):
    """Rows of that table, and how many ids they have."""
    ids = F.countDistinct("write_id", "result_id")
    return _stored_twice(spark, sf_dir).agg(F.count("*").alias("n_rows"), ids.alias("n_ids"))


@query
def batch_outcome(spark, sf_dir):
    """Counts per batch of eight messages."""
    n = given.number()
    rows = given.corpus(spark, sf_dir).withColumn("batch", F.expr("CAST(id AS BIGINT) div 8"))
    bodies = rows.select("batch", F.to_json(
        F.struct(
            given.routed_plan().alias("plan"),
            F.struct("id", "comment", "label").alias("input"),
        )
    ).alias("value"))
    routed = route_messages(bodies, given.PLANS, given.steps())
    ok = F.col("completed")
    return (
        message_outcomes(routed)
        .groupBy(F.col("batch").alias("batch_id"))
        .agg(F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"))
    )


@query
def echo_step(spark, sf_dir):
    """Event properties echoed, every third of them cut short."""
    events = given.events(spark, sf_dir).withColumn(
        "text", F.expr("if(event_id % 3 = 0, left(props, length(props) - 1), props)")
    )
    parsed = with_strict_variant(events, "text", "value")
    return parsed.select("event_id", F.expr(f"to_json({echo_answer('value')})").alias("answer"))


@query
def smoke_gate(spark, sf_dir):
    """Passes for a scorer that never flags a harmless text, fails for one that must flag
    every harmful one; a scorer without a check passes."""
    a, b = given.scorers()
    sample = given.corpus(spark, sf_dir).filter(F.col("label").isNotNull())
    return smoke_check(
        sample,
        [
            replace(a, name="careful", check=~F.col("flagged") | (F.col("label") >= 0.5)),
            replace(b, name="complete", check=F.col("flagged") | (F.col("label") < 0.5)),
            replace(b, name="unchecked"),
        ],
    )


def _stream(spark, sf_dir):
    where = scratch_dir(spark, "stream")
    publish(given.messages(spark, sf_dir), f"{where}/messages")
    bodies = stream_messages(spark, f"{where}/messages")
    score_stream(
        bodies, given.PLANS[:1], given.steps(), out=where, checkpoint=f"{where}/checkpoint"
    ).awaitTermination()
    return where


@query
def stream_results(spark, sf_dir):
    """Published, streamed, stored in batches and read back."""
    stored = read_outcomes(spark, _stream(spark, sf_dir) + "/outcomes")
    return results(stored).select(*records.RESULT_COLUMNS)


@query
def stream_batches(spark, sf_dir):
    """Counts summed over all batches of the stream."""
    return batch_totals(spark.read.parquet(_stream(spark, sf_dir) + "/batches"))


def _merged(spark, sf_dir):
    """A stream of four batches whose stored outcomes were merged, and the folder of them."""
    where = scratch_dir(spark, "merged")
    publish(given.messages(spark, sf_dir).repartition(4), f"{where}/messages")
    bodies = stream_messages(spark, f"{where}/messages", max_files=1)
    score_stream(
        bodies, given.PLANS[:1], given.steps(), out=where, checkpoint=f"{where}/checkpoint"
    ).awaitTermination()
    merge_outcomes(spark, f"{where}/outcomes")
    return where


@query
def merged_results(spark, sf_dir):
    """The rows of a stream after its batches were merged."""
    return results(read_outcomes(spark, _merged(spark, sf_dir) + "/outcomes")).select(*records.RESULT_COLUMNS)


@query
def running_accuracy(spark, sf_dir):
    """Accuracy per model from the counts of the batches of a stream."""
    return accuracy_so_far(spark, _merged(spark, sf_dir))


@query
def redelivered_results(spark, sf_dir):
    """Messages of an unknown plan, stored as dead letters, run once the plan is there and no second time."""
    where = scratch_dir(spark, "redelivery")
    publish(given.mixed_messages(spark, sf_dir), f"{where}/messages")
    bodies = stream_messages(spark, f"{where}/messages")
    score_stream(bodies, given.PLANS, given.steps(), out=where, checkpoint=f"{where}/checkpoint").awaitTermination()
    later = [*given.PLANS, Plan("Nobody", given.PLANS[0].steps)]
    for _ in range(2):
        redeliver(spark, where, later, given.steps())
    return results(read_redelivered(spark, where)).select(*records.RESULT_COLUMNS)


@query
def bounded_batches(spark, sf_dir):
    """Messages of one file, taken 300 a batch: how many each batch completed."""
    where = scratch_dir(spark, "bounded")
    publish(given.messages(spark, sf_dir).coalesce(1), f"{where}/messages")
    bodies = stream_bounded(spark, f"{where}/messages", f"{where}/log", 300)
    drain(
        score_stream(
            bodies, given.PLANS[:1], given.steps(), out=where, checkpoint=f"{where}/checkpoint",
            once=False, interval="0 seconds",
        )
    )
    counts = spark.read.parquet(f"{where}/batches")
    return counts.select(F.col("batch_id").cast("bigint").alias("batch_id"), "completed", "stored")


@query
def csv_corpus(spark, sf_dir):
    """The corpus written as CSV, half of it with other columns first, and read back."""
    where = scratch_dir(spark, "csv")
    rows, even = given.corpus(spark, sf_dir), given.number() % 2 == 0
    write_labelled_csv(rows.filter(even), f"{where}/even")
    write_labelled_csv(rows.filter(~even), f"{where}/odd", order=("label", "text", ""))
    return read_labelled_csv(spark, f"{where}/*")


@query
def large_csv(spark, sf_dir):
    """The corpus in CSV files of about ``CSV_BYTES``, its texts with line breaks and quotes, each read by many tasks."""
    where = scratch_dir(spark, "large-csv")
    size = given.texts(spark, sf_dir).agg(F.sum(F.octet_length("comment"))).first()[0] or 0
    text = F.concat(F.lit('"\n'), F.replace("comment", F.lit(" "), F.lit("\n")), F.lit(',"'))
    write_labelled_csv(given.corpus(spark, sf_dir).withColumn("comment", text).repartition(1 + size // CSV_BYTES), where)
    return read_large_csv(spark, where)


@query
def jsonl_input(spark, sf_dir):
    """Scorer inputs from lines, half of them in single quotes, one field picked."""
    where = scratch_dir(spark, "lines")
    line = F.to_json(F.struct("event_id", "props"))
    quoted = F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit("'"), line, F.lit("'"))
    ).otherwise(line)
    given.events(spark, sf_dir).select(quoted.alias("value")).write.text(where)
    read = with_strict_variant(read_scorer_lines(spark, where), "json", "input")
    return read.select(
        F.try_variant_get("input", "$.event_id", "bigint").alias("event_id"),
        F.try_variant_get("input", "$.props", "string").alias("props"),
    )


@query
def published_messages(spark, sf_dir):
    """Messages published to a directory and read in bulk."""
    where = scratch_dir(spark, "messages")
    publish(given.messages(spark, sf_dir), where)
    return decode_messages(read_messages(spark, where)).select(_input_id(), "plan")


@query
def peeked_message(spark, sf_dir):
    """Looking at one message takes nothing: how many were seen, how many are left."""
    where = scratch_dir(spark, "messages")
    publish(given.messages(spark, sf_dir), where)
    waiting = read_messages(spark, where)
    both = peek_message(waiting).select(F.lit("seen").alias("what")).unionAll(
        waiting.select(F.lit("waiting").alias("what"))
    )
    return both.groupBy("what").agg(F.count("*").alias("n"))


@query
def published_counts(spark, sf_dir):
    """How many messages were published, wait, and are taken for a batch of eight."""
    where = scratch_dir(spark, "messages")
    n = publish(given.messages(spark, sf_dir), where)
    waiting = read_messages(spark, where)
    taken = take_messages(waiting, 8).select(F.lit("taken").alias("what"))
    both = taken.unionAll(waiting.select(F.lit("waiting").alias("what")))
    counted = both.groupBy("what").agg(F.count("*").alias("n"))
    return counted.unionAll(spark.range(1).select(F.lit("published"), F.lit(n).cast("bigint")))


@query
def message_files(spark, sf_dir):
    """Messages spread over several lines, each in a file of its own."""
    where = scratch_dir(spark, "files")
    suppliers = given.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("comment")
    )
    body = F.to_json(
        F.struct(F.lit("AB").alias("plan"), F.struct("id", "comment").alias("input")),
        {"pretty": "true"},
    )
    tasks = 1 + suppliers.count() // TASK_FILES
    suppliers.select(body.alias("value")).repartition(tasks).write.option("maxRecordsPerFile", 1).text(where)
    return decode_messages(read_message_file(spark, where)).select(
        _input_id(), "plan", F.try_variant_get("input", "$.comment", "string").alias("comment")
    )
