"""Scorers: native, pandas and ml forms, errors per row, the smoke gate, evaluation."""

import os
import uuid
import weakref
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from acceptance import inputs as given
from verdict.operators import models, tolerant
from verdict.operators.evaluate import accuracy_by_model, row_correctness, score_labelled
from verdict.operators.outcomes import score_messages
from verdict.operators.scoring import (
    ColumnScorer,
    ModelScorer,
    PandasScorer,
    lexicon,
    registry,
    require_smoke,
    score_corpus,
    smoke_check,
)
from verdict.operators.tolerant import score_tolerant
from verdict.plans.model import plan
from verdict.plans.steps import StoreStep

TEXTS = ["Idiot!", "idiots", "an IDIOT", "midiot", "clownè", "éclown", "", None, "fine", "moron\nclown", "x" * 70000 + " scum"]


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, comment string")


def test_lexicon(spark):
    rows = score_corpus(texts(spark), given.scorers()[:1], ["id"]).orderBy("id").collect()
    assert [r["flagged"] for r in rows] == [True, False, True, False, True, True, None, None, False, True, True]
    assert [r["error"] for r in rows] == [None] * 6 + ["missing_text"] * 2 + [None] * 3
    assert all(r["success"] == (r["error"] is None) for r in rows)


def test_native_equals_pandas_equals_model(spark, sf_dir):
    corpus = given.corpus(spark, sf_dir).unionByName(
        texts(spark).select(F.col("id").cast("string"), "comment", F.lit(None).cast("double").alias("label"))
    )
    rule = "SELECT *, CAST(lower(text) RLIKE '(^|[^a-z])({})([^a-z]|$)' AS DOUBLE) AS prediction FROM __THIS__"
    model = [
        ModelScorer(n, transformer=PipelineModel([SQLTransformer(statement=rule.format("|".join(w)))]))
        for n, w in (("lexicon_a", given.WORDS_A), ("lexicon_b", given.WORDS_B))
    ]
    native = score_corpus(corpus, given.scorers(), ["id"])
    for other in (given.pandas_scorers(), model):
        scored = score_corpus(corpus, other, ["id"])
        assert scored.exceptAll(native).count() == 0 and native.exceptAll(scored).count() == 0
    assert native.filter("flagged").count() > 0


def picky(series: pd.Series) -> pd.Series:
    if series.str.contains("fine").any():
        raise ValueError("not this one")
    return series.str.contains("diot")


def test_a_failing_text_is_an_answer(spark):
    scorers = [PandasScorer("picky", flag=picky), ColumnScorer("undecided", flag=lambda t: F.when(t == "fine", True))]
    rows = score_corpus(texts(spark), scorers, ["id"]).collect()
    got = {(r["model"], r["id"]): (r["success"], r["flagged"], r["error"]) for r in rows}
    assert got["picky", 8] == (False, None, "ValueError")
    assert got["picky", 0] == (True, True, None) and got["picky", 9] == (True, False, None)
    assert got["picky", 7] == (False, None, "missing_text")
    assert got["undecided", 8] == (True, True, None)
    assert got["undecided", 0] == (False, None, "no_verdict")


def test_a_failed_score_is_rejected(spark):
    known = registry(PandasScorer("picky", flag=picky), StoreStep("store"))
    plans = [plan("P", ("picky", ["default_input"]), ("store", ["picky"]))]
    body = F.to_json(F.struct(F.lit("P").alias("plan"), F.struct("id", "comment").alias("input")))
    rows = score_messages(texts(spark).select(body.alias("value")), plans, known).collect()
    bad = {r["body"] for r in rows if r["kind"] == "rejected" and "ValueError" in r["body"]}
    assert bad == {'{"error":"ValueError","model":"picky","success":false}'}
    assert len(rows) == len(TEXTS)


def test_text_wins_over_comment(spark):
    df = spark.createDataFrame([(1, "idiot", "fine"), (2, "", "idiot"), (3, None, "fine")], "id int, text string, comment string")
    rows = score_corpus(df, given.scorers()[:1], ["id"]).orderBy("id").collect()
    assert [r["flagged"] for r in rows] == [True, True, False]


def test_registry_keeps_the_last(spark):
    a, b = given.scorers()
    assert registry(a, replace(b, name=a.name))[a.name].flag is b.flag


def labelled(spark, rows):
    return spark.createDataFrame(rows, "id string, comment string, label double")


def test_smoke_gate(spark):
    sample = labelled(spark, [("1", "idiot", 1.0), ("2", "fine", 0.0)])
    exact = F.col("flagged") == (F.col("label") >= 0.5)
    good = ColumnScorer("good", flag=lexicon(["idiot"]), check=exact, require_check=True)
    bad = replace(good, name="bad", flag=lexicon(["fine"]))
    free = replace(bad, name="free", check=None)
    got = {r["model"]: r["passed"] for r in smoke_check(sample, [good, bad, free]).collect()}
    assert got == {"good": True, "bad": False, "free": True}
    require_smoke(sample, [good, free, replace(bad, require_check=False)])
    with pytest.raises(RuntimeError, match="bad"):
        require_smoke(sample, [good, bad])
    # A check that says nothing does not pass.
    with pytest.raises(RuntimeError, match="good"):
        require_smoke(sample.filter("id = '9'"), [good])


def test_plans_wait_for_the_gate(spark):
    sample = labelled(spark, [("1", "idiot", 1.0), ("2", "fine", 0.0)])
    exact = F.col("flagged") == (F.col("label") >= 0.5)
    strict = ColumnScorer("s", flag=lexicon(["idiot"]), check=exact, require_check=True)
    plans = [plan("P", ("s", ["default_input"]), ("store", ["s"]))]
    body = F.to_json(F.struct(F.lit("P").alias("plan"), F.struct("id", "comment").alias("input")))
    messages = texts(spark).select(body.alias("value"))
    known = registry(strict, StoreStep("store"))
    assert score_messages(messages, plans, known, sample=sample).count() == len(TEXTS)
    with pytest.raises(ValueError):
        score_messages(messages, plans, known)
    with pytest.raises(RuntimeError):
        worse = registry(replace(strict, flag=lexicon(["fine"])), StoreStep("store"))
        score_messages(messages, plans, worse, sample=sample)
    # A classifier no plan uses is not checked.
    score_messages(messages, plans, known | {"t": replace(strict, name="t")}, sample=sample)


def test_correctness_cells(spark):
    rows = [(1.0, True), (0.5, True), (1.0, False), (0.4, True), (0.0, False), (None, True)]
    df = spark.createDataFrame(rows, "label double, flagged boolean")
    got = [(r["label"], r["flagged"], r["correct"]) for r in row_correctness(df).collect()]
    assert got == [(1.0, True, 1), (0.5, True, 1), (1.0, False, 0), (0.4, True, 0), (0.0, False, 1)]


def test_accuracy_order_and_rounding(spark):
    rows = [("b", 1.0, True), ("b", 1.0, False), ("a", 0.0, True), ("a", 0.0, False)]
    rows += [("c", 1.0, True)] * 2 + [("c", 1.0, False)]
    got = accuracy_by_model(spark.createDataFrame(rows, "model string, label double, flagged boolean"))
    assert [tuple(r) for r in got.collect()] == [("c", 3, 2, 66.67), ("a", 2, 1, 50.0), ("b", 2, 1, 50.0)]


def test_all_cells_are_reached_with_a_common_word(spark, sf_dir):
    words = [ColumnScorer("common", flag=lexicon(["hest", "is"]))]
    docs = given.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("comment"))
    labels = given.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    cells = score_labelled(docs, labels, words, "doc_id").groupBy("label", "flagged").count().collect()
    assert len(cells) == 4


def test_labels_join_flags_not_texts(spark, sf_dir):
    docs = given.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("comment"))
    labels = given.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    small = score_labelled(docs, labels, given.scorers(), "doc_id").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = score_labelled(docs, labels, given.scorers(), "doc_id")
        tree = scored._jdf.queryExecution().executedPlan().toString()
        large = scored.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(small) == sorted(large)
    # Texts are read and scored, but what is shuffled for the join has no text.
    exchanges = [line for line in tree.splitlines() if "Exchange" in line]
    assert exchanges and "SortMergeJoin" in tree
    assert not any("comment" in line for line in exchanges)


def test_pandas_answers_are_booleans_or_nothing(spark):
    answers = {"a": True, "b": 0, "c": None, "d": float("nan"), "e": "NO", "f": 2}
    calls = spark.sparkContext.accumulator(0)

    def classify(texts):
        calls.add(1)
        if (texts == "g").any():
            raise KeyError("g")
        return texts.map(answers)

    rows = spark.createDataFrame([(c,) for c in "abcdefg"] + [("a",)] * 57, "text string").coalesce(1)
    scored = PandasScorer("p", flag=classify).add_verdict(rows, "text", "v").select("text", "v.*").distinct().collect()
    assert {(r["text"], r["flagged"], r["error"]) for r in scored} == {
        ("a", True, None), ("b", False, None), ("c", None, None), ("d", None, None),
        ("e", None, "ValueError"), ("f", None, "ValueError"), ("g", None, "KeyError"),
    }
    assert calls.value <= 2 * 7 + 1  # halves, not one text at a time


def test_set_up_runs_once_a_worker(spark, tmp_path):
    """Many tasks and batches, one set-up for each Python process; a large model comes by broadcast."""
    where = str(tmp_path)
    words = spark.sparkContext.broadcast(["bad"])

    def setup():
        with open(f"{where}/{uuid.uuid4().hex}", "w") as file:
            file.write(str(os.getpid()))
        return words.value

    def classify(model, texts):
        return texts.str.contains(model[0])

    scorer = PandasScorer("loaded", flag=classify, setup=setup)
    rows = spark.range(4_000).selectExpr("CAST(id AS STRING) AS id", "if(id % 3 = 0, 'bad ', '') || id AS comment").repartition(40)
    scored = score_corpus(rows, [scorer], carry=["id"]).collect()
    assert all(r["flagged"] == (int(r["id"]) % 3 == 0) and r["success"] for r in scored) and len(scored) == 4_000
    pids = [path.read_text() for path in tmp_path.iterdir()]
    assert 0 < len(pids) == len(set(pids)) <= 16


def test_memory_of_a_pandas_scorer_is_bounded(spark):
    """Batches are bounded by bytes, and the texts of one are gone before the third after it is read."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)

    def classify(seen, texts):
        large = texts.str.len().sum() > 5 << 20
        seen.append(weakref.ref(texts))
        return pd.Series([bool(large) or sum(r() is not None for r in seen) > 3] * len(texts))

    rows = spark.range(0, 6000, 1, 1).select(F.col("id"), F.expr("repeat('x', 4000)").alias("comment"))
    scored = score_corpus(rows, [PandasScorer("bounded", flag=classify, setup=list)], carry=["id"])
    try:
        assert scored.filter("success AND NOT flagged").count() == 6000
    finally:
        if before is not None:
            spark.conf.set(key, before)


def test_a_failing_set_up_is_an_answer(spark):
    def setup():
        raise OSError("no model")

    rows = spark.createDataFrame([("1", "a"), ("2", None)], "id string, comment string")
    scored = score_corpus(rows, [PandasScorer("gone", flag=lambda m, t: t, setup=setup)], carry=["id"]).collect()
    assert {r["id"]: (r["success"], r["error"]) for r in scored} == {"1": (False, "OSError"), "2": (False, "missing_text")}


def test_a_fitted_model_is_kept_and_scores_held_out_rows(spark, sf_dir, tmp_path):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    rows = given.corpus(spark, folder).filter("label IS NOT NULL").withColumn("fold", models.fold("id"))
    models.save_model(models.fit_text_model(rows.filter("fold <> 0")), f"{tmp_path}/model")
    held = score_corpus(rows.filter("fold = 0"), [models.load_scorer("fitted", f"{tmp_path}/model")], carry=["id", "label"]).collect()
    toxic = [r for r in held if r["label"] == 1]
    assert all(r["success"] for r in held) and len(held) > 500
    assert sum(r["flagged"] for r in toxic) >= 0.5 * len(toxic)
    assert sum(r["flagged"] == (r["label"] == 1) for r in held) >= 0.93 * len(held)


def test_models_need_both_labels(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), (None, 0.0), ("d", 2.0)], "comment string, label double")
    with pytest.raises(ValueError, match="both labels"):
        models.fit_text_model(rows)
    model = models.fit_text_model(rows.unionByName(spark.createDataFrame([("e", 0.0)], rows.schema)))
    models.save_model(model, str(tmp_path / "m"))
    scored = score_corpus(rows, [models.load_scorer("m", str(tmp_path / "m"))], carry=["comment"]).collect()
    assert {r["comment"]: (r["flagged"], r["error"]) for r in scored if r["comment"] in ("a", "b", None)} == {
        "a": (True, None), "b": (True, None), None: (None, "missing_text")
    }


def test_folds(spark):
    rows = spark.range(1_000).select(models.fold("id").alias("f"), F.lit(None).cast("string").alias("none"))
    counts = [r["count"] for r in rows.groupBy("f").count().collect()]
    assert len(counts) == 5 and min(counts) > 150
    assert rows.limit(1).select(models.fold("none")).first()[0] == 0


def test_faults_of_native_scorers_are_answers(spark, tmp_path):
    rows = [("1", "scum a"), ("2", "fine"), ("3", "scum a"), ("4", None), ("5", "scum b"), ("6", "an idiot")]
    rows = spark.createDataFrame(rows, "id string, comment string").repartition(2)
    known = lexicon(["idiot"])
    raising = ColumnScorer("raising", flag=lambda c: F.when(c.contains("scum a"), F.raise_error(F.lit("no")).cast("boolean")).otherwise(known(c)))
    scorers = [ColumnScorer("plain", flag=known), raising]
    scored = score_tolerant(rows, scorers, str(tmp_path / "out"), carry=["id"])
    assert scored.columns == score_corpus(rows, scorers, ["id"]).columns
    got = {(r["id"], r["model"]): (r["success"], r["flagged"], r["error"]) for r in scored.collect()}
    assert len(got) == 12 and scored.count() == 12
    assert got["1", "raising"] == got["3", "raising"] == (False, None, "USER_RAISED_EXCEPTION")
    assert got["4", "raising"] == (False, None, "missing_text")
    assert got["5", "raising"] == (True, False, None) and got["6", "raising"] == (True, True, None) and got["1", "plain"] == (True, False, None)


def test_hopeless_scorers_and_lost_paths_raise(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tolerant, "HOPELESS", 2)
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(9)], "id string, comment string")
    never = ColumnScorer("never", flag=lambda c: F.raise_error(c).cast("boolean"))
    with pytest.raises(RuntimeError, match="every text"):
        score_tolerant(rows, [never], str(tmp_path / "a"))
    with pytest.raises(Exception, match="nowhere"):
        score_tolerant(rows, [ColumnScorer("x", flag=lambda c: F.col("nowhere"))], str(tmp_path / "b"))
    assert score_tolerant(rows.limit(0), [never], str(tmp_path / "c")).count() == 0
