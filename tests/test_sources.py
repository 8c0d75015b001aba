"""Files in and out: corpora, messages, results."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from acceptance import inputs as given
from acceptance import queries
from verdict.operators.envelope import decode_messages, encode_messages, take_messages
from verdict.session import scratch_dir
from verdict.sources import split_csv
from verdict.sources.corpus import read_labelled_csv, read_large_csv, write_labelled_csv
from verdict.sources.messages import (
    peek_message,
    publish,
    read_message_file,
    read_messages,
    read_scorer_lines,
)
from verdict.sources.results import append_results, create_results_table

CSV = ''',text,label,other
0,"two
lines, and ""quotes""",1,x
1,  spaced  ,0.0,y
2,,,z
3,short
'''


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV, encoding="utf-8")
    rows = read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [
        ("0", 'two\nlines, and "quotes"', "1"), ("1", "  spaced  ", "0.0"), ("2", "", ""), ("3", "short", ""),
    ]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "b.csv").write_text("label,text\n1,é\n", encoding="utf-8")
    assert [tuple(r) for r in read_labelled_csv(spark, str(tmp_path / "b.csv")).collect()] == [("", "é", "1")]


def test_csv_columns_go_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "with space.csv").write_text(',text,label\n1,aaa,0\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("label,,text\n1,2,bbb\n0,3,ccc\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("text,label,\nddd,1,4\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    rows = sorted(tuple(r) for r in read_labelled_csv(spark, str(tmp_path)).collect())
    assert rows == [("1", "aaa", "0"), ("2", "bbb", "1"), ("3", "ccc", "0"), ("4", "ddd", "1")]


def test_csv_roundtrip_of_odd_texts(spark, tmp_path):
    odd = ['a"b', "line\nbreak", "crlf\r\nend", "back\\slash", '\\"', ",", " lead", "trail ", "'", "é﻿", '""', "#x"]
    df = spark.createDataFrame([(str(i), t, "1") for i, t in enumerate(odd)], "id string, comment string, label string")
    write_labelled_csv(df, str(tmp_path / "c"))
    back = {r["id"]: r["comment"] for r in read_labelled_csv(spark, str(tmp_path / "c")).collect()}
    assert back == {str(i): t for i, t in enumerate(odd)}


def test_messages_out_and_in(spark, tmp_path):
    corpus = spark.createDataFrame([(str(i), f"line\n{i}", "1") for i in range(300)], "id string, comment string, label string")
    where = str(tmp_path / "queue")
    assert publish(encode_messages(corpus, "AB"), where) == 300
    assert publish(encode_messages(corpus.limit(5), "AB"), where) == 5
    waiting = read_messages(spark, where)
    assert waiting.count() == 305
    assert peek_message(waiting).count() == 1 and waiting.count() == 305
    assert take_messages(waiting, 8).count() == 8
    back = decode_messages(waiting).filter("reason IS NULL").select(F.expr("try_variant_get(input, '$.comment', 'string')"))
    assert {r[0] for r in back.collect()} == {f"line\n{i}" for i in range(300)}


def test_a_batch_is_bounded_by_messages(spark, tmp_path):
    where = str(tmp_path / "queue")
    publish(spark.range(20).selectExpr("cast(id as string) as value").coalesce(1), where, per_file=8)
    files = read_messages(spark, where).groupBy("_metadata.file_path").count()
    assert sorted(r["count"] for r in files.collect()) == [4, 8, 8]


def test_envelope_by_column(spark):
    df = spark.createDataFrame([("p", "1", "c", None)], "plan string, id string, comment string, label string")
    body = encode_messages(df, F.col("plan")).first()["value"]
    assert json.loads(body) == {"plan": "p", "input": {"id": "1", "comment": "c"}}


def test_message_over_several_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n"plan": "AB",\n"input":{\n"id":"1",\n"comment": "fine"\n}\n}')
    row = decode_messages(read_message_file(spark, str(tmp_path))).first()
    assert (row["plan"], row["reason"]) == ("AB", None)


def test_quoted_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("'{\"a\": \"it's\"}'\n{\"a\": 1}\n'\n''\n")
    got = [r["json"] for r in read_scorer_lines(spark, str(tmp_path)).collect()]
    assert got == ['{"a": "it\'s"}', '{"a": 1}', "'", ""]


def test_results_table(spark, tmp_path):
    table = "verdict_test_results"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    rows = spark.createDataFrame(
        [("m", True, "1", "text", 1.0, None), ("m", False, "1", "text", None, "2025")],
        "model string, flagged boolean, record_id string, comment string, label double, input_ts string",
    ).repartition(2)
    for _ in range(2):
        create_results_table(spark, table, str(tmp_path / "results"))
        append_results(rows, table)
    stored = spark.table(table)
    assert stored.count() == 4
    assert dict(stored.dtypes)["stored_at"] == "timestamp"
    first = stored.filter("flagged").first()
    assert (first["model"], first["record_id"], first["label"]) == ("m", "1", 1.0)
    assert stored.select("write_id", "result_id").distinct().count() == 4
    assert stored.select("write_id").distinct().count() == 2
    late = stored.filter(
        "stored_at > current_timestamp() OR stored_at < current_timestamp() - INTERVAL 1 HOUR "
        "OR stored_at <> date_trunc('second', stored_at)"
    )
    assert late.count() == 0
    spark.sql(f"DROP TABLE {table}")


class Cluster:
    """The parts of a session that decide where scratch files go."""

    def __init__(self, folder, master="spark://somewhere:7077"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_below_the_shared_folder():
    cluster = Cluster("/shared/folder/")
    one, two = scratch_dir(cluster, "x"), scratch_dir(cluster, "x")
    assert one != two and one.startswith("/shared/folder/x-")
    assert scratch_dir(Cluster("hdfs:///a", "local[2]"), "x").startswith("hdfs:///a/x-")
    with pytest.raises(ValueError):
        scratch_dir(Cluster(None), "x")


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records and quotes run over their ends."""
    sizes = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in sizes}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def whole_and_split(spark, path):
    left, right = (Counter(map(tuple, f(spark, path).collect())) for f in (read_labelled_csv, read_large_csv))
    assert left == right
    return left


def test_large_csv_equals_the_read_by_one_task(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    bits = ['a', 'é,', '""', '\n', '\r\n', 'word ', '\n\n', ' ', ',']
    lines = [",text,label"]
    for i in range(120):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        lines.append(f'{i},"{text}",{rng.choice(["0", "1", ""])}')
    lines[50] = '49,"' + "long\n" * 200 + '",1'
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")
    assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 20
    assert sum(whole_and_split(spark, str(tmp_path)).values()) == 120


def test_large_csv_with_beginnings_too_long_to_hold(spark, tmp_path, small_blocks, monkeypatch):
    """Fragments that are stitched after a shuffle give the same rows as beginnings the driver holds."""
    lines = [",text,label", *(f'{i},"{'a ""b""' * (i % 7)}\n{"c" * (3 * i)}\n",1' for i in range(40))]
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")
    (tmp_path / "two.csv").write_text('label,text,\n0,"' + "word\n" * 300 + '",x\n1,open,"y\n\nz', newline="")
    held = whole_and_split(spark, str(tmp_path))
    for name, few in (("MARKED", 3), ("FIRST_LINES", 3), ("HELD_OF_BLOCK", 20)):
        monkeypatch.setattr(split_csv, name, few)
        assert whole_and_split(spark, str(tmp_path)) == held and held.total() == 42


def test_large_csv_lines_go_to_python_once(spark, tmp_path):
    (tmp_path / "one.csv").write_text(',text,label\n1,"a\nb",0\n', newline="")
    plan = read_large_csv(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_large_csv_by_header_and_odd_files(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text(",text,label\r\n1,aaa,0\r\n\r\n2,\"b\r\nb\",1\r\n" * 1, newline="")
    (tmp_path / "b.csv").write_text("label,,text\n1,2,bbb\n0,3,ccc", newline="")
    (tmp_path / "c.csv").write_text("text,label,\nddd,1,4\nshort\n", newline="")
    (tmp_path / "d with space.csv").write_text("text,other\neee,f\n", newline="")
    (tmp_path / "empty.csv").write_text("")
    rows = whole_and_split(spark, str(tmp_path))
    assert rows["2", "b\nb", "1"] == 1 and rows["", "short", ""] == 1 and rows["", "eee", ""] == 1 and sum(rows.values()) == 7
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert read_large_csv(spark, str(tmp_path / "none")).collect() == []


def test_large_csv_header_over_blocks(spark, tmp_path, small_blocks):
    """A byte order mark, a header longer than a block, a quote that is never closed."""
    header = "\ufeff" + ",text," + ",".join(f'"c\n{i}"' for i in range(40)) + ",label\n"
    body = "".join(f"{i},t{i},{',' * 39},{i % 2}\n" for i in range(30))
    (tmp_path / "a.csv").write_text(header + body + '30,"open\nend', encoding="utf-8", newline="")
    rows = {r["id"]: (r["comment"], r["label"]) for r in read_large_csv(spark, str(tmp_path)).collect()}
    assert len(rows) == 31 and rows["7"] == ("t7", "1") and rows["30"][0].startswith("open")


def test_large_csv_is_written_by_as_many_tasks_as_it_needs(spark, sf_dir, tmp_path, monkeypatch):
    where = tmp_path / "csv"
    monkeypatch.setattr(queries, "scratch_dir", lambda *_: str(where))
    monkeypatch.setattr(queries, "CSV_BYTES", 100_000, raising=False)
    rows = Counter(map(tuple, queries.large_csv(spark, sf_dir).collect()))
    sizes = [part.stat().st_size for part in where.glob("part-*")]
    assert len(sizes) > 3 and max(sizes) < 300_000
    assert rows.total() == given.corpus(spark, sf_dir).count()


def test_message_files_are_written_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    where = tmp_path / "files"
    monkeypatch.setattr(queries, "scratch_dir", lambda *_: str(where))
    monkeypatch.setattr(queries, "TASK_FILES", 3, raising=False)
    n = given.table(spark, sf_dir, "supplier").count()
    assert queries.message_files(spark, sf_dir).count() == n
    files = [part.name for part in where.glob("part-*")]
    assert len(files) == n and len({name.split("-")[1] for name in files}) > 1
