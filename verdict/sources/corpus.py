"""Labelled corpora."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.sources.split_csv import read_split_csv


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header to (id, comment, label), all text.

    Columns are taken by name, file by file: the unnamed row index, ``text`` and ``label``. A
    missing column or an empty field is the empty string. A header takes one line. Texts may
    hold quoted line breaks, so a file is read by one task; ``read_large_csv`` splits large files.
    """
    found = None
    for files in _by_header(spark, path):
        part = _named_columns(
            spark.read.csv(files, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
        )
        found = part if found is None else found.unionByName(part)
    return found


def read_large_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same rows, each file read by as many tasks as it has blocks."""
    return read_split_csv(spark, path, {"id": "", "comment": "text", "label": "label"})


def _named_columns(raw: DataFrame) -> DataFrame:
    def named(column: str) -> Column:
        value = F.col(f"`{column}`") if column in raw.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(""))

    # Spark names a column without a name by its place.
    unnamed = next((c for i, c in enumerate(raw.columns) if c == f"_c{i}"), "_c0")
    return raw.select(
        named(unnamed).alias("id"), named("text").alias("comment"), named("label").alias("label")
    )


def _by_header(spark: SparkSession, path: str) -> list[str | list[str]]:
    """Files grouped by their header line: the whole path where all have the same.

    Spark takes column names from one file of a read, so files of different headers have to be read
    apart. One pass over the lines, which are split among tasks and leave a hash each; what comes
    back is a row per file.
    """
    first = F.min_by("header", "at")
    headers = (
        spark.read.text(path)
        .filter("_metadata.file_block_start = 0 AND value <> ''")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.xxhash64("value").alias("header"),
            F.monotonically_increasing_id().alias("at"),
        )
        .groupBy("file")
        .agg(first.alias("header"))
    )
    groups: dict[int, list[str]] = {}
    for row in headers.orderBy("file").collect():
        groups.setdefault(row["header"], []).append(unquote(row["file"]))
    return list(groups.values()) if len(groups) > 1 else [path]


def write_labelled_csv(
    corpus: DataFrame, path: str, order: tuple[str, str, str] = ("", "text", "label")
) -> None:
    """(id, comment, label) as CSV that ``read_labelled_csv`` reads back unchanged.

    ``order`` is that of the columns in the files; the row index has no name.
    """
    columns = {
        "": F.col("id").alias(""),
        "text": F.col("comment").alias("text"),
        "label": F.col("label").cast("string").alias("label"),
    }
    corpus.select(*[columns[c] for c in order]).write.csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        encoding="UTF-8",
    )


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their label where there is one: (id, comment, label double)."""
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("comment"),
        F.col("toxic").cast("double").alias("label"),
    )
