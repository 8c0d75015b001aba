"""A training-data pipeline over documents: each stage reads what the one before it kept.

Rows that go: texts without a letter, and texts whose words are of no clear language (language); all but one document of
each group of near-duplicates (near_duplicates); what the mix leaves out (mixing), which also repeats rows.
Personal data is masked in the texts. The last stage returns the pieces of packed sequences.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.llm import language, minhash, mixing, packing, pii
from verdict.llm.common import clear_scratch, fold, scratch_tables, small_batches, stored, text_slices

#: Mean of the greatest probability of each word below which a document is rejected.
CLEAR = 0.4
#: A column for row numbers.
ROW = "_row"
#: Bytes of a bitmap of rows, and of all bitmaps up to which they are broadcast.
BITMAP, BROADCAST = 4_096, 64 << 20
#: Bytes of text a packing worker holds at once and parts of words it remembers, next to what earlier stages left in the executor.
PACKED_AT_ONCE, REMEMBERED = 2_000_000, 120_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognized language; all are kept where no language can be learned."""
    small_batches(spark)
    model = language.fit(docs.filter(fold() != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    shared = spark.sparkContext.broadcast(model)

    text = docs.columns.index("text")

    def keep(batches):
        known = {}
        for batch in batches:
            for a, b, texts in text_slices(batch.column(text), language.CHUNK):
                seen = language.predict(shared.value, texts, known)
                clear = [not shared.value.languages or (lang != "und" and certain >= CLEAR) for lang, _, _, certain in seen]
                yield batch.slice(a, b - a).filter(pa.array(clear, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose number (ROW) is in ids, each once, read where they lie.

    A bit a row is broadcast, so no text is shuffled; beyond BROADCAST bytes, about 500 million rows, Spark chooses the join.
    Tables that ids reads are not needed any more.
    """
    # One more, as bitmaps begin at 1: the first row of a partition begins one.
    bucket, bit = F.bitmap_bucket_number(F.col(ROW) + 1), F.bitmap_bit_position(F.col(ROW) + 1)
    # Dealt out before the aggregation, or every task would send a bitmap for every bucket.
    marks = ids.select(bucket.alias("_bucket"), bit.alias("_bit")).repartition("_bucket")
    marks = stored(marks.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_marks")), "marks")
    if marks.count() * BITMAP <= BROADCAST:
        marks = F.broadcast(marks)
    marked = F.expr("getbit(cast(conv(hex(substring(_marks, cast(_bit div 8 + 1 as int), 1)), 16, 10) as int), cast(_bit % 8 as int)) = 1")
    return rows.withColumns({"_bucket": bucket, "_bit": bit}).join(marks, "_bucket").filter(marked).select(rows.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of least id, rows without id last.

    Each row is a document of its own, whatever its id, so different texts of one id all stay and equal
    rows are copies. Sets are of five words, as is usual for such stages (op2 takes two, as its contract says), linked
    at a similarity of 0.8 or more. Rows without words link with nothing and stay.
    """
    small_batches(spark)
    numbered = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    before = scratch_tables()
    found = minhash.near_duplicates(numbered.select(F.col(ROW).alias("doc_id"), "text"), width=5, percent=80)
    found = found.select(F.col("doc_id").alias(ROW), "component_id").join(numbered.select(ROW, "doc_id"), ROW)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("least")
    kept = rows_of(numbered, found.groupBy("component_id").agg(least).select(F.col(f"least.{ROW}").alias(ROW)))
    # Sketches, sets and links are of no use any more; only the marks of the rows are.
    clear_scratch(spark, before, keep=1)
    return kept.select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in texts masked and n_chars counted anew; null texts stay null."""
    small_batches(spark)
    masked = pii.mask(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.copies(docs)
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; see packing.pack."""
    small_batches(spark)
    return packing.pack(docs, chunk=PACKED_AT_ONCE, remembered=REMEMBERED)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and tokenizers have no form in SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_tables()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        # What the stage read and made on the way is of no use any more.
        clear_scratch(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
