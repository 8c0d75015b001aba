"""Queries over the given tables, one for each operator, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.llm import ann, bpe, chat, language, licenses, minhash, mixing, packing, pii, ranked, toxicity, vector_dedup, whiten
from verdict.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = docs.filter(fold() != 0).join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("toxic").alias("label"))
    scored = toxicity.score_documents(docs, toxicity.fit(learned))
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").alias("n_segments")
    )


@query
def op4_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold() != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    return language.label_documents(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", F.size("words").alias("n_langs"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source and language, a folder for each thousand."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("doc_id div 1000"), "doc_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), path.alias("path"), "text")
    return licenses.scan(docs).withColumnRenamed("file", "doc_id")


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(given.unionByName(more)))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@query
def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_WORDS = r"[^\x20\x09-\x0D]+"
_CONTROL = r"([<\[])(\\*)(\|(turn|text|end|image|audio|document|im_start|im_end|startoftext|endoftext)\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"

ORACLES: dict[str, str] = {
    "op12_ranked_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
d AS (SELECT doc, any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY doc),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
m AS (SELECT doc, doc_id, 75 + (25 * n * docs) // terms AS m FROM d, g),
p AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY doc, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
b AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT item, item_id, doc, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""",
    "op7_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
l AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
        sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
v AS (SELECT *, CAST(total - f AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM l),
a AS (SELECT level FROM v WHERE level * w <= 3 * source_size ORDER BY source_size / w, i LIMIT 1),
g AS (SELECT source, source_size,
        CAST(coalesce(least((SELECT level FROM a) * w, 3 * source_size), 3 * source_size) AS DOUBLE) AS target FROM w),
k AS (SELECT *, least(CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END, 3) AS whole FROM g),
b AS (SELECT *, target - whole * source_size AS budget FROM k),
c AS (SELECT d.*, source_size, target, whole, budget,
        sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN whole < 3 AND (upto <= budget OR (upto - own <= budget AND upto - budget <= budget - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
""",
    "op10_chat": rf"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    '<|turn|>' || regexp_replace(coalesce(role, ''), '{_CONTROL}', '\1\\\2\3', 'g') || '<|text|>'
      || regexp_replace(coalesce(text, ''), '{_CONTROL}', '\1\\\2\3', 'g') || '<|end|>' AS formatted
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
}
