"""A corpus pipeline of five stages: classify, drop boilerplate, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.

Every stage works on whole texts of any length, and an empty table gives an empty result. Null texts count as empty ones; extra
columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, line_dedup, mixing, quality, simhash
from twinsift.llm.common import bucket, discard, documents, materialize

#: Documents below this probability of being good are rejected.
MIN_QUALITY = 0.3
#: Near copies share 0.8 of their distinct five-word shingles (Jaccard). Such texts differ in 15 % of SimHash bits on average, 19
#: of 128 with a deviation of 4. Candidates are at most 13 bits apart in either word of 64 and 32 of 128; shingles decide.
SHINGLE, NEAR_BITS, CHECK_BITS, NEAR = 5, 13, 32, 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Repeated rows get one verdict; a document without text gets the
    intercept's score; one without an id is scored, but trains nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.select("doc_id", "text"), labels.where(bucket(F.col("doc_id"), 5) != 0))
    return quality.keep_documents(docs, model, MIN_QUALITY)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that many sources share; n_chars follows the text. The least id that holds a line keeps it, in all rows of that
    id; null texts stay null with n_chars 0; rows without an id keep their lines."""
    cleaned = line_dedup.remove_boilerplate(docs, counts=False)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, in all rows of that id; documents without an id stay."""
    found = simhash.near_copies(docs, SHINGLE, NEAR_BITS, CHECK_BITS, NEAR)
    copies = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources reach their target weights. Rows of one id are drawn alike; null is a source of its own."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of what they decode to, a row for each row; null texts have no token."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe_encode_decode", encode),
]
#: A trained classifier and SimHash can't be expressed in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one's is written."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs
