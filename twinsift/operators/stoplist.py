"""Boilerplate shingles: document frequency, cutoff, top k, and overlap with and without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.text import shingle_id, shingles, tokens


def shingle_sets(codes: DataFrame, n: int) -> DataFrame:
    """code_id, lang and shingle, each shingle of a document once."""
    toks = codes.select("code_id", "lang", tokens(F.col("code")).alias("toks"))
    return toks.select("code_id", "lang", F.explode(F.array_distinct(_shingled(n))).alias("shingle"))


def _shingled(n: int):
    return F.element_at(F.transform(F.array("toks"), lambda t: shingles(t, n)), 1)


def document_frequency(codes: DataFrame, n: int) -> DataFrame:
    return shingle_sets(codes, n).groupBy("lang", "shingle").agg(F.count(F.lit(1)).alias("df"))


def stoplist(codes: DataFrame, n: int, share: float, min_df: int = 2, top: int | None = None) -> DataFrame:
    """lang, shingle and df of shingles in at least max(min_df, int(documents with shingles * share)) documents."""
    sets = shingle_sets(codes, n)
    docs = codes.where(F.size(tokens(F.col("code"))) >= n).groupBy("lang").agg(F.count_distinct("code_id").alias("docs"))
    kept = sets.groupBy("lang", "shingle").agg(F.count(F.lit(1)).alias("df")).join(docs, "lang")
    kept = kept.where(F.col("df") >= F.greatest(F.lit(min_df), F.floor(F.col("docs") * F.lit(share)))).drop("docs")
    if top is None:
        return kept
    order = Window.partitionBy("lang").orderBy(F.desc("df"), "shingle")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


def stoplist_table(codes: DataFrame, n: int, share: float, corpus_id: str, version: str, **more) -> DataFrame:
    """The stored form, with ids; corpus and version are part of its key."""
    kept = stoplist(codes, n, share, **more)
    return kept.select("lang", F.lit(n).alias("n"), shingle_id("shingle").alias("hash"), F.split("shingle", "\x01").alias("shingle"), "df", F.lit(corpus_id).alias("corpus_id"), F.lit(version).alias("version"))


def masked_overlap(pairs: DataFrame, codes: DataFrame, stop: DataFrame, n: int) -> DataFrame:
    """a_id, b_id, label, raw and masked Jaccard of shingle sets.

    Texts of documents in pairs are read once: each document gets the 64-bit hashes of its shingles, all and those that aren't stop-listed,
    and each pair intersects two such lists. A list is as long as its document; hashes of two texts agree by chance in one of 2^64.
    """
    ids = pairs.select(F.col("a_id").alias("code_id")).unionByName(pairs.select(F.col("b_id").alias("code_id"))).distinct()
    sets = shingle_sets(codes.join(ids, "code_id", "left_semi"), n).join(stop.select("lang", "shingle", F.lit(1).alias("stop")), ["lang", "shingle"], "left")
    key = F.xxhash64("shingle")
    held = sets.groupBy("code_id").agg(F.collect_list(key).alias("all"), F.collect_list(F.when(F.col("stop").isNull(), key)).alias("kept"))
    side = lambda p: held.select(F.col("code_id").alias(f"{p}_id"), F.struct("all", "kept").alias(p))
    j = pairs.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")

    def jaccard(kind: str) -> Column:
        both = F.size(F.array_intersect(f"a.{kind}", f"b.{kind}"))
        any_of = F.size(f"a.{kind}") + F.size(f"b.{kind}") - both
        return F.when(F.col("a").isNull() | F.col("b").isNull() | (any_of == 0), F.lit(0.0)).otherwise(F.try_divide(both, any_of))

    return j.select("a_id", "b_id", "label", jaccard("all").alias("raw"), jaccard("kept").alias("masked"))
