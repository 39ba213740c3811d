"""Uniqueness of a text among its neighbours, and two-stage searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions import scoring as S
from twinsift.functions.text import identifier_set, normalize_search, word_set


def features(neighbours: DataFrame, queries: DataFrame, codes: DataFrame, top_k: int = 5) -> DataFrame:
    """query_id, code_id, rank, similarity, overlap, penalty and score of the neighbours that are scored.

    neighbours: query_id, code_id, similarity and rank of the shortlist. queries: query_id, code and lang. Of each shortlist
    the first max(10, 2 * top_k) are scored; those without code are passed over.
    """
    short = neighbours.where(F.col("rank") <= max(10, 2 * top_k)).join(codes.select("code_id", "code"), "code_id").where("code <> ''")
    q = queries.select("query_id", F.col("code").alias("q_code"), F.col("lang").alias("q_lang"))
    j = short.join(q, "query_id")
    # The sets are columns of their own before they are compared.
    j = j.select("query_id", "code_id", "similarity", "rank", word_set(F.col("q_code"), F.col("q_lang")).alias("a"), word_set(F.col("code"), F.col("q_lang")).alias("b"), F.length("q_code").alias("la"), F.length("code").alias("lb"))
    j = j.withColumn("overlap", S.jaccard(F.col("a"), F.col("b"))).withColumn("penalty", S.length_penalty(F.col("la"), F.col("lb")))
    score = S.boilerplate_cap(S.hybrid(F.col("similarity"), F.col("overlap"), F.col("penalty")), F.col("similarity"), F.col("overlap"))
    return j.select("query_id", "code_id", "rank", "similarity", "overlap", "penalty", F.round(score, 9).alias("score"))


def check(neighbours: DataFrame, queries: DataFrame, codes: DataFrame, top_k: int = 5) -> DataFrame:
    """query_id, closest_id, similarity and uniqueness_percent, one row a query; among equal scores the first counts."""
    scored = features(neighbours, queries, codes, top_k)
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("code_id", "score"), F.struct(F.col("score"), -F.col("rank"))).alias("m"))
    found = queries.select("query_id").join(best, "query_id", "left").select("query_id", F.when(F.col("m.score") > 0, F.col("m.code_id")).alias("closest_id"), F.greatest(F.coalesce("m.score", F.lit(0.0)), F.lit(0.0)).alias("similarity"))
    return found.withColumn("uniqueness_percent", S.uniqueness_percent(F.col("similarity")))


def fallback(tiers: list[DataFrame]) -> DataFrame:
    """Each query's neighbours from the first tier that has any, with the tier's number."""
    all_of = None
    for n, t in enumerate(tiers, 1):
        t = t.withColumn("tier", F.lit(n))
        all_of = t if all_of is None else all_of.unionByName(t)
    first = F.min("tier").over(Window.partitionBy("query_id"))
    return all_of.withColumn("_first", first).where("tier = _first").drop("_first")


def progressive(neighbours: DataFrame, queries: DataFrame, codes: DataFrame, k: int = 5, early: float = 0.985, fast_head: int = 30, deep_head: int = 120, low: float = 0.5, high: float = 2.0, min_overlap: float = 0.10, alpha: float = 0.7, lang: str | None = None) -> DataFrame:
    """query_id, mode, code_id, final and rank. A near hit among the fast head ends the search; else the deep head is gated and
    ranked anew. The language filters after the head is cut, as the head is what an index returns."""
    head = neighbours.join(codes.select("code_id", "lang"), "code_id")
    head = head.where(F.col("lang") == lang) if lang else head
    fast = head.where(F.col("rank") <= fast_head)
    done = fast.groupBy("query_id").agg(F.max("similarity").alias("top")).where(F.col("top") >= early).select("query_id")
    early_hits = fast.join(done, "query_id", "left_semi").select("query_id", F.lit("early").alias("mode"), "code_id", F.col("similarity").alias("final"))
    deep = head.where(F.col("rank") <= deep_head).join(done, "query_id", "left_anti")
    deep_hits = rerank(deep, queries, codes, low, high, min_overlap, alpha).select("query_id", F.lit("deep").alias("mode"), "code_id", "final")
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "code_id")
    return early_hits.unionByName(deep_hits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(head: DataFrame, queries: DataFrame, codes: DataFrame, low: float, high: float, min_overlap: float, alpha: float) -> DataFrame:
    """query_id, code_id and final: gates by length ratio and overlap, then blends cosine and overlap. The candidate's text is
    raw, the query's is normalized."""
    q = queries.select("query_id", normalize_search(F.col("code")).alias("q_code"), F.col("lang").alias("q_lang"))
    j = head.select("query_id", "code_id", "similarity").join(codes.select("code_id", "code", F.col("lang").alias("c_lang")), "code_id").where("code <> ''").join(q, "query_id")
    j = j.where(S.length_ratio(F.length("code"), F.length("q_code")).between(low, high))
    j = j.select("query_id", "code_id", "similarity", identifier_set(F.col("q_code"), F.col("q_lang")).alias("a"), identifier_set(F.col("code"), F.col("c_lang")).alias("b"))
    j = j.withColumn("overlap", S.jaccard(F.col("a"), F.col("b"))).where(F.col("overlap") >= min_overlap)
    return j.select("query_id", "code_id", F.round(S.blended(F.col("similarity"), F.col("overlap"), alpha), 9).alias("final"))
