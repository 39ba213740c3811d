"""The service's operations as functions of DataFrames: add, list, search, look up, health, uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.text import public_id
from twinsift.operators import knn, uniqueness
from twinsift.operators.embedder import Embedder, HashingEmbedder, embed
from twinsift.operators.migration import new_id, unembedded
from twinsift.sources.sinks import delete_where

#: One profile for inserts and checks.
PROFILE = {"model": "hashing", "pooling": "mean", "transform_ver": 2}


def add_codes(rows: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of codes and of embeddings for uploads (lang, code), with the time; blank uploads are left out."""
    e = embedder or HashingEmbedder()
    kept = rows.where(F.coalesce(F.trim("code"), F.lit("")) != "")
    codes = kept.select(new_id(F.col("lang"), F.col("code")).alias("code_id"), F.lit("").alias("old_id"), "lang", F.lit("").alias("split"), F.lit("").alias("label"), "code", F.sha2("code", 256).alias("code_hash"), F.lit("api").alias("source"), F.current_timestamp().alias("ingested_at"))
    return codes, embed_codes(codes, e)


def embed_codes(codes: DataFrame, embedder: Embedder) -> DataFrame:
    """Embeddings of codes under the profile."""
    fixed = [F.lit(v).alias(k) for k, v in PROFILE.items()]
    return codes.select("code_id", "lang", *fixed, F.lit(embedder.dim).alias("dim"), embed(F.col("code"), embedder).alias("vector"), F.current_timestamp().alias("created_at"))


def refresh_profile(codes: DataFrame, embeddings: DataFrame, embedder: Embedder, replace: bool = False) -> DataFrame:
    """All embeddings after a run: those of the profile are made anew, or only where they are missing."""
    of_profile = (F.col("model") == PROFILE["model"]) & (F.col("pooling") == PROFILE["pooling"]) & (F.col("transform_ver") == PROFILE["transform_ver"])
    kept = delete_where(embeddings, of_profile) if replace else embeddings
    return kept.unionByName(embed_codes(unembedded(codes, kept, **PROFILE), embedder), allowMissingColumns=True)


def list_codes(codes: DataFrame, query: str = "", langs: list[str] | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """Total and page of codes that hold the text (any case) in these languages; page from 1, size from 1 to 100."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1, size is 1 to 100")
    found = codes.where(knn.where_all(langs=langs))
    found = found.where(F.instr(F.lower("code"), F.lit(query.lower())) > 0) if query else found
    shown = found.select(public_id(F.col("old_id"), F.col("lang"), F.col("code_id")).alias("id"), "lang", "split", "label", "code_id")
    return found.agg(F.count(F.lit(1)).alias("total")), shown.orderBy("code_id").offset((page - 1) * size).limit(size)


def get_code(codes: DataFrame, wanted: str) -> DataFrame:
    """By old id or lang/id if there is a slash, else by id."""
    if "/" not in wanted:
        return codes.where(F.col("code_id") == wanted).limit(1)
    lang, code_id = wanted.split("/", 1)
    return codes.where((F.col("old_id") == wanted) | ((F.col("lang") == lang) & (F.col("code_id") == code_id))).limit(1)


def languages(table: DataFrame) -> DataFrame:
    return table.where("enabled").select("lang").orderBy("lang")


def storage_health(codes: DataFrame, embeddings: DataFrame) -> DataFrame:
    return codes.agg(F.count(F.lit(1)).alias("codes")).withColumn("embeddings", embeddings.agg(F.count(F.lit(1))).scalar())


def check_uniqueness(spark: SparkSession, texts: list[tuple[str, str | None]], codes: DataFrame, embeddings: DataFrame, top_k: int = 5, embedder: Embedder | None = None) -> DataFrame:
    """Uniqueness of (code, lang) texts: neighbours of the profile and language, then of the profile, then any."""
    e = embedder or HashingEmbedder()
    rows = [(i, c, lang, e.encode([c])[0].tolist()) for i, (c, lang) in enumerate(texts)]
    q = spark.createDataFrame(rows, "query_id long, code string, lang string, vector array<float>")
    have = embeddings.join(codes.where("code <> ''").select("code_id"), "code_id", "left_semi")
    profile = knn.where_all(**PROFILE)
    k = max(20, 3 * top_k)
    by_lang = None
    for lang in sorted({x for _, x in texts if x}):
        near = knn.top_k(q.where(F.col("lang") == lang), have.where(profile & (F.col("lang") == lang)), k)
        by_lang = near if by_lang is None else by_lang.unionByName(near)
    tiers = ([by_lang] if by_lang is not None else []) + [knn.top_k(q, have.where(profile), k), knn.top_k(q, have, k)]
    return uniqueness.check(uniqueness.fallback(tiers), q, codes, top_k)
