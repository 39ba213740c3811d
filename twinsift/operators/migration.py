"""Moves between schema versions: new ids, re-keyed embeddings, incremental work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import vectors
from twinsift.sources.sinks import first_wins

PROFILE = ("model", "pooling", "transform_ver")


def new_id(*parts: Column) -> Column:
    """A stable id of 26 signs from the parts, in place of a random one."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 26))


def id_map(old: DataFrame) -> DataFrame:
    """lang, old_code_id and code_id, one new id for each (lang, old id)."""
    return first_wins(old, ["lang", "old_code_id"], "old_code_id").select("lang", "old_code_id", new_id(F.col("lang"), F.col("old_code_id")).alias("code_id"))


def rekey(embeddings: DataFrame, ids: DataFrame, done: DataFrame) -> DataFrame:
    """Embeddings under their new ids that ``done`` doesn't hold yet (by id, profile and time)."""
    moved = embeddings.join(ids, ["lang", "old_code_id"]).drop("old_code_id")
    return moved.join(done, ["code_id", *PROFILE, "created_at"], "left_anti")


def unembedded(codes: DataFrame, embeddings: DataFrame, model: str, pooling: str, transform_ver: int) -> DataFrame:
    """Codes that lack an embedding of this profile."""
    have = embeddings.where((F.col("model") == model) & (F.col("pooling") == pooling) & (F.col("transform_ver") == transform_ver))
    return codes.join(have, ["code_id", "lang"], "left_anti")


def copied(embeddings: DataFrame, dim: int) -> DataFrame:
    """Rows of the right length, scaled to unit length."""
    return embeddings.where(vectors.has_dim(F.col("vector"), dim)).withColumn("vector", vectors.normalized(F.col("vector")))


def with_fixed_vectors(table: DataFrame, dim: int) -> DataFrame:
    """emb becomes emb_fixed if it has this length, else null."""
    return table.withColumn("emb_fixed", F.when(vectors.has_dim(F.col("emb"), dim), F.col("emb"))).drop("emb")
