"""Mixing sources to target weights, with DataFrame functions only.

Tokens are counted per source, a target is set for each source, and the repetition rate of a source is its target over its
tokens. Each document is emitted floor(rate) times, and once more with the fraction as probability, drawn from a hash of seed
and id: reruns agree and rows with one id are treated alike.

Targets share ``share`` times all tokens by weight. None exceeds ``most`` times its source's tokens: what exceeds it is shared
again among the others. With targets min(cap, level * weight), sources reach their caps in order of cap over weight, so that
the level follows from running sums over the sources in this order; no loop is needed.

A null text has size 0, null is a source of its own and comes last, an empty table gives an empty result. Only the columns
named are read; the emitted copies keep all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size and target, one row per source, from rows of source and size.

    The windows below have no partition: they run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest, all_of = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        weighted.withColumn("total", F.sum("source_size").over(all_of))
        .withColumn("filled", F.coalesce(F.sum("source_size").over(below), F.lit(0)) * most)
        .withColumn("level", (F.col("total") * F.lit(share) - F.col("filled")) / F.sum("weight").over(rest))
        # The first source that isn't full sets the level for itself and all after it.
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * most)
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(all_of))
    )
    cap = (F.col("source_size") * most).cast("double")
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))
    return leveled.select("source", "source_size", target.alias("target"))


def copies(rate: Column, id_: Column, seed: int) -> Column:
    """floor(rate), plus one if the draw of this id falls below the fraction."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def plan_mix(docs: DataFrame, seed: int = 7, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **shares) -> DataFrame:
    """doc_id, source, size, source_size, target and n_copies of each document; texts are read once."""
    sizes = materialize(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")))
    return _with_copies(sizes, sizes, seed, **shares)


def mix_sources(docs: DataFrame, seed: int = 7, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **shares) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    size, source = word_count(docs[text_col]), docs[source_col]
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), source.alias("source"), docs[id_col].alias("doc_id"))
    planned = _with_copies(docs.select(source.alias("source"), size.alias("size")), tagged, seed, **shares)
    return planned.where("n_copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("row.*")


def _with_copies(sizes: DataFrame, rows: DataFrame, seed: int, **shares) -> DataFrame:
    targets = broadcast_if_small(materialize(source_targets(sizes, **shares)))
    targets = targets.withColumnRenamed("source", "of")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    return rows.join(targets, rows["source"].eqNullSafe(targets["of"]), "inner").drop("of").withColumn("n_copies", copies(rate, F.col("doc_id"), seed))
