"""Evaluation: thresholds, curves, confusion, and agreement of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Scores are dealt by steps of this size of their arc tangent, whatever their range: 6,437 bins at most.
BINS = 2048


def curve(scored: DataFrame) -> DataFrame:
    """score, tp, fp, p and n at each distinct score as threshold (label 1 is positive).

    Running sums within a bin of scores, on top of those of the bins above: only the bins' totals pass through one task.
    """
    per = scored.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    per = per.withColumn("bin", F.when(F.isnan("score"), F.lit(1 << 20)).otherwise(F.floor(F.atan(F.col("score").cast("double")) * BINS)).cast("long"))
    above, all_of = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    bins = per.groupBy(F.col("bin").alias("of")).agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn")).withColumnRenamed("of", "bin")
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    bins = bins.select(F.col("bin").alias("of"), before("bp").alias("tp0"), before("bn").alias("fp0"), F.sum("bp").over(all_of).alias("p"), F.sum("bn").over(all_of).alias("n"))
    down = Window.partitionBy("bin").orderBy(F.desc("score"))
    placed = per.join(F.broadcast(bins), F.col("bin").eqNullSafe(F.col("of")))
    return placed.select("score", "pos", "neg", (F.sum("pos").over(down) + F.col("tp0")).alias("tp"), (F.sum("neg").over(down) + F.col("fp0")).alias("fp"), "p", "n")


def _auc() -> Column:
    won = F.col("neg") * (F.col("tp") - F.col("pos")) + F.lit(0.5) * F.col("neg") * F.col("pos")
    return F.sum(won) / F.nullif(F.first("p") * F.first("n"), F.lit(0))


def _precision_sum() -> Column:
    return F.sum(F.col("pos") / F.nullif(F.col("p"), F.lit(0)) * (F.col("tp") / (F.col("tp") + F.col("fp"))))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of positive and negative pairs in right order, ties count half."""
    return curve(scored).agg(_auc().alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over thresholds of the step in recall times precision."""
    return curve(scored).agg(_precision_sum().alias("average_precision"))


def best_f1(scored: DataFrame) -> DataFrame:
    """The lowest threshold of greatest F1, with precision and recall there."""
    return summary(scored).drop("roc_auc", "pr_auc")


def summary(scored: DataFrame) -> DataFrame:
    """threshold, f1, precision and recall as of best_f1, roc_auc and pr_auc, from one curve."""
    c = curve(scored).withColumn("f1", F.lit(2.0) * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")))
    best = c.agg(F.max_by(F.struct("score", "f1", "tp", "fp", "p"), F.struct(F.col("f1"), -F.col("score"))).alias("b"), _auc().alias("roc_auc"), _precision_sum().alias("pr_auc"))
    return best.select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"), (F.col("b.tp") / F.nullif(F.col("b.tp") + F.col("b.fp"), F.lit(0))).alias("precision"), (F.col("b.tp") / F.nullif(F.col("b.p"), F.lit(0))).alias("recall"), "roc_auc", "pr_auc")


def confusion(scored: DataFrame, threshold: float, *by: str) -> DataFrame:
    """tp, fp, tn, fn, precision, recall and f1, of all rows or of each group; an empty denominator gives 0."""
    hit = F.col("score") >= F.lit(threshold)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = scored.groupBy(*by).agg(n(hit & (F.col("label") == 1)).alias("tp"), n(hit & (F.col("label") == 0)).alias("fp"), n(~hit & (F.col("label") == 0)).alias("tn"), n(~hit & (F.col("label") == 1)).alias("fn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = c.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", share(F.lit(2.0) * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def recall_at_k(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """query_id and the share of its exact neighbours that approx has."""
    hits = approx.select("query_id", "code_id", F.lit(1).alias("hit"))
    return exact.join(hits, ["query_id", "code_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def kendall_tau(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """query_id and tau over the neighbours both have; queries with fewer than two are left out."""
    both = exact.select("query_id", "code_id", F.col("rank").alias("ra")).join(approx.select("query_id", "code_id", F.col("rank").alias("rb")), ["query_id", "code_id"])
    o = both.select("query_id", F.col("ra").alias("oa"), F.col("rb").alias("ob"))
    pairs = both.join(o, "query_id").where("ra < oa")
    return pairs.groupBy("query_id").agg((F.sum(F.signum((F.col("oa") - F.col("ra")).cast("double") * (F.col("ob") - F.col("rb")))) / F.count(F.lit(1))).alias("tau"))
