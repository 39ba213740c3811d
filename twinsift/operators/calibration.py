"""What a calibration run stores: scored pairs, and one row of the thresholds found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.scoring import decision
from twinsift.operators import metrics


def scores_table(scored: DataFrame, threshold: float, run_id: str, model: str, metric: str = "cosine", normalization: str = "none", boilerplate: str = "none") -> DataFrame:
    """Rows of practice_scores from a_lang, a_uid, b_lang, b_uid, label and score, with the decision at the threshold."""
    fixed = {"model": model, "normalization": normalization, "boilerplate": boilerplate, "metric": metric}
    return scored.select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ts"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(threshold).cast("float").alias("threshold"),
        "a_lang", F.col("a_uid").cast("string").alias("a_uid"), "b_lang", F.col("b_uid").cast("string").alias("b_uid"),
        F.col("label").cast("byte").alias("label"), F.col("score").cast("float").alias("score"), decision(F.col("score"), F.lit(threshold)).alias("decision"),
    )


def thresholds_table(scored: DataFrame, run_id: str, profile: str, split: str = "valid", metric: str = "cosine") -> DataFrame:
    """The row of practice_thresholds: the lowest threshold of greatest F1, with both areas."""
    numbers = {"threshold": "threshold", "roc_auc": "roc_auc", "pr_auc": "pr_auc", "precision": "precision_at_t", "recall": "recall_at_t", "f1": "f1_at_t"}
    fixed = [F.lit(v).alias(k) for k, v in {"profile": profile, "split": split, "metric": metric}.items()]
    return metrics.summary(scored).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ts"), *fixed, *[F.col(c).cast("float").alias(n) for c, n in numbers.items()])
