"""Latency and agreement of searches: each query timed on its own, and held against exact search."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators import knn, metrics
from twinsift.operators.pairs import draw

#: engine -> (search of (queries, rows wanted), its parameters)
Engines = dict[str, tuple[Callable[[DataFrame, int], DataFrame], dict]]


def top_k_benchmark(corpus: DataFrame, engines: Engines, k: int = 10, n_queries: int = 300, seed: int = 42, exclude_self: bool = True) -> DataFrame:
    """Rows of bench_topk_results without run_id and ts: exact search and each engine over n_queries random rows of the corpus.

    Each query runs as a job of its own, so that latency is that of one query. Only n_queries vectors and k neighbours of each
    come to the driver.
    """
    spark = corpus.sparkSession
    asked = corpus.orderBy(draw(seed, F.col("code_id")), "code_id").limit(n_queries).select(F.col("code_id").alias("query_id"), "vector")
    schema, rows = asked.schema, asked.collect()
    exact = lambda q, m: knn.top_k(q, corpus, m)
    n, d = corpus.count(), len(rows[0]["vector"]) if rows else 0
    found, out = {}, []
    for engine, (search, params) in {"exact": (exact, {}), **engines}.items():
        took, near = [], []
        for row in rows:
            began = time.perf_counter()
            got = search(spark.createDataFrame([row], schema), k + exclude_self).select("query_id", "code_id", "rank").orderBy("rank").collect()
            took.append((time.perf_counter() - began) * 1000)
            kept = [g for g in got if not (exclude_self and g["code_id"] == g["query_id"])][:k]
            near += [(g["query_id"], g["code_id"], i + 1) for i, g in enumerate(kept)]
        ids = schema["query_id"].dataType.simpleString()
        found[engine] = spark.createDataFrame(near, f"query_id {ids}, code_id {ids}, rank int")
        out.append((engine, n, d, k, len(rows), json.dumps(params), *(_figures(took)), *_agreement(found["exact"], found[engine])))
    return spark.createDataFrame(out, "engine string, n int, d int, k int, queries int, params string, p50_ms float, p95_ms float, mean_ms float, recall_mean float, recall_p50 float, recall_p95 float, tau_mean float")


def _figures(took: list[float]) -> tuple[float | None, ...]:
    return (float(np.percentile(took, 50)), float(np.percentile(took, 95)), float(np.mean(took))) if took else (None, None, None)


def _agreement(exact: DataFrame, other: DataFrame) -> tuple:
    recall, tau = metrics.recall_at_k(exact, other), metrics.kendall_tau(exact, other)
    r = recall.agg(F.avg("recall"), F.percentile("recall", 0.5), F.percentile("recall", 0.95)).first()
    return (*r, tau.agg(F.avg("tau")).first()[0])
