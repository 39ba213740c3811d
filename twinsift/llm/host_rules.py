"""Quality rules judged by host, with DataFrame functions only.

Each document is measured; documents that fail a rule are counted by host; host rates are shrunk toward all hosts' rate by a
beta prior fitted to the hosts' rates by moments; a host whose shrunk rate reaches ``host_limit`` is rejected with all its
documents. Words are measured within the row by array functions: a document's windows are never exploded, so that nothing but
host counts is shuffled.

A null text has no words (and fails), null is a host of its own, an empty table gives an empty result. Rows are judged
independently, so repeated rows agree. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep, let, materialize, scratch

GAP = "[\\x20\\x09-\\x0D]+"
WINDOW = 8


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of a text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeat_words(ws).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that are found twice or more; windows are told apart by a 64-bit hash.

    Hashes of 1, 2, 4 and then 8 words: each is made from two of half its length.
    """
    joined = lambda a, k: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + k)))
    single = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(single, lambda a: let(joined(a, 1), lambda b: let(joined(b, 2), lambda c: joined(c, 4))))
    windows = F.when(F.size(words) > WINDOW, F.slice(eight, F.lit(1), F.size(words) - (WINDOW - 1)))
    return F.coalesce(let(windows, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), _covered(v)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def _covered(windows: Column) -> Column:
    """Words covered by windows that have an equal: sort by hash, keep those with an equal neighbour, add up by position."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    equal = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    found = let(pairs, lambda s: F.transform(F.filter(s, lambda x, k: equal(s, x, k - 1) | equal(s, x, k + 1)), lambda x: x["i"]))
    step = lambda p: F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(let(F.sort_array(found), step), F.lit(0), lambda a, x: a + x)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def host_verdicts(measured: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """source, n, failed, rate (shrunk) and host_kept, one row per host.

    A document counts as failed for its host if it fails the base rules, if symbols exceed a fifth of its words, or if over
    30 % of its lines with words repeat earlier lines (at least three).
    """
    failed = F.col("base_failed") | (5 * F.col("n_symbols") > F.col("n_words")) | ((F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")))
    hosts = materialize(measured.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failed")))
    # One row: pooled rate m, variance of the hosts' rates less what chance alone gives, and from both the prior's strength.
    m, rate = F.sum("failed") / F.sum("n"), F.col("failed") / F.col("n")
    stats = hosts.agg(m.alias("m"), (F.var_samp(rate) - m * (1 - m) * F.avg(1 / F.col("n"))).alias("v"))
    bound = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(10.0)), F.lit(1.0)), F.lit(1e6))
    strength = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).when(F.col("v") <= 0, F.lit(1e6))
    prior = stats.select(F.struct(F.col("m"), bound(strength).alias("k")).alias("p")).scalar()
    shrunk = (F.col("failed") + F.col("p.m") * F.col("p.k")) / (F.col("n") + F.col("p.k"))
    return hosts.withColumn("p", prior).withColumn("rate", shrunk).select("source", "n", "failed", "rate", (F.col("rate") < host_limit).alias("host_kept"))


def judge_documents(docs: DataFrame, host_limit: float = 0.5, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, the measures, base_failed, host_kept and kept, one row per document."""
    measured = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("source"), measures(docs[text_col]).alias("m")).select("doc_id", "source", "m.w.*", "m.l.*", "m.n_symbols")
    measured = materialize(measured.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))))
    with scratch():
        hosts = keep(materialize(host_verdicts(measured, host_limit).select(F.col("source").alias("of"), "rate", "host_kept")))
    hosts = broadcast_if_small(hosts)
    joined = measured.join(hosts, measured["source"].eqNullSafe(hosts["of"]), "inner").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
