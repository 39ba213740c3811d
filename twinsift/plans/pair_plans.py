"""Pair-set and evaluation queries. PLANS: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinsift.functions import scoring, vectors
from twinsift.functions.text import normalize_sql_light, rename_identifiers
from twinsift.operators import benchmark, calibration, knn, metrics, pairs, stoplist
from twinsift.sources.tables import codes, embeddings, read

WIDTH = 20


def _rows(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("lang", F.col("doc_id").alias("uid"), F.col("source").alias("split"), F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("md5"))


def norm_md5_pairs(spark, d):
    rows = read(spark, d, "documents").select("lang", F.col("doc_id").alias("uid"), normalize_sql_light(F.col("text")).alias("norm"))
    found = pairs.equal_key_pairs(rows, F.md5(F.col("norm").cast("binary")))
    return found.select("lang", "a_uid", "b_uid", F.lit(1).alias("label"), F.lit("norm_md5_dup").alias("notes")).orderBy("a_uid", "b_uid").limit(2000)


def random_negatives(spark, d):
    return pairs.random_negatives(_rows(spark, d), 200)


def band_join_hard_negatives(spark, d):
    rows = _rows(spark, d)
    return pairs.band_pairs(rows, rows, WIDTH)


def hard_negatives_quota(spark, d):
    rows = _rows(spark, d)
    anchors = pairs.sample(rows, 50, "uid", 42, by="lang")
    known = pairs.equal_key_pairs(rows, F.col("md5"))
    return pairs.quota(pairs.without_known(pairs.band_pairs(anchors, rows, WIDTH), known), 300)


def anti_duplicate_pairs(spark, d):
    rows = _rows(spark, d)
    found = pairs.band_pairs(rows, rows, 5).select("a_uid", "b_uid")
    both = found.unionByName(found.select(F.col("b_uid").alias("a_uid"), F.col("a_uid").alias("b_uid")))
    known = found.where("(a_uid + b_uid) % 2 = 0").select(F.col("b_uid").alias("a_uid"), F.col("a_uid").alias("b_uid"))
    return pairs.without_known(both, known)


def synth_positive_pairs(spark, d):
    rows = codes(spark, d).select("lang", F.col("code_id").cast("string").alias("uid"), "code")
    augmented = rows.where(F.col("uid").endswith("7")).select("lang", F.concat("uid", F.lit("__aug")).alias("uid"))
    return pairs.synthetic_positives(augmented, rows, "__aug")


def augment_identifiers(spark, d):
    """100 texts of each language with renamed identifiers, as split aug."""
    some = pairs.sample(codes(spark, d), 100, "code_id", by="lang")
    return some.select("lang", F.lit("aug").alias("split"), F.concat(F.col("code_id").cast("string"), F.lit("__aug")).alias("uid"), rename_identifiers("code", "lang").alias("code"))


def seeded_sample(spark, d):
    return pairs.sample(codes(spark, d), 100, "code_id").select("code_id", "lang")


def group_pair_sampling(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("group"))
    return pairs.group_pairs(rows, 40, 1.0)


def _scored(spark, d):
    """Pairs of every vector whose id is divisible by 20 with all others: label 1 if their groups agree; scored by cosine."""
    e = embeddings(spark, d)
    stated = e.where("code_id % 20 = 0").select(F.col("code_id").alias("query_id"), "vector")
    j = knn.all_scores(stated, e).select(F.col("query_id").alias("a_id"), F.col("code_id").alias("b_id"), "score")
    j = j.where("a_id <> b_id and (b_id % 20 <> 0 or a_id < b_id)")
    group = lambda x: e.select(F.col("code_id").alias(f"{x}_id"), F.col("label").alias(f"l{x}"))
    return j.join(group("a"), "a_id").join(group("b"), "b_id").select("a_id", "b_id", (F.col("la") == F.col("lb")).cast("int").alias("label"), "score")


def vector_join_scores(spark, d):
    return _scored(spark, d)


def pair_decisions(spark, d):
    return _scored(spark, d).withColumn("decision", scoring.decision(F.col("score"), F.lit(0.1)))


def _round(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


def roc_auc(spark, d):
    return _round(metrics.roc_auc(_scored(spark, d)), "roc_auc")


def average_precision(spark, d):
    return _round(metrics.average_precision(_scored(spark, d)), "average_precision")


def best_f1_threshold(spark, d):
    return _round(metrics.best_f1(_scored(spark, d)), "f1", "precision", "recall")


def confusion_at_threshold(spark, d):
    return _round(metrics.confusion(_scored(spark, d), 0.1), "precision", "recall", "f1")


def _exact_and_cut(spark, d, k=10):
    """Exact neighbours, and those by the first half of each vector."""
    e = embeddings(spark, d)
    q = e.where("code_id % 20 = 0").select(F.col("code_id").alias("query_id"), "vector")
    cut = lambda x: x.withColumn("vector", F.slice("vector", 1, 32))
    return knn.top_k(q, e, k, exclude_self=True), knn.top_k(cut(q), cut(e), k, exclude_self=True)


def recall_at_k(spark, d):
    return _round(metrics.recall_at_k(*_exact_and_cut(spark, d)), "recall")


def kendall_tau(spark, d):
    return _round(metrics.kendall_tau(*_exact_and_cut(spark, d)), "tau")


def ann_benchmark(spark, d):
    """Recall and tau of the cluster index against exact search, 300 queries, themselves left out."""
    e = embeddings(spark, d)
    q = e.orderBy(pairs.draw(42, F.col("code_id")), "code_id").limit(300).select(F.col("code_id").alias("query_id"), "vector")
    exact = knn.top_k(q, e, 10, exclude_self=True)
    indexed, centers = knn.ivf_index(e.select("code_id", "vector"))
    order = Window.partitionBy("query_id").orderBy("rank")
    approx = knn.ivf_top_k(q, indexed, centers, 11).where("query_id <> code_id").withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    both = metrics.recall_at_k(exact, approx).join(metrics.kendall_tau(exact, approx), "query_id", "left")
    return both.agg(F.lit("ivf").alias("engine"), F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall_mean"), F.percentile("recall", 0.5).alias("recall_p50"), F.avg("tau").alias("tau_mean"))


def top_k_benchmark(spark, d):
    """Latency and agreement with exact search, 20 queries one by one (the number is the benchmark's parameter)."""
    e = embeddings(spark, d).select("code_id", "vector")
    indexed, centers = knn.ivf_index(e)
    engines = {
        "ivf": (lambda q, m: knn.ivf_top_k(q, indexed, centers, m), {"n_lists": len(centers), "n_probe": knn.N_PROBE}),
        "lsh": (lambda q, m: knn.lsh_top_k(q, e, m), {"bits": knn.LSH_BITS, "tables": knn.LSH_TABLES}),
    }
    return benchmark.top_k_benchmark(e, engines, n_queries=20)


def latency_percentiles(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 9).alias("p50"), F.round(F.percentile("value", 0.95), 9).alias("p95"))


def vector_norm_diag(spark, d):
    n = embeddings(spark, d).select(vectors.norm(F.col("vector")).alias("n"))
    return n.agg(F.count_if(F.col("n") == 0).alias("zero"), F.round(F.min("n"), 6).alias("min"), F.round(F.max("n"), 6).alias("max"), F.round(F.avg("n"), 6).alias("mean"))


def pair_coverage(spark, d):
    """Of the labelled pairs, how many have both vectors."""
    p = group_pair_sampling(spark, d)
    have = embeddings(spark, d).select(F.col("code_id").alias("v")).distinct()
    a, b = have.select(F.col("v").alias("a_uid"), F.lit(1).alias("ha")), have.select(F.col("v").alias("b_uid"), F.lit(1).alias("hb"))
    j = p.join(a, "a_uid", "left").join(b, "b_uid", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ha").isNotNull() & F.col("hb").isNotNull()).alias("with_vecs"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def label_distribution(spark, d):
    return read(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def shingle_df(spark, d):
    return stoplist.document_frequency(codes(spark, d), 5).where("df > 1")


def stoplist_df_cutoff(spark, d):
    return stoplist.stoplist(codes(spark, d), 3, 0.02)


def stoplist_top_k(spark, d):
    return stoplist.stoplist(codes(spark, d), 3, 0.005, top=100)


def stoplist_table(spark, d):
    return stoplist.stoplist_table(codes(spark, d), 5, 0.005, "documents", "1")


def masked_overlap(spark, d):
    rows = codes(spark, d)
    p = norm_md5_pairs(spark, d).select(F.col("a_uid").alias("a_id"), F.col("b_uid").alias("b_id"), "label").unionByName(random_negatives(spark, d).select(F.col("a_uid").alias("a_id"), F.col("b_uid").alias("b_id"), F.lit(0).alias("label")))
    return _round(stoplist.masked_overlap(p, rows, stoplist.stoplist(rows, 3, 0.02), 3), "raw", "masked")


def masked_evaluation(spark, d):
    """Confusion of raw and masked scores, and the false positives that masking saves."""
    j = masked_overlap(spark, d)
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("score")) for c in ("raw", "masked")])).alias("s")
    both = metrics.confusion(j.select("label", kinds).select("label", "s.*"), 0.05, "kind")
    return _round(both.withColumn("fp_saved", F.max("fp").over(Window.partitionBy(F.lit(1))) - F.col("fp")), "precision", "recall", "f1")


def calibrate_threshold(spark, d):
    """One row of the thresholds table."""
    one = metrics.summary(_scored(spark, d))
    return _round(one.withColumn("metric", F.lit("cosine")), "f1", "precision", "recall", "roc_auc", "pr_auc")


def stored_pairs(spark, d):
    """Synthetic positives as stored rows; every uid that ends in 27 has its pair already, the other way round."""
    rows = codes(spark, d).select("lang", F.col("code_id").cast("string").alias("uid"))
    augmented = rows.where(F.col("uid").endswith("7")).select("lang", F.concat("uid", F.lit("__aug")).alias("uid"))
    stored = rows.where(F.col("uid").endswith("27")).select(F.col("uid").alias("a_uid"), F.concat("uid", F.lit("__aug")).alias("b_uid"))
    return pairs.added_synthetic(augmented, rows, "__aug", stored).drop("pair_id")


def stored_scores(spark, d):
    """The scored pairs of a calibration run, less its time."""
    s = _scored(spark, d).select(F.lit("x").alias("a_lang"), F.col("a_id").alias("a_uid"), F.lit("x").alias("b_lang"), F.col("b_id").alias("b_uid"), "label", "score")
    return calibration.scores_table(s, 0.1, "run", "m1").select("run_id", "model", "metric", "a_uid", "b_uid", F.col("label").cast("int").alias("label"), "decision")


_ROWS = "rows_ AS (SELECT lang, doc_id AS uid, source AS split, length(text) AS size, md5(text) AS md5 FROM documents)"
_LIGHT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)//.*$', '', 'g'), '(?m)#.*$', '', 'g'), '[\\t ]+', ' ', 'g')"
_MD5 = f"md5_pairs AS (SELECT a.lang, a.doc_id AS a_uid, b.doc_id AS b_uid, 1 AS label, 'norm_md5_dup' AS notes FROM (SELECT *, md5({_LIGHT}) AS k FROM documents) a JOIN (SELECT *, md5({_LIGHT}) AS k FROM documents) b ON a.lang = b.lang AND a.k = b.k AND a.doc_id < b.doc_id ORDER BY 2, 3 LIMIT 2000)"
_NEG = "random_pairs AS (SELECT a_uid, b_uid FROM (SELECT doc_id AS a_uid, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) JOIN (SELECT doc_id AS b_uid, row_number() OVER (ORDER BY md5('8:' || doc_id), doc_id) AS r FROM documents) USING (r) WHERE r <= 200 AND a_uid <> b_uid)"


def _band(anchors, width=WIDTH):
    return f"SELECT a.lang, a.uid AS a_uid, b.uid AS b_uid FROM {anchors} a JOIN rows_ b ON a.lang = b.lang AND b.uid > a.uid AND abs(a.size - b.size) <= {width} AND a.md5 <> b.md5"


_SCORED = "scored AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, (a.label = b.label)::INT AS label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0::DOUBLE AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND (b.vec_id % 20 <> 0 OR a.vec_id < b.vec_id))"
_CURVE = f"""{_SCORED},
per AS (SELECT score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM scored GROUP BY score),
curve AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM per)"""
_AUC = "SELECT sum(neg * (tp - pos) + 0.5::DOUBLE * neg * pos) / any_value(p * n) FROM curve"
_AP = "SELECT sum(pos::DOUBLE / p * (tp::DOUBLE / (tp + fp))) FROM curve"
_F1 = "best AS (SELECT score AS threshold, 2.0::DOUBLE * tp / (tp + fp + p) AS f1, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM curve ORDER BY f1 DESC, score LIMIT 1)"


def _confusion(table, score, threshold, more=""):
    return f"""SELECT {more} tp, fp, tn, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
FROM (SELECT count(*) FILTER (WHERE {score} >= {threshold} AND label = 1) AS tp, count(*) FILTER (WHERE {score} >= {threshold} AND label = 0) AS fp, count(*) FILTER (WHERE {score} < {threshold} AND label = 0) AS tn, count(*) FILTER (WHERE {score} < {threshold} AND label = 1) AS fn FROM {table})"""


def _near(name, vec):
    sim = f"round(list_cosine_similarity({vec.format('q')}, {vec.format('e')}), 6)"
    return f"{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS code_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {sim} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 10)"


_BOTH = _near("exact", "{}.embedding::DOUBLE[]") + ", " + _near("cut", "({}.embedding::DOUBLE[])[1:32]")
_TOK = r"regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*|==|!=|<=|>=|&&|\|\||[{}();,\[\].:+\-*/]')"


def _sets(n):
    return f"sets AS (SELECT DISTINCT doc_id, lang, array_to_string(t[i:i + {n - 1}], chr(1)) AS shingle FROM (SELECT doc_id, lang, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT doc_id, lang, {_TOK} AS t FROM documents)))"


def _stop(n, share, min_df=2):
    return f"{_sets(n)}, per_lang AS (SELECT lang, count(DISTINCT doc_id) AS docs FROM sets GROUP BY lang), stop AS (SELECT lang, shingle, count(*) AS df FROM sets JOIN per_lang USING (lang) GROUP BY lang, shingle, docs HAVING count(*) >= greatest({min_df}, floor(docs * {share}::DOUBLE)))"


_GROUPED = """placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS k FROM documents WHERE source IS NOT NULL AND source <> ''),
rings AS (SELECT source, doc_id, i, k, least(40, k * (k - 1) // 2) AS want, unnest(range(1, 2 + k)) AS d FROM placed WHERE k > 1),
pos AS (SELECT least(r.doc_id, o.doc_id) AS a_uid, greatest(r.doc_id, o.doc_id) AS b_uid, 1 AS label FROM rings r JOIN placed o ON o.source = r.source AND o.i = (r.i + r.d) % r.k
  WHERE (d - 1) * r.k + r.i < want AND NOT (2 * d = r.k AND 2 * r.i >= r.k)),
neg AS (SELECT a_uid, b_uid, 0 AS label FROM (SELECT a_uid, b_uid, row_number() OVER (ORDER BY r) AS p FROM
  (SELECT doc_id AS a_uid, source AS ga, row_number() OVER (ORDER BY md5('43:' || doc_id), doc_id) AS r FROM placed)
  JOIN (SELECT doc_id AS b_uid, source AS gb, row_number() OVER (ORDER BY md5('44:' || doc_id), doc_id) AS r FROM placed) USING (r) WHERE ga <> gb) WHERE p <= (SELECT count(*) FROM pos)),
grouped AS (SELECT * FROM pos UNION ALL SELECT * FROM neg)"""
_MASKED = f"""{_ROWS}, {_MD5}, {_NEG}, {_stop(3, 0.02)},
p AS (SELECT a_uid AS a_id, b_uid AS b_id, 1 AS label FROM md5_pairs UNION ALL SELECT a_uid, b_uid, 0 FROM random_pairs),
marked AS (SELECT s.doc_id, s.shingle, stop.shingle IS NOT NULL AS st FROM sets s LEFT JOIN stop ON s.lang = stop.lang AND s.shingle = stop.shingle),
l AS (SELECT doc_id, list(shingle) AS s, coalesce(list(shingle) FILTER (WHERE NOT st), []) AS m FROM marked GROUP BY doc_id),
masked AS (SELECT a_id, b_id, label, round(coalesce(len(list_intersect(x.s, y.s))::DOUBLE / nullif(len(list_distinct(list_concat(x.s, y.s))), 0), 0), 9) AS raw,
  round(coalesce(len(list_intersect(x.m, y.m))::DOUBLE / nullif(len(list_distinct(list_concat(x.m, y.m))), 0), 0), 9) AS masked
  FROM p LEFT JOIN l x ON x.doc_id = a_id LEFT JOIN l y ON y.doc_id = b_id)"""

PLANS = {
    "norm_md5_pairs": (norm_md5_pairs, f"WITH {_MD5} SELECT * FROM md5_pairs"),
    "random_negatives": (random_negatives, f"WITH {_NEG} SELECT * FROM random_pairs"),
    "band_join_hard_negatives": (band_join_hard_negatives, f"WITH {_ROWS} {_band('rows_')}"),
    "hard_negatives_quota": (hard_negatives_quota, f"""WITH {_ROWS}, anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || uid), uid) AS k FROM rows_) WHERE k <= 50), band AS ({_band('anchors')})
SELECT lang, a_uid, b_uid FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || a_uid || ':' || b_uid), a_uid, b_uid) AS k FROM band) WHERE k <= ceil(300.0 / (SELECT count(DISTINCT lang) FROM band))"""),
    "anti_duplicate_pairs": (anti_duplicate_pairs, f"WITH {_ROWS}, band AS ({_band('rows_', 5)}) SELECT a_uid, b_uid FROM band WHERE (a_uid + b_uid) % 2 <> 0"),
    "synth_positive_pairs": (synth_positive_pairs, "SELECT lang, doc_id || '__aug' AS a_uid, doc_id::VARCHAR AS b_uid FROM documents WHERE doc_id::VARCHAR LIKE '%7'"),
    "augment_identifiers": (augment_identifiers, None),
    "seeded_sample": (seeded_sample, "SELECT doc_id AS code_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100"),
    "group_pair_sampling": (group_pair_sampling, f"WITH {_GROUPED} SELECT * FROM grouped"),
    "vector_join_scores": (vector_join_scores, f"WITH {_SCORED} SELECT * FROM scored"),
    "pair_decisions": (pair_decisions, f"WITH {_SCORED} SELECT *, CASE WHEN score >= 0.1 THEN 'Plagiarism' ELSE 'OK' END AS decision FROM scored"),
    "roc_auc": (roc_auc, f"WITH {_CURVE} SELECT round(({_AUC}), 9) AS roc_auc"),
    "average_precision": (average_precision, f"WITH {_CURVE} SELECT round(({_AP}), 9) AS average_precision"),
    "best_f1_threshold": (best_f1_threshold, f"WITH {_CURVE}, {_F1} SELECT threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM best"),
    "confusion_at_threshold": (confusion_at_threshold, f"WITH {_SCORED} {_confusion('scored', 'score', '0.1::DOUBLE')}"),
    "recall_at_k": (recall_at_k, f"WITH {_BOTH} SELECT e.query_id, round(count(c.code_id)::DOUBLE / count(*), 9) AS recall FROM exact e LEFT JOIN cut c ON e.query_id = c.query_id AND e.code_id = c.code_id GROUP BY e.query_id"),
    "kendall_tau": (kendall_tau, f"WITH {_BOTH}, b AS (SELECT e.query_id, e.rank AS ra, c.rank AS rb FROM exact e JOIN cut c USING (query_id, code_id)) SELECT x.query_id, round(sum(sign(y.rb - x.rb))::DOUBLE / count(*), 9) AS tau FROM b x JOIN b y ON x.query_id = y.query_id AND x.ra < y.ra GROUP BY x.query_id"),
    "ann_benchmark": (ann_benchmark, None),
    "top_k_benchmark": (top_k_benchmark, None),
    "stored_pairs": (stored_pairs, "SELECT 'valid' AS split, lang AS a_lang, doc_id || '__aug' AS a_uid, lang AS b_lang, doc_id::VARCHAR AS b_uid, 1::TINYINT AS label, 'synth_positive' AS notes FROM documents WHERE doc_id::VARCHAR LIKE '%7' AND doc_id::VARCHAR NOT LIKE '%27'"),
    "stored_scores": (stored_scores, f"WITH {_SCORED} SELECT 'run' AS run_id, 'm1' AS model, 'cosine' AS metric, a_id::VARCHAR AS a_uid, b_id::VARCHAR AS b_uid, label, CASE WHEN score >= 0.1 THEN 'Plagiarism' ELSE 'OK' END AS decision FROM scored"),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY event_type"),
    "vector_norm_diag": (vector_norm_diag, "WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT count(*) FILTER (WHERE n = 0) AS zero, round(min(n), 6) AS min, round(max(n), 6) AS max, round(avg(n), 6) AS mean FROM n"),
    "pair_coverage": (pair_coverage, f"WITH {_GROUPED}, v AS (SELECT DISTINCT vec_id FROM embeddings) SELECT count(*) AS total, count(*) FILTER (WHERE a_uid IN (SELECT vec_id FROM v) AND b_uid IN (SELECT vec_id FROM v)) AS with_vecs, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM grouped"),
    "label_distribution": (label_distribution, "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic ORDER BY n DESC"),
    "shingle_df": (shingle_df, f"WITH {_sets(5)} SELECT lang, shingle, count(*) AS df FROM sets GROUP BY lang, shingle HAVING count(*) > 1"),
    "stoplist_df_cutoff": (stoplist_df_cutoff, f"WITH {_stop(3, 0.02)} SELECT * FROM stop"),
    "stoplist_top_k": (stoplist_top_k, f"WITH {_stop(3, 0.005)} SELECT lang, shingle, df FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, shingle) AS k FROM stop) WHERE k <= 100"),
    "stoplist_table": (stoplist_table, None),
    "masked_overlap": (masked_overlap, f"WITH {_MASKED} SELECT * FROM masked"),
    "masked_evaluation": (masked_evaluation, f"WITH {_MASKED}, c AS ({_confusion('masked', 'raw', '0.05::DOUBLE', chr(39) + 'raw' + chr(39) + ' AS kind,')} UNION ALL {_confusion('masked', 'masked', '0.05::DOUBLE', chr(39) + 'masked' + chr(39) + ' AS kind,')}) SELECT *, max(fp) OVER () - fp AS fp_saved FROM c"),
    "calibrate_threshold": (calibrate_threshold, f"WITH {_CURVE}, {_F1} SELECT threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall, round(({_AUC}), 9) AS roc_auc, round(({_AP}), 9) AS pr_auc, 'cosine' AS metric FROM best"),
}
