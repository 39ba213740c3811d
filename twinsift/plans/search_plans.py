"""Search, lookup and uniqueness queries. PLANS: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.functions import text as X
from twinsift.operators import knn, uniqueness
from twinsift.sources.tables import codes, embeddings, vector_literal

TOP = 10
#: Searches ask for every id divisible by this, against all rows.
EVERY = 20


def _queries(spark, d):
    return embeddings(spark, d).where(F.col("code_id") % EVERY == 0).select(F.col("code_id").alias("query_id"), "vector")


def _query_texts(spark, d):
    return codes(spark, d).where(F.col("code_id") % EVERY == 0).select(F.col("code_id").alias("query_id"), "code", "lang")


def enabled_languages(spark, d):
    return codes(spark, d).select("lang", F.lit(True).alias("enabled")).distinct().where("enabled").orderBy("lang")


def _matching(spark, d, q, langs=()):
    found = codes(spark, d).where(F.instr(F.lower("code"), F.lit(q.lower())) > 0)
    return found.where(F.col("lang").isin(*langs)) if langs else found


def _page(found, page, size):
    shown = found.select("code_id", "lang", "split", X.public_id(F.lit(""), F.col("lang"), F.col("code_id").cast("string")).alias("public_id"))
    return shown.orderBy("code_id").offset((page - 1) * size).limit(size)


def search_text_page(spark, d):
    return _page(_matching(spark, d, "License"), 2, 20)


def search_text_langs(spark, d):
    return _page(_matching(spark, d, "on", ("de", "fr")), 1, 50)


def search_text_total(spark, d):
    return _matching(spark, d, "License").agg(F.count(F.lit(1)).alias("total"))


def get_code_by_id(spark, d):
    """By lang/id, or by id alone."""
    wanted = spark.createDataFrame([("en/5",), ("7",), ("zz/9",)], "wanted string")
    c = codes(spark, d).withColumn("id", F.col("code_id").cast("string"))
    hit = (F.col("wanted") == F.concat("lang", F.lit("/"), "id")) | (F.col("wanted") == F.col("id"))
    ids = F.element_at(F.split("wanted", "/"), -1)
    return c.join(F.broadcast(wanted.withColumn("id", ids)), "id").where(hit).select("wanted", "code_id", "lang", "split", "code")


def fetch_by_uid(spark, d):
    return codes(spark, d).where((F.col("lang") == "fr") & (F.col("split") == "src3") & F.concat(F.col("code_id").cast("string"), F.lit("_1")).isin("3_1", "23_1", "43_1")).select("code_id", "code")


def storage_health(spark, d):
    return codes(spark, d).agg(F.count(F.lit(1)).alias("codes")).withColumn("embeddings", embeddings(spark, d).agg(F.count(F.lit(1))).scalar())


def filter_builder(spark, d):
    return codes(spark, d).where(knn.where_all(langs=["en", "fr"], splits=["src1", "src2"], not_id=1, id_prefix="1") & knn.where_all()).select("code_id", "lang", "split")


def exact_top_k(spark, d):
    near = knn.top_k(_queries(spark, d), embeddings(spark, d), TOP, exclude_self=True)
    return near.select("query_id", "code_id", "similarity", "rank")


def filtered_knn(spark, d):
    corpus = embeddings(spark, d).join(codes(spark, d).where(F.col("lang").isin("en", "de")).select("code_id", "lang"), "code_id")
    return knn.top_k(_queries(spark, d), corpus, 5, keep=("lang",)).select("query_id", "code_id", "lang", "similarity", "rank")


def knn_with_text(spark, d):
    near = knn.top_k_with_code(_queries(spark, d), embeddings(spark, d), codes(spark, d), 5)
    return near.select("query_id", "rank", "code_id", "similarity", "lang", "code")


def vector_literal_knn(spark, d):
    q = vector_literal("[" + ", ".join("0.125" if i % 2 else "-0.125" for i in range(64)) + "]", 64)
    query = spark.createDataFrame([(0, q)], "query_id long, vector array<float>")
    return knn.top_k(query, embeddings(spark, d), TOP).select("code_id", "similarity", "rank")


def uniqueness_check(spark, d):
    """Each text against the others; its neighbours come from its vector."""
    top = 5
    near = knn.top_k(_queries(spark, d), embeddings(spark, d).join(codes(spark, d).select("code_id"), "code_id", "left_semi"), max(20, 3 * top), exclude_self=True)
    return uniqueness.check(near, _query_texts(spark, d), codes(spark, d), top)


def uniqueness_debug(spark, d):
    """What each neighbour's score is made of."""
    near = knn.top_k(_queries(spark, d), embeddings(spark, d).join(codes(spark, d).select("code_id"), "code_id", "left_semi"), 20, exclude_self=True)
    f = uniqueness.features(near, _query_texts(spark, d), codes(spark, d))
    return f.select("query_id", "code_id", "rank", "similarity", F.round("overlap", 9).alias("overlap"), F.round("penalty", 9).alias("penalty"), "score")


def uniqueness_fallback_tier(spark, d):
    """Strict filters first (label and language), then label, then none."""
    meta = embeddings(spark, d).join(codes(spark, d).select("code_id", "lang"), "code_id")
    strict = knn.where_all(langs=["xx"]) & (F.col("label") == 1)
    tiers = [knn.top_k(_queries(spark, d), part, 3, exclude_self=True) for part in (meta.where(strict), meta.where(F.col("label") == 1), meta)]
    return uniqueness.fallback(tiers).select("query_id", "tier", "code_id", "similarity", "rank")


def _head(spark, d, n=120):
    return knn.top_k(_queries(spark, d), embeddings(spark, d).join(codes(spark, d).select("code_id"), "code_id", "left_semi"), n)


def progressive_search(spark, d):
    """Half of the queries find themselves and stop early; the others search deep without themselves."""
    head = _head(spark, d).where((F.col("query_id") % 2 == 0) | (F.col("query_id") != F.col("code_id")))
    return uniqueness.progressive(head, _query_texts(spark, d), codes(spark, d)).select("query_id", "mode", "code_id", "final", "rank")


def rerank_headroom(spark, d):
    from pyspark.sql import Window

    k = 5
    hits = uniqueness.rerank(_head(spark, d, max(5 * k, 50)), _query_texts(spark, d), codes(spark, d), 0.5, 2.0, 0.10, 0.7)
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "code_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ivf_top_k(spark, d):
    indexed, centers = knn.ivf_index(embeddings(spark, d).select("code_id", "vector"))
    return knn.ivf_top_k(_queries(spark, d), indexed, centers, TOP).select("query_id", "code_id", "similarity", "rank")


def lsh_top_k(spark, d):
    return knn.lsh_top_k(_queries(spark, d), embeddings(spark, d), TOP).select("query_id", "code_id", "similarity", "rank")


def embed_codes(spark, d):
    from twinsift.operators.embedder import HashingEmbedder, embed

    return codes(spark, d).select("code_id", embed(F.col("code"), HashingEmbedder()).alias("vector"))


SIM = "round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 6)"


def _knn_sql(corpus: str, k: int, more: str = "true", cols: str = "") -> str:
    return f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {EVERY} = 0),
near AS (SELECT * FROM (SELECT query_id, e.vec_id AS code_id, {cols} {SIM} AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY {SIM} DESC, e.vec_id)::INT AS rank FROM q, {corpus} e WHERE {more}) WHERE rank <= {k})"""


_EN_DE = "(SELECT e0.*, lang FROM embeddings e0 JOIN documents ON doc_id = vec_id WHERE lang IN ('en', 'de'))"
_HAS_CODE = "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"
_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[A-Za-z_][A-Za-z_0-9]*'))"
_IDS = r"list_distinct(regexp_extract_all({}, '[A-Za-z_][\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'))"
_JACCARD = "coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0)::DOUBLE"
_NORM_SEARCH = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*?$', '', 'g'), '\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_RERANK = f"""gated AS (
  SELECT n.query_id, n.code_id, similarity, {_IDS.format(_NORM_SEARCH.format('q2.text'))} AS a, {_IDS.format('c.text')} AS b
  FROM deep n JOIN documents c ON c.doc_id = n.code_id JOIN documents q2 ON q2.doc_id = n.query_id
  WHERE c.text <> '' AND length(c.text)::DOUBLE / greatest(length({_NORM_SEARCH.format('q2.text')}), 1) BETWEEN 0.5 AND 2.0),
ranked AS (SELECT query_id, code_id, round(0.7::DOUBLE * similarity + (1 - 0.7::DOUBLE) * j, 9) AS final FROM (SELECT *, {_JACCARD} AS j FROM gated) WHERE j >= 0.10)"""

PLANS = {
    "enabled_languages": (enabled_languages, "SELECT DISTINCT lang, true AS enabled FROM documents ORDER BY lang"),
    "search_text_page": (search_text_page, "SELECT doc_id AS code_id, lang, source AS split, lang || '/' || doc_id AS public_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20 OFFSET 20"),
    "search_text_langs": (search_text_langs, "SELECT doc_id AS code_id, lang, source AS split, lang || '/' || doc_id AS public_id FROM documents WHERE contains(lower(text), 'on') AND lang IN ('de', 'fr') ORDER BY doc_id LIMIT 50"),
    "search_text_total": (search_text_total, "SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'license')"),
    "get_code_by_id": (get_code_by_id, "SELECT w AS wanted, doc_id AS code_id, lang, source AS split, text AS code FROM documents JOIN (VALUES ('en/5'), ('7'), ('zz/9')) t(w) ON w = lang || '/' || doc_id OR w = doc_id::VARCHAR"),
    "fetch_by_uid": (fetch_by_uid, "SELECT doc_id AS code_id, text AS code FROM documents WHERE lang = 'fr' AND source = 'src3' AND doc_id || '_1' IN ('3_1', '23_1', '43_1')"),
    "storage_health": (storage_health, "SELECT (SELECT count(*) FROM documents) AS codes, (SELECT count(*) FROM embeddings) AS embeddings"),
    "filter_builder": (filter_builder, "SELECT doc_id AS code_id, lang, source AS split FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2') AND doc_id <> 1 AND doc_id::VARCHAR LIKE '1%'"),
    "exact_top_k": (exact_top_k, f"WITH {_knn_sql('embeddings', TOP, more='e.vec_id <> query_id')} SELECT query_id, code_id, similarity, rank FROM near"),
    "filtered_knn": (filtered_knn, f"WITH {_knn_sql(_EN_DE, 5, cols='lang,')} SELECT query_id, code_id, lang, similarity, rank FROM near"),
    "knn_with_text": (knn_with_text, f"WITH {_knn_sql(_HAS_CODE, 5)} SELECT query_id, rank, code_id, similarity, lang, text AS code FROM near JOIN documents ON doc_id = code_id"),
    "vector_literal_knn": (vector_literal_knn, "WITH q AS (SELECT [CASE WHEN i % 2 = 1 THEN 0.125 ELSE -0.125 END::DOUBLE for i in range(64)] AS v), r AS (SELECT vec_id AS code_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings) SELECT * FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, code_id)::INT AS rank FROM r) WHERE rank <= 10"),
    "uniqueness_debug": (uniqueness_debug, f"""WITH {_knn_sql(_HAS_CODE, 20, more='e.vec_id <> query_id')},
j AS (SELECT n.query_id, code_id, similarity, rank, {_WORDS.format('q2.text')} AS a, {_WORDS.format('c.text')} AS b, length(q2.text) AS la, length(c.text) AS lb
  FROM near n JOIN documents c ON c.doc_id = code_id JOIN documents q2 ON q2.doc_id = n.query_id WHERE rank <= 10 AND c.text <> ''),
s AS (SELECT query_id, code_id, rank, similarity AS cs, {_JACCARD} AS jac, coalesce(exp(-2.0::DOUBLE * abs(la - lb)::DOUBLE / nullif(greatest(la, lb), 0)), 0) AS pen FROM j),
f AS (SELECT *, round(cs * (0.5::DOUBLE + 0.5::DOUBLE * jac) * pen * CASE WHEN cs > 0.985 AND jac < 0.08 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM s)
SELECT query_id, code_id, rank, cs AS similarity, round(jac, 9) AS overlap, round(pen, 9) AS penalty, score FROM f"""),
    "uniqueness_check": (uniqueness_check, f"""WITH {_knn_sql(_HAS_CODE, 20, more='e.vec_id <> query_id')},
j AS (SELECT n.query_id, code_id, similarity, rank, {_WORDS.format('q2.text')} AS a, {_WORDS.format('c.text')} AS b, length(q2.text) AS la, length(c.text) AS lb
  FROM near n JOIN documents c ON c.doc_id = code_id JOIN documents q2 ON q2.doc_id = n.query_id WHERE rank <= 10 AND c.text <> ''),
s AS (SELECT query_id, code_id, rank, similarity AS cs, {_JACCARD} AS jac, coalesce(exp(-2.0::DOUBLE * abs(la - lb)::DOUBLE / nullif(greatest(la, lb), 0)), 0) AS pen FROM j),
f AS (SELECT *, round(cs * (0.5::DOUBLE + 0.5::DOUBLE * jac) * pen * CASE WHEN cs > 0.985 AND jac < 0.08 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS k FROM f)
SELECT d.doc_id AS query_id, CASE WHEN score > 0 THEN code_id END AS closest_id, greatest(coalesce(score, 0), 0)::DOUBLE AS similarity,
  CASE WHEN score > 0 THEN (1.0::DOUBLE - score) * 100.0::DOUBLE ELSE 100.0::DOUBLE END AS uniqueness_percent
FROM documents d LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON d.doc_id = b.query_id WHERE d.doc_id % {EVERY} = 0"""),
    "uniqueness_fallback_tier": (uniqueness_fallback_tier, f"WITH {_knn_sql('(SELECT e0.* FROM embeddings e0 JOIN documents ON doc_id = vec_id WHERE label = 1)', 3, 'e.vec_id <> query_id')} SELECT query_id, 2 AS tier, code_id, similarity, rank FROM near"),
    "progressive_search": (progressive_search, f"""WITH {_knn_sql(_HAS_CODE, 120)},
head AS (SELECT * FROM near WHERE query_id % 2 = 0 OR query_id <> code_id), fast AS (SELECT * FROM head WHERE rank <= 30),
done AS (SELECT query_id FROM fast GROUP BY query_id HAVING max(similarity) >= 0.985), deep AS (SELECT * FROM head WHERE query_id NOT IN (SELECT query_id FROM done)),
{_RERANK},
hits AS (SELECT query_id, 'early' AS mode, code_id, similarity AS final FROM fast WHERE query_id IN (SELECT query_id FROM done) UNION ALL SELECT query_id, 'deep', code_id, final FROM ranked)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, code_id)::INT AS rank FROM hits) WHERE rank <= 5"""),
    "rerank_headroom": (rerank_headroom, f"WITH {_knn_sql(_HAS_CODE, 50)}, deep AS (SELECT * FROM near), {_RERANK} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, code_id)::INT AS rank FROM ranked) WHERE rank <= 5"),
    "ivf_top_k": (ivf_top_k, None),
    "lsh_top_k": (lsh_top_k, None),
    "embed_codes": (embed_codes, None),
}
