"""Load, change and move tables. PLANS: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinsift.functions import vectors
from twinsift.operators import migration, pairs
from twinsift.plans import pair_plans
from twinsift.sources import sinks, tables
from twinsift.sources.tables import codes, embeddings, read


def _scratch(spark) -> str:
    """A new folder under the warehouse, which executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/twinsift/{uuid.uuid4().hex}"


def import_with_literals(spark, d):
    return read(spark, d, "documents").select(F.lit("java").alias("lang"), F.lit("train").alias("split"), F.col("doc_id").cast("string").alias("uid"), F.coalesce("text", F.lit("")).alias("code"))


def multi_source_append(spark, d):
    parts = [codes(spark, d).where(F.col("lang") == x).select("code_id", "lang") for x in ("en", "de", "fr", "es")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def latest_version_merge(spark, d):
    """Events as versions: the last of each user."""
    e = read(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return sinks.latest_version(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


def upsert_ignore(spark, d):
    c = codes(spark, d).select("code_id", "lang")
    rows = c.withColumn("lang", F.lit("new"))
    return sinks.upsert_ignore(c.where("lang <> 'es'"), rows.unionByName(rows), ["code_id"])


def delete_by_predicate(spark, d):
    return sinks.delete_where(codes(spark, d).select("code_id", "lang", "split"), (F.col("split") == "src1") & F.col("lang").isin("en", "de"))


def dedupe_first_wins(spark, d):
    c = codes(spark, d).withColumn("h", F.md5(F.col("code").cast("binary")))
    return sinks.first_wins(c, ["lang", "h"], "code_id").select("lang", "h", "code_id")


def insert_select(spark, d):
    """Rows written from a query and read back."""
    path = _scratch(spark)
    embeddings(spark, d).where("label < 3").select("code_id", "label").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def audit_rows(spark, d):
    return sinks.audit(codes(spark, d), "documents").select("batch_id", "lang", "split", "n_rows", "path")


def single_row_insert(spark, d):
    row = spark.createDataFrame([("c1", "go", "api", "func main() {}"), ("c2", "go", "api", None)], "code_id string, lang string, source string, code string")
    return row.select("code_id", "lang", F.lit("").alias("split"), "source", "code", F.when(F.col("code").isNotNull(), F.sha2(F.col("code"), 256)).alias("code_hash"))


def schema_evolution(spark, d):
    t = embeddings(spark, d).select(F.col("code_id").alias("uid"), F.col("vector").alias("emb")).withColumn("emb", F.when(F.col("uid") % 50 == 0, F.slice("emb", 1, 10)).otherwise(F.col("emb")))
    fixed = migration.with_fixed_vectors(t, 64).withColumnRenamed("emb_fixed", "embedding")
    return fixed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("n_null"))


def embedding_copy(spark, d):
    e = embeddings(spark, d).select("code_id", F.when(F.col("code_id") % 50 == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector")).alias("vector"))
    e = migration.copied(e, 64)
    return e.select("code_id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


def _profiled(spark, d):
    e = embeddings(spark, d).join(codes(spark, d).select("code_id", "lang"), "code_id")
    model = F.when(F.col("code_id") % 3 == 0, "m2").otherwise("m1")
    return e.select("code_id", "lang", model.alias("model"), F.lit("mean").alias("pooling"), F.lit(2).alias("transform_ver"), F.col("label").alias("created_at"))


def anti_join_unembedded(spark, d):
    return migration.unembedded(codes(spark, d).select("code_id", "lang"), _profiled(spark, d), "m1", "mean", 2)


def profile_counts(spark, d):
    return _profiled(spark, d).groupBy("model", "pooling", "transform_ver").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def _ids(spark, d):
    return migration.id_map(codes(spark, d).select("lang", F.col("code_id").cast("string").alias("old_code_id")))


def id_map_join(spark, d):
    return _ids(spark, d)


def not_exists_migration(spark, d):
    """Embeddings still to be moved to new ids; a part of them is there already."""
    old = _profiled(spark, d).select("lang", F.col("code_id").cast("string").alias("old_code_id"), "model", "pooling", "transform_ver", "created_at")
    everything = old.join(_ids(spark, d), ["lang", "old_code_id"])
    done = everything.where(F.col("old_code_id").cast("long") % 2 == 0).select("code_id", "model", "pooling", "transform_ver", "created_at")
    return migration.rekey(old, _ids(spark, d), done).select("code_id", "lang", "model", "created_at")


def inline_values_join(spark, d):
    anchors = spark.sql("select * from values ('en', 1), ('de', 2), ('fr', 3) as t(lang, weight)")
    return codes(spark, d).join(F.broadcast(anchors), "lang").groupBy("lang", "weight").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("a"), F.array_distinct(F.split(F.lower("text"), " ")).alias("b"))
    return w.select("doc_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("any"), F.size(F.array_except("a", "b")).alias("only_a"))


def prefix_limit(spark, d):
    return codes(spark, d).orderBy("code_id").limit(25).select("code_id", "lang")


def zstd_round_trip(spark, d):
    path = _scratch(spark)
    sinks.write_zstd(codes(spark, d), path, rows_per_file=200, partition_by=["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("chars"))


def capped_shards(spark, d):
    """The first 100 rows of a file."""
    path = _scratch(spark)
    codes(spark, d).coalesce(1).sortWithinPartitions("code_id").write.parquet(path)
    return tables.read_shards(spark, path, 100).select("code_id", "lang")


def csv_report(spark, d):
    path = _scratch(spark)
    sinks.write_csv(read(spark, d, "labels").select("doc_id", F.format_string("%.6f", F.col("quality") / 3).alias("score")), path)
    return spark.read.option("header", True).csv(path)


def jsonl_stoplist(spark, d):
    path = _scratch(spark)
    sinks.write_jsonl(pair_plans.stoplist_top_k(spark, d), path)
    return spark.read.json(path, schema="lang string, shingle string, df long")


def random_row_copy(spark, d):
    return pairs.sample(codes(spark, d), 1, "code_id").select("code_id", F.coalesce("code", F.lit("")).alias("code"))


def page_of_codes(spark, d):
    return codes(spark, d).orderBy("code_id").offset(40).limit(20).select("code_id", "lang", "split")


def languages_seed(spark, d):
    return spark.createDataFrame([("go", True), ("java", True), ("javascript", True), ("python", True)], tables.LANGUAGES)


_PROFILED = "profiled AS (SELECT vec_id AS code_id, lang, CASE WHEN vec_id % 3 = 0 THEN 'm2' ELSE 'm1' END AS model, 'mean' AS pooling, 2 AS transform_ver, label AS created_at FROM embeddings JOIN documents ON doc_id = vec_id)"
_NEW = "upper(substr(sha256(lang || '|' || {}), 1, 26))"

PLANS = {
    "import_with_literals": (import_with_literals, "SELECT 'java' AS lang, 'train' AS split, doc_id::VARCHAR AS uid, coalesce(text, '') AS code FROM documents"),
    "multi_source_append": (multi_source_append, "SELECT doc_id AS code_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')"),
    "latest_version_merge": (latest_version_merge, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1"),
    "upsert_ignore": (upsert_ignore, "SELECT doc_id AS code_id, CASE WHEN lang <> 'es' THEN lang ELSE 'new' END AS lang FROM documents"),
    "delete_by_predicate": (delete_by_predicate, "SELECT doc_id AS code_id, lang, source AS split FROM documents WHERE NOT coalesce(source = 'src1' AND lang IN ('en', 'de'), false)"),
    "dedupe_first_wins": (dedupe_first_wins, "SELECT lang, md5(text) AS h, min(doc_id) AS code_id FROM documents GROUP BY 1, 2"),
    "insert_select": (insert_select, "SELECT vec_id AS code_id, label FROM embeddings WHERE label < 3"),
    "audit_rows": (audit_rows, "SELECT sha256('documents|' || lang || '|' || source) AS batch_id, lang, source AS split, count(*) AS n_rows, 'documents' AS path FROM documents GROUP BY lang, source"),
    "single_row_insert": (single_row_insert, "SELECT code_id, 'go' AS lang, '' AS split, 'api' AS source, code, sha256(code) AS code_hash FROM (VALUES ('c1', 'func main() {}'), ('c2', NULL)) t(code_id, code)"),
    "schema_evolution": (schema_evolution, "SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 50 = 0) AS n_null FROM embeddings"),
    "embedding_copy": (embedding_copy, "SELECT vec_id AS code_id, round(v[1] / (n + 1e-12::DOUBLE), 6) AS first, round(n / (n + 1e-12::DOUBLE), 6) AS norm FROM (SELECT *, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id % 50 <> 0)"),
    "anti_join_unembedded": (anti_join_unembedded, f"WITH {_PROFILED} SELECT doc_id AS code_id, lang FROM documents WHERE doc_id NOT IN (SELECT code_id FROM profiled WHERE model = 'm1')"),
    "profile_counts": (profile_counts, f"WITH {_PROFILED} SELECT model, pooling, transform_ver, count(*) AS n FROM profiled GROUP BY ALL"),
    "id_map_join": (id_map_join, f"SELECT lang, doc_id::VARCHAR AS old_code_id, {_NEW.format('doc_id')} AS code_id FROM documents"),
    "not_exists_migration": (not_exists_migration, f"WITH {_PROFILED} SELECT {_NEW.format('code_id')} AS code_id, lang, model, created_at FROM profiled WHERE code_id % 2 <> 0"),
    "inline_values_join": (inline_values_join, "SELECT lang, weight, count(*) AS n FROM documents JOIN (VALUES ('en', 1), ('de', 2), ('fr', 3)) t(lang, weight) USING (lang) GROUP BY ALL"),
    "set_operations": (set_operations, "SELECT doc_id, len(list_intersect(a, b))::INT AS both, len(list_distinct(list_concat(a, b)))::INT AS any, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_a FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lower(text), ' ')) AS b FROM documents)".replace("AS any", 'AS "any"')),
    "prefix_limit": (prefix_limit, "SELECT doc_id AS code_id, lang FROM documents ORDER BY doc_id LIMIT 25"),
    "zstd_round_trip": (zstd_round_trip, "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang"),
    "capped_shards": (capped_shards, "SELECT doc_id AS code_id, lang FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 100"),
    "csv_report": (csv_report, "SELECT doc_id::VARCHAR AS doc_id, printf('%.6f', quality / 3.0) AS score FROM labels"),
    "random_row_copy": (random_row_copy, "SELECT doc_id AS code_id, coalesce(text, '') AS code FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 1"),
    "page_of_codes": (page_of_codes, "SELECT doc_id AS code_id, lang, source AS split FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40"),
    "languages_seed": (languages_seed, "SELECT * FROM (VALUES ('go', true), ('java', true), ('javascript', true), ('python', true)) t(lang, enabled)"),
    "jsonl_stoplist": (jsonl_stoplist, pair_plans.PLANS["stoplist_top_k"][1]),
}
