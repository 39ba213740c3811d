"""Schemas of the stored tables, and their creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (columns, partition columns). Unsigned integers are one size wider; fixed strings are strings or binary.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "languages": ("lang string, enabled boolean", ()),
    "codes": ("code_id string, old_id string, split string, label string, code string, code_hash string, source string, ingested_at timestamp, lang string", ("lang",)),
    "embeddings": ("embedding_id string, code_id string, split string, model string, pooling string, transform_ver int, dim int, vector array<float>, created_at timestamp, lang string", ("lang",)),
    "code_id_map": ("lang string, old_code_id string, code_id string", ()),
    "embed_batches": ("batch_id string, lang string, split string, n_rows long, path string", ()),
    "practice_codes": ("split string, uid string, code string, code_len int, code_norm string, code_norm_md5 binary, lang string", ("lang",)),
    "practice_pairs": ("pair_id string, split string, a_lang string, a_uid string, b_lang string, b_uid string, label byte, notes string", ()),
    "practice_scores": ("run_id string, ts timestamp, model string, normalization string, boilerplate string, metric string, threshold float, a_lang string, a_uid string, b_lang string, b_uid string, label byte, score float, decision string", ()),
    "practice_boilerplate_patterns": ("pattern_id string, lang string, kind string, text string, weight float", ()),
    "practice_embeddings": ("lang string, uid string, model string, pool string, transform_ver int, dim int, vec array<float>, created_at timestamp", ()),
    "practice_thresholds": ("run_id string, ts timestamp, profile string, split string, metric string, threshold float, roc_auc float, pr_auc float, precision_at_t float, recall_at_t float, f1_at_t float", ()),
    "eval_pairs": ("id_a string, id_b string, label byte, path_a string, path_b string, lang string, split string", ()),
    "stoplist_shingles": ("hash string, shingle array<string>, df int, docs int, built_at timestamp, corpus_id string, version string, lang string, n int", ("lang", "n")),
    "bench_topk_vectors": ("code_id string, lang string, split string, model string, pooling string, transform_ver int, dim int, vector array<float>", ()),
    "bench_topk_queries": ("code_id string, lang string, split string", ()),
    "bench_topk_results": ("run_id string, ts timestamp, engine string, n int, d int, k int, queries int, params string, p50_ms float, p95_ms float, mean_ms float, recall_mean float, recall_p50 float, recall_p95 float, tau_mean float", ()),
}

#: The SQL normaliser as a function of the session.
NORMALIZE_CODE_LIGHT = r"""
CREATE OR REPLACE TEMPORARY FUNCTION normalize_code_light(s STRING) RETURNS STRING RETURN
regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, r'(?s)/\*.*?\*/', ''), r'(?dm)//.*$', ''), r'(?dm)#.*$', ''), r'[\t ]+', ' ')
"""


def create_tables(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Creates the tables that don't exist yet, as Parquet; returns their names."""
    made = []
    for name in names or TABLES:
        columns, by = TABLES[name]
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" PARTITIONED BY ({', '.join(by)})" if by else ""))
            made.append(name)
    return made


def register(spark: SparkSession, sf_dir: str) -> None:
    """The corpus as view code_all, and the SQL function."""
    from twinsift.sources.tables import codes

    codes(spark, sf_dir).createOrReplaceTempView("code_all")
    spark.sql(NORMALIZE_CODE_LIGHT)


def describe(spark: SparkSession, table: str) -> DataFrame:
    """col_name, data_type and comment of a table's columns."""
    return spark.sql(f"DESCRIBE TABLE {table}")


def column_type(spark: SparkSession, table: str, column: str) -> str | None:
    """The type of a column, or None if there is no such column."""
    return next((c.dataType for c in spark.catalog.listColumns(table) if c.name == column), None)


def explain(spark: SparkSession, statement: str) -> str:
    """The plan of a statement."""
    return spark.sql(f"EXPLAIN FORMATTED {statement}").first()[0]
