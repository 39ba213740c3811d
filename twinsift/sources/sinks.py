"""Sinks and changes to stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_zstd(df: DataFrame, path: str, rows_per_file: int = 200_000, level: int = 7, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", 1 << 20).option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows whose key it lacks, the first of a key in order of all columns."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*rows.columns))).where("_n = 1").drop("_n")
    return target.unionByName(first.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate isn't true; null isn't."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def latest_version(table: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """The row of each key with the greatest version."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version), *ties)
    return table.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_wins(table: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def append_missing(target: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows that target doesn't hold yet, by key: what an incremental run has left to do."""
    return rows.join(target, on, "left_anti")


def audit(df: DataFrame, path: str) -> DataFrame:
    """One row for each lang and split of an ingest."""
    return df.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_rows")).select(F.sha2(F.concat_ws("|", F.lit(path), "lang", "split"), 256).alias("batch_id"), "lang", "split", "n_rows", F.lit(path).alias("path"))
