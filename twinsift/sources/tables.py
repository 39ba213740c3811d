"""Sources: the corpus tables under the names of the data model, and readers for the file layouts it comes in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIFIED = "uid string, id long, side byte, lang string, split string, label int, code string"
CODE_COLUMNS = ("code", "func_code_string", "original_string", "function")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_id, lang, split and code."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("code_id"), "lang", F.col("source").alias("split"), F.col("text").alias("code"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_id, vector and label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code_id"), F.col("embedding").alias("vector"), "label")


def layout(df: DataFrame) -> str:
    """pair or single, by the columns there are."""
    return "pair" if {"func1", "func2"} <= set(df.columns) else "single"


def code_column(df: DataFrame) -> str:
    found = [c for c in CODE_COLUMNS if c in df.columns]
    if not found:
        raise ValueError(f"none of {CODE_COLUMNS} in {df.columns}")
    return found[0]


def _uid(side: Column) -> Column:
    return F.concat(F.col("id").cast("string"), F.lit("_"), side.cast("string"))


def unify_pairs(df: DataFrame, lang: str, split: str) -> DataFrame:
    """Two rows for each pair (id, func1, func2, label), one a side."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("func1").alias("code")), F.struct(F.lit(2).alias("side"), F.col("func2").alias("code")))).alias("s")
    s = df.select("id", "label", sides)
    return s.select(_uid(F.col("s.side")).alias("uid"), F.col("id").cast("long").alias("id"), F.col("s.side").cast("byte").alias("side"), F.lit(lang).alias("lang"), F.lit(split).alias("split"), F.col("label").cast("int").alias("label"), F.coalesce("s.code", F.lit("")).alias("code"))


def unify_single(df: DataFrame, lang: str, split: str) -> DataFrame:
    label = F.col("label").cast("int") if "label" in df.columns else F.lit(-1)
    return df.select(_uid(F.lit(1)).alias("uid"), F.col("id").cast("long").alias("id"), F.lit(1).cast("byte").alias("side"), F.lit(lang).alias("lang"), F.lit(split).alias("split"), label.alias("label"), F.coalesce(F.col(code_column(df)), F.lit("")).alias("code"))


def read_shards(spark: SparkSession, path: str, max_rows: int | None = None, code_col: str = "code") -> DataFrame:
    """Rows of a folder of shards with code, at most max_rows of each file (in file order)."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path).where(F.col(code_col).isNotNull())
    if max_rows is None:
        return df
    from pyspark.sql import Window

    order = Window.partitionBy("_file").orderBy("_at")
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return tagged.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_rows).drop("_file", "_at", "_n")


def read_layout(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """Rows of shards under <lang>/<split>/ or right under <lang>/ (split is empty there), with lang and split from the path. Without
    langs, every language there is; else only their folders are read."""
    roots = [f"{path}/{x}" for x in langs] if langs else [path]
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*roots)
    steps = F.split("_metadata.file_path", "/")
    base = len(path.rstrip("/").split("/")) - 1  # the last folder's place, from the name of the first root on
    below = F.slice(steps, F.array_position(steps, path.rstrip("/").split("/")[base]) + 1, F.size(steps))
    kept = [c for c in rows.columns if c not in ("lang", "split")]
    return rows.select(*kept, F.element_at(below, 1).alias("lang"), F.when(F.size(below) > 2, F.element_at(below, 2)).otherwise("").alias("split"))


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a dataset saved as Arrow files (*.arrow, stream or file format), with the columns of schema."""
    import pyarrow as pa

    names = T._parse_datatype_string(schema).names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw = pa.BufferReader(content.as_buffer())
                reader = pa.ipc.open_file(raw) if content.as_buffer()[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(raw)
                yield from reader.read_all().select(names).to_batches(max_chunksize=10_000)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.arrow").load(path)
    return files.select("content").mapInArrow(rows, schema)


def read_source_tree(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path and code of the files with these extensions; undecodable bytes become U+FFFD, empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)

    @F.pandas_udf("string")
    def lenient(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return files.where(suffix.isin(*extensions)).select("path", lenient("content").alias("code")).where(F.trim("code") != "")


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """row_idx and vector of raw little-endian float32 files of shape [n, dim]."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                if len(content) % (4 * dim):
                    raise ValueError(f"{len(content)} bytes aren't rows of {dim} floats")
                x = np.frombuffer(content, "<f4").reshape(-1, dim)
                yield pd.DataFrame({"row_idx": np.arange(len(x)), "vector": list(x)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row_idx long, vector array<float>")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, uid, label, split and lang of a TSV with header; malformed lines go, a bad label is -1."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).where((F.size("p") == 5) & F.try_to_number(F.get("p", F.lit(0)), F.lit("999999999999")).isNotNull())
    p = lambda i: F.get("p", F.lit(i))
    return lines.select(p(0).cast("long").alias("row_idx"), p(1).alias("uid"), F.coalesce(F.expr("try_cast(p[2] as int)"), F.lit(-1)).alias("label"), p(3).alias("split"), p(4).alias("lang"))


def vector_literal(text: str, dim: int) -> list[float]:
    """A vector from JSON, or from numbers parted by commas or white space."""
    import json
    import re

    try:
        flat = np.asarray(json.loads(text), np.float32).reshape(-1)
    except json.JSONDecodeError:
        flat = np.asarray([float(x) for x in re.split(r"[\s,]+", text.strip()) if x], np.float32)
    if len(flat) != dim:
        raise ValueError(f"{len(flat)} numbers, not {dim}")
    return flat.tolist()


LANGUAGES = T.StructType([T.StructField("lang", T.StringType()), T.StructField("enabled", T.BooleanType())])
