"""What the operators of this subpackage share: the shared folder, reading tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A table with at most this many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, or a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='twinsift-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Tables made inside each open scratch(), the innermost last.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end, unless kept."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        discard(*made)


def keep(table: DataFrame) -> DataFrame:
    """Hands a materialized table on from the innermost scratch() to the one around it, if any."""
    _SCOPES[-1][:] = [t for t in _SCOPES[-1] if t is not table]
    if len(_SCOPES) > 1:
        _SCOPES[-2].append(table)
    return table


def _path(table: DataFrame):
    session = table.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(table.table_path)
    return path, path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf())


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and survives lost executors. Results that are
    read lazily need their tables until then: what isn't discarded before goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/twinsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    at, files = _path(table)
    files.deleteOnExit(at)
    if _SCOPES:
        _SCOPES[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing still to be run reads."""
    for t in tables:
        at, files = _path(t)
        files.delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast of a materialized table after counting it; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: as a lambda's variable the optimizer can't copy it to each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
