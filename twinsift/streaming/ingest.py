"""Incremental ingest as a stream. An extension: batch tools poll for new rows instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinsift.sources.sinks import append_missing


def ingest(stream: DataFrame, target: str, keys: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends rows of a stream whose keys the target folder lacks; repeated keys of a batch enter once.

    A batch that is run again after a failure finds its keys in the target and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        try:
            known = spark.read.schema(batch.schema).parquet(target).select(*keys)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = rows.select(*keys).limit(0)
        append_missing(known, rows, keys).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
