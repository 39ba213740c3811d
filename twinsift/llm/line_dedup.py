"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites is kept for each line's hash and merged by aggregation. Lines whose estimate is clearly at or
over ``min_sites`` are boilerplate; lines near the threshold get an exact distinct count first, so that the verdict is exact.
Boilerplate is removed from every document but the one with the least id that holds it, so that no text is lost altogether.

Lines end at \\n and count if they have anything but ASCII white space; blank lines stay. A null site is a site of its own. A
null text stays null and has no line. Rows with one id are treated alike; rows without an id keep their lines. A document may
lose all its lines; it stays, with empty text. All columns pass through.

A very common line is no bottleneck: sketches are merged from each task's partial ones. A document's own lines are looked up
within its row in the boilerplate table if that is small, so that texts aren't shuffled; a larger table is joined by line with skew
handling, to the same result. Long texts are split whole; ties (several documents of the least id) keep their lines. An empty table
gives an empty result. Columns of any other names pass through; only n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import BROADCAST_ROWS, broadcast_if_small, keep, materialize, scratch

LG_K = 11
MIN_SITES = 10
SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """line (hash) and first_id, one row per boilerplate line; materialized."""
    site = F.coalesce(F.concat(F.lit("="), docs[site_col].cast("string")), F.lit(""))
    lines = docs.select(docs[id_col].alias("id"), site.alias("site"), F.explode(_lines(docs[text_col])).alias("x")).select("id", "site", F.xxhash64("x").alias("line"))
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("id").alias("first_id"))
    margin = max(1.0, 6 * 1.04 / 2 ** (LG_K / 2) * min_sites)  # six deviations of the estimate
    with scratch():
        return keep(_exact(lines, spread, min_sites, margin))


def _exact(lines: DataFrame, spread: DataFrame, min_sites: int, margin: float) -> DataFrame:
    likely = materialize(spread.where(F.col("sites") >= min_sites - margin))
    near = broadcast_if_small(likely.where(F.col("sites") <= min_sites + margin).select("line"))
    exact = lines.join(near, "line").select("line", "site").distinct().groupBy("line").count().where(F.col("count") >= min_sites)
    sure = likely.where(F.col("sites") > min_sites + margin)
    return materialize(sure.select("line", "first_id").unionByName(likely.join(exact, "line", "left_semi").select("line", "first_id")))


def _shortened(docs: DataFrame, known: DataFrame, text_col: str, id_col: str, counts: bool) -> DataFrame:
    """docs with shorter texts, each line looked up within the row. known: at most BROADCAST_ROWS rows."""
    held = known.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((held["line"].to_numpy(), held["first_id"].to_pylist()))
    added = ["n_lines", "n_removed"] if counts else []
    rest = [c for c in docs.columns if c not in added]
    at, of = rest.index(text_col), len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of = dict(zip(shared.value[0].view(np.uint64).tolist(), shared.value[1]))
        for b in batches:
            cols: tuple[list, list, list] = ([], [], [])
            for text, id_ in zip(b.column(at).to_pylist(), b.column(of).to_pylist()):
                left, lines, removed = [], 0, 0
                for x in text.split("\n") if text is not None else ():
                    counted = bool(x.strip(SPACE))
                    lines += counted
                    if counted and id_ is not None and first_of.get(xxh64_intdigest(x.encode(), 42), id_) != id_:
                        removed += 1
                    else:
                        left.append(x)
                for c, v in zip(cols, (None if text is None else "\n".join(left) if removed else text, lines, removed)):
                    c.append(v)
            new = [*b.columns[:of]]
            new[at] = pa.array(cols[0], b.column(at).type)
            yield pa.RecordBatch.from_arrays([*new, *(pa.array(c, pa.int64()) for c in cols[1:] if counts)], [f"c{k}" for k in range(len(new) + len(added))])

    # Columns go by position, so that no name can clash.
    types = [docs.schema[c].dataType.simpleString() for c in rest] + ["bigint"] * len(added)
    slim = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(rest)], docs[id_col].alias("holder"))
    out = slim.mapInArrow(run, ", ".join(f"c{k} {t}" for k, t in enumerate(types)))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate([*rest, *added])])


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id", counts: bool = True) -> DataFrame:
    """docs with shorter texts, and with n_lines and n_removed (of lines that count) in place of any such columns."""
    known = boilerplate(docs, min_sites, text_col, site_col, id_col)
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _shortened(docs, known, text_col, id_col, counts)
    held = docs.select(docs[id_col].alias("holder"), F.explode(F.array_distinct(F.transform(_lines(docs[text_col]), lambda x: F.xxhash64(x)))).alias("line"))
    drop = held.join(known, "line").where("holder <> first_id").groupBy("holder").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("of"))
    text, gone = F.col("row")[text_col], F.col("gone")
    bad = lambda x: F.array_contains(gone, F.xxhash64(x))
    shorter = F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~bad(x)), "\n"))
    removed = F.when(gone.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n"), bad)))
    added = {"n_lines": F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long"), "n_removed": removed.cast("long")} if counts else {}
    kept = [(shorter if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in added]
    return rows.join(drop, F.col("of") == F.col("holder"), "left").select(*kept, *[v.alias(k) for k, v in added.items()])
