"""Nearest neighbours by cosine: exact, and approximate by clusters or random projections.

Queries are a stated set against all rows, in blocks: each task holds a block of query vectors, multiplies them with its rows
and passes on its own k best of each query; a window then ranks these. The corpus is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
#: Bytes of query vectors that the driver gathers and each task holds at a time.
QUERY_BYTES = 1 << 26
DIGITS = 6
#: Lists probed of 32, and bits and tables of projections: recall of 0.9 at least on the whole of sf0.1.
N_PROBE, LSH_BITS, LSH_TABLES = 22, 4, 20


def where_all(model: str | None = None, pooling: str | None = None, transform_ver: int | None = None, langs: list[str] | None = None, split: str | None = None, splits: list[str] | None = None, not_id=None, id_prefix: str | None = None, id_col: str = "code_id") -> Column:
    """The conjunction of the filters that are given; an empty list means all."""
    out = F.lit(True)
    for name, value in (("model", model), ("pooling", pooling), ("transform_ver", transform_ver), ("split", split)):
        if value is not None:
            out = out & (F.col(name) == value)
    for name, values in (("lang", langs), ("split", splits)):
        if values:
            out = out & F.col(name).isin(*values)
    if not_id is not None:
        out = out & (F.col(id_col) != not_id)
    if id_prefix:
        out = out & F.col(id_col).cast("string").startswith(id_prefix)
    return out


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, code_id, similarity (rounded), rank and the columns to keep, k rows a query, ties by code_id.

    queries: query_id and vector. corpus: code_id, vector and the columns to keep. A query is compared with the vectors of its own
    length; null and empty ones are left out. Any number of queries is worked through in parts of QUERY_BYTES at most, by hash of the id.
    """
    return _ranked(_search(queries, corpus, k, exclude_self, keep), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "code_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _parts(queries: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """Vector length and queries of that length, in parts of QUERY_BYTES at most; one empty part if there is no query."""
    asked = queries.where(F.size("vector") > 0).select("query_id", "vector")
    sizes = asked.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()  # a row for each length
    for dim, n in sizes or [(0, 0)]:
        parts = -(-n * dim * 8 // QUERY_BYTES) or 1
        for part in range(parts):
            yield dim, asked.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part))


def _search(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, keep: tuple[str, ...] = (), scorer=None) -> DataFrame:
    """The k best of each task's rows for each query, part by part."""
    return reduce(DataFrame.unionByName, [_top_k_part(corpus.sparkSession, mine, queries, corpus, dim, k, exclude_self, keep, scorer) for dim, mine in _parts(queries)])


def _top_k_part(spark, asked: DataFrame, queries: DataFrame, corpus: DataFrame, dim: int, k: int, exclude_self: bool, keep: tuple[str, ...], scorer=None) -> DataFrame:
    """The k best of each task's rows for queries of one length that fit the driver and the tasks.

    scorer(unit query vectors) gives the rows worth reading, as a condition, and a function of (first query, unit rows, batch) to the
    block's similarities, -inf where a row is no candidate. Without it all rows are candidates.
    """
    held = asked.orderBy("query_id").toArrow().combine_chunks()
    kinds = ", ".join(f"{c} {corpus.schema[c].dataType.simpleString()}" for c in ("code_id", *keep))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {kinds}, similarity double"
    if not held.num_rows:
        return spark.createDataFrame([], schema)
    ids, matrix = held["query_id"], _unit(held["vector"], dim)
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    names = ["query_id", "code_id", *keep, "similarity"]
    comparable = np.array(ids.to_pylist())
    worth, score = scorer(matrix) if scorer else (F.lit(True), lambda at, x, b: matrix[at : at + QUERY_BLOCK] @ x.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _unit(b.column(1), dim), np.array(b.column(0).to_pylist())
            for at in range(0, len(matrix), QUERY_BLOCK):
                sim = np.round(score(at, x, b), DIGITS)
                if exclude_self:
                    sim[comparable[at : at + QUERY_BLOCK, None] == own[None, :]] = -np.inf
                n = min(k, sim.shape[1])
                # Ties at the edge of the k best go to the least id: order by id first, then stably by similarity.
                by_id = np.argsort(own, kind="stable")
                best = by_id[np.argsort(-sim[:, by_id], axis=1, kind="stable")[:, :n]]
                q = np.repeat(np.arange(at, at + len(sim)), n)
                value = np.take_along_axis(sim, best, 1).ravel()
                good = np.flatnonzero(np.isfinite(value))
                c = pa.array(best.ravel()[good])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[good])), b.column(0).take(c), *(b.column(2 + i).take(c) for i in range(len(keep))), pa.array(value[good])], names)

    return corpus.where((F.size("vector") == dim) & worth).select("code_id", "vector", *keep).mapInArrow(run, schema)


def all_scores(queries: DataFrame, corpus: DataFrame, digits: int = 4) -> DataFrame:
    """Cosine of every query with every row of its length: code_id, query_id and score; 0 if either vector has no length. For a stated
    query set of any number, in parts of QUERY_BYTES; each task multiplies a part with its own rows in blocks."""
    return reduce(DataFrame.unionByName, [_scores_part(mine, queries, corpus, dim, digits) for dim, mine in _parts(queries)])


def _scores_part(asked: DataFrame, queries: DataFrame, corpus: DataFrame, dim: int, digits: int) -> DataFrame:
    kinds = f"code_id {corpus.schema['code_id'].dataType.simpleString()}, query_id {queries.schema['query_id'].dataType.simpleString()}, score double"
    held = asked.orderBy("query_id").toArrow().combine_chunks()
    if not held.num_rows:
        return corpus.sparkSession.createDataFrame([], kinds)
    ids, matrix = held["query_id"], _unit(held["vector"], dim)
    names = ["code_id", "query_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                for q in range(0, len(matrix), QUERY_BLOCK):
                    sim = np.round(_unit(rows.column(1), dim) @ matrix[q : q + QUERY_BLOCK].T, digits) + 0.0
                    code, query = (pa.array(x.ravel()) for x in np.indices(sim.shape))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(code), pa.array(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).slice(q, sim.shape[1]).take(query), pa.array(sim.ravel())], names)

    return corpus.where(F.size("vector") == dim).select("code_id", "vector").mapInArrow(run, kinds)


def top_k_with_code(queries: DataFrame, corpus: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """Neighbours among those that have code, with it: ids are narrowed first, texts are joined to the k best only."""
    near = top_k(queries, corpus.join(codes.select("code_id"), "code_id", "left_semi"), k)
    return near.join(codes, "code_id")


# --- approximate ---


def ivf_index(corpus: DataFrame, n_lists: int = 32, seed: int = 42, max_fit_rows: int = 20_000) -> tuple[DataFrame, np.ndarray]:
    """corpus with the list of its nearest centroid, and the centroids. Fitted on a bounded sample; every row is indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = corpus.orderBy(F.xxhash64("code_id", F.lit(seed)), "code_id").limit(max_fit_rows).select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=n_lists, seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample)
    centers = np.array(model.clusterCenters())
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    return _nearest_lists(corpus, centers, 1, corpus.columns), centers


def _nearest_lists(rows: DataFrame, centers: np.ndarray, n: int, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = _unit(b.column(b.schema.get_field_index("vector")), centers.shape[1]) @ centers.T
                best = np.argsort(-sim, axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(best.ravel().astype(np.int32))], [*b.schema.names, "list"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns).mapInArrow(run, f"{kinds}, list int")


def ivf_top_k(queries: DataFrame, indexed: DataFrame, centers: np.ndarray, k: int, n_probe: int = N_PROBE) -> DataFrame:
    """query_id, code_id, similarity and rank from the lists nearest to each query.

    Tasks multiply the rows of each list with the queries that probe it; lists that no query probes aren't read. No row is shuffled.
    """

    def scorer(matrix: np.ndarray):
        probed = np.zeros((len(matrix), len(centers)), bool)
        np.put_along_axis(probed, np.argsort(-(matrix @ centers.T), axis=1, kind="stable")[:, :n_probe], True, 1)

        def score(at: int, x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            block, asks, own = matrix[at : at + QUERY_BLOCK], probed[at : at + QUERY_BLOCK], b.column(2).to_numpy()
            sim = np.full((len(block), len(x)), -np.inf)
            for one in np.unique(own):
                q, r = np.flatnonzero(asks[:, one]), np.flatnonzero(own == one)
                sim[np.ix_(q, r)] = block[q] @ x[r].T
            return sim

        return F.col("list").isin(np.flatnonzero(probed.any(0)).tolist()), score

    asked = queries.where(F.size("vector") == centers.shape[1])
    return _ranked(_search(asked, indexed, k, keep=("list",), scorer=scorer).drop("list"), k)


def write_index(indexed: DataFrame, centers: np.ndarray, path: str) -> None:
    """Stores an index: its rows in a folder for each list, and the centroids. Searches read only the lists they probe."""
    spark = indexed.sparkSession
    indexed.repartition("list").write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "list int, center array<double>").write.parquet(f"{path}/centers")


def read_index(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    """A stored index as ivf_top_k takes it."""
    centers = spark.read.parquet(f"{path}/centers").orderBy("list").collect()  # a row for each list
    return spark.read.parquet(f"{path}/rows"), np.array([r["center"] for r in centers])


def lsh_top_k(queries: DataFrame, corpus: DataFrame, k: int, bits: int = LSH_BITS, tables: int = LSH_TABLES, seed: int = 42, dim: int = 64) -> DataFrame:
    """Candidates share the signs of ``bits`` random projections in one of several tables. Signs are compared and candidates kept where
    the rows lie: neither buckets nor vectors are shuffled."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    def buckets(x: np.ndarray) -> np.ndarray:
        return ((x @ planes.T > 0).reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(2)

    def scorer(matrix: np.ndarray):
        asks = buckets(matrix)

        def score(at: int, x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            sim, own, block = matrix[at : at + QUERY_BLOCK] @ x.T, buckets(x), asks[at : at + QUERY_BLOCK]
            met = np.zeros(sim.shape, bool)
            for t in range(tables):
                met |= block[:, t, None] == own[None, :, t]
            return np.where(met, sim, -np.inf)

        return F.lit(True), score

    return _ranked(_search(queries.where(F.size("vector") == dim), corpus, k, scorer=scorer), k)
