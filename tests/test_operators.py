"""Search, pairs, metrics, sources and table changes on small rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import schemas
from twinsift.operators import benchmark, calibration, knn, metrics, migration, pairs, stoplist, uniqueness
from twinsift.operators.embedder import HashingEmbedder
from twinsift.plans import registry
from twinsift.sources import sinks, tables
from twinsift.streaming.ingest import ingest


def vectors(spark, n=40, dim=8, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, x[0].tolist()), (n + 1, None), (n + 2, [1.0])]
    return x, spark.createDataFrame(rows, "code_id long, vector array<float>")


def test_top_k_is_exact(spark):
    x, corpus = vectors(spark)
    got = knn.top_k(corpus.limit(5).withColumnRenamed("code_id", "query_id"), corpus, 4).collect()
    unit = np.vstack([x, x[:1]]) / np.linalg.norm(np.vstack([x, x[:1]]), axis=1, keepdims=True)
    for q in range(5):
        sim = np.round(unit[q].astype(float) @ unit.astype(float).T, 6)
        want = sorted(range(41), key=lambda i: (-sim[i], i))[:4]
        assert [r.code_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert knn.top_k(corpus.limit(0).withColumnRenamed("code_id", "query_id"), corpus, 4).count() == 0


def test_approximate_search_finds_most(spark):
    _, corpus = vectors(spark, 300, 16)
    corpus = corpus.where(F.size("vector") == 16)
    q = corpus.where("code_id < 20").withColumnRenamed("code_id", "query_id")
    exact = knn.top_k(q, corpus, 5)
    indexed, centers = knn.ivf_index(corpus, 8)
    assert indexed.count() == corpus.count()
    for found in (knn.ivf_top_k(q, indexed, centers, 5, 6), knn.lsh_top_k(q, corpus, 5, 3, 16, dim=16)):
        assert metrics.recall_at_k(exact, found).agg(F.avg("recall")).first()[0] >= 0.9


@pytest.mark.parametrize("name", ["ivf_top_k", "lsh_top_k"])
def test_registered_indexes_find_most(spark, name):
    d = "/root/testdata/sf0.1"
    e = tables.embeddings(spark, d)
    found = registry.queries()[name](spark, d)
    q = e.select(F.col("code_id").alias("query_id"), "vector").join(found.select("query_id").distinct(), "query_id")
    assert q.count() == e.where("code_id % 20 = 0").count() == q.where("query_id % 20 = 0").count()
    assert metrics.recall_at_k(knn.top_k(q, e, 10), found).agg(F.avg("recall")).first()[0] >= 0.9


def test_filters(spark):
    _, corpus = vectors(spark, 5)
    assert corpus.where(knn.where_all()).count() == 8 and corpus.where(knn.where_all(not_id=1, id_prefix="1")).count() == 0


def test_uniqueness(spark):
    codes = spark.createDataFrame([(1, "go", "alpha beta gamma"), (2, "go", "alpha beta delta"), (3, "go", ""), (4, "go", "alpha beta gamma")], "code_id long, lang string, code string")
    near = spark.createDataFrame([(9, 3, 1.0, 1), (9, 2, 0.9, 2), (9, 1, 0.9, 3), (9, 4, 0.9, 4)], "query_id long, code_id long, similarity double, rank int")
    q = spark.createDataFrame([(9, "alpha beta gamma", "go"), (8, "zeta", "go")], "query_id long, code string, lang string")
    got = {r.query_id: r for r in uniqueness.check(near, q, codes).collect()}
    assert got[9].closest_id == 1 and got[9].uniqueness_percent == pytest.approx(10)  # equal scores: the earlier rank
    assert got[8].closest_id is None and got[8].uniqueness_percent == 100


def test_fallback_takes_first_tier(spark):
    tier = lambda *q: spark.createDataFrame([(x, 1) for x in q], "query_id long, code_id long")
    got = uniqueness.fallback([tier(1), tier(1, 2), tier(1, 2, 3)]).collect()
    assert sorted((r.query_id, r.tier) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_band_pairs_equal_a_plain_join(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(r.choice(["a", "b"]), i, r.randint(0, 90), str(r.randint(0, 30))) for i in range(120)], "lang string, uid long, size int, md5 string")
    got = {(x.a_uid, x.b_uid) for x in pairs.band_pairs(rows, rows, 7).collect()}
    d = rows.collect()
    want = {(x.uid, y.uid) for x in d for y in d if x.lang == y.lang and y.uid > x.uid and abs(x["size"] - y["size"]) <= 7 and x.md5 != y.md5}
    assert got == want and pairs.band_pairs(rows, rows, 7).count() == len(want)


@pytest.mark.parametrize("k, per_group", [(2, 5), (3, 2), (5, 10), (6, 15), (7, 40), (8, 9)])
def test_group_pairs(spark, k, per_group):
    rows = spark.createDataFrame([(g * 100 + i, g) for g in range(3) for i in range(k)] + [(999, None)], "uid long, group int")
    got = pairs.group_pairs(rows, per_group, 0.5).collect()
    pos = [(r.a_uid, r.b_uid) for r in got if r.label]
    assert len(pos) == len(set(pos)) == 3 * min(per_group, k * (k - 1) // 2)
    assert all(a < b and a // 100 == b // 100 for a, b in pos)
    assert all(r.a_uid // 100 != r.b_uid // 100 for r in got if not r.label)


def test_without_known(spark):
    p = lambda *x: spark.createDataFrame(list(x), "a_uid long, b_uid long")
    assert [tuple(r) for r in pairs.without_known(p((1, 2), (2, 1), (3, 4)), p((4, 3))).collect()] == [(1, 2)]


def test_curves_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(round(r.random(), 1), r.randint(0, 1)) for _ in range(80)]
    scored = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(scored).first()[0] == pytest.approx(auc)
    steps, ap, last = sorted({s for s, _ in rows}, reverse=True), 0.0, 0.0
    f1 = {}
    for t in steps:
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last, f1[t] = tp / len(pos), 2 * tp / (tp + fp + len(pos))
    assert metrics.average_precision(scored).first()[0] == pytest.approx(ap)
    best = metrics.best_f1(scored).first()
    assert best.f1 == pytest.approx(max(f1.values())) and best.threshold == min(t for t in f1 if f1[t] == max(f1.values()))
    c = metrics.confusion(scored, 2.0).first()
    assert (c.tp, c.fp, c.precision, c.f1) == (0, 0, 0.0, 0.0)


def test_kendall_leaves_out_short_lists(spark):
    t = lambda rows: spark.createDataFrame(rows, "query_id long, code_id long, rank int")
    a = t([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1)])
    b = t([(1, 3, 1), (1, 2, 2), (1, 9, 3), (2, 1, 1)])
    assert [tuple(r) for r in metrics.kendall_tau(a, b).collect()] == [(1, -1.0)]
    assert {r.query_id: r.recall for r in metrics.recall_at_k(a, b).collect()} == {1: pytest.approx(2 / 3), 2: 1.0}


def test_masked_overlap(spark):
    codes = spark.createDataFrame([(1, "x", "a b c d"), (2, "x", "a b c e"), (3, "x", "z")], "code_id long, lang string, code string")
    p = spark.createDataFrame([(1, 2, 1), (1, 3, 0)], "a_id long, b_id long, label int")
    stop = spark.createDataFrame([("x", "a\x01b")], "lang string, shingle string")
    got = {(r.a_id, r.b_id): (r.raw, r.masked) for r in stoplist.masked_overlap(p, codes, stop, 2).collect()}
    assert got == {(1, 2): (pytest.approx(0.5), pytest.approx(1 / 3)), (1, 3): (0.0, 0.0)}


def test_sources(spark, tmp_path):
    pair = spark.createDataFrame([(5, "a", None, 1)], "id long, func1 string, func2 string, label int")
    assert tables.layout(pair) == "pair"
    assert [(r.uid, r.side, r.code) for r in tables.unify_pairs(pair, "java", "train").collect()] == [("5_1", 1, "a"), ("5_2", 2, "")]
    np.arange(12, dtype="<f4").tofile(tmp_path / "v.f32")
    assert [r.vector for r in tables.read_vectors(spark, str(tmp_path / "v.f32"), 4).orderBy("row_idx").collect()][2] == [8, 9, 10, 11]
    (tmp_path / "ids.tsv").write_text("row_idx\tuid\tlabel\tsplit\tlang\n0\t1_1\tbad\ttrain\tgo\nbroken\n1\t2_1\t1\ttrain\tgo\n")
    assert [(r.row_idx, r.label) for r in tables.read_ids(spark, str(tmp_path / "ids.tsv")).collect()] == [(0, -1), (1, 1)]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1 \xff")
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "src" / "c.py").write_text("  ")
    assert [r.code for r in tables.read_source_tree(spark, str(tmp_path / "src"), [".py"]).collect()] == ["x = 1 �"]
    assert tables.vector_literal("[1, 2]", 2) == tables.vector_literal("1, 2", 2) == [1.0, 2.0]
    with pytest.raises(ValueError):
        tables.vector_literal("1 2 3", 2)


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "id long, x string, v int")
    assert sorted(r.x or "" for r in sinks.latest_version(t, ["id"], "v").collect()) == ["", "b"]
    assert sinks.delete_where(t, F.col("x") == "a").count() == 2
    more = spark.createDataFrame([(2, "z", 9), (3, "z", 9), (3, "y", 9)], "id long, x string, v int")
    assert sorted((r.id, r.x) for r in sinks.upsert_ignore(t, more, ["id"]).where("id = 3").collect()) == [(3, "y")]
    e = spark.createDataFrame([([3.0, 4.0],), ([1.0],), (None,)], "vector array<double>")
    assert [r.vector for r in migration.copied(e, 2).collect()] == [pytest.approx([0.6, 0.8])]


def test_embedder():
    v = HashingEmbedder(16).encode(["a b c", "a b c", "", None])
    assert (v[0] == v[1]).all() and np.linalg.norm(v[0]) == pytest.approx(1, abs=1e-5) and not v[2].any()


def test_stream_adds_each_key_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i, "x") for i in ids], "id long, x string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, x string").parquet(src)
        ingest(stream, out, ["id"], str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_queries_of_any_number_and_length(spark, monkeypatch):
    x, corpus = vectors(spark)
    q = corpus.where("code_id < 41 or code_id = 42").withColumnRenamed("code_id", "query_id")
    want = sorted(map(tuple, knn.top_k(q, corpus, 3).collect()))
    assert {r[0] for r in want} == {*range(41), 42}  # the one of length 1 finds itself
    monkeypatch.setattr(knn, "QUERY_BYTES", 8 * 8 * 9)
    assert sorted(map(tuple, knn.top_k(q, corpus, 3).collect())) == want


def test_negatives_of_one_large_group(spark):
    rows = spark.createDataFrame([(i, "big" if i >= 50 else f"s{i % 5}") for i in range(5000)], "uid long, group string")
    got = pairs.group_pairs(rows, 20, 0.8).collect()
    assert sum(r.label for r in got) == 120 and sum(not r.label for r in got) == 96


def test_index_is_stored(spark, tmp_path):
    _, corpus = vectors(spark, 100, 8)
    corpus = corpus.where(F.size("vector") == 8)
    q = corpus.where("code_id < 10").withColumnRenamed("code_id", "query_id")
    indexed, centers = knn.ivf_index(corpus, 4)
    knn.write_index(indexed, centers, str(tmp_path / "index"))
    again = knn.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(str, knn.ivf_top_k(q, *again, 5, 2).collect())) == sorted(map(str, knn.ivf_top_k(q, indexed, centers, 5, 2).collect()))


def test_layouts(spark, tmp_path):
    import pyarrow as pa

    for lang, split in (("go", "train"), ("go", ""), ("java", "valid")):
        spark.createDataFrame([(f"{lang} {split}",)], "code string").coalesce(1).write.parquet(str(tmp_path / "corpus" / lang / split / "x.parquet") if split else str(tmp_path / "flat"))
    (tmp_path / "corpus" / "go" / "one.parquet").write_bytes(next((tmp_path / "flat").glob("*.parquet")).read_bytes())
    for lang, split in (("go", "train"), ("java", "valid")):
        folder = tmp_path / "corpus" / lang / split
        next((folder / "x.parquet").glob("*.parquet")).rename(folder / "two.parquet")
        for f in (folder / "x.parquet").iterdir():
            f.unlink()
        (folder / "x.parquet").rmdir()
    got = {(r.lang, r.split, r.code) for r in tables.read_layout(spark, str(tmp_path / "corpus")).collect()}
    assert got == {("go", "train", "go train"), ("go", "", "go "), ("java", "valid", "java valid")}
    assert {r.lang for r in tables.read_layout(spark, str(tmp_path / "corpus"), ["java"]).collect()} == {"java"}
    t = pa.table({"id": [1, 2], "code": ["a", None]})
    for kind, opened in (("s", pa.ipc.new_stream), ("f", pa.ipc.new_file)):
        with opened(str(tmp_path / f"{kind}.arrow"), t.schema) as w:
            w.write_table(t)
    assert sorted(r.id for r in tables.read_arrow(spark, str(tmp_path), "id long, code string").collect()) == [1, 1, 2, 2]


def test_admin_statements(spark):
    from twinsift import schemas

    spark.createDataFrame([(1, "x")], "a int, b string").createOrReplaceTempView("admin_view")
    assert [(r.col_name, r.data_type) for r in schemas.describe(spark, "admin_view").collect()] == [("a", "int"), ("b", "string")]
    assert schemas.column_type(spark, "admin_view", "b") == "string" and schemas.column_type(spark, "admin_view", "c") is None
    assert "Physical Plan" in schemas.explain(spark, "select a from admin_view")


def test_identifiers_without_java_keywords(spark):
    from twinsift.functions.text import identifier_set_java

    assert spark.createDataFrame([("class Foo return bar def x",)], "c string").select(identifier_set_java(F.col("c"))).first()[0] == ["Foo", "bar", "def"]


def test_curve_over_bins(spark):
    r = random.Random(5)
    rows = [(r.choice([r.uniform(-1, 1), r.uniform(-1e9, 1e9), 0.0, float("inf")]), r.randint(0, 1)) for _ in range(300)]
    got = {c.score: (c.tp, c.fp, c.p, c.n) for c in metrics.curve(spark.createDataFrame(rows, "score double, label int")).collect()}
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    assert got == {t: (sum(y for s, y in rows if s >= t), sum(1 - y for s, y in rows if s >= t), p, n) for t, _ in rows}
    odd = metrics.curve(spark.createDataFrame([(None, 1), (float("nan"), 0), (0.5, 1)], "score double, label int")).collect()
    assert sorted((str(c.score), c.tp, c.fp) for c in odd) == [("0.5", 1, 1), ("None", 2, 1), ("nan", 0, 1)]
    assert metrics.curve(spark.createDataFrame([], "score double, label int")).count() == 0


def test_benchmark_of_searches(spark):
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(60)], "code_id long, vector array<double>")
    half = lambda q, m: knn.top_k(q, e.where("code_id < 30"), m)
    got = {r.engine: r for r in benchmark.top_k_benchmark(e, {"half": (half, {"rows": 30})}, k=5, n_queries=4).collect()}
    assert (got["exact"].n, got["exact"].d, got["exact"].k, got["exact"].queries) == (60, 8, 5, 4)
    assert got["exact"].recall_mean == got["exact"].tau_mean == 1 and 0 <= got["half"].recall_mean < 1
    assert got["half"].params == '{"rows": 30}' and 0 < got["half"].p50_ms <= got["half"].p95_ms
    assert benchmark.top_k_benchmark(e.limit(0), {}, n_queries=4).first().p50_ms is None


def test_calibration_tables(spark):
    rows = spark.createDataFrame([("x", 1, "x", 2, 1, 0.9), ("x", 1, "x", 3, 0, 0.2)], "a_lang string, a_uid long, b_lang string, b_uid long, label int, score double")
    stored = calibration.scores_table(rows, 0.5, "r", "m")
    assert stored.columns == [c.split()[0] for c in schemas.TABLES["practice_scores"][0].split(", ")]
    assert sorted(r.decision for r in stored.collect()) == ["OK", "Plagiarism"]
    t = calibration.thresholds_table(rows, "r", "m/mean/2")
    assert t.columns == [c.split()[0] for c in schemas.TABLES["practice_thresholds"][0].split(", ")]
    row = t.first()
    assert (round(row.threshold, 6), row.roc_auc, row.pr_auc, row.f1_at_t) == (0.9, 1, 1, 1) and row.ts is not None


def test_pair_rows(spark):
    found = spark.createDataFrame([("x", 1, 2)], "lang string, a_uid long, b_uid long")
    stored = pairs.labelled(found, 0, "random_neg")
    assert stored.columns == [c.split()[0] for c in schemas.TABLES["practice_pairs"][0].split(", ")]
    row = stored.first()
    assert (row.a_uid, row.b_lang, row.label, row.notes) == ("1", "x", 0, "random_neg") and len(row.pair_id) == 64
