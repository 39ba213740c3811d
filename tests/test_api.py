"""The service's operations end to end, and the stored tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinsift import api, schemas
from twinsift.operators.embedder import HashingEmbedder


def test_service(spark):
    rows = spark.createDataFrame([("go", "func alpha() { return beta }"), ("go", "func gamma() { if delta { return } }"), ("java", "class Alpha { int beta; }"), ("go", "  "), ("go", None)], "lang string, code string")
    codes, embeddings = api.add_codes(rows)
    assert codes.count() == embeddings.count() == 3
    total, page = api.list_codes(codes, "ALPHA", ["go"])
    assert total.first()[0] == 1 and page.first()["id"].startswith("go/")
    shown = page.first()["id"]
    assert api.get_code(codes, shown).count() == api.get_code(codes, shown.split("/")[1]).count() == 1
    assert api.get_code(codes, "go/none").count() == 0
    with pytest.raises(ValueError):
        api.list_codes(codes, page=0)
    health = api.storage_health(codes, embeddings).first()
    assert (health.codes, health.embeddings) == (3, 3)
    got = api.check_uniqueness(spark, [("func alpha() { return beta }", "go"), ("zzz", "ruby")], codes, embeddings).orderBy("query_id").collect()
    assert got[0].uniqueness_percent == pytest.approx(0, abs=1e-4) and got[0].closest_id == shown.split("/")[1]
    assert got[1].uniqueness_percent > 50
    some = embeddings.limit(1)
    assert api.refresh_profile(codes, some, HashingEmbedder()).count() == 3
    assert api.refresh_profile(codes, embeddings, HashingEmbedder(), replace=True).count() == 3


def test_tables(spark):
    assert set(schemas.create_tables(spark)) == set(schemas.TABLES) and schemas.create_tables(spark) == []
    assert spark.table("stoplist_shingles").where(F.col("lang") == "x").count() == 0
