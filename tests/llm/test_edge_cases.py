"""Each operator and stage on odd rows, on an empty table, and with extra columns of clashing names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinsift.llm import audio, bpe, host_rules, language, line_dedup, mixing, quality, secrets, simhash, substring

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))


OPERATORS = {
    "secrets": lambda d: secrets.scan_secrets(d),
    "quality": lambda d: quality.score_documents(d, quality.fit(d.select("doc_id", "text"), _labels(d))),
    "audio": lambda d: audio.audio_features(audio.store_audio(d)).drop("media", "tensors"),
    "bpe": lambda d: bpe.encode_decode(d, PATH),
    "mix_plan": lambda d: mixing.plan_mix(d),
    "substring": lambda d: substring.shared_passages(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "simhash_wide": lambda d: simhash.near_duplicates(d, 5, 13, 24, distinct=True),
    "host_rules": lambda d: host_rules.judge_documents(d),
    "language": lambda d: language.identify(d, language.fit(d)),
    "line_dedup": lambda d: line_dedup.remove_boilerplate(d, 2).select("doc_id", "text", "n_lines", "n_removed"),
}
PER_ROW = ("secrets", "quality", "audio", "bpe", "mix_plan", "simhash", "simhash_wide", "host_rules", "language", "line_dedup")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = cases.documents(spark)
    out = OPERATORS[name](docs)
    got = cases.shape(out)
    if name in PER_ROW:
        assert len(got) == docs.count()
    assert cases.shape(OPERATORS[name](cases.documents(spark, extra=True))) == got


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](cases.empty(spark)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    labels = _labels(cases.documents(spark)).select("doc_id", F.col("label").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert f(spark, cases.empty(spark), str(tmp_path)).count() == 0
    plain, more = (f(spark, d, str(tmp_path)) for d in (cases.documents(spark), cases.documents(spark, extra=True)))
    assert plain.count() == more.count()
    if stage != "bpe_encode_decode":
        assert plain.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert more.columns == cases.documents(spark, extra=True).columns
