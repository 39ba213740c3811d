"""The registered queries of this subpackage, with the SQL that some are held against."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import audio, bpe, host_rules, language, line_dedup, mixing, quality, secrets, simhash, substring
from .common import bucket, documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the spans that secrets.scan_secrets finds."""
    kinds = pa.int64()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]

    def digest(batches):
        for b in batches:
            found = [[(s["kind"], s["start"], s["end"], s["base"]) for s in row] for row in b.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(s[0] == kind and s[3] for s in row) for row in found], kinds)
            base = [secrets.base_digest([s for s in row if s[3]]) for row in found]
            linked = pa.array([sum(not s[3] for s in row) for row in found], kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), count("assign"), count("access"), count("hex"), pa.array(base), pa.array([secrets.joined(r) for r in found]), linked], names)

    return secrets.scan_secrets(documents(spark, sf_dir)).mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document by a model of the labelled documents that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(bucket(F.col("doc_id"), 5) != 0)
    scored = quality.score_documents(docs, quality.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the stored sound and of its features."""
    f = audio.audio_features(audio.store_audio(documents(spark, sf_dir)))

    def digest(batches):
        for b in batches:
            col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            sha = [hashlib.sha256(m).hexdigest() for m in col["media"]]
            feature = []
            for stream, seg, n in zip(col["tensors"], col["segments"], col["n_frames"]):
                tensors, spans = audio.unpack_tensors(stream)
                loud = sum(s["end_s"] - s["start_s"] for s in seg)
                feature.append(f"frames={n};tensors={'x'.join(map(str, tensors.shape))};end_s={spans[-1, 1]:.3f};segments={len(seg)};loud_s={loud:.3f};sha256={hashlib.sha256(stream).hexdigest()[:16]}")
            arrays = [b.column(i) for i, n in enumerate(b.schema.names) if n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(map(len, col["media"]), pa.int64()), pa.array(sha), pa.array(feature)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return f.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ids and of the text decoded from them."""
    import public_tokenizers

    coded = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    mixed = mixing.plan_mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per_source),
filled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2 AS below,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM weighted WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST)),
leveled AS (SELECT *, (total * 1.5::DOUBLE - below) / rest AS level FROM filled),
found AS (SELECT arg_min(level, source_size::DOUBLE / weight) AS level FROM leveled WHERE level * weight <= source_size * 2),
targets AS (SELECT source, source_size, least((source_size * 2)::DOUBLE, coalesce(found.level * weight, (source_size * 2)::DOUBLE)) AS target FROM leveled LEFT JOIN found ON true),
rated AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0.0::DOUBLE) AS rate,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS draw
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM rated
"""


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share, a row for each of the two: doc_id has every document with a passage. All that share a run have
    rows with the least document that holds it, which represents them."""
    found = substring.shared_passages(documents(spark, sf_dir))
    side = lambda x, y: F.struct(*(F.col(p + c).alias(q + c) for p, q in ((x, ""), (y, "other_")) for c in ("start", "end")), "n_equal", "identity")
    ids = lambda x, y, s: F.struct(F.col(x).alias("doc_id"), F.col(y).alias("other_id"), s.alias("at"))
    both = found.select(F.explode(F.array(ids("doc_id", "other_id", side("", "other_")), ids("other_id", "doc_id", side("other_", "")))).alias("row"))
    return both.select("row.doc_id", "row.other_id", "row.at.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document."""
    judged = host_rules.judge_documents(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM split WHERE len(ws) > 8),
win AS (SELECT doc_id, i, ws[i:i + 7] AS w FROM pos),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM split LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
hosts AS (
  SELECT source, count(*) AS n, sum((base_failed OR 5 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines))::INT) AS failed
  FROM f GROUP BY source),
stats AS (
  SELECT sum(failed)::DOUBLE / sum(n) AS m, var_samp(failed::DOUBLE / n) - (sum(failed)::DOUBLE / sum(n)) * (1 - sum(failed)::DOUBLE / sum(n)) * avg(1.0::DOUBLE / n) AS v
  FROM hosts),
prior AS (SELECT m, least(greatest(coalesce(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 WHEN v <= 0 THEN 1e6 END, 10), 1), 1e6) AS k FROM stats),
verdict AS (SELECT source, (failed + m * k) / (n + k) < 0.5 AS ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by a model of the documents that aren't held out."""
    docs = documents(spark, sf_dir)
    held = bucket(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held).select("doc_id", "text", "lang"))
    return language.identify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate."""
    return line_dedup.remove_boilerplate(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


OP10_SQL = r"""
WITH split AS (SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
spread AS (
  SELECT line, min(doc_id) AS first_id FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT site) >= 10),
kept AS (
  SELECT s.doc_id, s.i, s.line, regexp_matches(s.line, '[^\x20\x09-\x0D]') AS counts, b.line IS NOT NULL AND s.doc_id <> b.first_id AS gone
  FROM split s LEFT JOIN spread b ON s.line = b.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
  count(*) FILTER (WHERE counts) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM kept GROUP BY doc_id
"""

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_audio": op3_audio,
    "op4_bpe": op4_bpe,
    "op5_mix": op5_mix,
    "op6_substring": op6_substring,
    "op7_simhash": op7_simhash,
    "op8_host_rules": op8_host_rules,
    "op9_language": op9_language,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op5_mix": OP5_SQL, "op8_host_rules": OP8_SQL, "op10_line_dedup": OP10_SQL}
