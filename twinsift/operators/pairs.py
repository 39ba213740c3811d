"""Labelled pair sets: positives, negatives, and what keeps them free of doubles.

Random order is the order of md5(seed:id), so that reruns and other engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]).cast("binary"))


def sample(df: DataFrame, n: int, id_col: str, seed: int = 42, by: str | None = None) -> DataFrame:
    """n random rows, or n of each group."""
    if by is None:
        return df.orderBy(draw(seed, F.col(id_col)), id_col).limit(n)
    order = Window.partitionBy(by).orderBy(draw(seed, F.col(id_col)), id_col)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def equal_key_pairs(rows: DataFrame, key: Column) -> DataFrame:
    """Pairs (a_uid < b_uid) of one language with equal keys."""
    keyed = rows.select("lang", "uid", key.alias("key"))
    a, b = keyed.select("lang", "key", F.col("uid").alias("a_uid")), keyed.select("lang", "key", F.col("uid").alias("b_uid"))
    return a.join(b, ["lang", "key"]).where("a_uid < b_uid").select("lang", "a_uid", "b_uid")


def random_negatives(rows: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n pairs of different rows: row r in one random order goes with row r in another."""
    order = lambda s: Window.orderBy(draw(s, F.col("uid")), "uid")  # noqa: E731  over 2 n rows at most
    left = sample(rows, n, "uid", seed).withColumn("r", F.row_number().over(order(seed)))
    right = sample(rows, n, "uid", seed + 1).withColumn("r", F.row_number().over(order(seed + 1)))
    return left.select("r", F.col("uid").alias("a_uid")).join(right.select("r", F.col("uid").alias("b_uid")), "r").where("a_uid <> b_uid").select("a_uid", "b_uid")


def band_pairs(anchors: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Pairs of one language with lengths at most width apart, different text and a_uid < b_uid.

    Lengths fall into buckets of width + 1: equal ones or neighbours hold all partners, which makes the band an equi-join.
    """
    side = lambda p: [F.col("lang"), F.col("uid").alias(f"{p}_uid"), F.col("size").alias(f"{p}_size"), F.col("md5").alias(f"{p}_md5")]
    bucket = F.floor(F.col("size") / (width + 1))
    a = anchors.select(*side("a"), bucket.alias("own")).withColumn("bucket", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    b = rows.select(*side("b"), bucket.alias("bucket"))
    near = (F.abs(F.col("a_size") - F.col("b_size")) <= width) & (F.col("b_uid") > F.col("a_uid")) & (F.col("a_md5") != F.col("b_md5"))
    return a.join(b, ["lang", "bucket"]).where(near).select("lang", "a_uid", "b_uid")


def without_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates of which neither orientation is known, each once."""
    key = lambda d: d.withColumn("k", F.struct(F.least("a_uid", "b_uid").alias("x"), F.greatest("a_uid", "b_uid").alias("y")))
    first = Window.partitionBy("k").orderBy("a_uid", "b_uid")
    once = key(candidates).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.join(key(known).select("k").distinct(), "k", "left_anti").drop("k")


def quota(pairs: DataFrame, total: int, by: str = "lang", seed: int = 42) -> DataFrame:
    """At most ceil(total / groups) random pairs of each group."""
    n = pairs.select(F.count_distinct(by).alias("n")).scalar()
    order = Window.partitionBy(by).orderBy(draw(seed, F.col("a_uid"), F.col("b_uid")), "a_uid", "b_uid")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.ceil(F.lit(total) / n)).drop("_n")


def synthetic_positives(augmented: DataFrame, originals: DataFrame, suffix: str) -> DataFrame:
    """Augmented rows with the row whose uid lacks the suffix."""
    a = augmented.select("lang", F.col("uid").alias("a_uid"), F.replace(F.col("uid"), F.lit(suffix), F.lit("")).alias("b_uid"))
    return a.join(originals.select("lang", F.col("uid").alias("b_uid")), ["lang", "b_uid"]).select("lang", "a_uid", "b_uid")


def group_pairs(rows: DataFrame, per_group: int, negative_ratio: float, seed: int = 42) -> DataFrame:
    """a_uid, b_uid and label: up to per_group random pairs in each group, and negatives across groups.

    A group's rows are put in random order; the d-th ring pairs each with the one d further on. Rings are used until there are
    enough pairs, so that no group's pairs are ever listed in full. Negatives pair a random row with one of another group; all ranks
    count if one group holds nearly all rows.
    """
    g = rows.where(F.col("group").isNotNull() & (F.col("group").cast("string") != ""))
    own, all_of = Window.partitionBy("group").orderBy(draw(seed, F.col("uid")), "uid"), Window.partitionBy("group")
    placed = g.withColumn("i", F.row_number().over(own) - 1).withColumn("k", F.count(F.lit(1)).over(all_of)).where("k > 1")
    want = F.least(F.lit(per_group).cast("long"), (F.col("k") * (F.col("k") - 1) / 2).cast("long"))
    # Pair number p = (d - 1) * k + i joins places i and i + d; in the last ring of an even k only half of them are new.
    rings = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(want / F.col("k")).cast("int")))).alias("d")
    left = placed.select("group", "uid", "i", "k", want.alias("want"), rings)
    left = left.where(((F.col("d") - 1) * F.col("k") + F.col("i") < F.col("want")) & ~((2 * F.col("d") == F.col("k")) & (2 * F.col("i") >= F.col("k"))))
    right = placed.select("group", F.col("uid").alias("o_uid"), F.col("i").alias("j"))
    pos = left.withColumn("j", F.pmod(F.col("i") + F.col("d"), F.col("k"))).join(right, ["group", "j"]).select(F.least("uid", "o_uid").alias("a_uid"), F.greatest("uid", "o_uid").alias("b_uid"), F.lit(1).alias("label"))
    n = int(pos.count() * max(0.0, negative_ratio))
    # Two random orders pair rows by rank. As many ranks are looked at as n pairs of different groups need, up to all of them.
    head = lambda s, m: g.select("uid", "group", draw(s, F.col("uid")).alias("o")).orderBy("o", "uid").limit(m)
    one = lambda s, m, u, gr: head(s, m).select(F.col("uid").alias(u), F.col("group").alias(gr), F.row_number().over(Window.orderBy("o", "uid")).alias("r"))
    unlike = lambda m: one(seed + 1, m, "a_uid", "ga").join(one(seed + 2, m, "b_uid", "gb"), "r").where("ga <> gb")
    total, m = g.count(), 4 * n + 100
    while m < total and unlike(m).count() < n:
        m *= 8
    neg = unlike(min(m, max(total, 1)))
    neg = neg.withColumn("p", F.row_number().over(Window.orderBy("r"))).where(F.col("p") <= n).select("a_uid", "b_uid", F.lit(0).alias("label"))
    return pos.unionByName(neg)


def labelled(found: DataFrame, label: int, notes: str, split: str = "valid") -> DataFrame:
    """Pairs (lang, a_uid, b_uid) as rows of the table practice_pairs; pair_id follows from the rest, so that reruns agree."""
    ids = [F.col(c).cast("string").alias(c) for c in ("a_uid", "b_uid")]
    rows = found.select(F.lit(split).alias("split"), F.col("lang").alias("a_lang"), ids[0], F.col("lang").alias("b_lang"), ids[1], F.lit(label).cast("byte").alias("label"), F.lit(notes).alias("notes"))
    return rows.select(F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("pair_id"), *rows.columns)


def added_synthetic(augmented: DataFrame, originals: DataFrame, suffix: str, stored: DataFrame) -> DataFrame:
    """Rows of practice_pairs for augmented texts and their originals, of which ``stored`` holds neither orientation."""
    found = synthetic_positives(augmented, originals, suffix)
    fresh = without_known(found, stored.select("a_uid", "b_uid"))
    return labelled(fresh, 1, "synth_positive")
