"""Documents with the cases that every operator must stand: nulls, empty and long texts, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "id string, kind string, start int, score double, line long, size long, rate double, key long, fp long, label int, target double, m string, _id long, spans string, component string, node long, cell long, pair long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(200)]
    return " ".join(r.choice(words) for _ in range(n))


def rows() -> list[tuple]:
    long = " ".join(prose(s, 400) for s in range(100, 160))
    base = [
        (1, prose(1, 120), "en", "a", 1), (2, prose(1, 120), "en", "b", 1), (3, prose(1, 120).replace(" ", "\n", 3), "en", None, None),
        (4, None, "en", "a", None), (5, "", None, "b", 0), (6, " \t\n\x0b\x0c\r ", "de", None, 7), (7, long, "de", "c", 1), (8, "x" * 50_000, None, "c", 1),
        (9, "퟿\U0001f600 éß ​ <|endoftext|> password = 'abcdefghijkl0123'", "fr", "a", 1), (None, prose(2, 60), "fr", "b", 1), (None, None, None, None, None),
        (10, "the the the the " * 30, "en", "a", 1), (10, "the the the the " * 30, "en", "a", 1), (11, prose(3, 90) + "\n" + prose(3, 90), "es", "d", 1),
    ]
    return base


def documents(spark, extra: bool = False):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows(), SCHEMA)
    if extra:
        d = d.select("*", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in ODD.split(", ")])
    return d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shape(df):
    """Rows in an order that doesn't depend on partitions."""
    return sorted(map(str, df.collect()))
