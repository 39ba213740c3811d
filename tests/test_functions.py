"""Text, vector and scoring functions on small rows."""

from __future__ import annotations

import math
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsift.functions import scoring as S
from twinsift.functions import text as X
from twinsift.functions import vectors as V


def one(spark, column, **values):
    """The column over one row of these values."""
    kinds = {str: "string", int: "int", float: "double", list: "array<double>"}
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else kinds.get(type(v), 'string')}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "lang, code, want",
    [
        ("java", "/* a\nb */ int x; // end\ny", "int x; \ny"),
        ("php", "x # c\n// d\ny", "x \n\ny"),
        ("python", '"""doc""" x # c\ny\n\'\'\'z\'\'\'', "x \ny"),
        ("ruby", "=begin a\nb\n=end x # c", "x"),
        ("go", "a // b\rc d\ne", "a \ne"),
        ("perl", " # kept ", "# kept"),
        ("java", None, ""),
    ],
)
def test_strip_comments(spark, lang, code, want):
    assert one(spark, X.strip_comments(F.col("c"), F.col("l")), c=code, l=lang) == want


def test_normalisers(spark):
    code = "/* x */ a \t b // c\n# d\n e"
    assert one(spark, X.normalize_sql_light(F.col("c")), c=code) == " a b \n\n e"
    assert one(spark, X.normalize_search(F.col("c")), c=code) == "a b # d e"
    assert one(spark, X.normalize_space(F.col("c")), c=" a \n b  ") == "a b"
    assert one(spark, X.replace_literals(F.col("c")), c="x = \"a 1\" + 'b' + 3.5 + a1") == "x = <STR> + <STR> + <NUM> + a1"


def test_light_normalisation_ignores_names(spark):
    a = "func fib(n int) int { return fib(n - 1) + MAX } // note"
    b = "func gib(k int) int {\n return gib(k - 2) + MAX }"
    norm = [one(spark, X.normalize_light(F.col("c"), F.col("l")), c=c, l="go") for c in (a, b)]
    assert norm[0] == norm[1] == "func v1(v2 v3) v3 { return v1(v2 - <NUM>) + MAX }"


@given(st.lists(st.sampled_from(["foo", "bar", "x", "MAX", "if", "self", "this", "_a"]), max_size=20))
def test_renaming_is_consistent(words):
    out = X.rename_words(" ".join(words), "python").split()
    names = dict(zip(words, out))
    assert out == [names[w] for w in words]
    assert all(names[w] == w for w in words if w in ("MAX", "if", "self", "this"))
    fresh = [names[w] for w in dict.fromkeys(words) if w not in ("MAX", "if", "self", "this")]
    assert fresh == [f"v{i + 1}" for i in range(len(fresh))]


def test_tokens_and_shingles(spark):
    code = "if (a1 >= 10) { é_b == c; }"
    want = re.findall(X.TOKEN, code)
    assert one(spark, X.tokens(F.col("c")), c=code) == want
    assert one(spark, X.shingles(F.col("t"), 3), t=["a", "b", "c", "d"]) == ["a\x01b\x01c", "b\x01c\x01d"]
    assert one(spark, X.shingles(F.col("t"), 5), t=["a", "b"]) == []
    assert one(spark, X.shingle_id(F.col("s")), s="a\x01b") == __import__("hashlib").blake2b(b"a\x01b", digest_size=8).hexdigest()
    assert set(one(spark, X.word_set(F.col("c"), F.col("l")), c="Func main Foo foo", l="go")) == {"foo"}
    assert set(one(spark, X.identifier_set(F.col("c"), F.col("l")), c="class Éa fooé x if", l="java")) == {"fooé"}


def test_public_id(spark):
    assert one(spark, X.public_id(F.col("o"), F.col("l"), F.col("c")), o="", l="go", c="7") == "go/7"
    assert one(spark, X.public_id(F.col("o"), F.col("l"), F.col("c")), o="old/1", l="go", c="7") == "old/1"


def test_vectors(spark):
    a, b = [3.0, 4.0], [4.0, 3.0]
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(0.96)
    assert one(spark, V.dot(F.col("a"), F.col("b")), a=a, b=b) == 24
    assert one(spark, V.cosine_or_zero(F.col("a"), F.col("b")), a=[0.0, 0.0], b=b) == 0
    assert one(spark, V.norm(F.col("a")), a=a) == 5
    assert one(spark, V.normalized(F.col("a")), a=a) == pytest.approx([0.6, 0.8])
    assert one(spark, V.has_dim(F.col("a"), 3), a=a) is False


@pytest.mark.parametrize("a, b, want", [(["x", "y"], ["y", "z"], 1 / 3), (["x"], ["x"], 1.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, S.jaccard(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    assert one(spark, S.jaccard(F.col("b"), F.col("a")), a=a, b=b) == pytest.approx(want)
    assert one(spark, S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0


def test_scores(spark):
    assert one(spark, S.length_penalty(F.lit(10), F.lit(5))) == pytest.approx(math.exp(-1))
    assert one(spark, S.length_penalty(F.lit(0), F.lit(0))) == 0
    assert one(spark, S.hybrid(F.lit(0.8), F.lit(0.5), F.lit(0.5))) == pytest.approx(0.3)
    assert one(spark, S.boilerplate_cap(F.lit(1.0), F.lit(0.99), F.lit(0.01))) == pytest.approx(0.85)
    assert [one(spark, S.uniqueness_percent(F.lit(x).cast("double"))) for x in (0.25, 0.0, None)] == [75, 100, 100]
    assert one(spark, S.blended(F.lit(1.0), F.lit(0.5))) == pytest.approx(0.85)
    assert one(spark, S.decision(F.lit(0.5), F.lit(0.5))) == "Plagiarism"
