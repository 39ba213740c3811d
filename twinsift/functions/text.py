"""Text functions on columns: comments, white space, literals, tokens, shingles and ids.

Java's ``.`` and ``$`` see more line ends than \\n; ``(?dm)`` keeps to \\n. Only renaming identifiers needs Python, as a renamed
word depends on all words before it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCK = r"(?s)/\*.*?\*/"
LINE = r"(?dm)//.*?$"
HASH = r"(?dm)#.*?$"
PY_BLOCKS = (r'(?s)""".*?"""', r"(?s)'''.*?'''")
RUBY_BLOCK = r"(?s)=begin.*?=end"
SPACE = " \t\n\x0b\x0c\r"

# Keywords and stop words by language, and what counts as a token.
JAVASCRIPT_KEYWORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield await async".split()
GO_KEYWORDS = "break default func interface select case defer go map struct chan else goto package switch const fallthrough if range type continue for import return var".split()
PYTHON_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
JAVA_KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits".split()
GO_STOP_WORDS = "package import func main fmt println printf var const type if for return go defer range make new len cap true false nil".split()
TOKEN = r"[A-Za-z_][A-Za-z_0-9]*|==|!=|<=|>=|&&|\|\||[{}();,\[\].:+\-*/]"
WORD = r"[A-Za-z_][A-Za-z_0-9]*"

KEYWORDS = {"javascript": JAVASCRIPT_KEYWORDS, "go": GO_KEYWORDS, "python": PYTHON_KEYWORDS, "java": JAVA_KEYWORDS}


def drop(code: Column, *patterns: str) -> Column:
    for p in patterns:
        code = F.regexp_replace(code, p, "")
    return code


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE))


def strip_comments(code: Column, lang: Column) -> Column:
    """Comments of six languages; null is empty."""
    code = F.coalesce(code, F.lit(""))
    c_like = drop(code, BLOCK, LINE)
    return strip(
        F.when(lang.isin("java", "javascript", "go"), c_like)
        .when(lang == "php", drop(c_like, HASH))
        .when(lang == "python", drop(code, *PY_BLOCKS, HASH))
        .when(lang == "ruby", drop(code, RUBY_BLOCK, HASH))
        .otherwise(code)
    )


def strip_comments_c(code: Column) -> Column:
    return strip(drop(code, BLOCK, LINE))


def light_strip(code: Column, lang: Column) -> Column:
    """The light normaliser's comments: lines before blocks for javascript and go, # for python, none elsewhere."""
    return F.when(lang.isin("javascript", "go"), drop(code, r"//[^\n]*", BLOCK)).when(lang == "python", drop(code, HASH)).otherwise(code)


def normalize_sql_light(code: Column) -> Column:
    """Comments of all kinds go, runs of blanks become one; line ends stay."""
    return F.regexp_replace(drop(code, BLOCK, r"(?dm)//.*$", r"(?dm)#.*$"), r"[\t ]+", " ")


def normalize_search(code: Column) -> Column:
    return strip(F.regexp_replace(drop(code, BLOCK, LINE), r"\s+", " "))


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def replace_literals(s: Column) -> Column:
    """Strings without escapes, then numbers."""
    s = F.regexp_replace(s, r"\"[^\n\"\\]*\"|'[^\n'\\]*'", "<STR>")
    return F.regexp_replace(s, r"\b\d+(\.\d+)?\b", "<NUM>")


_ID = re.compile(r"\b[_A-Za-z][_A-Za-z0-9]*\b")


def rename_words(code: str, lang: str | None) -> str:
    """Identifiers become v1, v2 .. in order of first use; keywords, self, this and upper-case names stay."""
    fixed = {*KEYWORDS.get(lang or "", ()), "self", "this"} if lang != "java" else {"self", "this"}
    names: dict[str, str] = {}

    def name(m: re.Match) -> str:
        w = m[0]
        if w in fixed or (len(w) > 1 and w.isupper()):
            return w
        return names.setdefault(w, f"v{len(names) + 1}")

    return _ID.sub(name, code)


@F.pandas_udf(StringType())
def rename_identifiers(code: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else rename_words(c, x) for c, x in zip(code, lang)])


def normalize_light(code: Column, lang: Column) -> Column:
    """Comments, white space, literals, identifiers, white space."""
    s = replace_literals(normalize_space(light_strip(F.coalesce(code, F.lit("")), lang)))
    return normalize_space(rename_identifiers(s, lang))


def tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def word_set(text: Column, lang: Column) -> Column:
    """Lower-case words, each once; Go's stop words go if the language is go."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.when(lang == "go", F.array_except(found, F.array(*map(F.lit, GO_STOP_WORDS)))).otherwise(found)


def identifier_set(code: Column, lang: Column) -> Column:
    """Identifiers of two letters or more, less the keywords of java and python."""
    found = F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?U)[A-Za-z_]\w+"), F.lit(0)))
    less = lambda words: F.array_except(found, F.array(*map(F.lit, words)))
    return F.when(lang == "java", less(JAVA_KEYWORDS)).when(lang == "python", less(PYTHON_KEYWORDS)).otherwise(found)


def identifier_set_java(code: Column) -> Column:
    """The variant that knows Java only: its keywords go whatever the language is."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?U)[A-Za-z_]\w+"), F.lit(0))), F.array(*map(F.lit, JAVA_KEYWORDS)))


def shingles(toks: Column, n: int) -> Column:
    """Runs of n tokens joined by U+0001; none if there are fewer tokens. ``toks`` should be a plain column."""
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), "\x01"))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def shingle_id(shingle: pd.Series) -> pd.Series:
    """blake2b of 8 bytes in hex, the id of a stop-listed shingle; called on the few that are kept."""
    from hashlib import blake2b

    return shingle.map(lambda s: blake2b(s.encode(), digest_size=8).hexdigest(), na_action="ignore")


def public_id(old_id: Column, lang: Column, code_id: Column) -> Column:
    return F.when(old_id != "", old_id).otherwise(F.concat(lang, F.lit("/"), code_id))
