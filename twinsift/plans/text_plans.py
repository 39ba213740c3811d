"""Text queries. PLANS: name -> (query, DuckDB SQL or None).

The corpus is prose: most queries run on snippets made of it, with comments, literals and blanks around the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.functions import text as X
from twinsift.sources import tables as S

SNIPPET = "concat('/* ', source, ' */ ', text, ' // ', lang, '\\n# ', source, '\\n\\t  \"\"\"doc ', lang, '\"\"\" =begin x\\n=end  y1 = \"', lang, '\"; z = 42;\\n')"
SNIPPET_SQL = "('/* ' || source || ' */ ' || text || ' // ' || lang || chr(10) || '# ' || source || chr(10) || chr(9) || '  \"\"\"doc ' || lang || '\"\"\" =begin x' || chr(10) || '=end  y1 = \"' || lang || '\"; z = 42;' || chr(10))"
LANG = "case lang when 'en' then 'java' when 'de' then 'php' when 'fr' then 'python' else 'ruby' end"
LIGHT = "case lang when 'en' then 'javascript' when 'de' then 'go' when 'fr' then 'python' else 'java' end"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _snippets(spark, d, lang=LANG):
    return S.read(spark, d, "documents").select("doc_id", F.expr(lang).alias("lang"), F.expr(SNIPPET).alias("code"))


def _out(column):
    return lambda spark, d: _snippets(spark, d).select("doc_id", column.alias("out"))


def _sub(s, *pairs):
    for p, r in pairs:
        s = f"regexp_replace({s}, '{p}', '{r}', 'g')"
    return s


_C = ((r"(?s)/\*.*?\*/", ""), ("(?m)//.*?$", ""))
_H = ("(?m)#.*?$", "")
_PY = (('(?s)""".*?"""', ""), ("(?s)''''''.*?''''''", ""))
_RB = ("(?s)=begin.*?=end", "")


def _from_snippet(expr, lang=None):
    inner = f"SELECT doc_id, {lang or LANG} AS lang, {SNIPPET_SQL} AS code FROM documents"
    return f"SELECT doc_id, {expr} AS out FROM ({inner})"


def _pairs(spark, d):
    docs = S.read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("func1"), F.lower("text").alias("func2"), (F.col("doc_id") % 2).alias("label"))


def unpivot_pairs(spark, d):
    return S.unify_pairs(_pairs(spark, d), "java", "train")


def single_to_unified(spark, d):
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("func_code_string"))
    assert S.layout(docs) == "single"
    return S.unify_single(docs, "python", "validation")


def light_normalize(spark, d):
    return _snippets(spark, d, LIGHT).select("doc_id", X.normalize_light(F.col("code"), F.col("lang")).alias("out"))


def obfuscate(spark, d):
    return _snippets(spark, d, LIGHT).select("doc_id", X.rename_identifiers("code", "lang").alias("out"))


def sql_function_normalize(spark, d):
    """The normaliser as a function in SQL text over a view."""
    from twinsift.schemas import register

    register(spark, d)
    return spark.sql("SELECT code_id, normalize_code_light(concat('/* a */ ', code, ' // b\n# c\n')) AS out FROM code_all")


def token_stream(spark, d):
    return _snippets(spark, d).select("doc_id", F.size(X.tokens(F.col("code"))).alias("n"), F.array_join(X.tokens(F.col("code")), " ").alias("toks"))


def uniqueness_word_sets(spark, d):
    return _snippets(spark, d, LIGHT).select("doc_id", F.array_join(F.array_sort(X.word_set(F.col("code"), F.col("lang"))), " ").alias("words"))


def search_identifier_sets(spark, d):
    return _snippets(spark, d).select("doc_id", F.array_join(F.array_sort(X.identifier_set(F.col("code"), F.col("lang"))), " ").alias("words"))


def content_hashes(spark, d):
    t = F.col("text")
    return S.read(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.lower(F.hex(F.unhex(F.md5(t.cast("binary"))))).alias("md5"), F.length(t).alias("n_chars"))


def id_plumbing(spark, d):
    docs = S.read(spark, d, "documents").withColumn("uid", F.expr("concat(lang, '/', doc_id, '_aug')"))
    return docs.select("doc_id", F.replace("uid", F.lit("_aug"), F.lit("")).alias("base"), F.split("uid", "/", 2)[1].alias("rest"), F.col("uid").startswith("en/1").alias("prefixed"))


def regex_group_key(spark, d):
    path = F.concat(F.lit("data/"), "lang", F.lit("/"), "source", F.lit("/part-"), F.col("doc_id").cast("string"), F.lit(".parquet"))
    return S.read(spark, d, "documents").select("doc_id", F.regexp_extract(path, r"^(?:data/[a-z]+/(?<g>src\d+)/.*)", 1).alias("group"))


def coerce_labels(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, F.lit("bad"))
    return S.read(spark, d, "documents").select("doc_id", F.coalesce(raw.try_cast("int"), F.lit(-1)).alias("label"), F.coalesce(raw, F.lit("")).alias("text_label"))


def group_row_lists(spark, d):
    docs = S.read(spark, d, "documents").where(F.col("source").isNotNull() & (F.col("source") != ""))
    return docs.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).select("source", F.size("ids").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("all_ids"))


_TOKEN_SQL = r"regexp_extract_all(code, '[A-Za-z_][A-Za-z_0-9]*|==|!=|<=|>=|&&|\|\||[{}();,\[\].:+\-*/]')"
_GO = "[" + ", ".join(f"'{w}'" for w in X.GO_STOP_WORDS) + "]"
_JAVA = "[" + ", ".join(f"'{w}'" for w in X.JAVA_KEYWORDS) + "]"
_PYTHON = "[" + ", ".join(f"'{w}'" for w in X.PYTHON_KEYWORDS) + "]"
_WS = "list_distinct(regexp_extract_all(lower(code), '[A-Za-z_][A-Za-z_0-9]*'))"
_IS = r"list_distinct(regexp_extract_all(code, '[A-Za-z_][\p{L}\p{M}\p{Nd}\p{Pc}]+'))"

PLANS = {
    "unpivot_pairs": (unpivot_pairs, "SELECT id || '_' || side AS uid, id, side::TINYINT AS side, 'java' AS lang, 'train' AS split, label::INT AS label, coalesce(code, '') AS code FROM (SELECT doc_id AS id, doc_id % 2 AS label, 1 AS side, text AS code FROM documents UNION ALL SELECT doc_id, doc_id % 2, 2, lower(text) FROM documents)"),
    "single_to_unified": (single_to_unified, "SELECT doc_id || '_1' AS uid, doc_id AS id, 1::TINYINT AS side, 'python' AS lang, 'validation' AS split, -1 AS label, coalesce(text, '') AS code FROM documents"),
    "strip_comments": (lambda spark, d: _snippets(spark, d).select("doc_id", X.strip_comments(F.col("code"), F.col("lang")).alias("out")), _from_snippet(f"trim(CASE lang WHEN 'java' THEN {_sub('code', *_C)} WHEN 'php' THEN {_sub('code', *_C, _H)} WHEN 'python' THEN {_sub('code', *_PY, _H)} ELSE {_sub('code', _RB, _H)} END, {SPACES})")),
    "strip_comments_c": (lambda spark, d: _out(X.strip_comments_c(F.col("code")))(spark, d), _from_snippet(f"trim({_sub('code', *_C)}, {SPACES})")),
    "normalize_sql_light": (lambda spark, d: _out(X.normalize_sql_light(F.col("code")))(spark, d), _from_snippet(_sub("code", _C[0], ("(?m)//.*$", ""), ("(?m)#.*$", ""), ("[\\t ]+", " ")))),
    "sql_function_normalize": (sql_function_normalize, "SELECT code_id, " + _sub("code", _C[0], ("(?m)//.*$", ""), ("(?m)#.*$", ""), ("[\\t ]+", " ")) + " AS out FROM (SELECT doc_id AS code_id, '/* a */ ' || text || ' // b' || chr(10) || '# c' || chr(10) AS code FROM documents)"),
    "normalize_search": (lambda spark, d: _out(X.normalize_search(F.col("code")))(spark, d), _from_snippet(f"trim({_sub('code', *_C, (chr(92) + 's+', ' '))}, {SPACES})")),
    "light_strip": (lambda spark, d: _snippets(spark, d, LIGHT).select("doc_id", X.light_strip(F.col("code"), F.col("lang")).alias("out")), _from_snippet(f"CASE WHEN lang IN ('javascript', 'go') THEN {_sub('code', ('//[^' + chr(92) + 'n]*', ''), _C[0])} WHEN lang = 'python' THEN {_sub('code', _H)} ELSE code END", LIGHT)),
    "normalize_space": (lambda spark, d: _out(X.normalize_space(F.col("code")))(spark, d), _from_snippet(f"trim({_sub('code', (chr(92) + 's+', ' '))})")),
    "replace_literals": (lambda spark, d: _out(X.replace_literals(F.col("code")))(spark, d), _from_snippet(_sub("code", ("\"[^\\n\"\\\\]*\"|''[^\\n''\\\\]*''", "<STR>"), (r"\b\d+(\.\d+)?\b", "<NUM>")))),
    "light_normalize": (light_normalize, None),
    "obfuscate": (obfuscate, None),
    "token_stream": (token_stream, f"SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS toks FROM (SELECT doc_id, {_TOKEN_SQL} AS t FROM (SELECT doc_id, {SNIPPET_SQL} AS code FROM documents))"),
    "uniqueness_word_sets": (uniqueness_word_sets, f"SELECT doc_id, array_to_string(list_sort(CASE WHEN lang = 'go' THEN list_filter({_WS}, lambda w: NOT list_contains({_GO}, w)) ELSE {_WS} END), ' ') AS words FROM (SELECT doc_id, {LIGHT} AS lang, {SNIPPET_SQL} AS code FROM documents)"),
    "search_identifier_sets": (search_identifier_sets, f"SELECT doc_id, array_to_string(list_sort(CASE lang WHEN 'java' THEN list_filter({_IS}, lambda w: NOT list_contains({_JAVA}, w)) WHEN 'python' THEN list_filter({_IS}, lambda w: NOT list_contains({_PYTHON}, w)) ELSE {_IS} END), ' ') AS words FROM (SELECT doc_id, {LANG} AS lang, {SNIPPET_SQL} AS code FROM documents)"),
    "content_hashes": (content_hashes, "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, length(text)::INT AS n_chars FROM documents"),
    "id_plumbing": (id_plumbing, "SELECT doc_id, lang || '/' || doc_id AS base, doc_id || '_aug' AS rest, starts_with(lang || '/' || doc_id || '_aug', 'en/1') AS prefixed FROM documents"),
    "regex_group_key": (regex_group_key, r"SELECT doc_id, regexp_extract('data/' || lang || '/' || source || '/part-' || doc_id || '.parquet', '^(?:data/[a-z]+/(src\d+)/.*)', 1) AS group FROM documents".replace(" AS group", ' AS "group"')),
    "coerce_labels": (coerce_labels, "SELECT doc_id, coalesce(try_cast(raw AS INT), -1) AS label, coalesce(raw, '') AS text_label FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'bad' END AS raw FROM documents)"),
    "group_row_lists": (group_row_lists, "SELECT source, len(ids)::INT AS n, array_to_string(ids, ',') AS all_ids FROM (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY source)"),
}
