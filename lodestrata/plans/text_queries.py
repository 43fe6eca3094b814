"""Text and code-search queries over files, symbols and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.names import module_of, normalize
from lodestrata.operators import text as T
from lodestrata.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _norm(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[\s\-_]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _words(c: str) -> str:
    return f"list_filter(string_split({_norm(c)}, '_'), lambda w: w <> '')"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


_EXT = "CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.js' THEN 'javascript' WHEN file_path LIKE '%.ts' THEN 'typescript' WHEN file_path LIKE '%.go' THEN 'go' WHEN file_path LIKE '%.java' THEN 'java' END"


def _language():
    p = F.col("file_path")
    return F.when(p.endswith(".py"), "python").when(p.endswith(".js"), "javascript").when(p.endswith(".ts"), "typescript").when(p.endswith(".go"), "go").when(p.endswith(".java"), "java")


def _files(spark, d):
    return table(spark, d, "files").select("file_path", "repo", "content", "content_hash").distinct()


_F = "f AS (SELECT DISTINCT file_path, repo, content, content_hash FROM files)"


@query(f"SELECT DISTINCT name, {_norm('name')} AS normalized FROM symbols")
def text_normalize_names(spark, d):
    return table(spark, d, "symbols").select("name", normalize(F.col("name")).alias("normalized")).distinct()


_Q = "decodeOrientation"


@query(f"""
WITH s AS (SELECT DISTINCT file_path || ':' || name AS id, name FROM symbols),
w AS (SELECT *, {_norm('name')} AS nn, list_distinct({_words('name')}) AS nw, {_norm(f"'{_Q}'")} AS qn, list_distinct({_words(f"'{_Q}'")}) AS qw FROM s),
r AS (SELECT id, name, CASE WHEN lower(name) = lower('{_Q}') THEN 1.0::DOUBLE WHEN nn = qn THEN 0.95::DOUBLE WHEN contains(lower(name), lower('{_Q}')) THEN 0.7::DOUBLE WHEN contains(nn, qn) THEN 0.6::DOUBLE
  WHEN len(list_intersect(qw, nw)) = len(qw) THEN 0.5::DOUBLE WHEN len(list_intersect(qw, nw)) > 0 THEN 0.3::DOUBLE * len(list_intersect(qw, nw)) / len(qw) ELSE 0.0::DOUBLE END AS score FROM w)
SELECT id, name, score FROM r WHERE score > 0 ORDER BY score DESC, name, id LIMIT 50""")
def text_symbol_search(spark, d):
    s = table(spark, d, "symbols").select(F.concat_ws(":", "file_path", "name").alias("id"), "name").distinct()
    return T.symbol_search(s, _Q, 50).select("id", "name", "score")


@query("SELECT DISTINCT file_path FROM files WHERE contains(lower(file_path), 'orientation')")
def text_file_search(spark, d):
    return table(spark, d, "files").where(F.lower("file_path").contains("orientation")).select("file_path").distinct()


@query(f"WITH {_F}, l AS (SELECT file_path, unnest(regexp_split_to_array(content, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(content, '\\r?\\n'), 1) AS n FROM f) SELECT file_path, CAST(n AS INTEGER) AS line_no, substr(trim(line, ' '), 1, 100) AS hit FROM l WHERE contains(lower(line), 'todo')")
def text_content_grep(spark, d):
    return T.grep(_files(spark, d), "content", ["file_path"], "TODO").select("file_path", F.col("line_no").cast("int").alias("line_no"), "hit")


@query(r"""
WITH k AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\b', 1), regexp_extract_all(text, '\b([a-z]+_[a-z_]+)\b', 1)), regexp_extract_all(text, '`([^`\n]+)`', 1)))) AS keyword FROM documents WHERE text IS NOT NULL)
SELECT doc_id, keyword FROM k WHERE length(keyword) > 2 AND lower(keyword) NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'import')""")
def text_keyword_extract(spark, d):
    return T.keyword_rows(table(spark, d, "documents"), "text", ["doc_id"])


@query(f"""
WITH a AS (SELECT name AS keyword, unnest(list_distinct({_words('name')})) AS word, len(list_distinct({_words('name')})) AS n FROM ideal_bands),
b AS (SELECT name, unnest(list_distinct({_words('name')})) AS word FROM (SELECT DISTINCT name FROM symbols)),
p AS (SELECT keyword, name, n, count(*) AS shared FROM a JOIN b USING (word) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY shared / n DESC, name) AS k FROM p)
SELECT keyword, name, shared, round(shared / n, 6) AS score FROM r WHERE k <= 10""")
def text_keyword_name_join(spark, d):
    k = table(spark, d, "ideal_bands").select(F.col("name").alias("keyword"))
    return T.keyword_names(k, table(spark, d, "symbols")).select("keyword", "name", "shared", F.round("score", 6).alias("score"))


@query(f"""
WITH {_F}, l AS (SELECT file_path, {_EXT} AS language, unnest(regexp_split_to_array(content, '\\r?\\n')) AS line FROM f WHERE content IS NOT NULL),
c AS (SELECT file_path, trim(line, ' ') = '' AS blank, regexp_matches(line, CASE WHEN language = 'python' THEN '^\\s*#' ELSE '^\\s*(//|/\\*|\\*)' END) AS com FROM l)
SELECT file_path, count(*) AS total, CAST(count_if(blank) AS BIGINT) AS blank, CAST(count_if(NOT blank AND com) AS BIGINT) AS comment, CAST(count(*) - count_if(blank) - count_if(NOT blank AND com) AS BIGINT) AS code FROM c GROUP BY 1""")
def text_line_metrics(spark, d):
    pattern = F.when(_language() == "python", F.lit(T.COMMENT["python"])).otherwise(F.lit(T.COMMENT["go"]))
    return T.line_metrics(_files(spark, d).select("file_path", "content"), "content", ["file_path"], pattern)


@query(f"WITH {_F} SELECT file_path, CAST(1 + len(regexp_extract_all(content, '{T.BRANCHES}')) AS BIGINT) AS complexity FROM f WHERE content IS NOT NULL")
def text_complexity(spark, d):
    return _files(spark, d).where("content is not null").select("file_path", T.complexity(F.col("content")).cast("long").alias("complexity"))


@query("""
WITH s AS (SELECT DISTINCT file_path, name, node_type, end_line - start_line + 1 AS n, regexp_extract(signature, '\\((.*)\\)', 1) AS inner_ FROM symbols),
p AS (SELECT *, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(inner_, '<[^<>]*>|\\[[^\\[\\]]*\\]|\\{[^{}]*\\}', '', 'g'), '\\([^()]*\\)', '', 'g'), ','), lambda x: trim(x, ' ')), lambda x: x NOT IN ('', 'self', 'cls', '*', '/'))) AS params FROM s)
SELECT DISTINCT file_path, name, smell FROM (SELECT file_path, name, unnest([CASE WHEN n > 50 THEN 'long' END, CASE WHEN params >= 4 AND node_type <> 'class' THEN 'many_parameters' END, CASE WHEN length(name) > 24 THEN 'long_name' END]) AS smell FROM p) WHERE smell IS NOT NULL""")
def text_smells(spark, d):
    s = table(spark, d, "symbols").withColumn("n", F.col("end_line") - F.col("start_line") + 1).withColumn("params", T.parameter_count(F.col("signature")))
    found = F.array_compact(F.array(F.when(F.col("n") > 50, F.lit("long")), F.when((F.col("params") >= 4) & (F.col("node_type") != "class"), F.lit("many_parameters")), F.when(F.length("name") > 24, F.lit("long_name"))))
    return s.select("file_path", "name", F.explode(found).alias("smell")).distinct()


@query("WITH t AS (SELECT doc_id, doc_kind, coalesce(length(text) // 4, 0) AS tokens FROM documents), r AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_kind ORDER BY doc_id) - tokens AS before FROM t) SELECT doc_id, doc_kind, CAST(tokens AS BIGINT) AS tokens, CAST(before AS BIGINT) AS before FROM r WHERE before < 8000")
def text_token_budget(spark, d):
    return T.token_budget(table(spark, d, "documents").select("doc_id", "doc_kind", "text"), ["doc_kind"], ["doc_id"], "text", 8000).select("doc_id", "doc_kind", "tokens", "before")


@query(f"WITH {_F} SELECT DISTINCT file_path FROM f WHERE (file_path, md5(coalesce(content, ''))) NOT IN (SELECT (file_path, content_hash) FROM files WHERE content_hash IS NOT NULL)")
def text_incremental_scan(spark, d):
    """Files whose content is not the one they were indexed with."""
    f = _files(spark, d)
    return T.changed(f.select("file_path", "content"), f.where("content_hash is not null"), "file_path", "content", "content_hash").select("file_path").distinct()


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def text_dedupe_first_wins(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("digest"))
    return T.keep_one(t, ["digest"], ["doc_id"])


@query("SELECT file_path, max(parsed_at) AS parsed_at FROM files GROUP BY 1")
def text_dedupe_last_wins(spark, d):
    return T.keep_one(table(spark, d, "files").select("file_path", "parsed_at"), ["file_path"], ["parsed_at"], last=True)


@query(r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, nullif(regexp_extract(line, '^#{1,6}\s+(.*)$', 1), '') AS head, regexp_extract(line, '^\s*[-*]\s+(?:\[[ x]\]\s+)?(.*)$', 1) AS item FROM l),
s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
SELECT doc_id, CAST(n AS INTEGER) AS line_no, section, item FROM s WHERE item <> ''""")
def text_section_parse(spark, d):
    return T.sections(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "section", "item")


@query(r"SELECT DISTINCT file_path, regexp_replace(replace(regexp_replace(file_path, '\.[^./]+$', ''), '/', '.'), '\.__init__$', '') AS module FROM files")
def text_module_names(spark, d):
    return table(spark, d, "files").select("file_path", module_of(F.col("file_path")).alias("module")).distinct()
