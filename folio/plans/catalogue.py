"""Named queries of the document engine over the given tables, each with the SQL that DuckDB checks it by.

The tables hold no files, so the roles of files, pages and lines are played by documents and conversations, with damage,
wraps and clashes put in by rule, the same way in Spark and in SQL.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folio.functions import paths as P
from folio.functions import text as X
from folio.operators import lines as L
from folio.operators import geometry, ocr, planning, quality, reports
from folio.schema import ELEMENT, PARSED, PIPELINE_VERSION

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Unicode white space for RE2, as Java's (?U)\s has it.
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DIGEST = "d1"


def query(sql: str) -> Callable:
    """Registers a function under its name with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _squeezed(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def _stripped(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{WS}+', ''), '{WS}+$', '')"


def _nonspace(t: str) -> str:
    return f"length(regexp_replace({t}, '{WS}+', '', 'g'))"


def _count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


# Text functions

NOISY_SQL = "replace(text, chr(10), chr(13) || chr(10)) || chr(160) || chr(8239) || chr(173) || chr(8203) || chr(7)"


def noisy(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("\n"), F.lit("\r\n")), F.lit("  ­​\u0007"))


@query(rf"""
WITH n AS (SELECT doc_id, {NOISY_SQL} AS t FROM documents),
c AS (SELECT doc_id, length(t) AS before, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x{{A0}}\x{{2007}}\x{{202F}}]', ' ', 'g'), '[\x00-\x08\x0B-\x1F\x7F-\x9F]|\p{{Cf}}', '', 'g') AS t FROM n)
SELECT doc_id, length(t) AS clean_len, before - length(t) AS removed, md5(t) AS clean_md5 FROM c
""")
def clean_text_lengths(spark, sf_dir):
    t = noisy(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(X.clean(t)).cast("long").alias("clean_len"), (F.length(t) - F.length(X.clean(t))).cast("long").alias("removed"), F.md5(X.clean(t)).alias("clean_md5"))


LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"


@query(f"SELECT doc_id, line_no, length(line) AS line_len FROM ({LINES_SQL})")
def doc_lines(spark, sf_dir):
    return L.explode_lines(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("text").cast("long").alias("line_len"))


@query(f"SELECT doc_id, {_nonspace('text')} AS nonspace FROM documents")
def nonspace_by_doc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.nonspace(F.col("text")).alias("nonspace"))


@query(f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS tokens FROM documents)
SELECT doc_id, len(tokens) AS tokens, round(list_sum(list_transform(tokens, lambda x: length(x))) / nullif(len(tokens), 0)::DOUBLE, 6) AS avg_len FROM t
""")
def token_stats(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(X.tokens(t)).cast("long").alias("tokens"), F.round(X.token_length(t), 6).alias("avg_len"))


CJK_ROWS = [(1, "文字 and text"), (2, "あカｦ⺀"), (3, "\U00020000\U0002ebe0x"), (4, "plain 42")]


@query(r"""
WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, '文字 and text'), (-2, 'あカｦ⺀'), (-3, '𠀀𮯠x'), (-4, 'plain 42')))
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin,
  len(regexp_extract_all(text, '[\x{2e80}-\x{2fdf}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{2ebef}]')) AS cjk,
  len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')) AS cjk_counted, len(regexp_extract_all(text, '\p{Nd}')) AS digits
FROM t
""")
def script_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text").union(spark.createDataFrame([(-i, t) for i, t in CJK_ROWS], "doc_id long, text string"))
    t = F.col("text")
    return docs.select("doc_id", X.count_of(t, "[A-Za-z]").alias("latin"), X.count_of(t, X.CJK).alias("cjk"), X.count_of(t, X.CJK_COUNTED).alias("cjk_counted"), X.count_of(t, r"\p{Nd}").alias("digits"))


def _key_sql(t: str) -> str:
    return rf"regexp_replace({_squeezed(t)}, '\p{{Nd}}+', '%d', 'g')"


@query(f"SELECT CASE WHEN key = '%d' THEN '' ELSE key END AS key, count(*) AS n FROM (SELECT {_key_sql('line')} AS key FROM ({LINES_SQL})) GROUP BY 1")
def head_keys(spark, sf_dir):
    return L.explode_lines(_docs(spark, sf_dir), ["doc_id"]).select(X.head_key(F.col("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, median(n) AS med, median(n) * 0.6 AS short_cut FROM (SELECT doc_id, length({_stripped('line')}) AS n FROM ({LINES_SQL})) WHERE n > 0 GROUP BY doc_id")
def line_median(spark, sf_dir):
    lines = L.explode_lines(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", F.length(X.strip(F.col("text"))).alias("n")).where("n > 0")
    return lines.groupBy("doc_id").agg(F.median("n").alias("med"), (F.median("n") * 0.6).alias("short_cut"))


# Soft wraps

WRAPPED_SQL = "SELECT doc_id, unnest(c) AS line, generate_subscripts(c, 1) AS line_no FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '.{1,60}') AS c FROM documents)"
HYPHEN_SQL = f"SELECT doc_id, CASE WHEN line_no % 5 = 0 AND regexp_matches(line, '[A-Za-z]$') THEN line || '-' ELSE line END AS line, line_no FROM ({WRAPPED_SQL})"
CJK_CLASS = r"[\x{2e80}-\x{2fdf}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{2ebef}。！？；：，、）」』】〉》”’]"
CJK_LINES = [(1, 1, "这是第一行文字，"), (1, 2, "这是第二行文字"), (1, 3, "接着的第三行。"), (1, 4, "新的一段从这里"), (1, 5, "Latin words here"), (1, 6, "go on in 文字"), (1, 7, "𠀀𠀁文字的行"), (1, 8, ""), (1, 9, "a-"), (1, 10, "break"), (1, 11, "Mixed long line of words,"), (1, 12, "and on")]


def _wrap_ctes(source: str) -> str:
    """CTEs up to `joined`: the lines with what joins them."""
    return f"""
lines AS (SELECT doc_id, line_no, {_stripped('line')} AS line FROM ({source})),
cuts AS (SELECT doc_id, coalesce(median(CASE WHEN length(line) > 0 THEN length(line) END), 0) * 0.6 AS short_cut FROM lines GROUP BY doc_id),
near AS (SELECT l.*, short_cut, lag(line) OVER w AS prev FROM lines l JOIN cuts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
kinds AS (SELECT *, CASE
  WHEN prev IS NULL OR prev = '' OR line = '' THEN NULL
  WHEN regexp_matches(prev, '[。！？；：.!?;:…”’)》」』】]$') THEN NULL
  WHEN regexp_matches(prev, '{CJK_CLASS}$') THEN CASE WHEN regexp_matches(line, '^{CJK_CLASS}') THEN 'cat' END
  WHEN regexp_matches(prev, '[A-Za-z]-$') THEN CASE WHEN regexp_matches(line, '^[a-z]') THEN 'dehyphen' END
  WHEN regexp_matches(prev, '[A-Za-z,]$') AND regexp_matches(line, '^[a-z]') THEN 'space' END AS kind FROM near),
runs AS (SELECT *, count(*) FILTER (kind IS NULL) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM kinds),
joined AS (SELECT *, kind IS NOT NULL AND coalesce(bool_or(kind IS NOT NULL AND length(prev) >= short_cut) OVER (PARTITION BY doc_id, run ORDER BY line_no), false) AS joins FROM runs)"""


def _merged_ctes(source: str) -> str:
    return _wrap_ctes(source) + """,
parts AS (SELECT doc_id, line_no, joins, CASE WHEN row_number() OVER w = 1 THEN '' WHEN NOT joins THEN chr(10) WHEN kind = 'space' THEN ' ' ELSE '' END
  || CASE WHEN coalesce(lead(joins) OVER w AND lead(kind) OVER w = 'dehyphen', false) THEN regexp_replace(line, '-$', '') ELSE line END AS part
  FROM joined WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
merged AS (SELECT doc_id, string_agg(part, '' ORDER BY line_no) AS text, count(*) FILTER (NOT joins) AS merged_lines FROM parts GROUP BY doc_id)"""


def _wrapped(spark, sf_dir) -> DataFrame:
    return L.wrap_chunks(_docs(spark, sf_dir), ["doc_id"])


@query(f"WITH {_wrap_ctes(WRAPPED_SQL)} SELECT kind, joins, count(*) AS n FROM joined GROUP BY ALL")
def soft_wrap_kinds(spark, sf_dir):
    return L.soft_wrap_kinds(_wrapped(spark, sf_dir), ["doc_id"]).groupBy("kind", "joins").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_merged_ctes(WRAPPED_SQL)} SELECT doc_id, merged_lines, length(text) AS merged_len, md5(text) AS text_md5 FROM merged")
def soft_wrap_merge(spark, sf_dir):
    return L.merge_soft_wraps(_wrapped(spark, sf_dir), ["doc_id"]).select("doc_id", "merged_lines", F.length("text").cast("long").alias("merged_len"), F.md5("text").alias("text_md5"))


@query(f"WITH {_merged_ctes(HYPHEN_SQL)} SELECT doc_id, merged_lines, md5(text) AS text_md5 FROM merged")
def dehyphenate(spark, sf_dir):
    cut = (F.col("line_no") % 5 == 0) & F.col("text").rlike("[A-Za-z]$")
    lines = _wrapped(spark, sf_dir).withColumn("text", F.when(cut, F.concat("text", F.lit("-"))).otherwise(F.col("text")))
    return L.merge_soft_wraps(lines, ["doc_id"]).select("doc_id", "merged_lines", F.md5("text").alias("text_md5"))


_CJK_VALUES = ", ".join(f"({d}, {i}, '{t}')" for d, i, t in CJK_LINES)
#: Vowels, commas and full stops of the wrapped lines written as CJK characters, so that most lines end or begin with one.
CJK_FROM, CJK_TO = "aeiou,.", "文字中日本，。"
CJK_SQL = f"SELECT doc_id, line_no, translate(line, '{CJK_FROM}', '{CJK_TO}') AS line FROM ({WRAPPED_SQL}) UNION ALL SELECT -doc_id, line_no, line FROM (VALUES {_CJK_VALUES}) v(doc_id, line_no, line)"


@query(f"WITH {_merged_ctes(CJK_SQL)} SELECT doc_id, merged_lines, md5(text) AS text_md5 FROM merged")
def cjk_wrap_merge(spark, sf_dir):
    written = spark.createDataFrame([(-d, i, t) for d, i, t in CJK_LINES], "doc_id long, line_no int, text string")
    lines = _wrapped(spark, sf_dir).withColumn("text", F.translate("text", CJK_FROM, CJK_TO)).unionByName(written)
    return L.merge_soft_wraps(lines, ["doc_id"]).select("doc_id", "merged_lines", F.md5("text").alias("text_md5"))


def _collapsed(t: str) -> str:
    blank = WS.replace(r"\s", r"\t\f\r ")
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '{blank}+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '')"


BLANKS_SQL = "chr(10) || replace(text, chr(10), '  ' || repeat(chr(10), 3)) || chr(10)"


@query(f"SELECT doc_id, len(string_split({BLANKS_SQL}, chr(10))) AS lines_before, len(string_split({_collapsed(BLANKS_SQL)}, chr(10))) AS lines_after, md5({_collapsed(BLANKS_SQL)}) AS text_md5 FROM documents")
def collapse_blank_lines(spark, sf_dir):
    t = F.concat(F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("  \n\n\n")), F.lit("\n"))
    count = lambda c: F.size(F.split(c, "\n")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", count(t).alias("lines_before"), count(L.collapse_blanks(t)).alias("lines_after"), F.md5(L.collapse_blanks(t)).alias("text_md5"))


@query(f"WITH {_merged_ctes(LINES_SQL)} SELECT doc_id, length(t) AS len, md5(t) AS text_md5 FROM (SELECT doc_id, {_collapsed('text')} AS t FROM merged)")
def normalize_page(spark, sf_dir):
    return L.normalise_pages(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", F.length("text").cast("long").alias("len"), F.md5("text").alias("text_md5"))


# Running heads

HEAD_LINES_SQL = f"""
numbered AS (SELECT doc_id AS page_no, source AS doc, string_split('SRC ' || source || ' - page ' || doc_id || chr(10) || text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc, page_no, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n_lines FROM numbered),
placed AS (SELECT *, 100.0 * (line_no - 1) / n_lines AS y0, {_key_sql(_stripped('line'))} AS k FROM lines),
keyed AS (SELECT *, CASE WHEN k = '%d' THEN '' ELSE k END AS key, length({_stripped('line')}) AS n FROM placed)"""


def _head_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page_no"), F.concat(F.lit("SRC "), "source", F.lit(" - page "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("text"))
    n = F.size(F.split("text", "\n"))
    lines = docs.select("doc", "page_no", n.alias("n_lines"), F.posexplode(F.split("text", "\n")))
    return docs.select("doc", "page_no"), lines.select("doc", "page_no", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text"), (F.lit(100.0) * F.col("pos") / F.col("n_lines")).alias("y0"))


@query(f"""
WITH {HEAD_LINES_SQL}, docs AS (SELECT doc, greatest(3, floor(count(*) * 0.5)) AS least FROM numbered GROUP BY doc HAVING count(*) >= 3)
SELECT doc, key, count(DISTINCT page_no) AS n_pages FROM keyed JOIN docs USING (doc) WHERE key <> '' AND n BETWEEN 1 AND 120 GROUP BY doc, key, least HAVING count(DISTINCT page_no) >= least
""")
def running_head_freq(spark, sf_dir):
    pages, lines = _head_pages(spark, sf_dir)
    nowhere = F.lit(None).cast("double")
    found = L.running_heads(pages.withColumn("height", nowhere), lines.withColumn("y0", nowhere).withColumn("y1", nowhere))
    return found.select("doc", "key", "n_pages")


BAND = "(y0 <= 8 OR y0 >= 92)"


@query(f"""
WITH {HEAD_LINES_SQL}
SELECT doc, key, count(DISTINCT page_no) AS n_pages FROM keyed WHERE key <> '' AND n BETWEEN 1 AND 120 AND {BAND} GROUP BY doc, key HAVING count(DISTINCT page_no) >= 3
""")
def running_head_band(spark, sf_dir):
    pages, lines = _head_pages(spark, sf_dir)
    return L.running_heads(pages.withColumn("height", F.lit(100.0)), lines.withColumn("y1", F.lit(None).cast("double"))).select("doc", "key", "n_pages")


@query(f"""
WITH {HEAD_LINES_SQL}, heads AS (SELECT doc, key FROM keyed WHERE key <> '' AND n BETWEEN 1 AND 120 AND {BAND} GROUP BY doc, key HAVING count(DISTINCT page_no) >= 3)
SELECT k.doc, k.page_no, count(*) FILTER (NOT coalesce(h.key IS NOT NULL AND {BAND}, false)) AS kept, count(*) FILTER (coalesce(h.key IS NOT NULL AND {BAND}, false)) AS removed
FROM keyed k LEFT JOIN heads h ON k.doc = h.doc AND k.key = h.key GROUP BY k.doc, k.page_no
""")
def running_head_removed_lines(spark, sf_dir):
    pages, lines = _head_pages(spark, sf_dir)
    pages, lines = pages.withColumn("height", F.lit(100.0)), lines.withColumn("y1", F.lit(None).cast("double"))
    kept = L.without_heads(pages, lines, L.running_heads(pages, lines))
    count = lambda rows, name: rows.groupBy("doc", "page_no").agg(F.count(F.lit(1)).alias(name))
    both = count(lines, "n").join(count(kept, "kept"), ["doc", "page_no"], "left").fillna(0, ["kept"])
    return both.select("doc", "page_no", "kept", (F.col("n") - F.col("kept")).alias("removed"))


# Quality

DAMAGED_SQL = r"""damaged AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN regexp_replace(text, '([A-Za-z])', '\1 ', 'g') WHEN doc_id % 17 = 0 THEN text || repeat(chr(65533), (length(text) // 20 + 1)::INT) WHEN doc_id % 19 = 0 THEN text || repeat(chr(57344), (length(text) // 10 + 1)::INT) ELSE text END AS text FROM documents)"""


def damaged(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    some = lambda c, k: F.expr(f"repeat('{c}', cast(floor(length(text) / {k}) + 1 AS INT))")
    spread = F.regexp_replace(t, "([A-Za-z])", "$1 ")
    return docs.select("doc_id", F.when(F.col("doc_id") % 13 == 0, spread).when(F.col("doc_id") % 17 == 0, F.concat(t, some("�", 20))).when(F.col("doc_id") % 19 == 0, F.concat(t, some("", 10))).otherwise(t).alias("text"))


def _ratios(t: str) -> str:
    return rf"{_count(t, chr(0xFFFD))} / nullif(length({t}), 0)::DOUBLE AS fffd, {_count(t, chr(92) + 'p{Co}')} / nullif(length({t}), 0)::DOUBLE AS private, {_count(t, '[A-Za-z]')} AS latin, {_count(t, '[' + chr(0x3040) + '-' + chr(0x30ff) + chr(0x3400) + '-' + chr(0x4dbf) + chr(0x4e00) + '-' + chr(0x9fff) + chr(0xf900) + '-' + chr(0xfaff) + ']')} AS cjk, {_nonspace(t)} AS nonspace, len(list_filter(regexp_split_to_array({t}, '{WS}+'), lambda x: x <> '')) AS tokens"


def _status_sql(median: str) -> str:
    return f"""CASE WHEN nonspace < 50 THEN 'empty' WHEN fffd > 0.01 OR private > 0.05 OR (latin >= 20 AND latin > cjk AND nonspace / nullif(tokens, 0)::DOUBLE < 1.5) THEN 'garbled'
  WHEN {median} < 100 OR chars < 200 THEN 'low' ELSE 'ok' END"""


QUALITY_SQL = f"WITH {DAMAGED_SQL}, r AS (SELECT doc_id, length(text) AS chars, {_ratios('text')} FROM damaged), q AS (SELECT doc_id, chars, nonspace, nonspace AS median, {_status_sql('nonspace')} AS status FROM r)"


def _quality(spark, sf_dir) -> DataFrame:
    return quality.assess(damaged(_docs(spark, sf_dir)).withColumn("page_no", F.lit(1)), doc="doc_id")


@query(f"""WITH {DAMAGED_SQL}, r AS (SELECT doc_id, length(text) AS chars, {_ratios('text')} FROM damaged), g AS (SELECT *, {_status_sql('nonspace')} AS status FROM r)
SELECT doc_id, array_to_string(CASE status WHEN 'empty' THEN ['characters that aren''t white space ' || nonspace || ' (under 50)'] WHEN 'ok' THEN [] WHEN 'low' THEN
  list_filter([CASE WHEN nonspace < 100 THEN 'median characters of a page ' || nonspace || ' (under 100)' END, CASE WHEN chars < 200 THEN 'characters ' || chars || ' (under 200)' END], lambda x: x IS NOT NULL)
  ELSE list_filter([CASE WHEN fffd > 0.01 THEN printf('replacement characters %.1f%% (over 1%%)', 100 * fffd) END, CASE WHEN private > 0.05 THEN printf('private-use or unassigned characters %.1f%% (over 5%%)', 100 * private) END,
    CASE WHEN latin >= 20 AND latin > cjk AND nonspace / nullif(tokens, 0)::DOUBLE < 1.5 THEN printf('mean token length %.2f (under 1.5)', nonspace / nullif(tokens, 0)::DOUBLE) END], lambda x: x IS NOT NULL) END, '; ') AS reasons FROM g""")
def quality_reasons(spark, sf_dir):
    return _quality(spark, sf_dir).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"{QUALITY_SQL} SELECT * FROM q")
def quality_by_doc(spark, sf_dir):
    return _quality(spark, sf_dir).select("doc_id", "chars", "nonspace", "median", "status")


CONV_SQL = "SELECT conv_id AS doc, turn + 1 AS page_no, CASE WHEN role = 'system' THEN 'ocr' ELSE 'text' END AS source, text FROM conversations"


def _conv(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_no"), F.when(F.col("role") == "system", "ocr").otherwise("text").alias("source"), "text")


@query(f"""
WITH p AS ({CONV_SQL}), f AS (SELECT doc, string_agg(text, chr(10) ORDER BY page_no) AS text, CAST(floor(median({_nonspace('text')})) AS BIGINT) AS median FROM p GROUP BY doc),
r AS (SELECT doc, median, length(text) AS chars, {_ratios('text')} FROM f)
SELECT doc, chars, nonspace, median, {_status_sql('median')} AS status FROM r
""")
def quality_paged(spark, sf_dir):
    return quality.assess(_conv(spark, sf_dir)).select("doc", "chars", "nonspace", "median", "status")


def _garbled(name: str, ratio: str, flag: str, of: Callable[[Column], Column]) -> None:
    ORACLE_SQL[name] = f"WITH {DAMAGED_SQL}, r AS (SELECT doc_id, {_ratios('text')} FROM damaged) SELECT doc_id, round({ratio}, 6) AS ratio, coalesce({flag}, false) AS flag FROM r"
    QUERIES[name] = lambda spark, sf_dir: damaged(_docs(spark, sf_dir)).select("doc_id", F.round(of(F.col("text")), 6).alias("ratio"), X.garbled_flags(F.col("text"))[{"garbled_replacement": "replacement", "garbled_pua": "private", "garbled_tokens": "split"}[name]].alias("flag"))


_garbled("garbled_replacement", "fffd", "fffd > 0.01", X.replacement_ratio)
_garbled("garbled_pua", "private", "private > 0.05", X.private_ratio)
_garbled("garbled_tokens", "nonspace / nullif(tokens, 0)::DOUBLE", "latin >= 20 AND latin > cjk AND nonspace / nullif(tokens, 0)::DOUBLE < 1.5", X.token_length)


@query(f"{QUALITY_SQL} SELECT status, count(*) AS n FROM q GROUP BY status")
def quality_counts(spark, sf_dir):
    return reports.status_counts(_quality(spark, sf_dir)).select("status", "n")


@query(f"""
SELECT doc, CASE WHEN count(*) FILTER (n < 30) = count(*) THEN 'none' WHEN count(*) FILTER (n < 30) > 0 THEN 'mixed' WHEN min(n) >= 200 THEN 'rich' ELSE 'sparse' END AS layer
FROM (SELECT doc, {_nonspace('text')} AS n FROM ({CONV_SQL})) GROUP BY doc
""")
def text_layer_class(spark, sf_dir):
    return _conv(spark, sf_dir).groupBy("doc").agg(F.collect_list(X.nonspace(F.col("text"))).alias("counts")).select("doc", geometry.text_layer(F.col("counts")).alias("layer"))


MATH_SQL = "CASE WHEN doc_id % 3 = 0 THEN text || repeat('∑≤', (doc_id % 7)::INT) ELSE text END"


@query(f"""
SELECT doc_id, hits, hits >= 8 OR (hits >= 3 AND hits / greatest(length(t), 1)::DOUBLE > 0.004) AS has_math
FROM (SELECT doc_id, t, {_count('t', X.MATH)} AS hits FROM (SELECT doc_id, {MATH_SQL} AS t FROM documents))
""")
def math_flag(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.expr("concat(text, repeat('∑≤', cast(doc_id % 7 AS INT)))")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", X.math_hits(F.col("t")).alias("hits"), X.has_math(F.col("t")).alias("has_math"))


# OCR

@query(f"SELECT doc, page_no FROM ({CONV_SQL}) WHERE {_nonspace('text')} < 200")
def pages_needing_ocr(spark, sf_dir):
    return ocr.needing_ocr(_conv(spark, sf_dir), 200).select("doc", "page_no")


@query(f"SELECT doc, page_no, n > 3 AS partial FROM (SELECT doc, page_no, row_number() OVER (PARTITION BY doc ORDER BY page_no) AS i, count(*) OVER (PARTITION BY doc) AS n FROM ({CONV_SQL})) WHERE i <= 3")
def ocr_page_cap(spark, sf_dir):
    return ocr.capped(_conv(spark, sf_dir), 3).select("doc", "page_no", "partial")


def _work(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    work = _conv(spark, sf_dir).select("doc", F.md5(F.col("doc").cast("string")).alias("content_hash"), "page_no", F.lit(DIGEST).alias("digest"), "text")
    cache = work.where(F.col("page_no") % 3 != 0).select("content_hash", "page_no", F.when(F.col("page_no") % 5 == 0, "old").otherwise(F.col("digest")).alias("digest"), F.expr("array(struct(concat('read: ', text) AS text, 1.0D AS confidence, 0.1D AS y0, 0.2D AS y1))").alias("blocks"))
    return work, cache


@query(f"SELECT CASE WHEN page_no % 3 <> 0 AND page_no % 5 <> 0 THEN 'hit' ELSE 'miss' END AS status, count(*) AS n FROM ({CONV_SQL}) GROUP BY 1")
def ocr_cache_join(spark, sf_dir):
    hits, misses = ocr.from_cache(*_work(spark, sf_dir))
    return hits.select(F.lit("hit").alias("status")).unionByName(misses.select(F.lit("miss").alias("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc, page_no, CASE WHEN hit THEN 'ocr' ELSE source END AS source, md5(CASE WHEN hit THEN 'read: ' || text ELSE text END) AS text_md5 FROM (SELECT *, page_no % 3 <> 0 AND page_no % 5 <> 0 AS hit FROM ({CONV_SQL}))")
def ocr_replace_pages(spark, sf_dir):
    hits, _ = ocr.from_cache(*_work(spark, sf_dir))
    nowhere = F.lit(None).cast("double")
    pages = _conv(spark, sf_dir).select("doc", "page_no", "source", nowhere.alias("height"), F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text"), nowhere.alias("y0"), nowhere.alias("y1"))).alias("lines"))
    return ocr.replaced(pages, hits).select("doc", "page_no", "source", F.md5(F.array_join(F.transform("lines", lambda line: line["text"]), "\n")).alias("text_md5"))


@query(f"""
WITH w AS (SELECT doc, page_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc, page_no, string_split(text, ' ') AS ws FROM ({CONV_SQL})))
SELECT doc, page_no, md5(string_agg(word, ' ' ORDER BY CASE WHEN i % 5 = 0 THEN 1.0 ELSE (i * 37 % 10) / 10.0 END, i)) AS words_md5 FROM w GROUP BY ALL
""")
def ocr_block_order(spark, sf_dir):
    place = lambda i: F.when((i + 1) % 5 != 0, ((i + 1) * 37 % 10) / F.lit(10.0))
    blocks = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), F.lit(1.0).alias("confidence"), place(i).alias("y0"), place(i).alias("y1")))
    found = _conv(spark, sf_dir).select("doc", "page_no", ocr.in_order(blocks).alias("blocks"))
    return found.select("doc", "page_no", F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), " ")).alias("words_md5"))


@query(f"SELECT doc, list_sort(list(page_no)) AS pages, sum(length(text) + 6)::BIGINT AS chars FROM ({CONV_SQL}) WHERE page_no % 3 <> 0 AND page_no % 5 <> 0 GROUP BY doc")
def ocr_summary(spark, sf_dir):
    hits, _ = ocr.from_cache(*_work(spark, sf_dir))
    return ocr.summary(hits)


# Planning

EXT_SQL = "list_extract(['.pdf', '.pptx', '.docx', '.png', '.txt', '.md', '.xlsx', '.bin'], (doc_id % 8 + 1)::INT)"
_EXTS = ["pdf", "pptx", "docx", "png", "txt", "md", "xlsx", "bin"]
#: First bytes by doc_id % 8, some of which contradict the extension.
_HEADS = ["255044462D312E37", "504B0304", "504B0304", "89504E470D0A1A0A0000000D4948445200000064000000C8", "68656C6C6F", "255044462D312E37", "504B0304", "00010203"]
FILES_SQL = f"""files AS (SELECT doc_id, source || '/' || doc_id || {EXT_SQL} AS rel, n_chars * 40 AS bytes, 1000000 + doc_id AS mtime_ns,
  list_extract(['pdf', 'pptx', 'docx', 'image', 'plaintext', 'pdf', 'unsupported', 'unknown'], (doc_id % 8 + 1)::INT) AS kind, doc_id % 8 = 5 AS warned, CASE WHEN doc_id % 8 = 3 THEN 20000 END AS pixels FROM documents)"""
PLAN_SQL = FILES_SQL + """, reasoned AS (SELECT *, CASE WHEN bytes > 400000 THEN 'too_large' WHEN kind = 'unknown' THEN 'unknown_type' WHEN kind = 'unsupported' THEN 'unsupported'
  WHEN kind = 'image' AND (bytes < 20480 OR pixels < 40000) THEN 'trivial_image' END AS reason FROM files),
planned AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'skip' WHEN kind = 'plaintext' THEN 'register' ELSE 'extract' END AS action, CASE WHEN kind = 'plaintext' THEN 'out/text/' || rel ELSE 'out/text/' || rel || '.md' END AS target FROM reasoned)"""


def _files(spark, sf_dir) -> DataFrame:
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % 8 + 1).cast("int"))
    container = F.when(F.col("doc_id") % 8 == 1, "pptx").when(F.col("doc_id") % 8 == 2, "docx").when(F.col("doc_id") % 8 == 6, "unsupported")
    files = _docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), of(_EXTS)).alias("rel"), (F.col("n_chars") * 40).alias("bytes"), (F.col("doc_id") + 1_000_000).alias("mtime_ns"), F.unhex(of(_HEADS)).alias("head"), container.alias("container"))
    return planning.identified(files).withColumn("pixels", planning.image_pixels(F.col("head")))


def _planned(spark, sf_dir) -> DataFrame:
    items = planning.classified(_files(spark, sf_dir), max_bytes=400_000)
    return items.withColumn("target", P.target_path(F.col("rel"), F.col("kind"), "mirror", "out/text"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT list_extract(['pdf', 'pptx', 'docx', 'image', 'plaintext', 'plaintext', 'unsupported', NULL], (doc_id % 8 + 1)::INT) AS kind FROM documents) GROUP BY kind")
def identify_ext(spark, sf_dir):
    return _files(spark, sf_dir).select(P.kind_by_extension(F.col("rel")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES_SQL} SELECT kind, warned, count(*) AS n FROM files GROUP BY ALL")
def identify_magic(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("kind", F.array_contains("notes", "mismatch").alias("warned")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PLAN_SQL} SELECT action, reason, count(*) AS n FROM planned GROUP BY ALL")
def classify_action(spark, sf_dir):
    return _planned(spark, sf_dir).groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES_SQL} SELECT rel, CASE WHEN kind = 'plaintext' THEN 'out/text/' || rel ELSE 'out/text/' || rel || '.md' END AS mirror_target, CASE WHEN kind <> 'plaintext' THEN 'root/' || rel || '.md' END AS in_place_target FROM files")
def target_paths(spark, sf_dir):
    rel, kind = F.col("rel"), F.col("kind")
    return _files(spark, sf_dir).select("rel", P.target_path(rel, kind, "mirror", "out/text").alias("mirror_target"), P.target_path(rel, kind, "in-place", "root").alias("in_place_target"))


CLASH_SQL = PLAN_SQL + """, items AS (SELECT rel, target, action, reason FROM planned UNION ALL SELECT rel || '.md', target, 'register', NULL FROM planned WHERE doc_id % 40 = 0),
marked AS (SELECT *, regexp_matches(rel, '7\\.docx$') AS blocked FROM items),
settled AS (SELECT rel, target, action, reason, CASE WHEN blocked THEN 'target_exists' WHEN row_number() OVER (PARTITION BY target, blocked ORDER BY rel) > 1 THEN 'target_collision' END AS lost FROM marked)"""


@query(f"WITH {CLASH_SQL} SELECT rel, CASE WHEN lost IS NULL THEN target END AS target, CASE WHEN lost IS NULL THEN action ELSE 'collision' END AS action, coalesce(lost, reason) AS reason FROM settled")
def target_collisions(spark, sf_dir):
    planned = _planned(spark, sf_dir).select("doc_id", "rel", "target", "action", "reason")
    clash = planned.where("doc_id % 40 = 0").select("doc_id", F.concat("rel", F.lit(".md")).alias("rel"), "target", F.lit("register").alias("action"), F.lit(None).cast("string").alias("reason"))
    existing = planned.where(F.col("rel").rlike(r"7\.docx$")).select("target", F.lit(False).alias("generated"))
    known = planned.where(~F.col("rel").rlike(r"7\.docx$")).select("target")
    return planned.unionByName(clash).drop("doc_id").transform(planning.resolved, existing, known).select("rel", "target", "action", "reason")


PRIOR_SQL = PLAN_SQL + f""", prior AS (SELECT rel, bytes + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS bytes, mtime_ns, CASE WHEN doc_id % 23 = 0 THEN 'old' ELSE '{PIPELINE_VERSION}' END AS version, target FROM planned WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'gone/' || (doc_id + 1000000) || '.pdf', 1, 1, '{PIPELINE_VERSION}', 'out/text/gone/' || (doc_id + 1000000) || '.pdf.md' FROM planned WHERE doc_id % 50 = 0),
fingerprinted AS (SELECT p.rel, CASE WHEN p.action IN ('extract', 'register') AND p.bytes = o.bytes AND p.mtime_ns = o.mtime_ns AND o.version = '{PIPELINE_VERSION}' AND p.doc_id % 11 <> 0 THEN 'unchanged' ELSE p.action END AS action FROM planned p LEFT JOIN prior o USING (rel))"""


def _prior(planned: DataFrame) -> DataFrame:
    old = planned.where("doc_id % 7 <> 0").select("rel", (F.col("bytes") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("bytes"), "mtime_ns", F.when(F.col("doc_id") % 23 == 0, "old").otherwise(PIPELINE_VERSION).alias("pipeline_version"), "target")
    name = F.concat(F.lit("gone/"), (F.col("doc_id") + 1_000_000).cast("string"), F.lit(".pdf"))
    ghosts = planned.where("doc_id % 50 = 0").select(name.alias("rel"), F.lit(1).cast("long").alias("bytes"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(PIPELINE_VERSION).alias("pipeline_version"), F.concat(F.lit("out/text/"), name, F.lit(".md")).alias("target"))
    return old.unionByName(ghosts).withColumn("config_digest", F.lit(DIGEST))


def _fingerprinted(spark, sf_dir) -> DataFrame:
    planned = _planned(spark, sf_dir)
    return planning.fingerprinted(planned, _prior(planned).drop("target"), planned.where("doc_id % 11 <> 0").select("target"), DIGEST)


@query(f"WITH {PRIOR_SQL} SELECT rel, action FROM fingerprinted")
def fingerprint_plan(spark, sf_dir):
    return _fingerprinted(spark, sf_dir).select("rel", "action")


@query(f"WITH {PRIOR_SQL} SELECT action, count(*) AS n FROM fingerprinted GROUP BY action")
def fingerprint_counts(spark, sf_dir):
    return _fingerprinted(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRIOR_SQL} SELECT DISTINCT target FROM prior WHERE target NOT IN (SELECT target FROM planned WHERE action <> 'skip') AND target LIKE 'out/%'")
def orphans_plan(spark, sf_dir):
    planned = _planned(spark, sf_dir)
    return planning.orphans(_prior(planned), planned.where("action <> 'skip'"), _prior(planned))


@query(f"""
WITH {PRIOR_SQL}, existing AS (SELECT target FROM prior WHERE NOT regexp_matches(target, '3\\.')), artifacts AS (SELECT target FROM prior UNION ALL SELECT 'out/text/extra-' || doc_id || '.md' FROM planned WHERE doc_id % 60 = 0)
SELECT DISTINCT target FROM (SELECT target FROM prior WHERE rel NOT IN (SELECT rel FROM planned) UNION ALL SELECT target FROM artifacts WHERE target NOT IN (SELECT target FROM prior))
WHERE target IN (SELECT target FROM existing) OR target LIKE 'out/text/extra-%'
""")
def orphans_status(spark, sf_dir):
    planned = _planned(spark, sf_dir)
    prior = _prior(planned).select("rel", "target")
    extra = planned.where("doc_id % 60 = 0").select(F.concat(F.lit("out/text/extra-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("target"))
    existing = prior.where(~F.col("target").rlike(r"3\.")).select("target").union(extra)
    return planning.status_orphans(prior, prior.select("target").union(extra), planned.select("rel"), existing)


@query(f"""WITH {PRIOR_SQL}, known AS (SELECT 'root/' || rel || '.md' AS target FROM planned WHERE doc_id % 9 = 0 UNION ALL SELECT target FROM prior)
SELECT DISTINCT target FROM known WHERE target NOT IN (SELECT target FROM planned) AND NOT regexp_matches(target, '[37]\\.')""")
def stale_other_mode(spark, sf_dir):
    planned = _planned(spark, sf_dir)
    stale = planned.where("doc_id % 9 = 0").select(F.concat(F.lit("root/"), "rel", F.lit(".md")).alias("target"))
    known = stale.union(_prior(planned).select("target")).distinct()
    # Of everything that is or was there, files whose number ends in 3 or 7 are gone.
    there = known.union(planned.select("target")).where(~F.col("target").rlike(r"[37]\."))
    return planning.orphans(known, planned, there)


@query(f"WITH {PRIOR_SQL} SELECT rel FROM planned WHERE doc_id % 4 <> 0 AND target NOT IN (SELECT target FROM prior WHERE rel LIKE '%1.%')")
def artifact_exclusion(spark, sf_dir):
    """Files that look generated or are on record as artifacts are no sources."""
    planned = _planned(spark, sf_dir)
    known = _prior(planned).where("rel LIKE '%1.%'").select("target")
    items = planned.select("rel", F.col("target").alias("path"), (F.col("doc_id") % 4 == 0).alias("generated"))
    return planning.without_artifacts(items, known).select("rel")


@query(f"WITH {PRIOR_SQL} SELECT p.rel, coalesce(p.action IN ('extract', 'register') AND p.bytes = o.bytes AND o.version = '{PIPELINE_VERSION}' AND p.doc_id % 2 = 1, false) AS doubtful FROM planned p LEFT JOIN prior o USING (rel)")
def doubtful_files(spark, sf_dir):
    """Which files must be hashed to tell whether they changed: odd ones got another time."""
    planned = _planned(spark, sf_dir)
    items = planned.withColumn("mtime_ns", F.col("mtime_ns") + F.col("doc_id") % 2)
    return planning.doubtful(items, _prior(planned).drop("target"), DIGEST).select("rel", "doubtful")


@query(f"""WITH {PRIOR_SQL}, orphans AS (SELECT DISTINCT target, row_number() OVER (ORDER BY target) AS i FROM (SELECT DISTINCT target FROM prior)),
left_ AS (SELECT target FROM orphans WHERE target NOT IN (SELECT target FROM planned WHERE action = 'extract'))
SELECT target FROM left_ WHERE target NOT LIKE '%5.%'""")
def orphans_left(spark, sf_dir):
    """Orphans that this run neither wrote nor deleted."""
    planned = _planned(spark, sf_dir)
    known = _prior(planned).select("target").distinct()
    return planning.left_over(known, planned.where("action = 'extract'").select("target"), known.where("target LIKE '%5.%'"))


@query(f"WITH {PLAN_SQL} SELECT rel, row_number() OVER (ORDER BY rel) AS place FROM planned")
def plan_order(spark, sf_dir):
    """Places by rel over the whole plan: counts by range first, so that no task sorts everything."""
    return reports.placed(_planned(spark, sf_dir).select("rel"), "rel")


@query(f"WITH {FILES_SQL} SELECT rel, 'text/' || rel AS text_rel, '/m/text/' || rel AS back FROM files")
def relative_paths(spark, sf_dir):
    target = F.concat(F.lit("/m/text/"), "rel")
    found = _files(spark, sf_dir).select("rel", P.below(target, "/m").alias("text_rel"))
    return found.select("rel", "text_rel", P.joined("/m", F.col("text_rel")).alias("back"))


RECORDS_SQL = PRIOR_SQL + f""", quality AS (SELECT doc_id, status FROM ({QUALITY_SQL.replace('WITH ', 'WITH ')} SELECT * FROM q)),
records AS (SELECT p.rel, p.kind, p.doc_id, CASE WHEN p.action = 'skip' THEN 'skipped' WHEN p.action = 'register' THEN 'registered' WHEN p.doc_id % 97 = 0 THEN 'failed' ELSE q.status END AS status,
  p.reason AS skip_reason, CASE WHEN p.action = 'extract' AND p.doc_id % 97 = 0 THEN 'corrupt' END AS error, CASE WHEN p.warned THEN ['mismatch'] ELSE CAST([] AS VARCHAR[]) END AS warnings,
  CASE WHEN p.action <> 'skip' THEN p.target END AS text_rel, p.doc_id % 4 AS pages, p.doc_id % 6 = 0 AS has_math, p.doc_id % 10 = 0 AS has_tables, p.doc_id % 15 = 0 AS partial, p.bytes, p.action FROM planned p JOIN quality q USING (doc_id))"""


def _records(spark, sf_dir) -> DataFrame:
    planned, q = _planned(spark, sf_dir), _quality(spark, sf_dir).select("doc_id", F.col("status").alias("graded"), "chars", "median")
    extract = F.col("action") == "extract"
    status = F.when(F.col("action") == "skip", "skipped").when(F.col("action") == "register", "registered").when(F.col("doc_id") % 97 == 0, "failed").otherwise(F.col("graded"))
    every = lambda k: F.col("doc_id") % k == 0
    return planned.join(q, "doc_id").select(
        "rel", "kind", "doc_id", "bytes", "action", status.alias("status"), F.col("reason").alias("skip_reason"), F.when(extract & every(97), "corrupt").alias("error"), F.col("notes").alias("warnings"),
        F.when(F.col("action") != "skip", F.col("target")).alias("text_rel"), (F.col("doc_id") % 4).alias("pages"), every(6).alias("has_math"), every(10).alias("has_tables"), every(15).alias("partial"), "chars", F.col("median").alias("chars_per_page_median"),
    )


# The quality CTEs stand in a subquery of their own.
RECORDS = f"WITH {RECORDS_SQL}"


@query(f"{RECORDS} SELECT status, count(*) AS n FROM records GROUP BY status")
def records_union(spark, sf_dir):
    """Skip records from the plan, and the rest, brought together again."""
    records = _records(spark, sf_dir)
    skipped = planning.skip_records(_planned(spark, sf_dir))
    rest = records.where("action <> 'skip'").select("rel", "kind", "status", "skip_reason", "warnings")
    return reports.status_counts(skipped.unionByName(rest)).select("status", "n")


@query(f"WITH {PRIOR_SQL} SELECT DISTINCT target AS artifact FROM (SELECT target FROM planned WHERE action <> 'skip' UNION ALL SELECT target FROM prior)")
def artifacts_union(spark, sf_dir):
    planned = _planned(spark, sf_dir)
    return planned.where("action <> 'skip'").select("target").union(_prior(planned).select("target")).distinct().select(F.col("target").alias("artifact"))


@query(f"WITH {FILES_SQL} SELECT '/data/' || rel AS path, starts_with('/data/' || rel, '/data/src1') AND doc_id % 3 <> 0 AND (doc_id % 2 = 0 OR NOT ends_with(lower(rel), '.md')) AS deletable FROM files")
def prune_safe(spark, sf_dir):
    paths = _files(spark, sf_dir).select(F.concat(F.lit("/data/"), "rel").alias("path"), (F.col("doc_id") % 3 != 0).alias("exists"), (F.col("doc_id") % 2 == 0).alias("generated"))
    return planning.prunable(paths, ["/data/src1", *(f"/data/src1{i}" for i in range(10))]).select("path", "deletable")


# Reports

_ADVICE_SQL = "CASE status WHEN 'ok' THEN 'include' WHEN 'low' THEN 'not recommended' WHEN 'empty' THEN 'not recommended' WHEN 'garbled' THEN 'not recommended' WHEN 'failed' THEN 'unusable' WHEN 'skipped' THEN 'not processed' WHEN 'registered' THEN 'include (plain text)' ELSE status END"
_NOTE_SQL = "concat_ws('; ', skip_reason, error, CASE WHEN has_math THEN 'formulas may be distorted' END, CASE WHEN has_tables THEN 'tables' END, CASE WHEN partial THEN 'partial' END)"


@query(f"""{RECORDS} SELECT rel, {_ADVICE_SQL} AS advice, {_NOTE_SQL} AS note,
  '| `' || rel || '` | ' || CASE WHEN text_rel IS NULL THEN '-' ELSE '[text](' || text_rel || ')' END || ' | ' || kind || ' | ' || CASE WHEN pages > 0 THEN pages::VARCHAR ELSE '-' END || ' | ' || status || ' | ' || {_ADVICE_SQL} || ' | ' || {_NOTE_SQL} || ' |' AS row FROM records""")
def index_rows(spark, sf_dir):
    return reports.index_rows(_records(spark, sf_dir)).select("rel", "advice", "note", "row")


@query(f"{RECORDS} SELECT split_part(rel, '/', 1) AS top_dir, count(*) AS files, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("ok", "low", "empty", "garbled", "failed", "skipped", "registered", "unchanged")) + " FROM records GROUP BY 1")
def index_shards(spark, sf_dir):
    return reports.shard_counts(_records(spark, sf_dir))


@query(f"""{RECORDS}, r AS (SELECT status, rel, list_concat(list_filter([error, skip_reason], lambda x: x IS NOT NULL), warnings) AS reasons FROM records WHERE status IN ('low', 'empty', 'garbled', 'failed', 'skipped') OR len(warnings) > 0),
s AS (SELECT status, rel, CASE WHEN len(reasons) = 0 THEN ['no details'] ELSE reasons END AS reasons FROM r)
SELECT status, rel, generate_subscripts(reasons, 1) AS ord, unnest(reasons) AS reason FROM s""")
def warnings_rows(spark, sf_dir):
    return reports.warning_rows(_records(spark, sf_dir))


@query(f"""{RECORDS} SELECT split_part(rel, '/', 1) AS top_dir, md5(string_agg('| `' || rel || '` | ' || CASE WHEN text_rel IS NULL THEN '-' ELSE '[text](' || text_rel || ')' END || ' | ' || kind || ' | ' || CASE WHEN pages > 0 THEN pages::VARCHAR ELSE '-' END || ' | ' || status || ' | ' || {_ADVICE_SQL} || ' | ' || {_NOTE_SQL} || ' |', chr(10) ORDER BY rel)) AS rows_md5 FROM records GROUP BY 1""")
def index_sections(spark, sf_dir):
    """The rows of each directory's index, in order."""
    rows = reports.index_rows(_records(spark, sf_dir)).groupBy("top_dir").agg(F.array_sort(F.collect_list(F.struct("rel", "row"))).alias("rows"))
    return rows.select("top_dir", F.md5(F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("rows_md5"))


@query(f"{RECORDS} SELECT status, rel, row_number() OVER (PARTITION BY status ORDER BY rel) AS place FROM records WHERE status IN ('low', 'empty', 'garbled', 'failed', 'skipped') OR len(warnings) > 0")
def problem_order(spark, sf_dir):
    rows = reports.warning_rows(_records(spark, sf_dir)).select("status", "rel").distinct()
    return rows.select("status", "rel", F.row_number().over(Window.partitionBy("status").orderBy("rel")).cast("long").alias("place"))


def _yaml_sql(t: str) -> str:
    quoted = f"""'"' || replace(replace(replace({t}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"'"""
    return f"""CASE WHEN {t} = '' THEN '""' WHEN regexp_matches({t}, '[:#{{}}\\[\\]&*!|>%@`"''\\n]') OR {_stripped(t)} <> {t} THEN {quoted} ELSE {t} END"""


_SCALAR_SQL = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' ' || text WHEN 2 THEN text || ': \"x\"' WHEN 3 THEN 'a\\b#' || text WHEN 4 THEN split_part(text, chr(10), 1) ELSE text END"


@query(f"SELECT doc_id, md5(v) AS value_md5, md5({_yaml_sql('v')}) AS quoted_md5 FROM (SELECT doc_id, {_SCALAR_SQL} AS v FROM documents)")
def yaml_scalar(spark, sf_dir):
    m, t = F.col("doc_id") % 6, F.col("text")
    value = F.when(m == 0, "").when(m == 1, F.concat(F.lit(" "), t)).when(m == 2, F.concat(t, F.lit(': "x"'))).when(m == 3, F.concat(F.lit("a\\b#"), t)).when(m == 4, F.split_part(t, F.lit("\n"), F.lit(1))).otherwise(t)
    return _docs(spark, sf_dir).select("doc_id", value.alias("value")).select("doc_id", F.md5("value").alias("value_md5"), F.md5(X.yaml_scalar(F.col("value"))).alias("quoted_md5"))


FRONT_SQL = f"""concat_ws(chr(10), '---', 'schema_version: 1', 'source_rel: ' || {_yaml_sql('rel')}, 'bytes: ' || bytes, 'content_hash: ' || {_yaml_sql('content_hash')}, 'kind: ' || kind, 'pages: ' || pages, 'extractor: ""', 'text_layer: n/a',
  'chars: ' || chars, 'chars_per_page_median: ' || median, 'quality: ' || status, 'has_math: ' || has_math, 'has_tables: ' || has_tables, CASE WHEN partial THEN 'partial: true' END,
  'removed_running_heads: []', CASE WHEN len(warnings) = 0 THEN 'warnings: []' ELSE 'warnings:' || chr(10) || '  - mismatch' END, 'pipeline_version: 0.1.0', '---')"""
FULL_SQL = RECORDS + f", full_records AS (SELECT r.*, d.text, length(g.text) AS chars, {_nonspace('g.text')} AS median, 'sha2-256:' || sha256(d.text) AS content_hash FROM records r JOIN documents d USING (doc_id) JOIN (WITH {DAMAGED_SQL} SELECT * FROM damaged) g USING (doc_id))"


def _full(spark, sf_dir) -> DataFrame:
    texts = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("sha2-256:"), F.sha2("text", 256)).alias("content_hash"))
    empty = F.array().cast("array<string>")
    return _records(spark, sf_dir).join(texts, "doc_id").withColumns({"extractor": F.lit(""), "text_layer": F.lit("n/a"), "quality": F.lit(None).cast("string"), "removed_running_heads": empty})


@query(f"{FULL_SQL} SELECT doc_id, md5({FRONT_SQL}) AS front_md5 FROM full_records")
def front_matter(spark, sf_dir):
    records = _full(spark, sf_dir)
    return records.select("doc_id", F.md5(reports.front_matter(records)).alias("front_md5"))


@query(f"""{FULL_SQL} SELECT rel, md5({FRONT_SQL} || chr(10) || chr(10) || '# ' || split_part(rel, '/', 2) || chr(10) || chr(10) || '> Generated from `' || rel || '`, ' || CASE WHEN pages > 1 THEN 'pages 1–' || pages ELSE 'whole file' END || '.' || chr(10) || chr(10)
  || CASE WHEN len(warnings) > 0 THEN '> [!] mismatch' || chr(10) || chr(10) ELSE '' END || '## Page 1' || chr(10) || '<!-- page:1 -->' || chr(10) || chr(10) || CASE WHEN {_stripped('text')} = '' THEN '(no extractable text)' ELSE {_stripped('text')} END || chr(10)) AS text_md5 FROM full_records""")
def sidecar_hash(spark, sf_dir):
    records = _full(spark, sf_dir)
    pages = records.select("rel", "doc_id").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("rel", F.lit(1).alias("page_no"), F.lit("text").alias("source"), "text")
    return reports.sidecars(records, pages).select("rel", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, 'sha2-256:' || sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("sha2-256:"), F.sha2("text", 256)).alias("content_hash"))


@query(r"""
SELECT doc_id, doc_id % 3 = 0 AND doc_id % 2 = 0 AS is_generated FROM documents
""")
def generated_detect(spark, sf_dir):
    even, front = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    rel = F.when(even, F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".pdf.md"))).otherwise(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")))
    head = F.when(front, F.concat(F.lit("---\nkind: pdf\npipeline_version: 0.1.0\n---\n"), F.left("text", F.lit(50)))).otherwise(F.concat(F.lit("---\nkind: pdf\n---\npipeline_version: 1\n"), F.left("text", F.lit(50))))
    return _docs(spark, sf_dir).select("doc_id", P.is_generated(rel, head).alias("is_generated"))


@query(rf"""
WITH {FILES_SQL}, r AS (SELECT CASE WHEN doc_id % 12 = 0 THEN '.hidden/' || rel WHEN doc_id % 12 = 1 THEN 'node_modules/' || rel WHEN doc_id % 12 = 2 THEN 'build/' || rel ELSE rel END AS rel, doc_id FROM files)
SELECT rel, doc_id % 12 IN (0, 1) OR regexp_matches(rel, '^build/') OR (ends_with(rel, '.xlsx') AND NOT starts_with(rel, 'src3/')) AS ignored FROM r
""")
def ignore_match(spark, sf_dir):
    from folio.sources.ignore import IgnoreRules

    m, rel = F.col("doc_id") % 12, F.col("rel")
    rel = F.when(m == 0, F.concat(F.lit(".hidden/"), rel)).when(m == 1, F.concat(F.lit("node_modules/"), rel)).when(m == 2, F.concat(F.lit("build/"), rel)).otherwise(rel)
    from folio.schema import IGNORED_DIRS

    rules = IgnoreRules(["# generated", "/build/", "*.xlsx", "!src3/*.xlsx"])
    return _files(spark, sf_dir).select(rel.alias("rel")).select("rel", (P.dir_excluded(F.col("rel"), IGNORED_DIRS) | rules.column(F.col("rel"))).alias("ignored"))


# Geometry and tables

GEO_SQL = f"lines AS (SELECT doc_id AS page, line_no, line, round(line_no * 10 + (line_no % 3) * 0.25, 2) AS y0, (line_no * 37) % 5 AS x0 FROM ({LINES_SQL}) WHERE {_stripped('line')} <> '')"


def _elements(kind: str, **given: Column) -> Column:
    """An element with the given fields, the others null."""
    return F.struct(*[(F.lit(kind) if f.name == "kind" else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in ELEMENT])


@query(f"""
WITH {GEO_SQL}, kept AS (SELECT page, line, y0, x0::DOUBLE AS x0, line_no::BIGINT AS arrival FROM lines WHERE NOT (page % 2 = 0 AND y0 + 4 BETWEEN 35 AND 65)),
cells AS (SELECT page, unnest(['', '| a | b |', '|---|---|', '| ' || page || ' |  |', '']) AS line, unnest([35, 35, 35, 35, 65]) AS y0, unnest([1, 1, 1 + 1e-6, 1 + 2e-6, 1]) AS x0, unnest([1000000000, 1000000001, 1000000002, 1000000003, 1000000004]) AS arrival FROM (SELECT DISTINCT page FROM lines WHERE page % 2 = 0)),
every AS (SELECT * FROM kept UNION ALL SELECT * FROM cells)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY round(y0, 1), x0, arrival) AS ord, line AS text FROM every
""")
def reading_order(spark, sf_dir):
    lines = L.explode_lines(_docs(spark, sf_dir), ["doc_id"])
    y0, x0 = F.round(F.col("line_no") * 10 + (F.col("line_no") % 3) * 0.25, 2), (F.col("line_no") * 37) % 5
    line = _elements("line", text=F.col("text"), x0=x0, y0=y0, x1=x0 + 20, y1=y0 + 8)
    table = _elements("table", x0=F.lit(1.0), y0=F.lit(35.0), x1=F.lit(100.0), y1=F.lit(65.0), cells=F.array(F.array(F.lit(" a"), F.lit("b")), F.array(F.col("page").cast("string"))))
    pages = lines.groupBy(F.col("doc_id").alias("page")).agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("e")))).alias("ls"), F.bool_or(X.strip(F.col("text")) != "").alias("said"))
    elements = F.concat(F.transform("ls", lambda x: x["e"]), F.when((F.col("page") % 2 == 0) & F.col("said"), F.array(table)).otherwise(F.array().cast(f"array<{ELEMENT.simpleString()}>")))
    placed = pages.select("page", F.posexplode(geometry.placed_lines(elements)))
    return placed.select("page", (F.col("pos") + 1).cast("long").alias("ord"), "col.text")


@query(r"""
WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: string_split(trim(regexp_replace(l, '[\s]+', ' ', 'g')), ' ')) AS cells FROM documents),
w AS (SELECT doc_id, cells, list_max(list_transform(cells, lambda r: len(r))) AS width FROM t),
p AS (SELECT doc_id, width, list_transform(cells, lambda r: '| ' || array_to_string(list_resize(r, width, ''), ' | ') || ' |') AS rows, len(list_filter(flatten(cells), lambda c: trim(c) <> '')) AS filled, len(flatten(cells)) AS n, len(cells) AS height FROM w)
SELECT doc_id, height >= 2 AND width >= 2 AND filled / nullif(n, 0)::DOUBLE > 0.5 AS accepted, CASE WHEN width >= 2 THEN md5(rows[1] || chr(10) || '|' || repeat('---|', width) || CASE WHEN height > 1 THEN chr(10) || array_to_string(rows[2:], chr(10)) ELSE '' END) END AS markdown_md5 FROM p
""")
def table_markdown(spark, sf_dir):
    cells = geometry.squeezed_cells(F.transform(F.split("text", "\n"), lambda r: F.split(F.trim(F.regexp_replace(r, r"\s+", " ")), " ")))
    tables = _docs(spark, sf_dir).select("doc_id", cells.alias("cells"))
    return tables.select("doc_id", geometry.table_accepted(F.col("cells")).alias("accepted"), F.md5(F.array_join(geometry.table_rows(F.col("cells")), "\n")).alias("markdown_md5"))


@query(f"""
WITH w AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY CASE WHEN i % 4 = 0 THEN 1099511627776 ELSE i * 31 % 7 END, CASE WHEN i % 4 = 0 THEN 0 ELSE i * 13 % 5 END, i)) AS order_md5 FROM w GROUP BY doc_id
""")
def shape_order(spark, sf_dir):
    n = lambda i: (i + 1).cast("long")
    shapes = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.when(n(i) % 4 != 0, n(i) * 31 % 7).alias("top"), F.when(n(i) % 4 != 0, n(i) * 13 % 5).alias("left"), t.alias("text")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(F.transform(geometry.in_shape_order(shapes), lambda x: x["text"]), "\n")).alias("order_md5"))


@query(r"""
WITH s AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Heading ' || (doc_id % 9 + 1) WHEN 1 THEN 'Title' WHEN 2 THEN '标题 ' || (doc_id % 9 + 1) WHEN 3 THEN '标题' WHEN 4 THEN 'Normal' WHEN 5 THEN 'heading' ELSE 'HEADING 2' END AS style FROM documents)
SELECT doc_id, style, CASE WHEN doc_id % 7 IN (0, 2) THEN least(doc_id % 9 + 1, 6) WHEN doc_id % 7 IN (1, 3) THEN 1 WHEN doc_id % 7 = 6 THEN 2 END AS level FROM s
""")
def heading_levels(spark, sf_dir):
    n, m = (F.col("doc_id") % 9 + 1).cast("string"), F.col("doc_id") % 7
    style = F.when(m == 0, F.concat(F.lit("Heading "), n)).when(m == 1, "Title").when(m == 2, F.concat(F.lit("标题 "), n)).when(m == 3, "标题").when(m == 4, "Normal").when(m == 5, "heading").otherwise("HEADING 2")
    return _docs(spark, sf_dir).select("doc_id", style.alias("style")).select("doc_id", "style", geometry.heading_level(F.col("style")).cast("long").alias("level"))


@query(r"""
WITH i AS (SELECT doc_id AS page, (doc_id * k) % 500 - 50 AS x0, (doc_id * k * 7) % 700 - 50 AS y0, 40 + (doc_id * k) % 450 AS w, 30 + (doc_id + k) % 600 AS h FROM documents, generate_series(1, 3) t(k)),
c AS (SELECT page, greatest(0, least(600, x0 + w) - greatest(0, x0)) * greatest(0, least(800, y0 + h) - greatest(0, y0)) AS area FROM i)
SELECT page, sum(area)::BIGINT AS covered, least(sum(area)::DOUBLE / 480000::DOUBLE, 1::DOUBLE) AS ratio, sum(area)::DOUBLE / 480000::DOUBLE > 0.6::DOUBLE AS heavy FROM c GROUP BY page
""")
def image_coverage(spark, sf_dir):
    k = lambda k: F.col("page") * k
    box = lambda n: (k(n) % 500 - 50, k(7 * n) % 700 - 50, 40 + k(n) % 450, 30 + (F.col("page") + n) % 600)
    images = F.array(*[_elements("image", x0=x, y0=y, x1=x + w, y1=y + h) for x, y, w, h in map(box, (1, 2, 3))])
    side = lambda a, b, most: F.greatest(F.lit(0), F.least(F.lit(most), b) - F.greatest(F.lit(0), a))
    covered = sum((side(x, x + w, 600) * side(y, y + h, 800) for x, y, w, h in map(box, (1, 2, 3))), F.lit(0).cast("long"))
    pages = _docs(spark, sf_dir).select(F.col("doc_id").alias("page")).withColumn("ratio", geometry.image_coverage(images, F.lit(600.0), F.lit(800.0)))
    return pages.select("page", covered.alias("covered"), "ratio", geometry.heavy(F.col("ratio")).alias("heavy"))


@query(f"""{RECORDS} SELECT count(*) AS files, count(*) FILTER (text_rel IS NOT NULL AND action = 'extract') AS written, (SELECT count(DISTINCT target) FROM prior WHERE target NOT IN (SELECT target FROM planned WHERE action <> 'skip')) AS orphans,
  count(*) FILTER (status = 'failed') AS failed, bool_or(status = 'failed') AS any_failed FROM records""")
def run_summary(spark, sf_dir):
    return reports.run_summary(_records(spark, sf_dir), F.col("text_rel").isNotNull() & (F.col("action") == "extract"), orphans_plan(spark, sf_dir))


@query(f"WITH {PRIOR_SQL} SELECT DISTINCT target FROM prior WHERE target NOT IN (SELECT target FROM planned WHERE action <> 'skip') ORDER BY target LIMIT 20")
def top_orphans(spark, sf_dir):
    return reports.first_orphans(orphans_plan(spark, sf_dir))


@query(f"{RECORDS} SELECT rel, row_number() OVER (PARTITION BY split_part(rel, '/', 1) ORDER BY rel) AS ordinal FROM records")
def progress_ordinal(spark, sf_dir):
    return reports.progress(_records(spark, sf_dir))


# Containers


def _through(docs: DataFrame, made: Callable[[int, str], bytes], read: Callable[[BinaryIO], object], kind: pa.DataType, schema: str) -> DataFrame:
    """(doc_id, found): what is read from a container that is made of every document, in memory."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [read(io.BytesIO(made(doc_id, text or ""))) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, found {schema}")


def _extracted(docs: DataFrame, made: Callable[[int, str], bytes], kind: Callable[[int], str]) -> DataFrame:
    """(doc_id, document): containers of the documents through the extractors and the rules, as a build has them."""
    from folio.sources import extract

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [extract.extract_one(kind(i), io.BytesIO(made(i, text or "")), extract._EXTRACTORS) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, to_arrow_type(PARSED))], names=["doc_id", "found"])

    parsed = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, found {PARSED.simpleString()}")
    return parsed.select("doc_id", geometry.assembled(F.col("found")).alias("document"))


def _lines_of(document: Column) -> Column:
    return F.array_join(F.flatten(F.transform(document["pages"], lambda p: F.transform(p["lines"], lambda line: line["text"]))), "\n")


KEPT_LINES_SQL = f"SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM (SELECT doc_id, line_no, {_squeezed('line')} AS line FROM ({LINES_SQL})) WHERE line <> ''"


@query(f"""
WITH l AS ({KEPT_LINES_SQL}), t AS (SELECT doc_id, string_agg('<!-- para:' || n || ' -->' || chr(10) || line || chr(10), chr(10) ORDER BY n) AS text FROM l GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(t.text, '')) AS text_md5 FROM documents d LEFT JOIN t USING (doc_id)
""")
def docx_extract(spark, sf_dir):
    from folio.sources import ooxml

    found = _extracted(_docs(spark, sf_dir), lambda _, text: ooxml.docx_bytes(text.split("\n")), lambda _: "docx")
    return found.select("doc_id", F.md5(_lines_of(F.col("document"))).alias("text_md5"))


@query(f"""
WITH l AS ({KEPT_LINES_SQL}), f AS (SELECT doc_id, min_by(line, n) AS line FROM l GROUP BY doc_id)
SELECT d.doc_id, md5(CASE WHEN f.line IS NULL THEN '' ELSE '<!-- para:1 -->' || chr(10) || repeat('#', (d.doc_id % 4 + 2)::INT) || ' ' || f.line || chr(10) || chr(10) END
  || CASE WHEN d.doc_id % 3 = 0 THEN 'alone' || chr(10) || chr(10) ELSE '' END || '<!-- para:' || CASE WHEN f.line IS NULL THEN 1 ELSE 2 END || ' -->' || chr(10) || '| n | {{}} |' || chr(10) || '|---|---|' || chr(10) || '| ' || d.doc_id || ' |  |' || chr(10)) AS text_md5,
  true AS has_tables, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_warnings FROM documents d LEFT JOIN f USING (doc_id)
""")
def docx_tables(spark, sf_dir):
    """A heading by style, a table of one column in every third file, and a ragged table."""
    from folio.sources import ooxml

    def made(i: int, text: str) -> bytes:
        first = next((x for x in text.split("\n") if x.strip()), "")
        return ooxml.docx_bytes([first], style=f"heading {i % 4 + 1}", tables=[*([[["alone"]]] if i % 3 == 0 else []), [["n", "{}"], [str(i)]]])

    found = _extracted(_docs(spark, sf_dir), made, lambda _: "docx")
    return found.select("doc_id", F.md5(_lines_of(F.col("document"))).alias("text_md5"), "document.has_tables", F.size("document.warnings").cast("long").alias("n_warnings"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'no_extractor' WHEN 2 THEN 'corrupt' END AS reason, doc_id % 4 = 3 AS needs_ocr FROM documents")
def extract_failures(spark, sf_dir):
    """Broken containers and kinds without an extractor become documents with a reason; an image is a page that needs OCR."""
    found = _extracted(_docs(spark, sf_dir), lambda i, text: b"PK\x03\x04" + text.encode(), lambda i: ("docx", "plaintext", "pptx", "image")[i % 4])
    return found.select("doc_id", "document.reason", (F.size("document.pages_needing_ocr") > 0).alias("needs_ocr"))


@query(f"""
WITH l AS ({KEPT_LINES_SQL}), t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM l GROUP BY doc_id)
SELECT d.doc_id, md5('Document ' || d.doc_id || chr(10) || CASE WHEN t.text IS NULL THEN '' ELSE chr(10) || t.text || chr(10) END) AS text_md5 FROM documents d LEFT JOIN t USING (doc_id)
""")
def pptx_extract(spark, sf_dir):
    from folio.sources import ooxml

    found = _extracted(_docs(spark, sf_dir), lambda i, text: ooxml.pptx_bytes(f"Document {i}", text.split("\n")), lambda _: "pptx")
    return found.select("doc_id", F.md5(_lines_of(F.col("document"))).alias("text_md5"))


@query(f"SELECT doc_id, CASE WHEN n < 30 THEN 'none' WHEN n >= 200 THEN 'rich' ELSE 'sparse' END AS layer, n < 30 AS needs_ocr FROM (SELECT doc_id, {_nonspace('text')} + length('Document') + length(doc_id::VARCHAR) AS n FROM documents)")
def pptx_layer(spark, sf_dir):
    from folio.sources import ooxml

    found = _extracted(_docs(spark, sf_dir), lambda i, text: ooxml.pptx_bytes(f"Document {i}", text.split("\n")), lambda _: "pptx")
    return found.select("doc_id", F.col("document.text_layer").alias("layer"), (F.size("document.pages_needing_ocr") > 0).alias("needs_ocr"))


@query("SELECT list_extract(['docx', 'pptx', 'unsupported', 'unknown'], (doc_id % 4 + 1)::INT) AS kind, count(*) AS n FROM documents GROUP BY 1")
def ooxml_kind(spark, sf_dir):
    from folio.sources import files, ooxml

    made = lambda i, text: (ooxml.docx_bytes([text]), ooxml.pptx_bytes("t", [text]), ooxml.xlsx_bytes(), b"PK\x03\x04 no archive" + text.encode())[i % 4]
    return _through(_docs(spark, sf_dir), made, files.archive_kind, pa.string(), "string").groupBy(F.col("found").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def fit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents are unwrapped and cleaned, graded, planned as files and listed with advice."""
    docs = _docs(spark, sf_dir)
    graded = quality.assess(L.normalise_pages(docs, ["doc_id"]).withColumn("page_no", F.lit(1)), docs, doc="doc_id")
    items = _planned(spark, sf_dir).join(graded, "doc_id")
    status = F.when(F.col("action") == "skip", "skipped").when(F.col("action") == "register", "registered").otherwise(F.col("status"))
    return items.select("rel", "kind", status.alias("status"), reports.advice(status).alias("advice"), "chars", "nonspace", F.coalesce("reason", F.array_join("reasons", ", ")).alias("reason"))
