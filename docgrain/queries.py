"""Driver queries of the document engine, each with SQL for DuckDB where SQL can say it.

``documents`` holds no Markdown, so the queries derive a corpus from it, line by line: headings, a
fence with a heading look-alike, tables, lists with inline code, and prose (see ``corpus``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import spans, text as tx
from .operators import blocks, glossary, jobs, merge, outline, parts
from .plans import requests, transform
from .ship import ensure_shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NL = "\n"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece(line: Column, i: Column) -> Column:
    """What line ``i`` of a document becomes in the derived corpus."""
    kind = i % 6
    marks = F.repeat(F.lit("#"), 1 + F.floor(i / 6).cast("int") % 3)
    cell = F.replace(line, F.lit("|"), F.lit("/"))
    n = i.cast("string")
    return (
        F.when(kind == 0, F.concat(marks, F.lit(" "), line, F.lit("\n\n")))
        .when(kind == 2, F.concat(F.lit("```txt\n"), line, F.lit("\n# not a heading\n```\n\n")))
        .when(kind == 3, F.concat(F.lit("| n | text |\n| --- | --- |\n| "), n, F.lit(" | "), cell, F.lit(" |\n\n")))
        .when(kind == 4, F.concat(F.lit("- "), line, F.lit("\n- see `id_"), n, F.lit("`\n\n\n")))
        .otherwise(F.concat(line, F.lit("\n\n")))
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text, lang, source."""
    docs = read(spark, sf_dir, "documents")
    text = F.concat_ws("", F.transform(F.split("text", "\n", -1), piece))
    path = F.concat(F.lit("/corpus/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), text.alias("text"), "lang", "source")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.with_blocks(corpus(spark, sf_dir))


CORPUS = """
WITH RECURSIVE lines0 AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i
  FROM documents
), blk0 AS (
  SELECT doc_id, lang, source, i AS block_idx, max(i) OVER (PARTITION BY doc_id) AS last_i,
    CASE i % 6 WHEN 0 THEN 'heading' WHEN 2 THEN 'code' WHEN 3 THEN 'table' WHEN 4 THEN 'list' ELSE 'prose' END AS kind,
    CAST(CASE WHEN i % 6 = 0 THEN 1 + (i // 6) % 3 ELSE 0 END AS INTEGER) AS level,
    CASE i % 6
      WHEN 0 THEN repeat('#', 1 + (i // 6) % 3) || ' ' || line
      WHEN 2 THEN '```txt' || chr(10) || line || chr(10) || '# not a heading' || chr(10) || '```'
      WHEN 3 THEN '| n | text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || i || ' | ' || replace(line, '|', '/') || ' |'
      WHEN 4 THEN '- ' || line || chr(10) || '- see `id_' || i || '`'
      ELSE line END AS text
  FROM lines0
), blk AS (
  SELECT doc_id, lang, source, block_idx, kind, level, CAST(CASE WHEN block_idx = last_i THEN 0 WHEN kind = 'list' THEN 2 ELSE 1 END AS INTEGER) AS gap,
    text, CAST(strlen(text) AS INTEGER) AS n_bytes, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n_newlines
  FROM blk0
), corpus AS (
  SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, '/corpus/doc-' || doc_id || '.md' AS path,
    string_agg(text || repeat(chr(10), CASE WHEN kind = 'list' THEN 3 ELSE 2 END), '' ORDER BY block_idx) AS text
  FROM blk GROUP BY doc_id
), canon AS (
  SELECT doc_id, string_agg(text || repeat(chr(10), gap + 1), '' ORDER BY block_idx) AS text FROM blk GROUP BY doc_id
)
"""

GROUPS = CORPUS + """, g0 AS (
  SELECT *, CASE WHEN lag(gap) OVER w <> 0 AND lag(kind) OVER w <> 'heading' THEN 1 ELSE 0 END AS fresh
  FROM blk WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)
), g1 AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY block_idx) AS INTEGER) AS group_idx FROM g0
), grp AS (
  SELECT doc_id, group_idx, CAST(min(block_idx) AS INTEGER) AS block_from, CAST(max(block_idx) + 1 AS INTEGER) AS block_to,
    CAST(sum(n_bytes + gap + 1) - arg_max(gap + 1, block_idx) AS INTEGER) AS size,
    arg_min(kind, block_idx) = 'heading' AS heading, CAST(arg_min(level, block_idx) AS INTEGER) AS level
  FROM g1 GROUP BY doc_id, group_idx
)
"""


def parts_sql(size: int) -> str:
    """Parts of ``size`` bytes: a step machine over groups, with the pull-back to the last heading passed."""
    return GROUPS + f""", gl AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n, list(size ORDER BY group_idx) AS sz, list(heading ORDER BY group_idx) AS hd,
    list(level ORDER BY group_idx) AS lv, list(block_from ORDER BY group_idx) AS bf, list(block_to ORDER BY group_idx) AS bt
  FROM grp GROUP BY doc_id
), walk AS (
  SELECT doc_id, 0 AS start, 0 AS i, 0 AS cur, -1 AS lasth, 0 AS lenh, -1 AS cut_from, -1 AS cut_to FROM gl
  UNION ALL
  SELECT doc_id,
    CASE WHEN act = 'take' THEN start ELSE stop END, CASE WHEN act = 'take' THEN i + 1 ELSE stop END,
    CASE WHEN act = 'take' THEN cur + CASE WHEN i > start THEN 2 ELSE 0 END + s ELSE 0 END,
    CASE WHEN act = 'take' AND i > start AND h THEN i WHEN act = 'take' THEN lasth ELSE -1 END,
    CASE WHEN act = 'take' AND i > start AND h THEN cur WHEN act = 'take' THEN lenh ELSE 0 END,
    CASE WHEN act = 'take' THEN -1 ELSE start END, CASE WHEN act = 'take' THEN -1 ELSE stop END
  FROM (
    SELECT *, CASE WHEN act <> 'size' OR h OR lasth <= start OR lenh < {size} // 4 THEN i ELSE lasth END AS stop FROM (
      SELECT w.*, gl.sz[i + 1] AS s, gl.hd[i + 1] AS h,
        CASE WHEN i >= n THEN 'end'
             WHEN i > start AND gl.hd[i + 1] AND cur >= CASE WHEN gl.lv[i + 1] <= 2 THEN {size} // 4 ELSE {size} // 2 END THEN 'head'
             WHEN i > start AND cur + 2 + gl.sz[i + 1] > {size} THEN 'size' ELSE 'take' END AS act
      FROM walk w JOIN gl ON gl.doc_id = w.doc_id WHERE start < n
    )
  )
), cut AS (
  SELECT w.doc_id, CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY cut_from) AS INTEGER) AS part,
    bf[cut_from + 1] AS b0, bt[cut_to] AS b1
  FROM walk w JOIN gl ON gl.doc_id = w.doc_id WHERE cut_from >= 0
), part AS (
  SELECT c.doc_id, part, count(*) OVER (PARTITION BY c.doc_id) AS n_parts, text, CAST(strlen(text) AS INTEGER) AS n_bytes, gap_after, heading
  FROM (
    SELECT c.doc_id, c.part,
      string_agg(b.text || CASE WHEN b.block_idx + 1 < c.b1 THEN repeat(chr(10), b.gap + 1) ELSE '' END, '' ORDER BY b.block_idx) AS text,
      arg_max(CASE WHEN block_idx = (SELECT max(block_idx) FROM blk x WHERE x.doc_id = b.doc_id) THEN NULL ELSE gap END, block_idx) AS gap0,
      coalesce(arg_min(CASE WHEN kind = 'heading' THEN rtrim(text) WHEN kind = 'code' THEN '# not a heading' END, block_idx)
               FILTER (kind IN ('heading', 'code')), '') AS heading,
      max(b.block_idx) AS last_b
    FROM cut c JOIN blk b ON b.doc_id = c.doc_id AND b.block_idx >= c.b0 AND b.block_idx < c.b1 GROUP BY c.doc_id, c.part, b.doc_id
  ) c LEFT JOIN (SELECT doc_id AS d2, block_idx AS i2, CASE WHEN block_idx = max(block_idx) OVER (PARTITION BY doc_id) THEN NULL ELSE gap END AS gap_after FROM blk) z
    ON z.d2 = c.doc_id AND z.i2 = c.last_b
)
"""


@query("""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS n_blank,
  CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_runes
FROM (SELECT doc_id, text, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents)""")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.lines(F.col("text"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(rows).cast("long").alias("n_lines"),
        F.size(F.filter(rows, lambda x: x == "")).cast("long").alias("n_blank"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.char_length("text").cast("long").alias("n_runes"),
    )


@query(CORPUS + """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM corpus)
SELECT doc_id, count(*) FILTER (regexp_matches(x, '^[ \\t]*(`{3,}|~{3,})')) AS fences,
  count(*) FILTER (regexp_matches(x, '^ {0,3}#{1,6}(\\s|$)')) AS headings,
  count(*) FILTER (regexp_matches(x, '^[ \\t]*\\|.*\\|[ \\t]*$')) AS rows_,
  count(*) FILTER (regexp_matches(x, '^[ \\t]*(?:[-*+]|\\d{1,9}[.)])(\\s|$)')) AS items,
  count(*) FILTER (x = '') AS blanks, count(*) FILTER (regexp_matches(x, '^[ \\t]')) AS indented,
  CAST(sum(length(CASE WHEN regexp_matches(x, '^ {0,3}#{1,6}(\\s|$)') THEN trim(ltrim(trim(x), '#')) ELSE '' END)) AS BIGINT) AS title_chars,
  CAST(sum(length(regexp_replace(x, '`+[^`]*`+', '', 'g'))) AS BIGINT) AS plain_chars
FROM l GROUP BY doc_id""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("x"))
    x = F.col("x")
    return rows.groupBy("doc_id").agg(
        F.count_if(tx.fence_marker(x) != "").alias("fences"), F.count_if(tx.heading_level(x) > 0).alias("headings"),
        F.count_if(tx.is_table_row(x)).alias("rows_"), F.count_if(tx.is_list_item(x)).alias("items"),
        F.count_if(tx.is_blank(x)).alias("blanks"), F.count_if(tx.is_indented(x)).alias("indented"),
        F.sum(F.when(tx.heading_level(x) > 0, F.length(tx.heading_title(x))).otherwise(0)).alias("title_chars"),
        F.sum(F.length(tx.strip_inline(x))).alias("plain_chars"),
    )


@query("""WITH p AS (SELECT page_id, '<div class="a">' || html || '</section>' AS x FROM pages),
s AS (SELECT page_id, x, regexp_replace(regexp_replace(x, '`+[^`]*`+', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS y FROM p),
t AS (SELECT page_id, x, y, list_filter(regexp_extract_all(y, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>'), lambda g: regexp_matches(g,
 '(?i)^</?(?:div|p|table|section|article|main|aside|header|footer|nav|details|figure|form|ul|ol|blockquote|pre|h1|h2|h3|h4|h5|h6)[^a-zA-Z0-9]')) AS g FROM s)
SELECT page_id, CAST(len(list_filter(g, lambda q: NOT starts_with(q, '</') AND NOT ends_with(q, '/>'))) - len(list_filter(g, lambda q: starts_with(q, '</'))) AS BIGINT) AS balance,
  regexp_matches(x, '^ {0,3}<[a-zA-Z/]') AND len(list_filter(g, lambda q: NOT starts_with(q, '</') AND NOT ends_with(q, '/>'))) > len(list_filter(g, lambda q: starts_with(q, '</'))) AS opens,
  contains(lower(y), '<pre') OR contains(lower(y), '<code') AS verbatim
FROM t""")
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit('<div class="a">'), F.col("html"), F.lit("</section>"))
    return read(spark, sf_dir, "pages").select(
        "page_id", tx.html_balance(x).cast("long").alias("balance"), tx.opens_html(x).alias("opens"),
        tx.opens_verbatim(x).alias("verbatim"),
    )


@query(CORPUS + """, d AS (SELECT doc_id, chr(10) || '  ' || chr(10) || replace(text, '.' || chr(10), '. ' || chr(10)) || '  ' || chr(10) || chr(10) || chr(10) AS t FROM corpus),
c AS (SELECT doc_id, t, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END), chr(10)), '^\\n+|\\n+$', '', 'g') AS b FROM d)
SELECT doc_id, md5(CASE WHEN b = '' THEN '' ELSE b || chr(10) END) AS canonical,
  md5(regexp_replace(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '[ \\t\\r]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') || chr(10)) AS normalized
FROM c""")
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("\n  \n"), F.replace("text", F.lit(".\n"), F.lit(". \n")), F.lit("  \n\n\n"))
    return corpus(spark, sf_dir).select(
        "doc_id", F.md5(tx.canonical(t)).alias("canonical"), F.md5(tx.normalized(t)).alias("normalized")
    )


@query(CORPUS + """SELECT doc_id, block_idx, kind, level, gap, md5(text) AS body, n_bytes, n_newlines,
  CAST(1 + coalesce(sum(n_newlines + 1 + gap) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line
FROM blk""")
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.block_rows(parsed(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "block_idx", "kind", "level", "gap", F.md5("text").alias("body"), "n_bytes", "n_newlines", "line")


@query(CORPUS + """SELECT kind, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(DISTINCT doc_id) AS docs FROM blk GROUP BY kind""")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.block_rows(parsed(spark, sf_dir), ["doc_id"])
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), F.count_distinct("doc_id").alias("docs")
    )


@query()
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; without SQL, which can't run the parser's automaton over lines (tested by brute force)."""
    rows = blocks.block_rows(blocks.with_blocks(read(spark, sf_dir, "pages"), "html"), ["page_id"])
    return rows.select("page_id", "block_idx", "kind", "level", "gap", F.md5("text").alias("body"), "n_bytes", "n_newlines", "line")


@query("""WITH p AS (SELECT page_id, replace(html, chr(10), ' ') AS x FROM pages),
s AS (SELECT page_id, x, regexp_replace(regexp_replace(x, '`+[^`]*`+', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS y FROM p),
t AS (SELECT page_id, x, list_filter(regexp_extract_all(y, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>'), lambda g: regexp_matches(g,
 '(?i)^</?(?:div|p|table|section|article|main|aside|header|footer|nav|details|figure|form|ul|ol|blockquote|pre|h1|h2|h3|h4|h5|h6)[^a-zA-Z0-9]')) AS g FROM s),
u AS (SELECT page_id, '<div>' || chr(10) || x AS two, CAST(len(list_filter(g, lambda q: NOT starts_with(q, '</') AND NOT ends_with(q, '/>')))
  - len(list_filter(g, lambda q: starts_with(q, '</'))) AS BIGINT) AS b FROM t),
r AS (SELECT page_id, CASE WHEN b < 0 THEN [two, '</div>', 'after'] WHEN b = 0 THEN [two || chr(10) || '</div>', 'after']
  ELSE [two || chr(10) || '</div>' || chr(10) || chr(10) || 'after'] END AS l FROM u)
SELECT page_id, CAST(i - 1 AS INTEGER) AS block_idx, CASE WHEN i = 1 THEN 'html' ELSE 'prose' END AS kind, md5(l[i]) AS body,
 CAST(CASE WHEN i = len(l) - 1 THEN 1 ELSE 0 END AS INTEGER) AS gap FROM r, unnest(generate_series(1, len(l))) AS s(i)""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page on one line inside a block of its own: where the block ends tells what the page leaves open."""
    x = F.concat(F.lit("<div>\n"), F.replace("html", F.lit("\n"), F.lit(" ")), F.lit("\n</div>\n\nafter\n"))
    rows = blocks.block_rows(blocks.with_blocks(read(spark, sf_dir, "pages").select("page_id", x.alias("x")), "x"), ["page_id"])
    return rows.select("page_id", "block_idx", "kind", F.md5("text").alias("body"), "gap")


@query(GROUPS + """SELECT doc_id, group_idx, block_from, block_to, size, heading, level FROM grp""")
def group_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.group_rows(parsed(spark, sf_dir), ["doc_id"]).drop("atomic")


@query(GROUPS + """SELECT doc_id, group_idx, block_from, block_to, size, heading, level FROM grp""")
def group_blocks_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.with_groups(parsed(spark, sf_dir)).select("doc_id", F.posexplode("groups").alias("group_idx", "g"))
    return rows.select("doc_id", "group_idx", "g.*").drop("atomic")


def _split(size: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parts.split(corpus(spark, sf_dir), size)
        return rows.select("doc_id", "part", F.col("n_parts").cast("long").alias("n_parts"), F.md5("text").alias("body"),
                           "n_bytes", "gap_after", "heading", "oversize")

    run.__name__ = f"split_{size}"
    return query(parts_sql(size) + f"SELECT doc_id, part, n_parts, md5(text) AS body, n_bytes, gap_after, heading, n_bytes > {size} AS oversize FROM part")(run)


for _size in (300, 1000, 4000, 8000):
    _split(_size)


@query(parts_sql(1000) + """SELECT doc_id, count(*) AS parts, CAST(min(n_bytes) AS INTEGER) AS smallest, CAST(max(n_bytes) AS INTEGER) AS largest,
 CAST(sum(n_bytes) AS BIGINT) AS total, CAST(sum(n_bytes) // count(*) AS BIGINT) AS average FROM part GROUP BY doc_id""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.split(corpus(spark, sf_dir), 1000)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("parts"), F.min("n_bytes").alias("smallest"), F.max("n_bytes").alias("largest"),
        F.sum("n_bytes").alias("total"), F.floor(F.sum("n_bytes") / F.count(F.lit(1))).alias("average"),
    )


@query(parts_sql(1000) + """SELECT p.doc_id, max(n_parts) AS n_parts, md5(any_value(c.text)) AS merged, 'byte-exact' AS verdict
FROM part p JOIN canon c ON c.doc_id = p.doc_id GROUP BY p.doc_id""")
def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = parts.with_parts(parsed(spark, sf_dir), 1000)
    merged = packed.withColumn("merged", merge.join_parts(parts.texts_of()))
    return merged.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.md5("merged").alias("merged"),
                         merge.roundtrip_verdict(F.col("text"), F.col("merged")).alias("verdict"))


OUTLINE = CORPUS + """, pos AS (
  SELECT *, coalesce(sum(n_bytes + gap + 1) OVER w, 0) AS before, CAST(1 + coalesce(sum(n_newlines + 1 + gap) OVER w, 0) AS INTEGER) AS line,
    max(block_idx) OVER (PARTITION BY doc_id) + 1 AS n FROM blk
  WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, trim(ltrim(trim(text), '#')) AS title FROM pos WHERE kind = 'heading'
), e AS (
  SELECT h.*, coalesce((SELECT min(x.block_idx) FROM h x WHERE x.doc_id = h.doc_id AND x.block_idx > h.block_idx AND x.level <= h.level), n) AS end_idx,
    (SELECT max(x.block_idx) FROM h x WHERE x.doc_id = h.doc_id AND x.block_idx < h.block_idx AND x.level <= 1) AS a1,
    (SELECT max(x.block_idx) FROM h x WHERE x.doc_id = h.doc_id AND x.block_idx < h.block_idx AND x.level <= 2) AS a2 FROM h
), topic AS (
  SELECT e.doc_id, e.block_idx, CAST(e.end_idx AS INTEGER) AS end_idx, e.level, e.title, e.line,
    concat_ws(' > ', CASE WHEN e.level > 1 AND p1.level = 1 THEN p1.title END, CASE WHEN e.level > 2 AND p2.level = 2 THEN p2.title END, e.title) AS path,
    CAST(z.before + z.n_bytes - e.before AS BIGINT) AS chars
  FROM e LEFT JOIN h p1 ON p1.doc_id = e.doc_id AND p1.block_idx = e.a1 LEFT JOIN h p2 ON p2.doc_id = e.doc_id AND p2.block_idx = e.a2
  JOIN pos z ON z.doc_id = e.doc_id AND z.block_idx = e.end_idx - 1
)
"""


@query(OUTLINE + "SELECT doc_id, block_idx, end_idx, level, title, path, line, chars, printf('%5d %7d  %s%s', line, chars, repeat('  ', level - 1), title) AS rendered FROM topic")
def outline_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.outline_text(outline.topics(parsed(spark, sf_dir), ["doc_id"]))


@query(OUTLINE + """, asked AS (
  SELECT doc_id, replace(path, 'e', 'E') || ' ' AS address FROM topic WHERE block_idx = 6 UNION SELECT doc_id, title FROM topic WHERE block_idx = 0
  UNION SELECT doc_id, 'the' FROM topic WHERE block_idx = 0 UNION SELECT doc_id, ' ' FROM topic WHERE block_idx = 0
), m AS (
  SELECT a.doc_id, a.address, t.block_idx, t.end_idx, t.path, CASE WHEN trim(a.address) = '' THEN 4 WHEN lower(t.path) = lower(trim(a.address)) THEN 1
    WHEN lower(t.title) = lower(trim(a.address)) THEN 2 WHEN contains(lower(t.title), lower(trim(a.address))) THEN 3 ELSE 4 END AS r
  FROM asked a JOIN topic t ON t.doc_id = a.doc_id
), b AS (SELECT doc_id, address, min(r) AS best FROM m GROUP BY ALL),
k AS (SELECT b.doc_id, b.address, best, count(*) AS n, string_agg(path, '|' ORDER BY block_idx) AS paths,
        string_agg(path, '|' ORDER BY block_idx) FILTER (rn <= 8) AS first8, min(block_idx) AS b0, min(end_idx) AS b1
      FROM b JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, address, r ORDER BY block_idx) AS rn FROM m) m
        ON m.doc_id = b.doc_id AND m.address = b.address AND m.r = b.best GROUP BY ALL)
SELECT k.doc_id, k.address, CASE WHEN best > 2 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status,
  CASE WHEN best <= 2 AND n = 1 THEN (SELECT md5(string_agg(x.text || CASE WHEN x.block_idx + 1 < b1 THEN repeat(chr(10), x.gap + 1) ELSE '' END, '' ORDER BY x.block_idx))
     FROM blk x WHERE x.doc_id = k.doc_id AND x.block_idx >= b0 AND x.block_idx < b1) END AS body,
  CASE WHEN best = 3 THEN first8 WHEN best <= 2 AND n > 1 THEN paths ELSE '' END AS candidates
FROM k""")
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parsed(spark, sf_dir)
    t = outline.topics(docs, ["doc_id"])
    path = F.concat(F.replace("path", F.lit("e"), F.lit("E")), F.lit(" "))
    address = F.when(F.col("block_idx") == 6, F.array(path)).when(F.col("block_idx") == 0, F.array("title", F.lit("the"), F.lit(" ")))
    asked = t.select("doc_id", F.explode(address).alias("address"))
    got = outline.sections(docs, asked, ["doc_id"])
    return got.select("doc_id", "address", "status", F.md5("text").alias("body"), F.array_join("candidates", "|").alias("candidates"))


JOBS = parts_sql(1000) + """, job AS (
  SELECT doc_id, path, text AS src, substr(sha256(path || '|1000'), 1, 10) AS job_id FROM corpus
)
"""


@query(JOBS + """SELECT j.job_id, j.doc_id, path AS source_file, count(*) AS total_parts, string_agg(gap_after, ',' ORDER BY part) AS gaps,
 string_agg(printf('doc-%d-part-%02d.md', j.doc_id, part) || ':' || n_bytes || ':' || heading, '|' ORDER BY part) AS parts,
 substr(sha256(src), 1, 16) AS source_sha256, CAST(strlen(src) AS INTEGER) AS source_chars
FROM job j JOIN part p ON p.doc_id = j.doc_id GROUP BY ALL""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    m = jobs.manifests(parts.split(docs, 1000), docs, 1000)
    item = F.transform("parts", lambda p: F.concat_ws(":", p["file"], p["chars"].cast("string"), F.coalesce(p["heading"], F.lit(""))))
    gaps = F.when(F.size("gaps") > 0, F.array_join(F.transform("gaps", lambda g: g.cast("string")), ","))
    return m.select("job_id", "doc_id", "source_file", F.col("total_parts").cast("long").alias("total_parts"), gaps.alias("gaps"),
                    F.array_join(item, "|").alias("parts"), "source_sha256", "source_chars")


def _edits(rows: DataFrame) -> DataFrame:
    """Two versions of every even part's edit, and a blank one that doesn't count."""
    even = rows.where("part % 2 = 0")
    old = even.select("doc_id", "part", F.lit("old\n").alias("text"), F.lit(1).alias("updated_at"))
    new = even.select("doc_id", "part", F.replace("text", F.lit("e"), F.lit("E")).alias("text"), F.lit(2).alias("updated_at"))
    blank = rows.where("part = 1").select("doc_id", "part", F.lit(" \n").alias("text"), F.lit(3).alias("updated_at"))
    return old.union(new).union(blank)


@query(JOBS + """SELECT doc_id, count(*) FILTER (part % 2 = 0) AS done, count(*) AS total,
 coalesce(string_agg(part, ', ' ORDER BY part) FILTER (part % 2 = 1), '') AS missing,
 count(*) FILTER (part % 2 = 0) || '/' || count(*) AS summary FROM part GROUP BY doc_id""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.split(corpus(spark, sf_dir), 1000)
    return jobs.status(rows, _edits(rows), ["doc_id", "part"])


@query(JOBS + """SELECT doc_id, part, part % 2 = 1 AS is_open, md5(CASE WHEN part % 2 = 0 THEN replace(text, 'e', 'E') ELSE text END) AS body FROM part""")
def current_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.split(corpus(spark, sf_dir), 1000)
    edits, keys = _edits(rows), ["doc_id", "part"]
    opened = jobs.open_parts(rows, edits, keys).select(*keys, F.lit(True).alias("is_open"))
    done = jobs.done_parts(rows, edits, keys).select(*keys, F.lit(False).alias("is_open"))
    now = jobs.with_edits(rows, edits, keys).select(*keys, F.md5("current").alias("body"))
    return now.join(opened.union(done), keys)


@query(JOBS + """SELECT doc_id, CAST(count(*) AS INTEGER) AS n_parts, CAST(count(*) FILTER (part % 2 = 0) AS INTEGER) AS n_edited,
 md5(string_agg(CASE WHEN part % 2 = 0 THEN replace(text, 'e', 'E') ELSE text END || repeat(chr(10), coalesce(gap_after, 0) + 1), '' ORDER BY part)) AS merged,
 CASE WHEN count(*) = 1 THEN 'byte-exact' END AS verdict FROM part GROUP BY doc_id""")
def merge_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    rows = parts.split(docs, 1000)
    got = jobs.merge_job(rows, _edits(rows), docs, ["doc_id", "part"])
    return got.select("doc_id", "n_parts", "n_edited", F.md5("merged").alias("merged"), "verdict")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.when(F.col("doc_id") % 5 != 0, jobs.source_hash(F.col("text")))
    known = docs.select("doc_id", sha.alias("source_sha256"))
    now = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return jobs.staleness(known, now, "doc_id").select("doc_id", "state")


STAMPED = """
WITH d AS (SELECT doc_id, text, lang, substr(sha256(text), 1, 16) AS sha, CAST(strlen(text) AS INTEGER) AS n FROM documents),
y AS (SELECT *, 'translation:' || chr(10) || '  tool: docgrain' || chr(10) || '  version: 0.1.0' || chr(10) || '  source: "a: b"' || chr(10) || '  source_sha256: ' || sha || chr(10)
  || CASE WHEN n > 0 THEN '  source_chars: ' || n || chr(10) ELSE '' END || '  target_lang: ' || lang || chr(10) || '  parts: 3/3' || chr(10) || '  machine_translation: true' || chr(10) AS b FROM d)
"""


@query(STAMPED + """SELECT doc_id, md5('---' || chr(10) || b || '---' || chr(10) || chr(10) || ltrim(text, chr(10))) AS fresh,
 md5('---' || chr(10) || 'title: x' || chr(10) || 'b: 1' || chr(10) || b || '---' || chr(10) || text) AS edited,
 md5('---' || chr(10) || 'title: x' || chr(10) || 'b: 1' || chr(10) || '---' || chr(10) || text) AS cleared FROM y""")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    p = F.struct(
        F.lit(jobs.TOOL).alias("tool"), F.lit(jobs.VERSION).alias("version"), F.lit("").alias("url"), F.lit("a: b").alias("source"),
        jobs.source_hash(F.col("text")).alias("source_sha256"), F.octet_length("text").alias("source_chars"), F.col("lang").alias("target_lang"),
        none.alias("model"), none.alias("mode"), none.alias("translated"), F.lit(True).alias("machine_translation"),
    )
    d = docs.select("doc_id", "text", jobs.yaml_block(p, F.lit("3/3")).alias("b"))
    front = F.concat(F.lit("---\ntitle: x\ntranslation:\n  tool: old\n\n  more: y\nb: 1\n---\n"), F.col("text"))
    return d.select(
        "doc_id", F.md5(jobs.stamp(F.col("text"), F.col("b"))).alias("fresh"), F.md5(jobs.stamp(front, F.col("b"))).alias("edited"),
        F.md5(jobs.unstamp(front)).alias("cleared"),
    )


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in glossary.STOPWORDS) + "]"
GLOSSARY = CORPUS + f""", prose AS (
  SELECT doc_id, block_idx, text, regexp_replace(text, '`+[^`]*`+', ' ', 'g') AS clean FROM blk WHERE kind NOT IN ('code', 'html')
), cl AS (
  SELECT doc_id, block_idx, text, unnest(cs) AS clause, generate_subscripts(cs, 1) AS c FROM (
    SELECT *, string_split_regex(clean, '[,.;:!?()\\[\\]{{}}"—–\\n]+') AS cs FROM prose)
), wd AS (
  SELECT doc_id, block_idx, text, c, unnest(ws) AS word, generate_subscripts(ws, 1) AS w, ws FROM (
    SELECT *, regexp_extract_all(clause, '\\p{{L}}[\\p{{L}}0-9-]*') AS ws FROM cl)
), tk AS (
  SELECT doc_id, block_idx, text, c, w, word, lower(word) AS lw, lower(ws[w + 1]) AS nx FROM wd
), ok AS (SELECT * FROM tk WHERE strlen(lw) >= 3 AND NOT list_contains({_STOP_SQL}, lw)
), terms AS (
  SELECT doc_id, block_idx, text, c, w, word, lw AS term FROM ok UNION ALL
  SELECT doc_id, block_idx, text, c, w, word, lw || ' ' || nx FROM ok WHERE strlen(nx) >= 3 AND NOT list_contains({_STOP_SQL}, nx)
), cnt AS (
  SELECT doc_id, term, count(*) AS n, count(DISTINCT block_idx) AS blocks, arg_min(struct_pack(t := text, w := word), (block_idx, c, w)) AS f
  FROM terms GROUP BY doc_id, term HAVING count(DISTINCT block_idx) >= 2 OR count(*) >= 3
), code AS (
  SELECT doc_id, list_distinct(list(lower(v))) AS vocab FROM (
    SELECT doc_id, unnest(flatten(list_transform(CASE WHEN kind = 'code' THEN regexp_extract_all(text, '[\\p{{L}}0-9]+(?:[_./-][\\p{{L}}0-9]+)+|[a-z]+[A-Z][\\p{{L}}0-9]*')
       ELSE regexp_extract_all(text, '`+[^`]*`+') END, lambda s: regexp_extract_all(s, '\\p{{L}}[\\p{{L}}0-9-]*')))) AS v FROM blk WHERE kind <> 'html'
  ) WHERE strlen(v) >= 3 GROUP BY doc_id
), c1 AS (
  SELECT cnt.*, coalesce(list_contains(vocab, split_part(term, ' ', 1)), false) AS in_code, contains(term, ' ') AS phrase, lower(corpus.text) AS low
  FROM cnt JOIN corpus ON corpus.doc_id = cnt.doc_id LEFT JOIN code ON code.doc_id = cnt.doc_id
), c2 AS (
  SELECT *, CAST(blocks * 3 + n + CASE WHEN in_code THEN 8 ELSE 0 END + CASE WHEN phrase THEN 5 ELSE 0 END AS BIGINT) AS score FROM c1
  WHERE (phrase OR in_code) AND NOT (phrase AND (contains(low, replace(term, ' ', '_'))
    OR contains(low, replace(term, ' ', '_') || '(') OR contains(low, replace(term, ' ', '-') || '(') OR contains(low, replace(term, ' ', '') || '(') OR contains(low, replace(term, ' ', '.') || '(')
    OR contains(low, '`' || replace(term, ' ', '_')) OR contains(low, '`' || replace(term, ' ', '-')) OR contains(low, '`' || replace(term, ' ', '')) OR contains(low, '`' || replace(term, ' ', '.'))))
), c3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM c2),
c4 AS (
  SELECT doc_id, replace(term, '-', ' ') AS term, CAST(sum(n) AS BIGINT) AS count, max(blocks) AS blocks, arg_min(in_code, r) AS in_code, arg_min(score, r) AS score, min(r) AS r
  FROM c3 GROUP BY doc_id, replace(term, '-', ' ')
), inside AS (SELECT DISTINCT doc_id, unnest(string_split(term, ' ')) AS term FROM c4 WHERE contains(term, ' ')),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS rank FROM c4 a
  WHERE contains(term, ' ') OR NOT EXISTS (SELECT 1 FROM inside i WHERE i.doc_id = a.doc_id AND i.term = a.term)
)
"""


@query(GLOSSARY + """SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, blocks, count, in_code, score,
 count || ' occurrences in ' || blocks || ' chunks' || CASE WHEN in_code THEN ', also appears in code' ELSE '' END AS note FROM cand WHERE rank <= 40""")
def glossary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.notes(glossary.candidates(parsed(spark, sf_dir), ["doc_id"])).drop("example")


@query("""WITH a AS (SELECT item_id, 'Term ' || item_id AS asked, unnest([' term ' || item_id, 'term ' || item_id, 'other', 'TERM ' || item_id]) AS term,
 unnest([' value ' || item_id || ' ', 'a sentence.', 'x', '']) AS value FROM benchmark)
SELECT item_id, trim(term) AS term, trim(value) AS value FROM a WHERE trim(term) <> '' AND trim(value) <> '' AND lower(trim(term)) = lower(asked)
 AND lower(trim(term)) <> lower(trim(value)) AND NOT regexp_matches(trim(value), '[.!?;\\n(]')""")
def glossary_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "benchmark").select("item_id")
    n = F.col("item_id").cast("string")
    reply = F.concat(F.lit('Sure:\n{" term '), n, F.lit('": " value '), n, F.lit(' ", "term '), n, F.lit('": "a sentence.", "other": "x", "TERM '), n, F.lit('": ""}\nDone.'))
    answers = ids.select("item_id", F.explode(glossary.parse_reply(reply)).alias("term", "value"))
    asked = ids.select("item_id", F.concat(F.lit("Term "), n).alias("term"))
    return glossary.clean(answers, asked, ["item_id"])


@query("""WITH c AS (SELECT doc_id, unnest(['', 'EN-gb', ' de ', 'zh_CN', '-x', 'English', lang]) AS code FROM documents)
SELECT doc_id, code, CASE WHEN b IN ('', 'en', 'english') THEN 'good' WHEN b IN ('zh', 'ja', 'th', 'ko') THEN 'none' ELSE 'noisy' END AS support,
 CASE lower(trim(code)) WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' ELSE trim(code) END AS name
FROM (SELECT *, CASE WHEN regexp_matches(lower(trim(code)), '^[^_-]') THEN regexp_replace(lower(trim(code)), '[_-].*$', '') ELSE lower(trim(code)) END AS b FROM c)""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, ["", "EN-gb", " de ", "zh_CN", "-x", "English"]), F.col("lang"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(codes).alias("code"))
    return d.select("doc_id", "code", tx.source_support(F.col("code")).alias("support"), tx.language_name(F.col("code")).alias("name"))


@query(CORPUS + """SELECT doc_id, count(*) FILTER (kind = 'code') + count(*) FILTER (kind = 'heading' AND level = 1) + count(*) FILTER (kind = 'table') AS reasons,
 count(*) FILTER (kind = 'code') AS code_, count(*) FILTER (kind = 'heading' AND level = 1) AS heads, count(*) FILTER (kind = 'table') AS tables_ FROM blk GROUP BY doc_id""")
def verify_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir)
    bad = F.replace("text", F.lit("```txt\n"), F.lit("```txt\nx "))
    bad = F.replace(bad, F.lit("| --- | --- |\n"), F.lit("| --- | --- |\n| extra | row |\n"))
    bad = F.regexp_replace(bad, r"(?m)^# (?!not a heading$)", "### ")
    got = merge.verify(d.select("doc_id", F.col("text").alias("source"), bad.alias("rewritten")))
    n = lambda p: F.size(F.filter("findings", lambda r: r["code"] == p)).cast("long")
    return got.select("doc_id", F.size("reasons").cast("long").alias("reasons"), n("code").alias("code_"), n("level").alias("heads"), n("rows").alias("tables_"))


@query(CORPUS + """, n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (block_idx = 0 OR kind <> 'list') AS INTEGER) AS m,
  list(kind ORDER BY block_idx) AS k, list(kind ORDER BY block_idx) FILTER (kind <> 'list') AS j FROM blk GROUP BY doc_id)
SELECT doc_id, n <> m AS other_count, CAST(len(list_filter(generate_series(1, least(n, m)), lambda i: k[i] <> j[i])) AS INTEGER) AS other_kinds FROM n""")
def verify_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten texts that have lost their lists: another number of blocks, and other kinds at their places."""
    d = parsed(spark, sf_dir)
    left = F.filter("blocks", lambda b: b["kind"] != "list")
    found = d.select("doc_id", merge.structure_findings(F.col("blocks"), left).alias("f"))
    n = lambda p: F.size(F.filter("f", lambda x: x["code"] == p))
    return found.select("doc_id", (n("count") > 0).alias("other_count"), n("kind").alias("other_kinds"))


SPANS = """WITH d AS (SELECT doc_id, 'See `x_' || doc_id || '` and https://a.b/c?d=' || doc_id || ' or [the ' || lang || '](u/' || doc_id || ') ' || text || ' <br> [^' || doc_id || '] ⟦ 7 ⟧' AS t FROM documents),
r AS (SELECT doc_id, t, regexp_extract_all(t, '`+[^`]*`+|https?://[^\\s)]+|\\]\\([^)]*\\)|\\]\\[[^\\]]*\\]|\\[\\^[^\\]]+\\]|</?[a-zA-Z][^>]*>|⟦\\s*\\d+\\s*⟧') AS k,
  string_split_regex(t, '`+[^`]*`+|https?://[^\\s)]+|\\]\\([^)]*\\)|\\]\\[[^\\]]*\\]|\\[\\^[^\\]]+\\]|</?[a-zA-Z][^>]*>|⟦\\s*\\d+\\s*⟧') AS s FROM d),
m AS (SELECT doc_id, t, k, array_to_string(list_transform(s, lambda x, i: x || CASE WHEN i < len(s) THEN '⟦' || (i - 1) || '⟧' ELSE '' END), '') AS masked FROM r)
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, lit = F.col("doc_id").cast("string"), F.lit
    t = F.concat(lit("See `x_"), n, lit("` and https://a.b/c?d="), n, lit(" or [the "), "lang", lit("](u/"), n, lit(") "), "text", lit(" <br> [^"), n, lit("] ⟦ 7 ⟧"))
    d = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", "t", spans.mask(F.col("t")).alias("masked"), spans.tokens(F.col("t")).alias("k"))


@query(SPANS + "SELECT doc_id, md5(masked) AS masked, CAST(len(k) AS INTEGER) AS n, md5(array_to_string(k, chr(1))) AS saved FROM m")
def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", F.md5("masked").alias("masked"), F.size("k").alias("n"), F.md5(F.array_join("k", "\x01")).alias("saved"))


@query(SPANS + """SELECT doc_id, md5(t) AS back, CAST(NULL AS VARCHAR) AS fine, 'marker 0 came back 0 times, expected once' AS lost,
 'marker 1 came back 2 times, expected once' AS twice, 'marker ' || (len(k) + 3) || ' was never sent' AS invented FROM m""")
def restore_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _spans(spark, sf_dir), F.col("k")
    loose = F.replace(F.replace("masked", F.lit("⟦"), F.lit("⟦ ")), F.lit("⟧"), F.lit(" ⟧"))
    back = spans.restore(loose, k)
    lost = spans.restore(F.replace("masked", F.lit("⟦0⟧"), F.lit("")), k)
    twice = spans.restore(F.concat("masked", F.lit(" ⟦1⟧")), k)
    new = spans.restore(F.concat(F.col("masked"), F.lit(" ⟦"), (F.size(k) + 3).cast("string"), F.lit("⟧")), k)
    return d.select("doc_id", F.md5(back["text"]).alias("back"), back["error"].alias("fine"), lost["error"].alias("lost"), twice["error"].alias("twice"), new["error"].alias("invented"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, 'new structure' AS structure, 'echo of the instructions' AS echo,
 CASE WHEN length(text) > 4 * 10 + 80 THEN 'too long' END AS long_, md5(replace(text, 'x', 'y') || chr(10) || 'b') AS joined FROM documents""")
def fit_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lit = read(spark, sf_dir, "documents"), F.lit
    flat = spans.fit(F.replace("text", lit("\n"), lit(" ")), F.concat("text", lit("\n")))
    two = F.concat(F.replace("text", lit("x"), lit("y")), lit("\n \n\nb"))
    return d.select(
        "doc_id", flat["text"].alias("flat"), spans.fit(lit("a"), F.concat(lit("- "), F.lit("b")))["error"].alias("structure"),
        spans.fit(lit("a"), F.lit("Output ONLY the Result"))["error"].alias("echo"),
        spans.fit(lit("ab\nde fgij"), F.col("text"))["error"].alias("long_"), F.md5(spans.fit(F.concat("text", lit("\nb")), two)["text"]).alias("joined"),
    )


@query("""SELECT doc_id, CAST(3 AS INTEGER) AS n, '1=' || lang || '|2=b|4=d' AS items FROM documents""")
def numbered_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("Here:\n1. "), F.col("lang"), F.lit("\n 2) b \n9: too far\nplain\n3 - \n4 - d"))
    d = read(spark, sf_dir, "documents").select("doc_id", spans.numbered_items(reply, F.lit(5)).alias("r"))
    return d.select("doc_id", F.size("r").alias("n"), F.array_join(F.transform("r", lambda x: F.concat_ws("=", x["n"].cast("string"), x["text"])), "|").alias("items"))


@query("""SELECT doc_id, md5(text || chr(10) || 'z') AS inner_, md5('```' || chr(10) || text || chr(10) || 'z' || chr(10) || '```') AS kept FROM documents""")
def unwrap_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lit = read(spark, sf_dir, "documents"), F.lit
    a = F.concat(lit("```md\n"), "text", lit("\nz\n```\n"))
    b = F.concat(lit("```\n"), "text", lit("\nz\n```"))
    return d.select("doc_id", F.md5(spans.unwrap(a, lit("x\ny"))).alias("inner_"), F.md5(spans.unwrap(b, lit("```\ny\n```"))).alias("kept"))


TERM_ROWS = "[('the'), ('code fences'), ('of the'), ('is'), ('für')]"


@query("""WITH t AS (SELECT unnest(['the', 'words', 'of the', 'über', 'C++']) AS term, unnest(['the', 'word(?:e?s)?', 'of[\\s-]+the', 'über', 'C\\+\\+']) AS rx)
SELECT doc_id, term FROM (SELECT doc_id, text || ' WORD of-the' AS x FROM documents), t
WHERE regexp_matches(x, '(?i)(^|[^0-9A-Za-z_])' || rx || '($|[^0-9A-Za-z_])')""")
def glossary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("the",), ("words",), ("of the",), ("über",), ("C++",)], "term string")
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" WORD of-the")).alias("x"))
    return d.join(F.broadcast(terms), spans.applies(F.col("term"), F.col("x"))).select("doc_id", "term")


@query("""SELECT conv_id, turn, '{"model":"m","messages":[{"role":"system","content":"Translate the text below into German."},{"role":"user","content":' || to_json(text) || '}],"temperature":0,"stream":false}' AS chat,
 '{"model":"m","prompt":' || to_json('en>de:' || text || '/German') || ',"temperature":0,"stream":false,"stop":["<end_of_turn>"]}' AS completion FROM conversations""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    system, none, to = requests.default_task(F.lit("de"), "the text below"), F.lit(""), F.lit("de")
    chat = requests.request_body(requests.Config(model="m"), system, F.col("text"), none, to)
    shape = requests.Config(model="m", transport="completions", prompt_template="{{.SourceLang}}>{{.TargetLang}}:{{.User}}/{{.TargetLangName}}")
    return c.select("conv_id", "turn", chat.alias("chat"), requests.request_body(shape, system, F.col("text"), none, to).alias("completion"))


@query("""SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN NULL WHEN 1 THEN 'http' WHEN 2 THEN 'json' WHEN 3 THEN 'endpoint' WHEN 4 THEN 'no_choices' WHEN 5 THEN 'truncated' ELSE 'empty' END AS error_kind,
 CASE WHEN turn % 7 = 0 THEN 'ok ' || role END AS reply FROM conversations""")
def reply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "conversations"), F.col("turn") % 7
    body = (
        F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":"ok '), "role", F.lit('"},"finish_reason":"stop"}]}')))
        .when(k == 2, "{no").when(k == 3, '{"error":{"message":"busy"}}').when(k == 4, '{"choices":[]}')
        .when(k == 5, '{"choices":[{"text":"x","finish_reason":"length"}]}').otherwise('{"choices":[{"text":" "}]}')
    )
    out = requests.reply_outcome(F.when(k == 1, 500).otherwise(200), body)
    return c.select("conv_id", "turn", out["error_kind"].alias("error_kind"), out["text"].alias("reply"))


@query(parts_sql(1000) + """SELECT doc_id, part, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10)) AS body, true AS stored FROM part""")
def transform_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.split(corpus(spark, sf_dir), 1000)
    got = transform.transform_parts(rows, ["doc_id", "part"], transform.identity, transform.Options(language="de", batch_short=False))
    return got.select("doc_id", "part", F.md5("out").alias("body"), "stored")


@query(parts_sql(1000) + """SELECT doc_id, part, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10)) AS body, true AS stored FROM part""")
def transform_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.split(corpus(spark, sf_dir), 1000)
    got = transform.transform_parts(rows, ["doc_id", "part"], transform.identity, transform.Options(language="de", mode="chunk"))
    return got.select("doc_id", "part", F.md5("out").alias("body"), "stored")


@query(CORPUS + """SELECT lang, source, count(*) AS blocks, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM blk GROUP BY ROLLUP (lang, source)""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: totals by language and source."""
    rows = blocks.block_rows(parsed(spark, sf_dir), ["doc_id", "lang", "source"])
    return rows.rollup("lang", "source").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_bytes").alias("bytes"))


@query(CORPUS + "SELECT doc_id, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM blk GROUP BY doc_id")
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser as a SQL table function."""
    blocks.register_sql(spark)
    corpus(spark, sf_dir).createOrReplaceTempView("docgrain_corpus")
    return spark.sql(
        "SELECT doc_id, count(*) AS n, sum(n_bytes) AS bytes FROM docgrain_corpus, LATERAL md_blocks(text) GROUP BY doc_id"
    )


def split_report(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """The flagship: per document its parts, bytes, oversize parts and round-trip verdict. No shuffle."""
    d = parts.with_parts(parsed(spark, sf_dir), size).withColumn("texts", parts.texts_of())
    sizes = F.transform("texts", lambda x: F.octet_length(x["text"]).cast("long"))
    verdict = merge.roundtrip_verdict(F.col("text"), merge.join_parts(F.col("texts"))).alias("verdict")
    return d.where(F.size("parts") > 0).select(
        "doc_id", F.size("parts").alias("n_parts"), verdict, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"),
        F.size(F.filter(sizes, lambda x: x > size)).cast("long").alias("oversize"),
    )


QUERIES["split_report"] = split_report
SQL["split_report"] = parts_sql(1000) + """SELECT doc_id, CAST(count(*) AS INTEGER) AS n_parts, 'byte-exact' AS verdict, CAST(sum(n_bytes) AS BIGINT) AS bytes,
 count(*) FILTER (n_bytes > 1000) AS oversize FROM part GROUP BY doc_id"""
