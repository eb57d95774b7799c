"""Queries on page layout. The layout is derived from the lines of ``documents.text``: position and size follow from the
document's number and the line's."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import layout as ly
from foliograph.plans.catalogue import query
from foliograph.plans.views import with_
from foliograph.sources.tables import table

# Geometry as arithmetic, the same text in both dialects.
X0 = "CASE WHEN (doc_id + n) % 9 = 0 THEN 60.0 WHEN n % 20 < 10 THEN 60.0 ELSE 320.0 END"
X1 = "CASE WHEN (doc_id + n) % 9 = 0 THEN 550.0 WHEN n % 20 < 10 THEN 300.0 ELSE 550.0 END"
Y0 = "70.0 + (n % 10) * 60 + (n % 20) * 0.25"
SIZE = "CASE WHEN n = 0 THEN 15.9 WHEN (doc_id + n) % 11 = 0 THEN 13.9 WHEN (doc_id + n) % 17 = 0 THEN 12.0 WHEN (doc_id + n) % 6 = 0 THEN 10.0 ELSE 9.5 END"
BOLD = "(n = 0 OR (doc_id + n) % 11 = 0 OR (doc_id + n) % 17 = 0 OR (doc_id + n) % 6 = 0)"
TEXT = "CASE WHEN n = 0 THEN 'i' || lpad(CAST(doc_id AS VARCHAR(20)), 8, '0') || ' ' ELSE '' END"
LINES = f"ln AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), bl AS (SELECT CAST(doc_id AS VARCHAR) AS doc, 1 + n // 20 AS page, n AS block_no, ({X0})::DOUBLE AS x0, ({X1})::DOUBLE AS x1, ({Y0})::DOUBLE AS y, ({SIZE})::DOUBLE AS size, {BOLD} AS bold, trim(regexp_replace(regexp_replace(({TEXT}) || line, '[ \\t]+', ' ', 'g'), '([\\p{{L}}\\p{{N}}_])- ([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')) AS text, ({TEXT}) || line AS raw FROM ln), tb AS (SELECT *, CASE WHEN x0 < 306 AND x1 > 324 THEN 'full' WHEN x0 < 306 THEN 'left' ELSE 'right' END AS col FROM bl WHERE y BETWEEN 60 AND 750 AND length(text) > 0)"
ORDER = "ro AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY band, CASE col WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, y, block_no) AS ord FROM (SELECT *, sum((col = 'full')::INT) OVER (PARTITION BY doc, page ORDER BY y RANGE UNBOUNDED PRECEDING) AS band FROM tb))"


def _blocks(spark, folder):
    d = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    box = F.struct(F.expr(X0).cast("double").alias("x0"), F.expr(Y0).cast("double").alias("y0"), F.expr(X1).cast("double").alias("x1"), (F.expr(Y0).cast("double") + 20.0).alias("y1"))
    span = F.struct(F.concat(F.expr(TEXT), F.col("line")).alias("text"), F.expr(SIZE).cast("double").alias("size"), F.when(F.expr(BOLD), 16).otherwise(0).alias("flags"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"))
    text = d.select(F.col("doc_id").cast("string").alias("doc"), (1 + F.floor(F.col("n") / 20)).cast("int").alias("page"), F.col("n").alias("block_no"), F.lit(0).alias("type"), box.alias("bbox"), F.array(F.struct(F.array(span).alias("spans"))).cast(ly.LINES).alias("lines"))
    # A banner 5 points above every line whose number leaves 3 of 15.
    at = F.struct(F.expr(X0).cast("double").alias("x0"), (F.expr(Y0).cast("double") - 31.0).alias("y0"), (F.expr(X0).cast("double") + 234.0).alias("x1"), (F.expr(Y0).cast("double") - 5.0).alias("y1"))
    banner = d.filter("n % 15 = 3").select(F.col("doc_id").cast("string").alias("doc"), (1 + F.floor(F.col("n") / 20)).cast("int").alias("page"), (F.col("n") + 100_000).alias("block_no"), F.lit(1).alias("type"), at.alias("bbox"), F.lit(None).cast(ly.LINES).alias("lines"))
    return text.unionByName(banner)


@query(with_(LINES, ORDER) + "SELECT doc, page, block_no, col, band, ord FROM ro")
def reading_order(spark, folder):
    return ly.reading_order(ly.text_blocks(_blocks(spark, folder))).select("doc", "page", "block_no", "col", "band", "ord")


@query(
    with_(LINES)
    + """, sz AS (SELECT doc, size, sum(length(trim(raw))) AS chars, sum(CASE WHEN bold THEN length(trim(raw)) ELSE 0 END) AS bold, min((page, block_no)) AS pos FROM bl WHERE trim(raw) <> '' AND y BETWEEN 60 AND 750 GROUP BY 1, 2),
body AS (SELECT doc, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chars DESC, pos) AS r FROM sz) WHERE r = 1),
anc AS (SELECT doc, size AS h1, count(*) AS c FROM bl WHERE regexp_matches(text, '^i\\d{8}(\\s|$)') AND y BETWEEN 60 AND 750 GROUP BY 1, 2)
SELECT a.doc, b.body, a.h1, least(2, count(CASE WHEN z.size > b.body AND z.size < a.h1 AND z.bold > z.chars / 2 THEN 1 END)) AS levels, max(CASE WHEN z.size > b.body AND z.size < a.h1 AND z.bold > z.chars / 2 THEN z.size END) AS h2 FROM anc a JOIN body b ON b.doc = a.doc JOIN sz z ON z.doc = a.doc GROUP BY 1, 2, 3"""
)
def heading_profile(spark, folder):
    p = ly.heading_profile(_blocks(spark, folder))
    return p.filter("h1_anchors > 0").select("doc", "body", "h1", (F.col("h2").isNotNull().cast("long") + F.col("h3").isNotNull().cast("long")).alias("levels"), "h2")


@query(with_(LINES, ORDER) + "SELECT count(*) AS n, count(DISTINCT doc) AS docs, count(*) FILTER (WHERE col = 'full') AS full_width FROM ro")
def block_columns(spark, folder):
    x = ly.text_blocks(_blocks(spark, folder))
    return x.agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"), F.count_if(F.col("col") == "full").alias("full_width"))


BAN = "ban AS (SELECT doc, page, CASE WHEN x0 < 306 AND x0 + 234 > 324 THEN 'full' WHEN x0 < 306 THEN 'left' ELSE 'right' END AS col, list(y - 5) AS bottoms FROM bl WHERE block_no % 15 = 3 AND y - 31 BETWEEN 60 AND 750 GROUP BY 1, 2, 3)"
WARN = """mk AS (SELECT r.*, coalesce(len(list_filter(b.bottoms, lambda v: r.y - v >= 0 AND r.y - v < 12)) > 0, false) AS opens, r.bold AND r.size < 11.5 AS thin FROM ro r LEFT JOIN ban b ON b.doc = r.doc AND b.page = r.page AND b.col = r.col),
tn AS (SELECT *, sum(chg) OVER (PARTITION BY doc, page ORDER BY ord) AS turn FROM (SELECT *, CASE WHEN lag(col) OVER (PARTITION BY doc, page ORDER BY ord) <> col THEN 1 ELSE 0 END AS chg FROM mk)),
wn AS (SELECT *, max(CASE WHEN opens THEN ord END) OVER (PARTITION BY doc, page, turn ORDER BY ord) AS o, max(CASE WHEN NOT thin THEN ord END) OVER (PARTITION BY doc, page, turn ORDER BY ord) AS e FROM tn)"""


@query(with_(LINES, ORDER, BAN, WARN) + "SELECT doc, page, block_no FROM wn WHERE thin AND o IS NOT NULL AND (e IS NULL OR e < o)")
def banner_blocks(spark, folder):
    """Blocks of warnings, with the third level at 12 points throughout."""
    blocks = _blocks(spark, folder)
    profiles = blocks.select("doc").distinct().withColumn("h3", F.lit(12.0))
    x = ly.warnings_marked(ly.reading_order(ly.text_blocks(blocks)), blocks, profiles)
    return x.filter("warning").select("doc", "page", "block_no")


def _drawings(spark, folder):
    pages = _blocks(spark, folder).filter("page % 3 = 1").select("doc", "page").distinct()
    lines = [("f", 60.0, y, 300.0, y + 1) for y in (200.0, 230.0, 260.0, 290.0)] + [("f", x, 200.0, x + 1, 291.0) for x in (60.0, 180.0, 299.0)] + [("f", 55.0, 62.0, 560.0, 63.0), ("s", 0.0, 0.0, 600.0, 1.0)]
    row = F.posexplode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(a).alias("x0"), F.lit(b).alias("y0"), F.lit(c).alias("x1"), F.lit(d).alias("y1")) for t, a, b, c, d in lines]))
    return pages.select("doc", "page", row.alias("seq", "l")).select("doc", "page", "seq", "l.*")


@query(with_(LINES) + "SELECT DISTINCT doc, page, 0 AS region, 60.0::DOUBLE AS x0, 200.0::DOUBLE AS y0, 300.0::DOUBLE AS x1, 291.0::DOUBLE AS y1 FROM bl WHERE page % 3 = 1")
def table_regions(spark, folder):
    return ly.table_regions(_drawings(spark, folder))


@query(with_(LINES) + "SELECT doc, page, block_no FROM tb WHERE page % 3 = 1 AND NOT bold AND greatest(0, least(x1, 300) - greatest(x0, 60)) * greatest(0, least(y + 20, 291) - greatest(y, 200)) / ((x1 - x0) * 20) > 0.6")
def table_assign(spark, folder):
    x = ly.text_blocks(_blocks(spark, folder)).filter(~F.col("bold")).withColumn("kind", F.lit("para"))
    return ly.in_tables(x, ly.table_regions(_drawings(spark, folder))).filter("region is not null").select("doc", "page", "block_no")


def extracted_elements(spark, folder):
    """The whole extraction: order, warnings, kinds, tables; checked against a sequential version in the tests."""
    return ly.extract(_blocks(spark, folder), _drawings(spark, folder)).select("doc", "seq", "kind", "page", F.length("text").alias("n_chars"))


query()(extracted_elements)
