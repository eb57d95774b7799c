"""From page layout (blocks with spans, drawings) to ordered elements.

Blocks are rows ``(doc, page, block_no, type, bbox struct<x0,y0,x1,y1>, lines array<struct<spans array<struct<text,size,flags,bbox>>>>)``;
a span's box may be null. Type 0 is text and 1 an image. Drawings are rows ``(doc, page, seq, type, x0, y0, x1, y1)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.functions import text as ft
from foliograph.session import materialise

# The geometry of the manuals, in points.
GUTTER, GUTTER_SLACK = 306.0, 18.0
BODY_TOP, BODY_BOTTOM = 60.0, 750.0
RULE_HEIGHT, RULE_WIDTH, RULE_BELOW = 3.0, 400.0, 70.0
BANNER_WIDTH, BANNER_HEIGHT, BANNER_GAP = (200.0, 260.0), (18.0, 36.0), 12.0
LINE_THIN, LINE_LONG = 3.0, 12.0
ROW_GAP, X_OVERLAP, ROW_LEAST = 34.0, 5.0, 6.0
TABLE_HEIGHT, TABLE_WIDTH = 20.0, 60.0
INSIDE_TABLE = 0.6
SIZE_SLACK = 0.5
BOLD = 16

LINES = "array<struct<spans:array<struct<text:string,size:double,flags:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>"
BLOCKS = f"doc string, page int, block_no int, type int, bbox struct<x0:double,y0:double,x1:double,y1:double>, lines {LINES}"
DRAWINGS = "doc string, page int, seq int, type string, x0 double, y0 double, x1 double, y1 double"


def column(bbox: str = "bbox") -> Column:
    x0, x1 = F.col(f"{bbox}.x0"), F.col(f"{bbox}.x1")
    return F.when((x0 < GUTTER) & (x1 > GUTTER + GUTTER_SLACK), "full").when(x0 < GUTTER, "left").otherwise("right")


def in_body(bbox: str = "bbox") -> Column:
    return F.col(f"{bbox}.y0").between(BODY_TOP, BODY_BOTTOM)


def is_banner() -> Column:
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    return (F.col("type") == 1) & (w > BANNER_WIDTH[0]) & (w < BANNER_WIDTH[1]) & (h > BANNER_HEIGHT[0]) & (h < BANNER_HEIGHT[1])


def is_table_line() -> Column:
    """A thin long filled rectangle that isn't the rule under the page's head."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rule = (h < RULE_HEIGHT) & (w > RULE_WIDTH) & (F.col("y0") < RULE_BELOW)
    return (F.col("type") == "f") & ((w < LINE_THIN) | (h < LINE_THIN)) & (F.greatest(w, h) > LINE_LONG) & ~rule


def _spans() -> Column:
    return F.filter(F.flatten(F.transform("lines", lambda line: line["spans"])), lambda s: F.trim(s["text"]) != "")


def max_size() -> Column:
    return F.coalesce(F.array_max(F.transform(F.flatten(F.transform("lines", lambda line: line["spans"])), lambda s: s["size"])), F.lit(0.0))


def all_bold() -> Column:
    return (F.size(_spans()) > 0) & F.forall(_spans(), lambda s: s["flags"].bitwiseAND(F.lit(BOLD)) != 0)


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks of the body with text, column, size and boldness."""
    x = blocks.filter((F.col("type") == 0) & in_body()).withColumns({"text": ft.block_text(F.col("lines")), "col": column(), "size": max_size(), "bold": all_bold()})
    first = F.get(_spans(), F.lit(0))
    x = x.withColumn("lead_bold", F.coalesce(first["flags"].bitwiseAND(F.lit(BOLD)) != 0, F.lit(False))).withColumn("lead", F.coalesce(F.trim(first["text"]), F.lit("")))
    return x.filter(F.length("text") > 0).withColumn("y", F.col("bbox.y0"))


def heading_profile(blocks: DataFrame) -> DataFrame:
    """One row per manual: ``(doc, body, h1, h2, h3, h1_anchors, h1_agreement, problem)``.

    The body is the size of most characters; h1 the size of most blocks that begin with an icode, or without such blocks the
    largest size above the body that is mostly bold; h2 and h3 are the next two mostly bold sizes between them. ``problem``
    says what is missing; :func:`validated` raises on it. Of equally frequent sizes the one met first counts.
    """
    x = blocks.filter(F.col("lines").isNotNull() & in_body())
    span = x.select("doc", "page", "block_no", F.posexplode(F.flatten(F.transform("lines", lambda line: line["spans"]))).alias("n", "s"))
    span = span.select("doc", F.struct("page", "block_no", "n").alias("at"), F.length(F.trim("s.text")).alias("c"), ft.tenths(F.col("s.size")).alias("size"), (F.col("s.flags").bitwiseAND(F.lit(BOLD)) != 0).alias("b")).filter("c > 0")
    sizes = span.groupBy("doc", "size").agg(F.sum("c").alias("chars"), F.coalesce(F.sum(F.when(F.col("b"), F.col("c"))), F.lit(0)).alias("bold"), F.min("at").alias("at"))
    back = lambda at: F.struct((-at["page"]).alias("p"), (-at["block_no"]).alias("b"), (-at["n"]).alias("n"))
    body = sizes.groupBy("doc").agg(F.max_by("size", F.struct("chars", back(F.col("at")))).alias("body"))
    anchors = x.withColumn("text", ft.block_text(F.col("lines"))).filter(F.col("text").rlike(rf"^{ft.ICODE}(\s|$)"))
    anchors = anchors.select("doc", "page", "block_no", ft.tenths(max_size()).alias("size"))
    counted = anchors.groupBy("doc", "size").agg(F.count("*").alias("c"), F.min(F.struct("page", "block_no")).alias("at"))
    hits = counted.groupBy("doc").agg(F.max_by("size", F.struct("c", F.struct((-F.col("at.page")).alias("p"), (-F.col("at.block_no")).alias("b")))).alias("ah1"), F.max("c").alias("hits"), F.sum("c").alias("n"))
    bold = sizes.filter(F.col("bold") > F.col("chars") / 2).join(body, "doc").filter(F.col("size") > F.col("body"))
    above = bold.groupBy("doc").agg(F.max("size").alias("bh1"))
    top = body.join(hits, "doc", "left").join(above, "doc", "left").withColumn("h1", F.coalesce("ah1", "bh1"))
    between = bold.select("doc", "size").join(top.select("doc", "h1"), "doc").filter(F.col("size") < F.col("h1")).groupBy("doc").agg(F.slice(F.sort_array(F.collect_set("size"), False), 1, 2).alias("l"))
    every = blocks.select("doc").distinct().join(top, "doc", "left").join(between, "doc", "left")
    return every.select(
        "doc",
        "body",
        "h1",
        F.get("l", F.lit(0)).alias("h2"),
        F.get("l", F.lit(1)).alias("h3"),
        F.coalesce("n", F.lit(0)).alias("h1_anchors"),
        F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("h1_agreement"),
        F.when(F.col("body").isNull(), "no text layer").when(F.col("h1").isNull(), "no bold size above the body").when(F.coalesce(F.size("l"), F.lit(0)) < 2, "fewer than two levels between body and h1").alias("problem"),
    )


def validated(profiles: DataFrame) -> DataFrame:
    bad = profiles.filter("problem is not null").select("doc", "problem").take(1)
    if bad:
        raise ValueError(f"{bad[0].doc}: {bad[0].problem}")
    return profiles


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``band`` and ``ord``: full-width blocks cut a page into bands; in a band the left column is read before the right.
    Windows are pages."""
    page = Window.partitionBy("doc", "page")
    upto = page.orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    x = blocks.withColumn("band", F.sum(F.when(F.col("col") == "full", 1).otherwise(0)).over(upto))
    # Of several full-width blocks at one height each begins its own band; the columns follow the last.
    x = x.withColumn("rank", F.when(F.col("col") == "full", 0).when(F.col("col") == "left", 1).otherwise(2))
    return x.withColumn("ord", F.row_number().over(page.orderBy("band", "rank", "y", "block_no")))


def warnings_marked(ordered: DataFrame, banners: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``warning``: a block right under a banner of its column opens a warning, which goes on while blocks are bold and
    smaller than a heading, and ends with the column."""
    at = banners.filter(is_banner() & in_body()).select("doc", "page", column().alias("col"), F.col("bbox.y1").alias("bottom"))
    bottoms = at.groupBy("doc", "page", "col").agg(F.collect_list("bottom").alias("bottoms"))
    x = ordered.join(bottoms, ["doc", "page", "col"], "left").join(profiles.select("doc", (F.col("h3") - SIZE_SLACK).alias("cut")), "doc", "left")
    opens = F.coalesce(F.exists("bottoms", lambda b: (F.col("y") - b >= 0) & (F.col("y") - b < BANNER_GAP)), F.lit(False))
    x = x.withColumn("opens", opens).withColumn("thin", F.col("bold") & (F.col("size") < F.coalesce("cut", F.lit(float("inf")))))
    w = Window.partitionBy("doc", "page").orderBy("ord")
    x = x.withColumn("turn", F.sum(F.when(F.lag("col").over(w) != F.col("col"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc", "page", "turn").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    last_open, last_end = F.max(F.when(F.col("opens"), F.col("ord"))).over(run), F.max(F.when(~F.col("thin"), F.col("ord"))).over(run)
    return x.withColumns({"_o": last_open, "_e": last_end}).withColumn("warning", F.col("thin") & F.col("_o").isNotNull() & (F.col("_e").isNull() | (F.col("_e") < F.col("_o")))).drop("_o", "_e", "bottoms", "turn", "thin", "opens", "cut")


def classified(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``kind``, by the first rule that holds."""
    x = rows.join(profiles.select("doc", "h1", "h2", "h3"), "doc", "left")
    t, size = F.col("text"), F.col("size")
    near = lambda level: F.abs(size - F.col(level)) < SIZE_SLACK
    kind = (
        F.when(F.col("warning"), "warning")
        .when(t.rlike(rf"^{ft.ICODE}$"), "icode")
        .when(t.startswith("SMCS Code:"), "smcs")
        .when(t.rlike(ft.TABLE_CAPTION), "table")
        .when(t.rlike(ft.ILLUSTRATION), "illustration")
        .when(F.col("bold") & (size >= F.col("h1") - SIZE_SLACK), "h1")
        .when(F.col("bold") & near("h2"), "h2")
        .when(F.col("bold") & near("h3"), "h3")
        .when(t.startswith("NOTICE"), "notice")
        .when(F.col("lead_bold") & F.concat(F.col("lead"), F.lit(" x")).rlike(ft.STEP), "step")
        .when(t.rlike(ft.STEP), "step")
        .otherwise("para")
    )
    return x.withColumn("kind", kind).drop("h1", "h2", "h3")


REGION = T.ArrayType(T.StructType([T.StructField("region", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]]))


def _gathered(lines: list[tuple[float, float, float, float]]) -> list[tuple]:
    """Boxes of lines ``(y0, x0, x1, y1)`` that come in order."""
    boxes: list[list[float]] = []
    for b, a, c, d in lines:
        near = next((r for r in boxes if min(r[2], c) - max(r[0], a) > X_OVERLAP and b <= r[3] + ROW_GAP), None)
        if near is None:
            boxes.append([a, b, c, d])
        else:
            near[:] = [min(near[0], a), min(near[1], b), max(near[2], c), max(near[3], d)]
    kept = [r for r in boxes if r[3] - r[1] > TABLE_HEIGHT and r[2] - r[0] > TABLE_WIDTH]
    return [(i, *r) for i, r in enumerate(kept)]


def table_regions(drawings: DataFrame) -> DataFrame:
    """``(doc, page, region, x0, y0, x1, y1)``: lines, from the top down, join the first region they overlap in x and follow
    closely in y. The order matters, so a page's lines are gone through together; an Arrow batch holds many pages."""

    @F.pandas_udf(REGION)
    def gather(y0: pd.Series, x0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([_gathered(list(zip(*page))) for page in zip(y0, x0, x1, y1)])

    line = F.struct("y0", "x0", "seq", "x1", "y1")
    pages = drawings.filter(is_table_line()).groupBy("doc", "page").agg(F.array_sort(F.collect_list(line)).alias("l"))
    pages = pages.select("doc", "page", *[F.col(f"l.{c}").alias(c) for c in ("y0", "x0", "x1", "y1")])
    return pages.select("doc", "page", F.explode(gather("y0", "x0", "x1", "y1")).alias("r")).select("doc", "page", "r.*")


def in_tables(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds ``region``: the first region that covers more than 0.6 of a paragraph's or step's area, else null. A page's regions
    come to its blocks as one array."""
    box = F.struct("region", *[F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    per_page = regions.groupBy("doc", "page").agg(F.array_sort(F.collect_list(box)).alias("_r"))
    area = (F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))

    def covers(r: Column) -> Column:
        w = F.least(F.col("bbox.x1"), r["x1"]) - F.greatest(F.col("bbox.x0"), r["x0"])
        h = F.least(F.col("bbox.y1"), r["y1"]) - F.greatest(F.col("bbox.y0"), r["y0"])
        return (w > 0) & (h > 0) & (w * h > INSIDE_TABLE * area)

    first = F.get(F.filter("_r", covers), F.lit(0))["region"]
    out = rows.join(per_page, ["doc", "page"], "left")
    return out.withColumn("region", F.when(F.col("kind").isin("para", "step") & (area > 0), first)).drop("_r")


def table_grid(spans: DataFrame, regions: DataFrame, drawings: DataFrame) -> DataFrame:
    """``(doc, page, region, table_rows)``: rows between neighbouring horizontal lines, cells between the vertical lines that
    cross a row's middle; the region's own left and right edge close a row, so that a table open at its sides keeps its
    outer columns, and a row without inner lines is one cell. ``spans`` are ``(doc, page, text, x0, y0, x1, y1)``; a span belongs
    to the cell of its middle. Lines closer than ``ROW_LEAST`` are one line drawn twice; empty rows are left out."""
    keys = ["doc", "page", "region"]
    r = regions.select(*keys, *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    lines = drawings.filter(is_table_line()).join(r, ["doc", "page"])
    lines = lines.filter((F.col("x0") >= F.col("rx0") - 1) & (F.col("x1") <= F.col("rx1") + 1) & (F.col("y0") >= F.col("ry0") - 1) & (F.col("y1") <= F.col("ry1") + 1))
    flat = (F.col("y1") - F.col("y0")) < LINE_THIN
    levels = lines.filter(flat).select(*keys, "rx0", "rx1", F.round("y0", 1).alias("top")).distinct()
    w = Window.partitionBy(*keys).orderBy("top")
    rows = levels.withColumn("bottom", F.lead("top").over(w)).filter(F.col("bottom") - F.col("top") >= ROW_LEAST).withColumn("row", F.row_number().over(w))
    posts = lines.filter(~flat & ((F.col("x1") - F.col("x0")) < LINE_THIN)).select(*keys, F.round("x0", 1).alias("left"), F.col("y0").alias("py0"), F.col("y1").alias("py1"))
    middle = (F.col("top") + F.col("bottom")) / 2
    inner = rows.join(posts, keys).filter(middle.between(F.col("py0") - 2, F.col("py1") + 2) & (F.col("left") > F.col("rx0") + 2) & (F.col("left") < F.col("rx1") - 2))
    inner = inner.groupBy(*keys, "row").agg(F.collect_set("left").alias("inner"))
    edges = rows.join(inner, [*keys, "row"], "left").withColumn("xs", F.array_sort(F.array_distinct(F.concat(F.array(F.round("rx0", 1), F.round("rx1", 1)), F.coalesce("inner", F.array().cast("array<double>"))))))
    spaces = F.transform(F.sequence(F.lit(0), F.size("xs") - 2), lambda i: F.struct(F.get("xs", i).alias("left"), F.get("xs", i + 1).alias("right")))
    cells = edges.select(*keys, "row", "top", "bottom", F.posexplode(spaces).alias("cell", "c")).select(*keys, "row", "top", "bottom", "cell", "c.*")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    put = cells.alias("c").join(spans.alias("s"), (F.col("c.doc") == F.col("s.doc")) & (F.col("c.page") == F.col("s.page")) & (mx >= F.col("left")) & (mx < F.col("right")) & (my > F.col("top")) & (my <= F.col("bottom")), "left")
    word = F.when(F.col("s.text").isNotNull(), F.struct(F.col("s.y0").alias("y"), F.col("s.x0").alias("x"), F.trim(F.regexp_replace("s.text", r"\s+", " ")).alias("t")))
    filled = put.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys], "row", "cell").agg(F.array_sort(F.collect_list(word)).alias("l"))
    filled = filled.select(*keys, "row", F.struct("cell", F.array_join(F.transform("l", lambda e: e["t"]), " ").alias("t")).alias("c"))
    by_row = filled.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list("c")), lambda e: e["t"]).alias("cells")).filter(F.exists("cells", lambda t: t != ""))
    return by_row.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda e: e["cells"]).alias("table_rows"))


def spans(blocks: DataFrame) -> DataFrame:
    """``(doc, page, text, x0, y0, x1, y1)`` of every span; a span without a box of its own has its block's."""
    one = blocks.filter("lines is not null").select("doc", "page", "bbox", F.explode(F.flatten("lines.spans")).alias("s"))
    own = "coalesce(s.bbox, bbox)" if "bbox" in blocks.schema["lines"].dataType.elementType["spans"].dataType.elementType.names else "bbox"
    return one.select("doc", "page", "s.text", *[F.expr(f"{own}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def extract(blocks: DataFrame, drawings: DataFrame, first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """Elements ``(doc, seq, kind, text, page, col, region, table_rows)`` in reading order. The heading profile is that of the whole
    manual, whatever the range of pages. A ruled table is one element of kind table with its cells as ``table_rows``; where
    its lines make no cells, its blocks stay as table rows with their texts."""
    profiles = materialise(heading_profile(blocks), "profiles")  # one small row per manual, read twice
    keep = F.col("page") >= first_page
    if last_page is not None:
        keep = keep & (F.col("page") <= last_page)
    rows = reading_order(text_blocks(blocks.filter(keep)))
    rows = classified(warnings_marked(rows, blocks.filter(keep), profiles), profiles)
    regions = materialise(table_regions(drawings.filter(keep)), "regions")
    rows = in_tables(rows, regions).join(table_grid(spans(blocks.filter(keep)), regions, drawings.filter(keep)), ["doc", "page", "region"], "left")
    # The cells stand where the first block of their table does; without them every block of the table keeps its text.
    w = Window.partitionBy("doc", "page", "region").orderBy("ord")
    rows = rows.withColumn("_n", F.when(F.col("table_rows").isNotNull(), F.row_number().over(w))).filter("_n is null or _n = 1")
    rows = rows.withColumn("kind", F.when(F.col("table_rows").isNotNull(), "table").when(F.col("region").isNotNull(), "table_row").otherwise(F.col("kind")))
    rows = rows.withColumn("text", F.when(F.col("table_rows").isNotNull(), "").otherwise(F.col("text")))
    head = F.col("kind").isin("h1", "h2", "h3") & F.col("text").rlike(rf"(?s)^{ft.ICODE}\s+.*$")
    code = F.when(head, F.regexp_extract("text", rf"(?s)^({ft.ICODE})\s+(.*)$", 1))
    body = F.when(head, F.regexp_extract("text", rf"(?s)^({ft.ICODE})\s+(.*)$", 2)).otherwise(F.col("text"))
    body = F.when(F.col("kind").isin("h1", "h2", "h3"), ft.heading(body)).otherwise(body)
    own = F.struct(F.lit(1).alias("half"), F.col("kind").alias("kind"), body.alias("text"))
    split = F.when(code.isNotNull(), F.array(F.struct(F.lit(0).alias("half"), F.lit("icode").alias("kind"), code.alias("text")), own)).otherwise(F.array(own))
    out = rows.select("doc", "page", "ord", "col", "region", "table_rows", F.explode(split).alias("e"))
    seq = F.col("page").cast("long") * 1_000_000 + F.col("ord") * 2 + F.col("e.half")
    return out.select("doc", seq.alias("seq"), "e.kind", "e.text", "page", "col", "region", "table_rows")


def _page_text(blocks: DataFrame) -> DataFrame:
    """``(doc, page, text)``: a page's lines in the order of its blocks."""
    line = F.transform("lines", lambda x: F.concat_ws("", F.transform(x["spans"], lambda s: s["text"])))
    rows = blocks.filter("lines is not null").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("block_no", line.alias("t")))).alias("b"))
    return rows.select("doc", "page", F.array_join(F.flatten(F.transform("b", lambda b: b["t"])), "\n").alias("text"))


def title_pages(blocks: DataFrame) -> DataFrame:
    """``(doc, serial_prefixes, applicable_models)`` of every document by its first page: prefixes in their order; models of
    the serial lines, else those named above the first serial line. Empty lists where the page names none."""
    x = blocks.select("doc").distinct().join(_page_text(blocks.filter("page = 1")).select("doc", "text"), "doc", "left")
    text, at = F.coalesce("text", F.lit("")), F.regexp_instr(F.coalesce("text", F.lit("")), F.lit(ft.SERIAL_ANY))
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(ft.SERIAL_MODEL), F.lit(2)))
    above = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    product = F.array_distinct(F.regexp_extract_all(above, F.lit(ft.PRODUCT_MODEL), F.lit(1)))
    prefixes = F.array_distinct(F.regexp_extract_all(text, F.lit(ft.SERIAL_ANY), F.lit(1)))
    return x.select("doc", prefixes.alias("serial_prefixes"), F.array_sort(F.when(F.size(named) > 0, named).otherwise(product)).alias("applicable_models"))


def page_sections(blocks: DataFrame) -> DataFrame:
    """``(doc, page, section)``: the section that a page's running header names."""
    rows = _page_text(blocks.filter(F.col("bbox.y0") < BODY_TOP)).withColumn("section", F.regexp_extract("text", ft.SECTION, 1))
    return rows.filter("section <> ''").select("doc", "page", "section")


def page_facts(blocks: DataFrame) -> DataFrame:
    """``(doc, page, icodes, footer_code, prefixes)`` of every page, as the acceptance gate takes them."""
    pages = blocks.select("doc", "page").distinct().join(_page_text(blocks), ["doc", "page"], "left").withColumn("t", F.coalesce("text", F.lit("")))
    code = F.regexp_extract("t", ft.PUBLICATION, 0)
    return pages.select(
        "doc", "page", F.array_distinct(F.regexp_extract_all("t", F.lit(ft.ICODE), F.lit(0))).alias("icodes"), F.when(code != "", code).alias("footer_code"), F.array_distinct(F.regexp_extract_all("t", F.lit(ft.PREFIX_UP), F.lit(1))).alias("prefixes")
    )
