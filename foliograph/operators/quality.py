"""Invariants of chunks, each a table of violations, and the acceptance gate of a publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ICODE_DENSITY, FOOTER_RATIO, LEAST_PAGES, BANNER_COVERAGE = 0.35, 0.80, 20, 0.9


def bad_citations(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")) | F.col("page_start").isNull())


def unattached_warnings(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.col("chunk_type") == "procedure") & F.col("has_warning") & (F.col("step_count") == 0))


def warning_coverage(banners: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(banners, captured, ok)``: whether nine tenths of the warning banners became warning blocks."""
    n = banners.agg(F.count("*").alias("banners"))
    m = chunks.agg(F.coalesce(F.sum(F.size(F.filter("safety_blocks", lambda b: b["type"] == "WARNING"))), F.lit(0)).alias("captured"))
    out = n.select("banners", m.scalar().alias("captured"))
    return out.withColumn("ok", F.col("captured") >= BANNER_COVERAGE * F.col("banners"))


def split_tables(parts: DataFrame) -> DataFrame:
    """Runs of table elements (of ``(doc, proc, part_index, src, run)``) that fall into more than one part."""
    return parts.groupBy("doc", "proc", "run").agg(F.countDistinct("part_index").alias("parts")).filter("parts > 1")


def captions_alone(rows: DataFrame) -> DataFrame:
    """Table captions without table content on either side, up to the next heading or caption, within ``(doc, proc)``.

    ``rows`` have ``caption`` and ``content`` flags; barriers are headings and captions.
    """
    # Both frames grow row by row, the second from the end, so the cost is linear in a procedure.
    w = Window.partitionBy("doc", "proc")
    back, ahead = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("seq"), F.col("seq").desc()))
    wall = F.col("kind").isin("h1", "h2", "h3") | F.col("caption")
    x = rows.withColumns({"_wb": F.max(F.when(wall, F.col("seq"))).over(back), "_cb": F.max(F.when(F.col("content"), F.col("seq"))).over(back)})
    x = x.withColumns({"_wa": F.min(F.when(wall, F.col("seq"))).over(ahead), "_ca": F.min(F.when(F.col("content"), F.col("seq"))).over(ahead)})
    near = (F.col("_cb").isNotNull() & (F.col("_wb").isNull() | (F.col("_cb") > F.col("_wb")))) | (F.col("_ca").isNotNull() & (F.col("_wa").isNull() | (F.col("_ca") < F.col("_wa"))))
    return x.filter(F.col("caption") & ~near).drop("_wb", "_cb", "_wa", "_ca")


def publication_stats(docs: DataFrame, chunks: DataFrame, vessel: list[str]) -> DataFrame:
    """Per manual: distinct icodes and pages, their density against the threshold, and whether a serial prefix is the vessel's.
    A manual without prefixes is universal."""
    n = chunks.groupBy("doc_id").agg(F.countDistinct("icode").alias("icodes"), F.countDistinct("page_start").alias("pages"))
    d = docs.select(F.col("id").alias("doc_id"), "serial_prefixes")
    ours = F.array(*[F.lit(v) for v in vessel])
    return n.join(d, "doc_id").select(
        "doc_id",
        "icodes",
        "pages",
        F.round(F.col("icodes") / F.col("pages"), 6).alias("density"),
        ((F.size("serial_prefixes") == 0) | (F.size(F.array_intersect("serial_prefixes", ours)) > 0)).alias("prefix_ok"),
        (F.col("icodes") / F.col("pages") >= ICODE_DENSITY).alias("density_ok"),
    )


def accept(pages: DataFrame, vessel: list[str]) -> DataFrame:
    """The gate over page rows ``(doc, page, icodes array, footer_code, prefixes array)``: five checks, all must hold."""
    codes = pages.filter("footer_code is not null").groupBy("doc", "footer_code").agg(F.count("*").alias("n"))
    mode = codes.groupBy("doc").agg(F.max_by("footer_code", F.struct("n", "footer_code")).alias("code"), F.max("n").alias("with_code"))
    stats = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.size(F.array_distinct(F.flatten(F.collect_set("icodes")))).alias("icodes"), F.array_distinct(F.flatten(F.collect_set("prefixes"))).alias("prefixes"))
    x = stats.join(mode, "doc", "left").fillna(0, ["with_code"])
    ours = F.array(*[F.lit(v) for v in vessel])
    x = x.withColumns(
        {
            "pages_ok": F.col("pages") >= LEAST_PAGES,
            "density_ok": F.col("icodes") / F.col("pages") >= ICODE_DENSITY,
            "footer_ok": F.col("with_code") / F.col("pages") >= FOOTER_RATIO,
            "code_ok": F.col("code").isNotNull(),
            "prefix_ok": (F.size("prefixes") == 0) | (F.size(F.array_intersect("prefixes", ours)) > 0),
        }
    )
    return x.withColumn("accepted", F.col("pages_ok") & F.col("density_ok") & F.col("footer_ok") & F.col("code_ok") & F.col("prefix_ok"))


def layout_invariants(elements: DataFrame, banners: DataFrame, **kw) -> dict[str, DataFrame]:
    """Violations that show only beside the layout: tables in several parts, captions alone, warning banners without a block."""
    from foliograph.operators import procedures as pr

    rows = pr.procedures(elements).withColumn("doc", F.col("doc").cast("string"))
    runs = pr.table_runs(rows)
    cut = pr.parts(rows, **kw).filter(F.col("kind").isin(*pr.TABLES)).select("doc", "proc", "part_index", "src")
    placed = cut.join(runs, ["doc", "proc"]).filter(F.col("src").between(F.col("first_seq"), F.col("last_seq")))
    caption = (F.col("kind") == "table") & F.col("table_rows").isNull()
    flagged = rows.withColumn("caption", caption).withColumn("content", F.col("kind").isin(*pr.TABLES) & ~caption)
    blocks = pr.safety_blocks(rows).groupBy("doc").agg(F.collect_list(F.struct("type", "text")).alias("safety_blocks"))
    return {"split tables": split_tables(placed), "captions alone": captions_alone(flagged), "banners without warning": warning_coverage(banners, blocks).filter("not ok")}
