"""Geometry: order, warnings, tables, grids, heading profiles, against sequential versions on random pages."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import layout as ly


def block(n, x0, y0, x1, text="t", size=9.5, flags=0, page=1, kind=0, height=10, doc="d"):
    lines = None if kind else [{"spans": [{"text": text, "size": float(size), "flags": flags}]}]
    return (doc, page, n, kind, {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y0 + height)}, lines)


def frame(spark, blocks):
    return spark.createDataFrame(blocks, ly.BLOCKS)


def read_page(blocks):
    """Band by band, left before right."""
    full = sorted((b for b in blocks if b[1] == "full"), key=lambda b: b[2])
    edges = [b[2] for b in full]
    band = lambda y: sum(e <= y for e in edges)
    return [b[0] for b in sorted(blocks, key=lambda b: (band(b[2]), {"full": 0, "left": 1, "right": 2}[b[1]], b[2], b[0]))]


def test_reading_order_random(spark):
    r = random.Random(4)
    all_blocks, want = [], {}
    for page in range(1, 6):
        ys = r.sample(range(70, 740), 20)
        page_blocks = []
        for n, y in enumerate(ys):
            col = r.choice(["left", "right", "full", "left"])
            x0, x1 = {"left": (60, 300), "right": (320, 550), "full": (60, 550)}[col]
            all_blocks.append(block(n, x0, y, x1, page=page))
            page_blocks.append((n, col, y))
        want[page] = read_page(page_blocks)
    got = ly.reading_order(ly.text_blocks(frame(spark, all_blocks))).orderBy("page", "ord").collect()
    for page in want:
        assert [g.block_no for g in got if g.page == page] == want[page]


def test_warnings_follow_banners(spark):
    bold = ly.BOLD
    blocks = [block(0, 60, 100, 294, kind=1, height=26), block(1, 60, 131, 300, "Hot", flags=bold), block(2, 60, 150, 300, "Still", flags=bold), block(3, 60, 170, 300, "plain"), block(4, 60, 190, 300, "Later", flags=bold), block(5, 320, 131, 550, "Other", flags=bold)]
    f = frame(spark, blocks)
    profiles = spark.createDataFrame([("d", 12.0)], "doc string, h3 double")
    got = ly.warnings_marked(ly.reading_order(ly.text_blocks(f)), f, profiles).filter("warning").collect()
    assert sorted(g.block_no for g in got) == [1, 2]


def test_margins_and_blank_blocks_are_left_out(spark):
    f = frame(spark, [block(0, 60, 59, 300), block(1, 60, 60, 300), block(2, 60, 750, 300), block(3, 60, 751, 300), block(4, 60, 100, 300, "  ")])
    assert sorted(x.block_no for x in ly.text_blocks(f).collect()) == [1, 2]


def test_block_text(spark):
    line = lambda *t: {"spans": [{"text": x, "size": 9.5, "flags": 0} for x in t]}
    f = spark.createDataFrame([("d", 1, 0, 0, {"x0": 60.0, "y0": 100.0, "x1": 300.0, "y1": 110.0}, [line("Tigh", "ten  the"), line("bol- "), line("ts")])], ly.BLOCKS)
    assert ly.text_blocks(f).first().text == "Tighten the bolts"


def test_heading_profile_anchor_and_problems(spark):
    bold = ly.BOLD
    good = [block(0, 60, 100, 300, "i00000001 Head", 15.95, bold), block(1, 60, 120, 300, "Section", 17.9, bold), block(2, 60, 140, 300, "Two", 13.9, bold), block(3, 60, 160, 300, "Three", 12.0, bold), block(4, 60, 180, 300, "Not bold " * 3, 11.0), block(5, 60, 200, 300, "body " * 60, 9.5)]
    p = ly.validated(ly.heading_profile(frame(spark, good))).first()
    assert (p.body, p.h1, p.h2, p.h3, p.h1_anchors, p.h1_agreement, p.problem) == (9.5, 15.9, 13.9, 12.0, 1, 1.0, None)
    for blocks, problem in (([block(0, 60, 100, 300, "x", kind=1)], "no text layer"), ([block(0, 60, 100, 300, "plain")], "no bold size above the body"), ([good[0], good[5]], "fewer than two levels between body and h1")):
        with pytest.raises(ValueError, match=problem):
            ly.validated(ly.heading_profile(frame(spark, blocks)))


def lines(spark, *boxes):
    return spark.createDataFrame([("d", 1, i, "f", *map(float, b)) for i, b in enumerate(boxes)], ly.DRAWINGS)


GRID = [(60, y, 300, y + 1) for y in (100, 120, 140, 160)] + [(x, 100, x + 1, 161) for x in (60, 180, 299)]


def test_regions_skip_the_rule_and_single_lines(spark):
    got = ly.table_regions(lines(spark, *GRID, (55, 62, 560, 63), (320, 400, 500, 401))).collect()
    assert [(g.region, g.x0, g.y0, g.x1, g.y1) for g in got] == [(0, 60.0, 100.0, 300.0, 161.0)]
    assert ly.table_regions(lines(spark, *GRID).limit(0)).count() == 0


def test_grid(spark):
    d = lines(spark, *GRID)
    spans = spark.createDataFrame([("d", 1, t, float(x), float(y), float(x + 20), float(y + 8)) for t, x, y in (("No", 70, 105), ("Gap", 190, 105), ("1", 70, 125), ("0.4", 190, 125), ("mm", 215, 125), ("2", 70, 145))], "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert ly.table_grid(spans, ly.table_regions(d), d).first().table_rows == [["No", "Gap"], ["1", "0.4 mm"], ["2", ""]]


def test_grid_open_at_its_sides_and_merged_head(spark):
    """Only one inner line, none at the sides, none in the first row; a line drawn twice."""
    d = lines(spark, *[(60, y, 300, y + 1) for y in (100, 120, 122, 140, 160)], (180, 121, 181, 161))
    words = [("Gaps", 150, 105), ("No", 70, 128), ("Gap", 190, 128), ("1", 70, 145), ("0.4", 250, 145)]
    spans = spark.createDataFrame([("d", 1, t, float(x), float(y), float(x + 20), float(y + 8)) for t, x, y in words], "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert ly.table_grid(spans, ly.table_regions(d), d).first().table_rows == [["Gaps"], ["No", "Gap"], ["1", "0.4"]]


def test_no_text_of_a_table_is_lost(spark):
    blocks = [block(0, 60, 105, 110, "No"), block(1, 185, 105, 230, "Gap"), block(2, 60, 125, 110, "1"), block(3, 185, 125, 230, "0.4 mm"), block(4, 60, 145, 110, "2")]
    got = ly.extract(frame(spark, blocks), lines(spark, *GRID)).collect()
    assert [(g.kind, g.table_rows) for g in got] == [("table", [["No", "Gap"], ["1", "0.4 mm"], ["2", ""]])]
    # Two vertical lines alone are a region without rows: its blocks keep their texts.
    posts = lines(spark, (60, 100, 61, 161), (60, 100, 300, 101), (299, 100, 300, 161))
    got = ly.extract(frame(spark, blocks), posts).orderBy("seq").collect()
    assert [(g.kind, g.text) for g in got] == [("table_row", t) for t in ("No", "Gap", "1", "0.4 mm", "2")] or [g.kind for g in got] == ["para"] * 5


def test_extract(spark):
    bold = ly.BOLD
    blocks = [block(0, 60, 70, 300, "i00000001 Air/ Shutoff", 15.9, bold), block(1, 60, 85, 300, "SMCS Code: 1105-040; 1106"), block(2, 60, 125, 170, "cell"), block(3, 60, 145, 170, "cell two"), block(4, 60, 200, 300, "Two", 13.9, bold), block(5, 60, 220, 300, "1. Stop."), block(6, 60, 240, 300, "Three", 12.0, bold), block(7, 60, 260, 300, "body " * 60), block(8, 60, 300, 300, "NOTICE Mind."), block(9, 60, 320, 300, "Table 3"), block(10, 60, 340, 300, "Illustration 4 g12345678")]
    got = [(g.kind, g.text) for g in ly.extract(frame(spark, blocks), lines(spark, *GRID)).orderBy("seq").collect()]
    assert got[:4] == [("icode", "i00000001"), ("h1", "Air/Shutoff"), ("smcs", "SMCS Code: 1105-040; 1106"), ("table", "")]
    assert [k for k, _ in got[4:]] == ["h2", "step", "h3", "para", "notice", "table", "illustration"]


def test_rounding_of_sizes(spark):
    from foliograph.functions.text import tenths

    xs = [15.95, 15.85, 9.55, 12.0, 13.949]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tenths(F.col("x"))).collect()]
    assert got == [round(x, 1) for x in xs]
