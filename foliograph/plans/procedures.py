"""Queries on elements, procedures and chunk statistics.

The element stream is derived from the lines of ``documents.text``: kinds follow from the document's number and the line's.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.functions import text as ft
from foliograph.operators import procedures as pr
from foliograph.plans import views
from foliograph.plans.catalogue import query
from foliograph.plans.views import CHUNKS, DOCS, with_
from foliograph.sources.tables import table

KIND = "CASE WHEN n = 0 THEN 'icode' WHEN n = 1 THEN 'h1' WHEN (doc_id + n) % 11 = 0 THEN 'h2' WHEN (doc_id + n) % 17 = 0 THEN 'h3' WHEN (doc_id + n) % 7 = 0 THEN 'warning' WHEN (doc_id + n) % 5 = 0 THEN 'step' WHEN (doc_id + n) % 13 = 0 THEN 'notice' WHEN (doc_id + n) % 19 < 2 THEN 'table_row' ELSE 'para' END"
EL = f"line AS (SELECT doc_id, source AS doc, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL), el AS (SELECT doc, doc_id * 100000 + n AS seq, {KIND} AS kind, text, (1 + n // 10)::INT AS page, doc_id FROM line)"
PROC = "pr AS (SELECT *, sum((kind = 'icode')::INT) OVER (PARTITION BY doc ORDER BY seq) AS proc FROM el)"
P = with_(EL, PROC)


def _elements(spark, folder):
    d = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.col("source").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    return d.select("doc", (F.col("doc_id") * 100000 + F.col("n")).alias("seq"), F.expr(KIND).alias("kind"), "text", (1 + F.floor(F.col("n") / 10)).cast("int").alias("page"))


def _rows(spark, folder):
    return pr.procedures(_elements(spark, folder))


@query(P + "SELECT doc, proc, count(*) AS n, count(*) FILTER (WHERE kind = 'step') AS steps, min(page) AS page_start, max(page) AS page_end FROM pr GROUP BY 1, 2")
def procedure_groups(spark, folder):
    return _rows(spark, folder).groupBy("doc", "proc").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "step").alias("steps"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def _level_sql(level: str) -> str:
    return f"SELECT doc, proc, '{level}' AS l FROM (SELECT *, sum((kind = '{level}')::INT) OVER (PARTITION BY doc, proc ORDER BY seq) AS seg FROM pr) WHERE seg > 0 GROUP BY 1, 2 HAVING max(seg) >= 2 AND count(DISTINCT CASE WHEN kind = 'step' THEN seg END) >= 2"


@query(P + f"SELECT k.doc, k.proc, min(l.l) AS level FROM (SELECT DISTINCT doc, proc FROM pr) k LEFT JOIN ({_level_sql('h2')} UNION ALL {_level_sql('h3')}) l ON l.doc = k.doc AND l.proc = k.proc GROUP BY 1, 2")
def variant_level(spark, folder):
    return pr.variant_level(_rows(spark, folder))


@query(P + "SELECT doc, proc, seg, count(*) AS n, sum(length(text)) AS chars FROM (SELECT *, sum((kind = 'h2')::INT) OVER (PARTITION BY doc, proc ORDER BY seq) AS seg FROM pr) GROUP BY 1, 2, 3")
def split_segments(spark, folder):
    return pr.segments(_rows(spark, folder), "h2").groupBy("doc", "proc", "seg").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


SAFE = "sb AS (SELECT *, sum(CASE WHEN kind = 'notice' OR (kind = 'warning' AND coalesce(before, '') <> 'warning') THEN 1 ELSE 0 END) OVER (PARTITION BY doc, proc ORDER BY seq) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc, proc ORDER BY seq) AS before FROM pr))"


@query(with_(EL, PROC, SAFE) + "SELECT doc, proc, block, upper(min(kind)) AS type, string_agg(CASE WHEN kind = 'notice' THEN trim(regexp_replace(text, '^NOTICE', '')) ELSE text END, ' ' ORDER BY seq) AS text FROM sb WHERE kind IN ('warning', 'notice') GROUP BY 1, 2, 3")
def safety_blocks(spark, folder):
    return pr.safety_blocks(_rows(spark, folder))


@query(with_(EL, PROC) + "SELECT doc, proc, run, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM (SELECT *, sum(CASE WHEN kind = 'table_row' AND coalesce(before, '') <> 'table_row' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, proc ORDER BY seq) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc, proc ORDER BY seq) AS before FROM pr)) WHERE kind = 'table_row' GROUP BY 1, 2, 3")
def table_runs(spark, folder):
    return pr.table_runs(_rows(spark, folder))


LINE = "CASE WHEN kind IN ('icode', 'smcs') THEN NULL WHEN kind = 'h1' THEN '# ' || text WHEN kind = 'h2' THEN '## ' || text WHEN kind = 'h3' THEN '### ' || text WHEN kind = 'warning' THEN 'WARNING: ' || text WHEN kind = 'notice' THEN 'NOTICE: ' || trim(regexp_replace(text, '^NOTICE', '')) WHEN kind = 'table_row' THEN '  | ' || text ELSE text END"


@query(P + f"SELECT doc, proc, md5(string_agg({LINE}, chr(10) || chr(10) ORDER BY seq)) AS content_md5, length(string_agg({LINE}, chr(10) || chr(10) ORDER BY seq)) AS n_chars FROM pr WHERE kind <> 'icode' GROUP BY 1, 2")
def render_chunk(spark, folder):
    return pr.render(_rows(spark, folder), ["doc", "proc"]).select("doc", "proc", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


@query(P + "SELECT chunk_type, count(*) AS n FROM (SELECT CASE WHEN bool_or(kind = 'step') THEN 'procedure' WHEN bool_or(kind = 'table_row') THEN 'table' ELSE 'reference' END AS chunk_type FROM pr GROUP BY doc, proc) GROUP BY 1")
def chunk_type_counts(spark, folder):
    return _rows(spark, folder).groupBy("doc", "proc").agg(pr.chunk_type().alias("chunk_type")).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query(P + r"SELECT doc, proc, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(text, '\b(\d{3}-\d{4}|\d[A-Z]-\d{4})\b', 1))))), ',') AS part_numbers, count(*) FILTER (WHERE kind = 'step')::INT AS step_count FROM pr GROUP BY 1, 2")
def chunk_meta_arrays(spark, folder):
    return pr.metadata(_rows(spark, folder), ["doc", "proc"]).select("doc", "proc", F.array_join("part_numbers", ",").alias("part_numbers"), "step_count")


@query(P + "SELECT doc, proc, min(page) AS page_start, max(page) AS page_end, CASE WHEN min(page) = max(page) THEN 'p. ' || min(page) ELSE 'pp. ' || min(page) || '–' || max(page) END AS citation FROM pr GROUP BY 1, 2")
def page_span(spark, folder):
    x = _rows(spark, folder).groupBy("doc", "proc").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return x.withColumn("citation", ft.citation(F.col("page_start"), F.col("page_end")))


def built_chunks(spark, folder):
    """All chunks of the stream, split and assembled; checked against a sequential version in the tests."""
    out = pr.build_chunks(_elements(spark, folder))
    return out.select("doc", "proc", "part_index", "part_total", "heading", "icode", "chunk_type", "step_count", "page_start", "page_end", "has_warning", F.length("content").alias("n_chars"))


query()(built_chunks)


STATS = "SELECT n, sorted[n // 2 + 1] AS median, sorted[floor(n * 0.9)::INT + 1] AS p90, sorted[n] AS longest FROM (SELECT count(*) AS n, list_sort(list(length(content))) AS sorted FROM chk)"


@query(with_(CHUNKS) + STATS)
def chunk_length_stats(spark, folder):
    """Upper median, ninetieth percentile and maximum as order statistics, found from counts of lengths; no list is gathered."""
    lengths = views.chunks(spark, folder, "content").groupBy(F.length("content").alias("l")).agg(F.count("*").alias("c"))
    # One row per distinct length: their number is bounded by the longest text.
    w = Window.orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    cum = lengths.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("l")))
    return cum.agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 0.9)).alias("p90"), F.max("l").alias("longest"))


@query(with_(CHUNKS) + "SELECT chunk_type, count(*) AS n, count(*) FILTER (WHERE has_warning) AS warned, sum(step_count) AS steps FROM chk GROUP BY 1")
def chunk_counts(spark, folder):
    x = views.chunks(spark, folder, "chunk_type", "has_warning", "step_count")
    return x.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if("has_warning").alias("warned"), F.sum("step_count").alias("steps"))


NUMS = r"num AS (SELECT id, unnest(range(1, len(l) + 1)) AS i, unnest(l)::BIGINT AS x FROM (SELECT id, regexp_extract_all(content, '(?m)^(\d{1,9})\.\s', 1) AS l FROM chk) WHERE len(l) >= 2)"


@query(with_(CHUNKS, NUMS) + "SELECT id, before, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS before FROM num) WHERE before IS NOT NULL AND x <> 1 AND x <> before + 1) WHERE r = 1")
def step_gap_check(spark, folder):
    """The first gap of step numbers in each chunk."""
    c = views.chunks(spark, folder, "content").select("id", F.regexp_extract_all("content", F.lit(r"(?m)^(\d{1,9})\.\s"), 1).alias("l")).filter(F.size("l") >= 2)
    n = F.transform("l", lambda x: x.cast("long"))
    pair = F.zip_with(F.slice(n, 1, F.size("l") - 1), F.slice(n, 2, F.size("l")), lambda a, b: F.struct(a.alias("before"), b.alias("x")))
    gaps = F.filter(pair, lambda p: (p["x"] != 1) & (p["x"] != p["before"] + 1))
    return c.withColumn("g", F.get(gaps, F.lit(0))).filter("g is not null").select("id", "g.before", "g.x")


@query(with_(CHUNKS) + "SELECT id, page_start, page_end FROM chk WHERE page_start < 1 OR page_end < page_start OR page_start IS NULL")
def citation_check(spark, folder):
    from foliograph.operators.quality import bad_citations

    return bad_citations(views.chunks(spark, folder, "page_start", "page_end")).select("id", "page_start", "page_end")


@query(with_(CHUNKS) + "SELECT id, chunk_type, step_count FROM chk WHERE chunk_type = 'procedure' AND has_warning AND step_count = 0")
def warning_attachment(spark, folder):
    from foliograph.operators.quality import unattached_warnings

    return unattached_warnings(views.chunks(spark, folder, "chunk_type", "has_warning", "step_count")).select("id", "chunk_type", "step_count")


@query(
    with_(CHUNKS)
    + "SELECT id, doc_id, part_index FROM (SELECT id, doc_id, part_index, len(coalesce(safety_blocks, [])) AS own, max(len(coalesce(safety_blocks, []))) OVER (PARTITION BY doc_id, heading, icode) AS most FROM chk WHERE part_index > 0) WHERE own = 0 AND most > 0"
)
def lost_safety_blocks(spark, folder):
    """Parts without safety blocks whose sibling parts (same manual, heading and code) have some."""
    x = views.chunks(spark, folder, "heading", "icode", "part_index", "safety_blocks").filter("part_index > 0").select("id", "doc_id", "heading", "icode", "part_index", (F.coalesce(F.size("safety_blocks"), F.lit(0)) > 0).alias("_own"))
    some = x.groupBy("doc_id", "heading", "icode").agg(F.bool_or("_own").alias("_some")).filter("_some")
    lost = x.filter("not _own").alias("x").join(some.alias("s"), (F.col("x.doc_id") == F.col("s.doc_id")) & F.col("x.heading").eqNullSafe(F.col("s.heading")) & F.col("x.icode").eqNullSafe(F.col("s.icode")), "left_semi")
    return lost.select("id", "doc_id", "part_index")


@query(with_(DOCS, CHUNKS) + "SELECT d.id AS doc_id, count(DISTINCT c.icode) AS icodes, count(DISTINCT c.page_start) AS pages, round(count(DISTINCT c.icode)::DOUBLE / count(DISTINCT c.page_start), 6) AS density, len(d.serial_prefixes) = 0 OR len(list_intersect(d.serial_prefixes, ['BR9', 'BN9', 'KZ3'])) > 0 AS prefix_ok, count(DISTINCT c.icode)::DOUBLE / count(DISTINCT c.page_start) >= 0.35 AS density_ok FROM docs d JOIN chk c ON c.doc_id = d.id GROUP BY d.id, d.serial_prefixes")
def publication_gate(spark, folder):
    from foliograph.operators.quality import publication_stats

    return publication_stats(views.docs(spark, folder), views.chunks(spark, folder, "icode", "page_start"), ["BR9", "BN9", "KZ3"])


# Cases of splitting: (case, kinds in order); an element's text is its number. Expected: (case, part, elements in order).
SPLIT_CASES = [
    ("variant_h2", "icode h1 warning para h2 step step h2 step"),
    ("variant_h3", "icode h1 h2 h3 step h3 step step"),
    ("header_steps", "icode h1 step h2 step h2 step"),
    ("warn_runs", "icode h1 warning warning notice warning step"),
    ("one_variant_without_steps", "icode h1 h2 para h2 step"),
    ("no_heading", "icode para step"),
]
SPLIT_WANT = [
    ("variant_h2", 1, "1 2 3 4 5 6"), ("variant_h2", 2, "1 2 7 8"), ("variant_h3", 1, "1 2 3 4"), ("variant_h3", 2, "1 2 5 6 7"), ("header_steps", 1, "1 2 3 4"), ("header_steps", 2, "1 5 6"),
    ("warn_runs", 0, "1 2 3 4 5 6"), ("one_variant_without_steps", 0, "1 2 3 4 5"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {p}, '{e}')" for c, p, e in SPLIT_WANT) + ") AS t(fixture, part, elements)")
def split_cases(spark, folder):
    """Where procedures fall apart, on literal cases."""
    rows = [(case, n, kind, str(n), 1) for case, kinds in SPLIT_CASES for n, kind in enumerate(kinds.split())]
    rows = spark.createDataFrame(rows, "doc string, seq long, kind string, text string, page int")
    cut = pr.parts(pr.procedures(rows))
    out = cut.groupBy("doc", "part_index").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("l"))
    return out.select(F.col("doc").alias("fixture"), F.col("part_index").alias("part"), F.array_join(F.transform("l", lambda e: e["text"]), " ").alias("elements"))


# Cases of the gate: (manual, pages, pages with a code, pages with the footer, prefixes). Expected: (manual, accepted).
GATE_CASES = [("good", 24, 20, 24, ["BR9"]), ("universal", 24, 20, 24, []), ("short", 12, 12, 12, ["BR9"]), ("sparse", 24, 3, 24, ["BR9"]), ("footer", 24, 20, 12, ["BR9"]), ("nameless", 24, 20, 0, ["BR9"]), ("foreign", 24, 20, 24, ["ZZ1"])]
GATE_WANT = ", ".join(f"('{m}', {'true' if m in ('good', 'universal') else 'false'})" for m, *_ in GATE_CASES)


@query(f"SELECT * FROM (VALUES {GATE_WANT}) AS t(doc, accepted)")
def gate_cases(spark, folder):
    """The five checks of the acceptance gate, one manual failing each."""
    from foliograph.operators.quality import accept

    rows = [(m, p, [f"i{p:08}"] if p < codes else [], "SEBU0001" if p < footer else None, prefixes) for m, pages, codes, footer, prefixes in GATE_CASES for p in range(pages)]
    pages = spark.createDataFrame(rows, "doc string, page int, icodes array<string>, footer_code string, prefixes array<string>")
    return accept(pages, ["BR9", "BN9", "KZ3"]).select("doc", "accepted")


# Cases of the invariants: kinds in order; a star marks a caption or a table with cells.
INVARIANT_CASES = [("whole", "icode h1 table table_row step"), ("alone", "icode h1 table para step"), ("behind", "icode h1 table_row table step"), ("walled", "icode h1 table h2 table_row step")]


@query("SELECT * FROM (VALUES ('alone', 'captions alone', 2), ('walled', 'captions alone', 2), ('', 'banners without warning', 0)) AS t(fixture, violation, seq)")
def invariant_cases(spark, folder):
    """Captions without a table, tables in several parts and banners without a block, on literal cases."""
    from foliograph.operators.quality import layout_invariants

    rows = [(case, n, kind, f"Table {n}" if kind == "table" else str(n), 1) for case, kinds in INVARIANT_CASES for n, kind in enumerate(kinds.split())]
    rows = spark.createDataFrame(rows, "doc string, seq long, kind string, text string, page int").withColumn("table_rows", F.lit(None).cast("array<array<string>>"))
    bad = layout_invariants(rows, spark.range(1).select(F.lit("whole").alias("doc")))
    shape = lambda df, name, doc, seq: df.select(doc.alias("fixture"), F.lit(name).alias("violation"), seq.cast("int").alias("seq"))
    out = shape(bad["captions alone"], "captions alone", F.col("doc"), F.col("seq"))
    out = out.unionByName(shape(bad["split tables"], "split tables", F.col("doc"), F.col("run")))
    return out.unionByName(shape(bad["banners without warning"], "banners without warning", F.lit(""), F.lit(0)))
