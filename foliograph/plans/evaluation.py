"""Queries on fusion, ranks and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.operators import evaluate, fusionlab
from foliograph.plans import views
from foliograph.plans.catalogue import query
from foliograph.plans.views import ASKS, CHUNKS, DOCS, RESULTS, with_
from foliograph.sources.tables import table

TARGETS = "tgt AS (SELECT DISTINCT g.id AS qid, c.id AS chunk_id FROM (SELECT id, target_chunk.doc AS doc, target_chunk.heading_startswith AS h, target_chunk.content_contains AS t, target_chunk.control_module AS m FROM golden_set WHERE target_chunk IS NOT NULL) g JOIN docs d ON d.filename = g.doc JOIN chk c ON c.doc_id = d.id WHERE (g.h IS NULL OR starts_with(c.heading, g.h)) AND (g.t IS NULL OR contains(c.content, g.t)) AND (g.m IS NULL OR c.control_module = g.m))"
HITS = "hits AS (SELECT DISTINCT a.ask_id, t.chunk_id FROM asks a JOIN tgt t ON t.qid = a.qid)"
RANKS = "rk AS (SELECT * FROM (SELECT ask_id, chunk_id, 'dense' AS branch, dense AS score, row_number() OVER (PARTITION BY ask_id ORDER BY dense DESC, chunk_id) AS rank FROM asks WHERE dense IS NOT NULL UNION ALL SELECT ask_id, chunk_id, 'sparse', sparse, row_number() OVER (PARTITION BY ask_id ORDER BY sparse DESC, chunk_id) FROM asks WHERE sparse > 0 UNION ALL SELECT ask_id, chunk_id, 'rrf', rrf_score, row_number() OVER (PARTITION BY ask_id ORDER BY rrf_score DESC, chunk_id) FROM asks WHERE rrf_score IS NOT NULL UNION ALL SELECT ask_id, chunk_id, 'rerank', rerank, row_number() OVER (PARTITION BY ask_id ORDER BY rerank DESC, chunk_id) FROM asks WHERE rerank IS NOT NULL) WHERE rank <= 50)"
BEST = "best AS (SELECT r.ask_id, r.branch, min(r.rank) AS best FROM rk r JOIN hits h ON h.ask_id = r.ask_id AND h.chunk_id = r.chunk_id GROUP BY 1, 2)"
REACH = "reach AS (SELECT DISTINCT a.ask_id, a.qid, a.arm, g.category FROM asks a JOIN golden_set g ON g.id = a.qid WHERE a.qid IN (SELECT qid FROM tgt))"


def _targets(spark, folder):
    return evaluate.targets(table(spark, folder, "golden_set"), views.chunks(spark, folder, "heading", "content", "control_module"), views.docs(spark, folder))


def _asked(asks):
    return asks.select("ask_id", "qid", "arm").distinct()


def _hits(spark, folder, asks):
    return _asked(asks).join(_targets(spark, folder), "qid").select("ask_id", "chunk_id").distinct()


def _ranks(asks):
    out = None
    for branch, c, kept in (("dense", "dense", F.col("dense").isNotNull()), ("sparse", "sparse", F.col("sparse") > 0), ("rrf", "rrf_score", F.col("rrf_score").isNotNull()), ("rerank", "rerank", F.col("rerank").isNotNull())):
        w = Window.partitionBy("ask_id").orderBy(F.col("score").desc(), "chunk_id")
        part = asks.filter(kept).select("ask_id", "chunk_id", F.lit(branch).alias("branch"), F.col(c).alias("score")).withColumn("rank", F.row_number().over(w)).filter("rank <= 50")
        out = part if out is None else out.unionByName(part)
    return out


@query(with_(DOCS, CHUNKS, TARGETS) + "SELECT qid, chunk_id FROM tgt")
def target_predicate(spark, folder):
    return _targets(spark, folder)


@query(with_(DOCS, CHUNKS, TARGETS) + "SELECT g.id AS qid, count(t.chunk_id) AS n_targets, count(t.chunk_id) > 0 AS reachable FROM golden_set g LEFT JOIN tgt t ON t.qid = g.id GROUP BY 1")
def reachable_targets(spark, folder):
    n = _targets(spark, folder).groupBy("qid").agg(F.count("*").alias("n"))
    return table(spark, folder, "golden_set").select(F.col("id").alias("qid")).join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_targets"), F.col("n").isNotNull().alias("reachable"))


@query(with_(ASKS, RANKS) + "SELECT ask_id, chunk_id, branch, round(score, 6) AS score, rank FROM rk")
def rank_lists(spark, folder):
    return _ranks(views.asks(spark, folder)).withColumn("score", F.round("score", 6))


@query(with_(ASKS) + "SELECT ask_id, chunk_id, srz FROM (SELECT ask_id, chunk_id, row_number() OVER (PARTITION BY ask_id ORDER BY sparse DESC, chunk_id) AS srz FROM asks WHERE sparse IS NOT NULL AND abs(sparse) > 1e-9) WHERE srz <= 50")
def rank_lists_nonzero(spark, folder):
    ranks = fusionlab.branch_ranks(views.asks(spark, folder), "ask_id", "dense", "sparse", "chunk_id")
    return ranks.filter("srz is not null").select("ask_id", "chunk_id", "srz")


@query(with_(DOCS, CHUNKS, ASKS, TARGETS, HITS, RANKS, BEST) + "SELECT ask_id, branch, best FROM best")
def target_best_rank(spark, folder):
    asks = views.asks(spark, folder)
    return evaluate.best_ranks(_ranks(asks), _hits(spark, folder, asks))


@query(with_(DOCS, CHUNKS, ASKS, TARGETS, HITS, RANKS, BEST, REACH) + "SELECT r.arm, b.branch, count(*) AS n, count(*) FILTER (WHERE x.best = 1) AS first, count(*) FILTER (WHERE x.best <= 6) AS in_top, count(*) FILTER (WHERE x.best IS NULL) AS missing, round(sum(coalesce(1.0::DOUBLE / x.best, 0)) / count(*), 6) AS mrr FROM reach r CROSS JOIN (VALUES ('dense'), ('sparse'), ('rrf'), ('rerank')) b(branch) LEFT JOIN best x ON x.ask_id = r.ask_id AND x.branch = b.branch GROUP BY 1, 2")
def eval_mrr(spark, folder):
    asks = views.asks(spark, folder)
    best = evaluate.best_ranks(_ranks(asks), _hits(spark, folder, asks))
    reach = _asked(asks).join(_targets(spark, folder).select("qid").distinct(), "qid", "left_semi")
    rows = reach.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in ("dense", "sparse", "rrf", "rerank")]))).join(best, ["ask_id", "branch"], "left")
    return evaluate.retrieval_metrics(rows, ["arm", "branch"])


def _variant_values() -> str:
    return ", ".join(f"('{a}', '{b}', {c}, {'NULL' if d is None else d}, {e}::DOUBLE, {str(f).lower()})" for a, b, c, d, e, f in fusionlab.VARIANTS)


LAB = f"""var(variant, kind, k, miss, ws, drop_zero) AS (VALUES {_variant_values()}),
d1 AS (SELECT * FROM (SELECT ask_id, chunk_id, row_number() OVER (PARTITION BY ask_id ORDER BY dense DESC, chunk_id) AS dr FROM asks WHERE dense IS NOT NULL) WHERE dr <= 50),
s1 AS (SELECT * FROM (SELECT ask_id, chunk_id, row_number() OVER (PARTITION BY ask_id ORDER BY sparse DESC, chunk_id) AS sr FROM asks WHERE sparse IS NOT NULL) WHERE sr <= 50),
z1 AS (SELECT * FROM (SELECT ask_id, chunk_id, row_number() OVER (PARTITION BY ask_id ORDER BY sparse DESC, chunk_id) AS srz FROM asks WHERE abs(sparse) > 1e-9) WHERE srz <= 50),
both1 AS (SELECT * FROM d1 FULL JOIN s1 USING (ask_id, chunk_id) FULL JOIN z1 USING (ask_id, chunk_id)),
lab AS (SELECT variant, kind, k, miss, ws, ask_id, chunk_id, dr, CASE WHEN drop_zero THEN srz ELSE sr END AS r FROM both1 CROSS JOIN var),
scored AS (SELECT *, round(CASE kind WHEN 'impute' THEN 1.0::DOUBLE / (k + coalesce(dr, miss)) + 1.0::DOUBLE / (k + coalesce(r, miss)) WHEN 'max' THEN greatest(coalesce(1.0::DOUBLE / (k + dr), 0), coalesce(ws / (k + r), 0)) ELSE coalesce(1.0::DOUBLE / (k + dr), 0) + coalesce(ws / (k + r), 0) END, 12) AS score FROM lab WHERE dr IS NOT NULL OR r IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY variant, ask_id ORDER BY score DESC, dr NULLS LAST, r NULLS LAST) AS place FROM scored),
labbest AS (SELECT v.variant, e.ask_id, e.arm, e.category, min(CASE WHEN h.chunk_id IS NOT NULL THEN p.place END) AS best FROM reach e CROSS JOIN var v LEFT JOIN placed p ON p.variant = v.variant AND p.ask_id = e.ask_id LEFT JOIN hits h ON h.ask_id = p.ask_id AND h.chunk_id = p.chunk_id GROUP BY 1, 2, 3, 4)"""
LABBED = with_(DOCS, CHUNKS, ASKS, TARGETS, HITS, REACH, LAB)


def _lab(spark, folder):
    asks = views.asks(spark, folder)
    ranks = fusionlab.branch_ranks(asks, "ask_id", "dense", "sparse", "chunk_id")
    places = fusionlab.fused(ranks, "ask_id", "chunk_id")
    found = _targets(spark, folder)
    category = table(spark, folder, "golden_set").select(F.col("id").alias("qid"), "category")
    reach = _asked(asks).join(found.select("qid").distinct(), "qid", "left_semi").join(category, "qid")
    best = fusionlab.target_ranks(places, _hits(spark, folder, asks), reach, "ask_id", "chunk_id")
    return best.join(reach, "ask_id")


@query(LABBED + "SELECT variant, arm, category = 'ru_no_anchor' AS unanchored, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, median(coalesce(best, 999)::DOUBLE) AS median_rank, count(*) FILTER (WHERE best = 1) AS first FROM labbest GROUP BY 1, 2, 3")
def fusion_variants(spark, folder):
    rows = _lab(spark, folder).withColumn("unanchored", F.col("category") == "ru_no_anchor")
    return fusionlab.summary(rows, ["variant", "arm", "unanchored"])


@query(LABBED + "SELECT b.variant, count(*) FILTER (WHERE coalesce(b.best, 999) > coalesce(c.best, 999)) AS worse, greatest(max(coalesce(b.best, 999) - coalesce(c.best, 999)), 0) AS worst FROM labbest b JOIN labbest c ON c.ask_id = b.ask_id AND c.variant = 'control k=60' GROUP BY 1")
def fusion_regressions(spark, folder):
    return fusionlab.against_control(_lab(spark, folder), "ask_id")


@query(LABBED + "SELECT ask_id, best AS least_top_k FROM labbest WHERE variant = 'impute 51 k=60'")
def least_rrf_top_k(spark, folder):
    """The smallest cut of the fused list that keeps a target: its fused rank."""
    return _lab(spark, folder).filter("variant = 'impute 51 k=60'").select("ask_id", F.col("best").alias("least_top_k"))


TRACE = "SELECT k.ask_id, k.chunk_id, max(CASE WHEN branch = 'dense' THEN rank END) AS dense_rank, max(CASE WHEN branch = 'sparse' THEN rank END) AS sparse_rank, max(CASE WHEN branch = 'rrf' THEN rank END) AS rrf_rank, max(CASE WHEN branch = 'rerank' THEN rank END) AS rerank_rank, round(1.0::DOUBLE / (60 + coalesce(max(CASE WHEN branch = 'dense' THEN rank END), 51)) + 1.0::DOUBLE / (60 + coalesce(max(CASE WHEN branch = 'sparse' THEN rank END), 51)), 9) AS contribution FROM rk k JOIN hits h ON h.ask_id = k.ask_id AND h.chunk_id = k.chunk_id GROUP BY 1, 2"


@query(with_(DOCS, CHUNKS, ASKS, TARGETS, HITS, RANKS) + TRACE)
def stage_trace(spark, folder):
    """Where each target stands in each stage; a branch that misses it contributes as if at rank 51."""
    asks = views.asks(spark, folder)
    rows = _ranks(asks).join(_hits(spark, folder, asks), ["ask_id", "chunk_id"], "left_semi")
    out = rows.groupBy("ask_id", "chunk_id").agg(*[F.max(F.when(F.col("branch") == b, F.col("rank"))).alias(f"{b}_rank") for b in ("dense", "sparse", "rrf", "rerank")])
    part = lambda c: 1.0 / (60 + F.coalesce(c, F.lit(51)))
    return out.withColumn("contribution", F.round(part("dense_rank") + part("sparse_rank"), 9))


RIVALS = "riv AS (SELECT DISTINCT h.ask_id, c.id AS chunk_id FROM hits h JOIN chk t ON t.id = h.chunk_id JOIN chk c ON c.doc_id = t.doc_id AND c.heading = t.heading WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.ask_id = h.ask_id AND x.chunk_id = c.id))"


def _rivals(spark, folder, hits):
    names = views.chunks(spark, folder, "heading").select(F.col("id").alias("chunk_id"), "doc_id", "heading")
    at = hits.join(names, "chunk_id").select("ask_id", "doc_id", "heading").distinct()
    near = at.join(names, ["doc_id", "heading"]).select("ask_id", "chunk_id").distinct()
    return near.join(hits, ["ask_id", "chunk_id"], "left_anti")


@query(with_(DOCS, CHUNKS, ASKS, TARGETS, HITS, RIVALS) + "SELECT ask_id, chunk_id FROM riv")
def variant_rivals(spark, folder):
    return _rivals(spark, folder, _hits(spark, folder, views.asks(spark, folder)))


@query(with_(DOCS, CHUNKS, ASKS, TARGETS, HITS, RIVALS) + "SELECT a.ask_id, max(CASE WHEN k.own THEN rerank END) AS right_score, max(CASE WHEN NOT k.own THEN rerank END) AS rival_score, round(max(CASE WHEN k.own THEN rerank END) - max(CASE WHEN NOT k.own THEN rerank END), 6) AS gap FROM asks a JOIN (SELECT *, true AS own FROM hits UNION ALL SELECT *, false FROM riv) k ON k.ask_id = a.ask_id AND k.chunk_id = a.chunk_id GROUP BY 1")
def variant_gap(spark, folder):
    asks = views.asks(spark, folder)
    hits = _hits(spark, folder, asks)
    return evaluate.variant_gaps(asks, hits, _rivals(spark, folder, hits))


@query(with_(ASKS) + "SELECT ask_id, backend, count(*) AS n, round(avg(rerank), 6) AS mean_top6 FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY rerank DESC, chunk_id) AS r FROM asks WHERE rerank IS NOT NULL) WHERE r <= 6 GROUP BY 1, 2")
def rerank_top6_mean(spark, folder):
    asks = views.asks(spark, folder).filter("rerank is not null")
    w = Window.partitionBy("ask_id").orderBy(F.col("rerank").desc(), "chunk_id")
    top = asks.withColumn("r", F.row_number().over(w)).filter("r <= 6")
    return top.groupBy("ask_id", "backend").agg(F.count("*").alias("n"), F.round(F.avg("rerank"), 6).alias("mean_top6"))


LOW = "lower(coalesce(r.answer, ''))"
CHECKED = f"""chkd AS (SELECT r.result_id, g.category, r.error,
list_transform(list_filter(coalesce(g.expected_contains, []), lambda e: len(list_filter(e, lambda a: contains({LOW}, lower(a)))) = 0), lambda e: array_to_string(e, ' | ')) AS missed,
list_filter(coalesce(g.must_not_contain, []), lambda w: contains({LOW}, lower(w))) AS banned,
list_transform(regexp_extract_all(coalesce(r.answer, ''), '(?:стр\\.|p\\.)\\s*(\\d+)', 1), lambda p: p::INT) AS cited, g.expected_pages AS pages
FROM res r JOIN golden_set g ON g.id = r.id),
verdict AS (SELECT *, CASE WHEN len(pages) > 0 THEN len(list_filter(cited, lambda p: p BETWEEN pages[1] AND pages[-1])) > 0 END AS pages_ok, len(missed) = 0 AND len(banned) = 0 AND coalesce(error, '') = '' AS passes FROM chkd)"""


def _checked(spark, folder):
    return evaluate.check_answers(views.results(spark, folder).drop("category"), table(spark, folder, "golden_set"))


@query(with_(RESULTS, CHECKED) + "SELECT result_id, array_to_string(missed, ' ; ') AS missed, array_to_string(banned, ' ; ') AS banned, array_to_string(cited, ',') AS cited, pages_ok, passes FROM verdict")
def eval_answer_checks(spark, folder):
    rows = _checked(spark, folder)
    return rows.select("result_id", F.array_join("missed", " ; ").alias("missed"), F.array_join("banned", " ; ").alias("banned"), F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), "pages_ok", "passes")


@query(with_(RESULTS, CHECKED) + "SELECT category, count(*) FILTER (WHERE passes) AS passed, count(*) AS total, floor(100 * count(*) FILTER (WHERE passes) / count(*))::INT AS percent FROM verdict GROUP BY 1")
def eval_by_category(spark, folder):
    return evaluate.by_category(_checked(spark, folder).withColumn("category", F.col("golden_category")), "category", "passes")


@query(with_(RESULTS) + "SELECT run_id, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE error <> '') AS errors, count(DISTINCT id) AS questions FROM res GROUP BY 1")
def eval_by_run(spark, folder):
    rows = views.results(spark, folder)
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if(F.col("error") != "").alias("errors"), F.countDistinct("id").alias("questions"))


@query("SELECT id, category, len(coalesce(expected_contains, [])) > 0 AS has_expectation FROM golden_set WHERE category IN ('part_number', 'number_accuracy') AND len(coalesce(expected_contains, [])) > 0")
def golden_filter(spark, folder):
    g = table(spark, folder, "golden_set").withColumn("has_expectation", F.size(F.coalesce("expected_contains", F.array().cast("array<array<string>>"))) > 0)
    return g.filter(F.col("category").isin("part_number", "number_accuracy") & F.col("has_expectation")).select("id", "category", "has_expectation")


@query("SELECT category, count(*) AS skipped FROM golden_set WHERE len(coalesce(expected_contains, [])) = 0 GROUP BY 1")
def golden_skipped(spark, folder):
    """What a filter leaves out is announced beside what it keeps."""
    g = table(spark, folder, "golden_set").filter(F.size(F.coalesce("expected_contains", F.array().cast("array<array<string>>"))) == 0)
    return g.groupBy("category").agg(F.count("*").alias("skipped"))
