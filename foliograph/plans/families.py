"""Queries on model families and applicability."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import families as fam
from foliograph.plans import views
from foliograph.plans.catalogue import query
from foliograph.plans.views import CHUNKS, DOCS, with_

ASKED = ["3528B", "3521C"]
NARROW = ["3528B"]
GEN = r"regexp_replace({}, '^[0-9]+', '')"
TOKENS = "tok AS (SELECT DISTINCT t.token, t.doc_id FROM (SELECT unnest(applicable_models) AS token, doc_id FROM chk) t JOIN docs d ON d.id = t.doc_id WHERE NOT list_contains(d.applicable_models, t.token))"
COVER = f"cover AS (SELECT t.token, t.doc_id, list_sort(list(DISTINCT m.m)) AS covers, count(DISTINCT m.m) AS n FROM tok t JOIN (SELECT id, unnest(applicable_models) AS m FROM docs) m ON m.id = t.doc_id WHERE {GEN.format('m.m')} = {GEN.format('t.token')} GROUP BY 1, 2)"
RIVAL = "SELECT 1 FROM cover o WHERE o.token <> c.token AND list_contains(o.covers, c.token) AND (o.n > c.n OR (o.n = c.n AND o.token < c.token))"
KEPT = f"kept AS (SELECT * FROM cover c WHERE NOT EXISTS ({RIVAL}))"
ASKED_SQL = f"asked AS (SELECT unnest({ASKED}) AS model UNION SELECT k.token FROM (SELECT token, unnest(covers) AS m FROM kept) k WHERE k.m IN {tuple(ASKED)})"
EFF = "CASE WHEN len(c.applicable_models) > 0 THEN c.applicable_models ELSE d.applicable_models END"


def _frames(spark, folder):
    return views.chunks(spark, folder, "applicable_models"), views.docs(spark, folder)


@query(with_(DOCS, CHUNKS, TOKENS) + "SELECT token, doc_id FROM tok")
def family_tokens(spark, folder):
    return fam.family_tokens(*_frames(spark, folder))


@query(with_(DOCS, CHUNKS, TOKENS, COVER) + "SELECT token, doc_id, array_to_string(covers, ',') AS covers, n FROM cover")
def family_cover(spark, folder):
    return fam.family_cover(*_frames(spark, folder)).withColumn("covers", F.array_join("covers", ","))


@query(with_(DOCS, CHUNKS, TOKENS, COVER, KEPT) + "SELECT token, doc_id, array_to_string(covers, ',') AS covers, n FROM kept")
def families_acyclic(spark, folder):
    return fam.families(fam.family_cover(*_frames(spark, folder))).withColumn("covers", F.array_join("covers", ","))


@query(with_(DOCS, CHUNKS, TOKENS, COVER) + f"SELECT token, doc_id, array_to_string(covers, ',') AS covers FROM cover c WHERE EXISTS ({RIVAL})")
def families_dropped(spark, folder):
    return fam.dropped_families(fam.family_cover(*_frames(spark, folder))).select("token", "doc_id", F.array_join("covers", ",").alias("covers"))


@query(with_(DOCS, CHUNKS, TOKENS, COVER, KEPT) + f"SELECT d.filename, k.token, {GEN.format('k.token')} AS generation, array_to_string(k.covers, ',') AS covers FROM kept k JOIN docs d ON d.id = k.doc_id")
def family_table(spark, folder):
    chunks, docs = _frames(spark, folder)
    kept = fam.families(fam.family_cover(chunks, docs))
    from foliograph.functions.text import generation

    return kept.join(docs.select(F.col("id").alias("doc_id"), "filename"), "doc_id").select("filename", "token", generation(F.col("token")).alias("generation"), F.array_join("covers", ",").alias("covers"))


@query(with_(DOCS, CHUNKS, TOKENS, COVER) + "SELECT d.filename, t.token, count(DISTINCT c.id) AS n_chunks FROM tok t ANTI JOIN cover v ON v.token = t.token AND v.doc_id = t.doc_id JOIN docs d ON d.id = t.doc_id JOIN (SELECT id, doc_id, unnest(applicable_models) AS m FROM chk) c ON c.doc_id = t.doc_id AND c.m = t.token GROUP BY 1, 2")
def family_orphans(spark, folder):
    return fam.orphans(*_frames(spark, folder))


@query(with_(DOCS, CHUNKS, TOKENS, COVER, KEPT, ASKED_SQL) + "SELECT DISTINCT model FROM asked")
def expand_query_models(spark, folder):
    return fam.expand(fam.family_cover(*_frames(spark, folder)), ASKED)


@query(with_(DOCS, CHUNKS) + f"SELECT c.id, array_to_string({EFF}, ',') AS models, CASE WHEN len(c.applicable_models) > 0 THEN 'own' ELSE 'document' END AS applicability_source FROM chk c JOIN docs d ON d.id = c.doc_id")
def effective_applicability(spark, folder):
    rows = fam.with_docs(*_frames(spark, folder))
    return rows.select("id", F.array_join(fam.effective(), ",").alias("models"), F.when(F.size("applicable_models") > 0, "own").otherwise("document").alias("applicability_source"))


@query(with_(DOCS, CHUNKS, TOKENS, COVER, KEPT, ASKED_SQL) + f"SELECT c.id, c.doc_id FROM chk c JOIN docs d ON d.id = c.doc_id WHERE list_has_any({EFF}, (SELECT list(model) FROM asked))")
def model_filter(spark, folder):
    chunks, docs = _frames(spark, folder)
    return fam.applicable(fam.with_docs(chunks, docs), fam.expand(fam.family_cover(chunks, docs), ASKED)).select("id", "doc_id")


@query(with_(DOCS, CHUNKS, TOKENS, COVER, KEPT, ASKED_SQL) + f"SELECT c.id FROM chk c JOIN docs d ON d.id = c.doc_id WHERE list_has_any({EFF}, (SELECT list(model) FROM asked)) AND NOT list_has_any({EFF}, {NARROW})")
def reach_gain(spark, folder):
    chunks, docs = _frames(spark, folder)
    wide = fam.expand(fam.family_cover(chunks, docs), ASKED)
    narrow = spark.createDataFrame([(m,) for m in NARROW], "model string")
    return fam.reach_gain(fam.with_docs(chunks, docs), wide, narrow).select("id")


@query(with_(CHUNKS) + "SELECT id, doc_id, control_module FROM chk WHERE control_module = 'ADEM III'")
def control_module_filter(spark, folder):
    return views.chunks(spark, folder, "control_module").filter(F.col("control_module") == "ADEM III")


@query(with_(DOCS, CHUNKS) + "SELECT d.filename, count(*) AS n_chunks, count(*) FILTER (WHERE len(c.applicable_models) = 0) AS inherited, count(DISTINCT c.icode) AS icodes FROM chk c JOIN docs d ON d.id = c.doc_id GROUP BY 1")
def chunks_per_manual(spark, folder):
    rows = fam.with_docs(views.chunks(spark, folder, "applicable_models", "icode"), views.docs(spark, folder))
    return rows.groupBy(F.col("doc_filename").alias("filename")).agg(F.count("*").alias("n_chunks"), F.count_if(F.size("applicable_models") == 0).alias("inherited"), F.countDistinct("icode").alias("icodes"))
