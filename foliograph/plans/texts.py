"""Queries on text functions, answers, grounding, loading and the log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.functions import text as ft
from foliograph.operators import answer, catalog
from foliograph.operators import families as fam
from foliograph.plans import views
from foliograph.plans.catalogue import query
from foliograph.plans.views import ASKS, CHUNKS, DOCS, RESULTS, with_
from foliograph.sources.tables import table

PART = r"\b(\d{3}-\d{4}|\d[A-Z]-\d{4})\b"
MEASURE = ft.MEASURE
MEASURES = "regexp_extract_all({}, '" + MEASURE + "', 0)"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{PART}', 1))), ',') AS part_numbers FROM documents WHERE text IS NOT NULL")
def part_numbers(spark, folder):
    d = table(spark, folder, "documents").filter("text is not null")
    return d.select("doc_id", F.array_join(ft.part_numbers(F.col("text")), ",").alias("part_numbers"))


@query("SELECT doc_id, array_to_string(" + MEASURES.format("text") + ", ',') AS measurements FROM documents WHERE text IS NOT NULL")
def measurements(spark, folder):
    d = table(spark, folder, "documents").filter("text is not null")
    return d.select("doc_id", F.array_join(ft.measurements(F.col("text")), ",").alias("measurements"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 'ru' WHEN length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) / length(text) > 0.1 THEN 'ru' ELSE 'en' END AS language FROM documents WHERE text IS NOT NULL")
def language_detect(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", ft.language(F.col("text")).alias("language"))


@query(with_(RESULTS) + "SELECT result_id, coalesce(contains(answer, 'не содержится в O&M Manual') OR contains(answer, 'is not in the O&M Manual'), false) AS declines FROM res")
def refusal_flags(spark, folder):
    return views.results(spark, folder).select("result_id", F.coalesce(ft.declines(F.col("answer")), F.lit(False)).alias("declines"))


@query(with_(RESULTS) + r"SELECT result_id, array_to_string(regexp_extract_all(coalesce(answer, ''), '(?:стр\.|p\.)\s*(\d+)', 1), ',') AS cited FROM res")
def cited_pages(spark, folder):
    return views.results(spark, folder).select("result_id", F.array_join(ft.cited_pages(F.coalesce("answer", F.lit(""))).cast("array<string>"), ",").alias("cited"))


@query(with_(CHUNKS) + r"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(content, 'SMCS Code:\s*([\d\-;,\s]+)', 1), '[;,]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ',') AS codes FROM chk")
def smcs_codes(spark, folder):
    return views.chunks(spark, folder, "content").select("id", F.array_join(ft.smcs_codes(F.col("content")), ",").alias("codes"))


@query(with_(CHUNKS) + r"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\b(3[59]\d{2}[BC])\b', 1))), ',') AS models, regexp_extract(content, '\b(g\d{8})\b', 1) AS graphic FROM chk")
def models_and_graphics(spark, folder):
    c = views.chunks(spark, folder, "content")
    return c.select("id", F.array_join(ft.models(F.col("content")), ",").alias("models"), F.regexp_extract("content", ft.GRAPHIC, 1).alias("graphic"))


@query("SELECT id, regexp_replace(trim(regexp_replace(coalesce(filename, ''), '(?i)\\.pdf$', '')), '^$', 'unknown source') AS publication FROM (SELECT DISTINCT id, filename FROM manuals)")
def publication_ids(spark, folder):
    return views.docs(spark, folder).select("id", ft.publication_id(F.col("filename")).alias("publication"))


KEYED = r"keyed AS (SELECT c.id, substring(sha256(regexp_replace(coalesce(nullif(trim(d.filename), ''), 'unknown document'), '(?i)\.pdf$', '') || chr(10) || c.content || chr(10) || '1'), 1, 16) AS cache_key FROM chk c JOIN docs d ON d.id = c.doc_id)"


def _keyed(spark, folder):
    return catalog.with_keys(fam.with_docs(views.chunks(spark, folder, "content"), views.docs(spark, folder)))


@query(with_(DOCS, CHUNKS, KEYED) + "SELECT id, cache_key FROM keyed")
def cache_key(spark, folder):
    return _keyed(spark, folder).select("id", "cache_key")


@query(with_(DOCS, CHUNKS, KEYED) + "SELECT id FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM keyed WHERE id % 3 = 0)")
def cache_miss(spark, folder):
    rows = _keyed(spark, folder).select("id", "cache_key")
    cache = rows.filter("id % 3 = 0").select("cache_key", F.lit("p").alias("prefix"))
    return catalog.cached(rows, cache)[1].select("id")


@query(with_(CHUNKS) + "SELECT id, md5(CASE WHEN context_prefix IS NULL OR context_prefix = '' THEN content ELSE context_prefix || chr(10) || chr(10) || content END) AS text_md5 FROM chk")
def embed_text(spark, folder):
    c = views.chunks(spark, folder, "content", "context_prefix")
    return c.select("id", F.md5(catalog.embed_text(F.col("context_prefix"), F.col("content"))).alias("text_md5"))


@query(with_(DOCS, CHUNKS) + "SELECT c.id, 'Applies to: ' || CASE WHEN trim(coalesce(c.control_module, '')) <> '' THEN concat_ws(' · ', 'engines with ' || trim(c.control_module), nullif(array_to_string(c.applicable_models, ', '), '')) WHEN len(c.applicable_models) > 0 THEN array_to_string(c.applicable_models, ', ') WHEN len(d.applicable_models) > 0 THEN array_to_string(d.applicable_models, ', ') END AS line FROM chk c JOIN docs d ON d.id = c.doc_id")
def applicability_line(spark, folder):
    rows = fam.with_docs(views.chunks(spark, folder, "applicable_models", "control_module"), views.docs(spark, folder))
    return rows.select("id", answer.applicability_line().alias("line"))


CITE = "CASE WHEN c.page_start = c.page_end THEN 'p. ' || c.page_start ELSE 'pp. ' || c.page_start || '–' || c.page_end END"
TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY rrf_score DESC, chunk_id) AS place FROM asks) WHERE place <= {n})"
PUB = r"coalesce(nullif(trim(regexp_replace(coalesce(d.filename, ''), '(?i)\.pdf$', '')), ''), 'unknown source')"


def _top(spark, folder, n: int, *columns: str):
    w = Window.partitionBy("ask_id").orderBy(F.col("rrf_score").desc(), "chunk_id")
    top = views.asks(spark, folder).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    rows = fam.with_docs(views.chunks(spark, folder, *columns), views.docs(spark, folder))
    return top.join(rows, top["chunk_id"] == rows["id"])


@query(with_(DOCS, CHUNKS, ASKS, TOP.format(n=6)) + f"SELECT t.ask_id, md5(string_agg('--- Fragment ' || t.place || ' — SOURCE [' || {PUB} || ', ' || {CITE} || '] — ' || coalesce(c.heading, '') || ' ---' || chr(10) || coalesce(c.content, '') || chr(10), chr(10) ORDER BY t.place)) AS context_md5 FROM top t JOIN chk c ON c.id = t.chunk_id JOIN docs d ON d.id = c.doc_id GROUP BY 1")
def context_build(spark, folder):
    x = answer.context(_top(spark, folder, 6, "heading", "content", "page_start", "page_end"))
    return x.select("ask_id", F.md5("context").alias("context_md5"))


CLAIMS = "list_concat(" + MEASURES.format("coalesce(r.answer, '')") + f", regexp_extract_all(coalesce(r.answer, ''), '{PART}', 1))"


@query(with_(RESULTS) + f"SELECT result_id, len(c) AS claims_checked, len(lost) = 0 AS ok, array_to_string(lost, ',') AS unverified FROM (SELECT result_id, c, list_filter(c, lambda x: NOT contains(regexp_replace(lower(source), '\\s+', '', 'g'), regexp_replace(lower(x), '\\s+', '', 'g'))) AS lost FROM (SELECT r.result_id, {CLAIMS} AS c, coalesce(array_to_string(list_transform(g.expected_contains, lambda e: array_to_string(e, ' ')), ' '), '') || ' ' || coalesce(g.notes, '') AS source FROM res r JOIN golden_set g ON g.id = r.id))")
def grounding_check(spark, folder):
    """Claims of each answer held against what the golden question states."""
    g = table(spark, folder, "golden_set").select(F.col("id").alias("gid"), F.concat(F.coalesce(F.array_join(F.transform("expected_contains", lambda e: F.array_join(e, " ")), " "), F.lit("")), F.lit(" "), F.coalesce("notes", F.lit(""))).alias("source"))
    r = views.results(spark, folder)
    x = r.join(g, r["id"] == g["gid"]).select("result_id", answer.grounding("answer", "source").alias("v"))
    return x.select("result_id", F.size("v.claims").alias("claims_checked"), "v.ok", F.array_join("v.unverified", ",").alias("unverified"))


@query(with_(DOCS, CHUNKS, ASKS, TOP.format(n=6)) + "SELECT t.ask_id, t.backend, count(*) AS n, round(max(1 / (1 + exp(-rerank))), 6) AS top_score, round(max(ln(greatest(least(1 / (1 + exp(-rerank)), 1 - 1e-9), 1e-9) / (1 - greatest(least(1 / (1 + exp(-rerank)), 1 - 1e-9), 1e-9)))), 4) AS top_logit, array_to_string(list_sort(list(DISTINCT c.control_module) FILTER (WHERE c.control_module IS NOT NULL)), ',') AS control_modules, count(DISTINCT c.control_module) > 1 AS cm_ambiguous FROM top t JOIN chk c ON c.id = t.chunk_id JOIN docs d ON d.id = c.doc_id GROUP BY 1, 2")
def scorelog_record(spark, folder):
    x = answer.score_record(_top(spark, folder, 6, "control_module"), "ask_id")
    return x.select("ask_id", "backend", "n", "top_score", "top_logit", F.nullif(F.array_join("control_modules", ","), F.lit("")).alias("control_modules"), "cm_ambiguous")


@query(with_(ASKS) + "SELECT ask_id, chunk_id, round(1 / (1 + exp(-rerank)), 6) AS p FROM asks WHERE rerank IS NOT NULL")
def logit_transform(spark, folder):
    return views.asks(spark, folder).filter("rerank is not null").select("ask_id", "chunk_id", F.round(ft.sigmoid(F.col("rerank")), 6).alias("p"))


def _new_docs(docs):
    return docs.filter("id % 4 <> 0").withColumns({"applicable_models": F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("NEW"))), "title": F.when(F.col("id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("again"))})


@query(with_(DOCS) + "SELECT o.id, o.filename, CASE WHEN n.id IS NULL OR n.id % 5 = 0 THEN o.title ELSE 'again' END AS title, array_to_string(CASE WHEN n.id IS NULL OR n.id % 3 = 0 THEN o.applicable_models ELSE ['NEW'] END, ',') AS models FROM docs o LEFT JOIN docs n ON n.filename = o.filename AND n.id % 4 <> 0")
def upsert_documents(spark, folder):
    docs = views.docs(spark, folder)
    out = catalog.upsert_documents(docs, _new_docs(views.docs(spark, folder)))
    return out.select("id", "filename", "title", F.array_join("applicable_models", ",").alias("models"))


@query(with_(CHUNKS) + "SELECT id, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'again' ELSE chunk_type END AS chunk_type FROM chk")
def reindex_document(spark, folder):
    c = views.chunks(spark, folder, "chunk_type")
    fresh = c.filter("doc_id % 7 = 0").withColumn("chunk_type", F.lit("again"))
    return catalog.reindex(c, fresh).select("id", "doc_id", "chunk_type")


@query(with_(DOCS, CHUNKS) + "SELECT id, doc_id FROM chk WHERE doc_id IN (SELECT id FROM docs WHERE id % 5 <> 0)")
def cascade_delete(spark, folder):
    return catalog.cascade(views.chunks(spark, folder), views.docs(spark, folder).filter("id % 5 <> 0"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    from foliograph.streaming.scorelog import event_windows as windows

    return windows(table(spark, folder, "events"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))) GROUP BY user_id, s")
def event_sessions(spark, folder):
    from foliograph.streaming.scorelog import event_sessions as sessions

    return sessions(table(spark, folder, "events"))


def embedded_texts(spark, folder):
    """The offline embedder over all chunk texts: length of the dense vector and number of weights."""
    from foliograph.operators.models import embed

    x = views.chunks(spark, folder, "content").select("id", embed(F.col("content")).alias("e"))
    return x.select("id", F.size("e.dense").alias("dims"), F.size("e.sparse").alias("terms"))


query()(embedded_texts)


def reranked(spark, folder):
    """The offline reranker over the candidates of all asked questions, best six."""
    from foliograph.operators.models import rerank

    g = table(spark, folder, "golden_set").select(F.col("id").alias("gid"), "question")
    rows = _top(spark, folder, 20, "content")
    rows = rows.join(g, rows["qid"] == g["gid"]).withColumn("logit", rerank(F.col("question"), F.col("content")))
    w = Window.partitionBy("ask_id").orderBy(F.col("logit").desc(), "place")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 6").select("ask_id", "chunk_id", "r", F.round("logit", 6).alias("logit"))


query()(reranked)
