"""Queries on dense, sparse and hybrid search. The stated queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions import vectors as fv
from foliograph.operators import families as fam
from foliograph.operators import search
from foliograph.plans import families as pf
from foliograph.plans import views
from foliograph.plans.catalogue import query
from foliograph.plans.views import CHUNKS, DOCS, with_

VEC = "vec AS (SELECT id, doc_id, embedding_dense::DOUBLE[] AS v FROM chk WHERE embedding_dense IS NOT NULL AND len(embedding_dense) = 64 AND len(list_filter(embedding_dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding_dense, lambda x: x <> 0)) > 0)"
DENSE = "dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, r.id, round(list_cosine_similarity(q.v, r.v), 9) AS score FROM {q} q JOIN {r} r ON r.id <> q.id WHERE q.id % 50 = 0)) WHERE rank <= 50)"
POST = "post AS (SELECT id, token, max(w)::DOUBLE AS weight FROM (SELECT id, unnest(map_keys(embedding_sparse)) AS token, unnest(map_values(embedding_sparse)) AS w FROM chk) WHERE w > 0 GROUP BY 1, 2)"
SPARSE = "sparse_all AS (SELECT q.id AS query_id, r.id, round(sum(q.weight * r.weight), 9) AS score FROM post q JOIN post r ON r.token = q.token AND r.id <> q.id WHERE q.id % 50 = 0 GROUP BY 1, 2 HAVING round(sum(q.weight * r.weight), 9) > 0)"
SPARSE_TOP = "sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sparse_all) WHERE rank <= 50)"


def fuse(miss: str = "51", name: str = "fused") -> str:
    part = lambda c: f"coalesce(1.0::DOUBLE / (60 + coalesce({c}, {miss})), 0)"
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS place FROM (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank, {part('d.rank')} + {part('s.rank')} AS rrf FROM dense d FULL JOIN sparse s ON s.query_id = d.query_id AND s.id = d.id))"


BASE = (CHUNKS, VEC, DENSE.format(q="vec", r="vec"))


def _rows(spark, folder, *more):
    return views.chunks(spark, folder, "embedding_dense", "embedding_sparse", *more)


def _asked(rows):
    return rows.filter("id % 50 = 0")


@query(with_(*BASE) + "SELECT query_id, id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, folder):
    rows = views.chunks(spark, folder, "embedding_dense")
    return search.dense_topk(_asked(rows), rows).withColumn("score", F.round("score", 6))


@query(with_(DOCS, CHUNKS, pf.TOKENS, pf.COVER, pf.KEPT, pf.ASKED_SQL, VEC, f"ok AS (SELECT v.* FROM vec v JOIN chk c ON c.id = v.id JOIN docs d ON d.id = c.doc_id WHERE list_has_any({pf.EFF}, (SELECT list(model) FROM asked)))", DENSE.format(q="vec", r="ok")) + "SELECT query_id, id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def dense_topk_filtered(spark, folder):
    """The filter on models stands before the scoring."""
    rows, docs = views.chunks(spark, folder, "embedding_dense", "applicable_models"), views.docs(spark, folder)
    asked = fam.expand(fam.family_cover(rows, docs), pf.ASKED)
    ok = fam.applicable(fam.with_docs(rows, docs), asked)
    return search.dense_topk(_asked(rows), ok, k=10).withColumn("score", F.round("score", 6))


@query(with_(CHUNKS, VEC) + "SELECT c.id, round(list_cosine_similarity(v.v, e.embedding::DOUBLE[]), 6) AS cosine FROM chk c JOIN vec v ON v.id = c.id JOIN embeddings e ON e.vec_id = c.id")
def cosine_scores(spark, folder):
    rows = views.chunks(spark, folder, "embedding_dense").filter(fv.usable("embedding_dense", 64))
    other = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    return rows.join(other, "id").select("id", F.round(fv.cosine("embedding_dense", "embedding"), 6).alias("cosine"))


@query(with_(CHUNKS, POST) + "SELECT id, token, round(weight, 6) AS weight FROM post")
def postings(spark, folder):
    return search.postings(views.chunks(spark, folder, "embedding_sparse")).withColumn("weight", F.round("weight", 6))


@query(with_(CHUNKS, POST) + "SELECT id, token, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, token) AS r FROM post) WHERE r <= 5")
def postings_heaviest(spark, folder):
    """The five heaviest tokens of each chunk (a top-k report)."""
    return search.postings(views.chunks(spark, folder, "embedding_sparse"), heaviest=5).withColumn("weight", F.round("weight", 6))


@query(with_(CHUNKS, POST, SPARSE) + "SELECT query_id, id, round(score, 6) AS score FROM sparse_all")
def sparse_scores(spark, folder):
    rows = views.chunks(spark, folder, "embedding_sparse")
    return search.sparse_scores(search.postings(_asked(rows)), search.postings(rows)).withColumn("score", F.round("score", 6))


@query(with_(CHUNKS, POST, SPARSE, SPARSE_TOP) + "SELECT query_id, id, round(score, 6) AS score, rank FROM sparse")
def sparse_topk(spark, folder):
    rows = views.chunks(spark, folder, "embedding_sparse")
    scores = search.sparse_scores(search.postings(_asked(rows)), search.postings(rows))
    return search.ranked(scores, "query_id", "score", "id", 50).withColumn("score", F.round("score", 6))


@query(with_(CHUNKS, POST, SPARSE, SPARSE_TOP) + "SELECT q.id AS query_id, count(s.id) AS n FROM chk q LEFT JOIN sparse s ON s.query_id = q.id WHERE q.id % 50 = 0 GROUP BY 1")
def sparse_window_size(spark, folder):
    rows = views.chunks(spark, folder, "embedding_sparse")
    top = search.ranked(search.sparse_scores(search.postings(_asked(rows)), search.postings(rows)), "query_id", "score", "id", 50)
    n = top.groupBy("query_id").agg(F.count("*").alias("n"))
    return _asked(rows).select(F.col("id").alias("query_id")).join(n, "query_id", "left").fillna(0, ["n"])


@query(with_(*BASE, POST, SPARSE, SPARSE_TOP, fuse()) + "SELECT query_id, id, dense_rank, sparse_rank, round(rrf, 9) AS rrf, place FROM fused WHERE place <= 20")
def hybrid_retrieve(spark, folder):
    rows = _rows(spark, folder)
    return search.hybrid(_asked(rows), rows).withColumn("rrf", F.round("rrf", 9))


@query(with_(*BASE, POST, SPARSE, SPARSE_TOP, fuse("NULL")) + "SELECT query_id, id, round(rrf, 9) AS rrf, place FROM fused WHERE place <= 20")
def rrf_no_impute(spark, folder):
    rows = _rows(spark, folder)
    dense = search.dense_topk(_asked(rows), rows)
    sparse = search.ranked(search.sparse_scores(search.postings(_asked(rows)), search.postings(rows)), "query_id", "score", "id", 50)
    return search.rrf(dense, sparse, miss=None).select("query_id", "id", F.round("rrf", 9).alias("rrf"), "place")


@query(with_(DOCS, *BASE, POST, SPARSE, SPARSE_TOP, fuse()) + "SELECT f.query_id, f.id, f.place, round(f.rrf, 9) AS rrf, c.heading, c.page_start, c.page_end, c.chunk_type, d.filename FROM fused f JOIN chk c ON c.id = f.id JOIN docs d ON d.id = c.doc_id WHERE place <= 6")
def hybrid_retrieve_details(spark, folder):
    rows = _rows(spark, folder)
    hits = search.hybrid(_asked(rows), rows, top=6).select("query_id", "id", "place", F.round("rrf", 9).alias("rrf"))
    wide = views.chunks(spark, folder, "heading", "page_start", "page_end", "chunk_type")
    found = search.details(hits, wide, ["doc_id", "heading", "page_start", "page_end", "chunk_type"])
    docs = views.docs(spark, folder).select(F.col("id").alias("doc_id"), "filename")
    return found.join(docs, "doc_id").drop("doc_id")


@query(with_(CHUNKS, POST) + "SELECT id, '{' || array_to_string(list_transform(list_sort(list((token + 1, weight))), lambda e: printf('%d:%.8g', e[1], e[2])), ',') || '}/250002' AS literal FROM post WHERE token BETWEEN 0 AND 250001 GROUP BY id")
def sparse_literal(spark, folder):
    rows = views.chunks(spark, folder, "embedding_sparse").filter(F.size("embedding_sparse") > 0)
    return rows.select("id", fv.sparse_index("embedding_sparse").alias("m")).filter(F.size("m") > 0).select("id", fv.sparse_literal("m").alias("literal"))
