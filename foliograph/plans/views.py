"""The tables the catalogues read, each row once, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.sources.tables import latest, table

NONE = "CAST([] AS VARCHAR[])"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Manuals by their last indexing; arrays are never null."""
    out = latest(table(spark, folder, "manuals"), ["id"], "indexed_at", ["id", "filename", "title", "page_count", "indexed_at", "applicable_models", "serial_prefixes"])
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("applicable_models", "serial_prefixes")})


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Chunks by their last delivery, with ``id``, ``doc_id`` and the named columns only."""
    wanted = ["id", "doc_id", *[c for c in columns if c not in ("id", "doc_id")]]
    rows = table(spark, folder, "chunks")
    if "embedding_sparse" in wanted:
        # Maps have no order; their entries have.
        rows = rows.withColumn("embedding_sparse", F.array_sort(F.map_entries("embedding_sparse")))
    out = latest(rows, ["id"], "created_at", wanted)
    if "embedding_sparse" in wanted:
        out = out.withColumn("embedding_sparse", F.map_from_entries("embedding_sparse"))
    if "applicable_models" in wanted:
        out = out.withColumn("applicable_models", F.coalesce("applicable_models", F.array().cast("array<string>")))
    return out


def asks(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of asked questions, each once."""
    return latest(table(spark, folder, "retrieved_chunks"), ["ask_id", "chunk_id"], "retrieved_at", ["ask_id", "chunk_id", "qid", "arm", "backend", "dense", "sparse", "rrf_score", "rerank"])


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of evaluation runs, each once."""
    return latest(table(spark, folder, "eval_results"), ["result_id"], "run_at", ["result_id", "run_id", "id", "question", "category", "passed", "answer", "missing", "forbidden", "pages_cited", "error"])


DOCS = "docs AS (SELECT * EXCLUDE (rn) REPLACE (coalesce(applicable_models, []) AS applicable_models, coalesce(serial_prefixes, []) AS serial_prefixes) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM manuals) WHERE rn = 1)"
CHUNKS = "chk AS (SELECT * EXCLUDE (rn) REPLACE (coalesce(applicable_models, []) AS applicable_models) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM chunks) WHERE rn = 1)"
ASKS = "asks AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ask_id, chunk_id ORDER BY retrieved_at DESC) AS rn FROM retrieved_chunks) WHERE rn = 1)"
RESULTS = "res AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY run_at DESC) AS rn FROM eval_results) WHERE rn = 1)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
