"""Table schemas, their creation, and bringing older rows up to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFETY = "array<struct<type:string,text:string>>"
DOCUMENTS = "id long, filename string, title string, page_count int, indexed_at timestamp, applicable_models array<string>, serial_prefixes array<string>"
CHUNKS = (
    "id long, heading string, icode string, section string, page_start int, page_end int, chunk_type string, content string, smcs_codes array<string>, part_numbers array<string>, illustrations array<string>, "
    f"applicable_models array<string>, control_module string, maintenance_interval string, step_count int, part_index int, part_total int, safety_blocks {SAFETY}, has_warning boolean, context_prefix string, "
    "embedding_dense array<float>, embedding_sparse map<int,float>, created_at timestamp, doc_id long"
)
ELEMENTS = "doc string, seq long, kind string, text string, page int, col string, table_rows array<array<string>>, smcs_codes array<string>, graphic_id string, part_numbers array<string>"
RANKS = "arm string, qid string, branch string, pos int, chunk_id long, score double"
CACHE = "cache_key string, prefix string"


def bootstrap(spark: SparkSession, database: str) -> None:
    """Create the database and its tables where they aren't there yet. Chunks are partitioned by document, which is what a
    re-index replaces; statistics of the other columns prune within."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.documents ({DOCUMENTS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.chunks ({CHUNKS}) USING parquet PARTITIONED BY (doc_id)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.prefix_cache ({CACHE}) USING parquet")


def evolve(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with exactly the columns of ``schema``: missing ones are added, arrays empty and others null; null arrays become empty, as an
    empty list of models means that the document's apply; columns that the schema lacks are dropped."""
    out = []
    for f in T.DataType.fromDDL(schema).fields:
        have = F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        vector = f.name.startswith("embedding")
        out.append((F.coalesce(have, F.array().cast(f.dataType)) if isinstance(f.dataType, T.ArrayType) and not vector else have).alias(f.name))
    return rows.select(*out)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: the check that stands in for a unique constraint."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
