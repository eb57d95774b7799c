"""Loading documents and chunks: merge, re-index, cascade, prefix cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as ft

ARRAYS = ("applicable_models", "serial_prefixes")


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by filename: a new one is added, a known one keeps its id; of arrays, a new one that isn't empty wins, and of other
    columns a new value that isn't null. New ids follow from the filename. A filename that is new twice counts once, with the
    last ``indexed_at``."""
    rest = [c for c in old.columns if c not in ("id", "filename")]
    w = Window.partitionBy("filename").orderBy(F.col("indexed_at").desc_nulls_last())
    n = new.filter("filename is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    n = n.select(F.col("filename").alias("_f"), *[F.col(c).alias(f"_n_{c}") for c in rest])
    both = old.join(n, old["filename"] == n["_f"], "full_outer")

    def merged(c: str) -> Column:
        if c in ARRAYS:
            return F.when(F.size(F.col(f"_n_{c}")) > 0, F.col(f"_n_{c}")).otherwise(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c)
        return F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c)

    name = F.coalesce("filename", "_f")
    return both.select(F.coalesce(F.col("id"), F.abs(F.xxhash64(name))).alias("id"), name.alias("filename"), *[merged(c) for c in rest])


def reindex(chunks: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """All chunks of the documents that come anew are replaced at once; a reader sees the old or the new ones."""
    return chunks.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def cascade(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document still exists."""
    return chunks.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def overwrite_documents(fresh: DataFrame, path: str) -> None:
    """Replace the partitions of the documents in ``fresh`` only, atomically per partition."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def with_keys(chunks: DataFrame, filename: str = "doc_filename") -> DataFrame:
    return chunks.withColumn("cache_key", ft.cache_key(ft.publication_id(F.col(filename), "unknown document"), F.col("content")))


def cached(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with a known prefix, and those that need one."""
    hits = chunks.join(cache.select("cache_key", "prefix").dropDuplicates(["cache_key"]), "cache_key")
    return hits, chunks.join(cache.select("cache_key"), "cache_key", "left_anti")


def embed_text(prefix: Column, content: Column) -> Column:
    return F.when(prefix.isNull() | (prefix == ""), content).otherwise(F.concat(prefix, F.lit("\n\n"), content))
