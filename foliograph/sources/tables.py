"""Parquet tables and their deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the engine's parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """One row per key: the one delivered last.

    Rows of equal time are ordered by their values, so the result is deterministic. Only ``columns`` travel,
    and the maximum is taken on the map side before the shuffle. Null keys form one key of their own.
    """
    rest = [c for c in columns if c not in keys]
    order = F.struct(F.col(at).alias("_at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    out = df.groupBy(*keys).agg(F.max(order).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(rest)])


def newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """As :func:`latest`, for rows whose columns have no order (maps); ties go to the larger row hash."""
    cols = [c for c in df.columns if c not in keys]
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map") and "map<" not in t]
    version: Column = F.struct(F.col(at), F.xxhash64(*plain))
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), version).alias("_row"))
    return out.select(*keys, "_row.*")
