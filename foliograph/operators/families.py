"""Model families derived from the corpus, the expansion of asked models, and the applicability of chunks.

A family token is a token on a chunk that its manual's own list of models lacks (3500B among 3508B, 3512B, 3516B); it
covers the manual's models of the same generation. Asking for a model also asks for the families that cover it, never
the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import generation


def family_tokens(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``(token, doc_id)``: distinct tokens on a manual's chunks that the manual itself doesn't list."""
    tokens = chunks.select(F.explode("applicable_models").alias("token"), "doc_id").distinct()
    listed = docs.select(F.col("id").alias("doc_id"), F.explode("applicable_models").alias("token"))
    known = docs.select(F.col("id").alias("doc_id"))
    return tokens.join(known, "doc_id", "left_semi").join(listed, ["doc_id", "token"], "left_anti").select("token", "doc_id")


def family_cover(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``(token, doc_id, covers, n)``: the manual's models of the token's generation."""
    tokens = family_tokens(chunks, docs).withColumn("gen", generation(F.col("token")))
    listed = docs.select(F.col("id").alias("doc_id"), F.explode("applicable_models").alias("m")).withColumn("gen", generation(F.col("m")))
    met = tokens.join(listed, ["doc_id", "gen"])
    return met.groupBy("token", "doc_id").agg(F.array_sort(F.collect_set("m")).alias("covers"), F.countDistinct("m").alias("n"))


def _rivals(cover: DataFrame) -> DataFrame:
    """Covers by the token they cover, which turns the guard against cycles into an equi-join."""
    return cover.select(F.explode("covers").alias("covered"), F.col("token").alias("other"), F.col("n").alias("m"))


def _guarded(cover: DataFrame, how: str) -> DataFrame:
    r = _rivals(cover)
    on = (cover["token"] == r["covered"]) & (r["other"] != cover["token"]) & ((r["m"] > cover["n"]) | ((r["m"] == cover["n"]) & (r["other"] < cover["token"])))
    return cover.join(r, on, how)


def families(cover: DataFrame) -> DataFrame:
    """Covers without those that another one covers and outweighs (more models, else the smaller name)."""
    return _guarded(cover, "left_anti")


def dropped_families(cover: DataFrame) -> DataFrame:
    return _guarded(cover, "left_semi")


def orphans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``(filename, token, n_chunks)``: tokens that cover no model of their manual; such chunks are out of reach."""
    left = family_tokens(chunks, docs).join(family_cover(chunks, docs).select("token", "doc_id"), ["token", "doc_id"], "left_anti")
    held = chunks.select("id", "doc_id", F.explode("applicable_models").alias("token"))
    counted = held.join(left, ["doc_id", "token"]).groupBy("doc_id", "token").agg(F.countDistinct("id").alias("n_chunks"))
    return counted.join(docs.select(F.col("id").alias("doc_id"), "filename"), "doc_id").select("filename", "token", "n_chunks")


def expand(cover: DataFrame, models: list[str]) -> DataFrame:
    """``(model)``: the asked models and the families that cover one of them, distinct."""
    asked = cover.sparkSession.createDataFrame([(m,) for m in models], "model string")
    wider = families(cover).select(F.explode("covers").alias("model"), "token").join(asked, "model", "left_semi").select(F.col("token").alias("model"))
    return asked.union(wider).distinct()


def effective(own: str = "applicable_models", of_doc: str = "doc_models") -> Column:
    """A chunk's own models, else those of its manual; never null."""
    none = F.array().cast("array<string>")
    mine = F.coalesce(own, none)
    return F.when(F.size(mine) > 0, mine).otherwise(F.coalesce(of_doc, none))


def with_docs(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("id").alias("doc_id"), F.col("applicable_models").alias("doc_models"), F.col("filename").alias("doc_filename"))
    return chunks.join(d, "doc_id")


def applicable(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunks (with ``doc_models``) that apply to an asked model. The asked set enters as a scalar subquery."""
    wanted = asked.agg(F.collect_set("model")).scalar()
    return chunks.filter(F.arrays_overlap(effective(), wanted))


def reach_gain(chunks: DataFrame, wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """Chunks that the wide set of models reaches and the narrow one doesn't."""
    w, n = wide.agg(F.collect_set("model")).scalar(), narrow.agg(F.collect_set("model")).scalar()
    return chunks.filter(F.arrays_overlap(effective(), w) & ~F.arrays_overlap(effective(), n))
