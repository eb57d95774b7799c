"""Batch retrieval: exact dense top-k, sparse top-k over postings, rank fusion with imputation, hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.vectors import usable

TOP_K, FUSED, RRF_K, MISS = 50, 20, 60, 51
#: Queries held by an executor at once; more are taken in further passes over the collection.
BLOCK = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def dense_topk(queries: DataFrame, rows: DataFrame, k: int = TOP_K, key: str = "id", vector: str = "embedding_dense", dims: int = 64) -> DataFrame:
    """``(query_id, id, score, rank)``: for each query the k rows of other ids most similar by cosine, exactly; ties go
    to the smaller id.

    Queries come to the executors in blocks of at most ``BLOCK``; each Arrow batch of rows is scored by one matrix product
    and keeps its k best per query, so that only candidates are shuffled. Unusable vectors take no part.
    """
    spark = rows.sparkSession
    q = queries.filter(usable(vector, dims)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    r = rows.filter(usable(vector, dims)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    passes = max(1, -(-q.count() // BLOCK))
    out = None
    for p in range(passes):
        part = q if passes == 1 else q.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)
        got = part.toPandas()
        ids = got["id"].to_numpy()
        block = spark.sparkContext.broadcast((ids, _unit(np.stack(got["v"].to_numpy())) if len(got) else np.zeros((0, dims))))

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            qid, qv = block.value
            for b in batches:
                if not len(b) or not len(qid):
                    continue
                rid = b["id"].to_numpy()
                s = np.round(qv @ _unit(np.stack(b["v"].to_numpy())).T, 9)
                s[qid[:, None] == rid] = -2
                if s.shape[1] > k:
                    # Ties with the k-th stay in; the final ranking settles them.
                    floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    i, j = np.nonzero((s >= floor[:, None]) & (s > -2))
                else:
                    i, j = np.nonzero(s > -2)
                yield pd.DataFrame({"query_id": qid[i], "id": rid[j], "score": s[i, j]})

        found = r.mapInPandas(run, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, "query_id", "score", "id", k)


def ranked(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group with their ranks; Spark limits each group per task before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def postings(rows: DataFrame, key: str = "id", weights: str = "embedding_sparse", heaviest: int | None = None) -> DataFrame:
    """``(id, token, weight)``: positive weights, the largest of a repeated token.

    ``heaviest`` keeps only so many of a row's weights; it changes scores and is off by default.
    """
    out = rows.select(F.col(key).alias("id"), F.explode(weights).alias("token", "weight")).filter("weight > 0")
    out = out.groupBy("id", "token").agg(F.max("weight").cast("double").alias("weight"))
    if heaviest:
        w = Window.partitionBy("id").orderBy(F.col("weight").desc(), "token")
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= heaviest).drop("_r")
    return out


def sparse_scores(query_postings: DataFrame, row_postings: DataFrame) -> DataFrame:
    """``(query_id, id, score)``: inner products over shared tokens; rows without one don't appear. A frequent token makes a
    hot join key, which adaptive execution splits."""
    q = query_postings.select(F.col("id").alias("query_id"), "token", F.col("weight").alias("wq"))
    met = q.join(row_postings, "token").filter(F.col("query_id") != F.col("id"))
    return met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("wq") * F.col("weight")), 9).alias("score")).filter("score > 0")


def rrf(dense: DataFrame, sparse: DataFrame, group: str = "query_id", k: int = RRF_K, miss: int | None = MISS, top: int | None = FUSED) -> DataFrame:
    """``(group, id, dense_rank, sparse_rank, rrf, place)``: reciprocal rank fusion of two ranked lists.

    A row missing from a list gets the rank ``miss`` (null: it adds nothing). Ties go to the better dense rank, rows
    without one after all others, then to the better sparse rank.
    """
    d = dense.select(group, "id", F.col("rank").alias("dense_rank"))
    s = sparse.select(group, "id", F.col("rank").alias("sparse_rank"))
    both = d.join(s, [group, "id"], "full_outer")

    def part(c: str):
        r = F.coalesce(c, F.lit(miss)) if miss else F.col(c)
        return F.coalesce(1.0 / (k + r), F.lit(0.0))

    both = both.withColumn("rrf", part("dense_rank") + part("sparse_rank"))
    w = Window.partitionBy(group).orderBy(F.col("rrf").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    out = both.withColumn("place", F.row_number().over(w))
    return out.filter(F.col("place") <= top) if top else out


def hybrid(queries: DataFrame, rows: DataFrame, k: int = TOP_K, top: int = FUSED) -> DataFrame:
    """Dense and sparse top-k of the same (already filtered) rows, fused."""
    dense = dense_topk(queries, rows, k)
    sparse = ranked(sparse_scores(postings(queries), postings(rows)), "query_id", "score", "id", k)
    return rrf(dense, sparse, top=top)


def details(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Late materialisation: wide columns are fetched for the selected ids only, and the rank travels along."""
    wanted = hits.select("id").distinct()
    few = chunks.join(wanted, "id", "left_semi").select("id", *columns)
    return hits.join(few, "id")
