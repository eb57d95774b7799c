"""The fusion lab: many ways of fusing the same two ranked lists, measured by the rank of the best target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The variants (name, kind, k, rank of a miss, weight of the sparse list, whether zero scores are dropped).
VARIANTS = [
    ("control k=60", "sum", 60, None, 1.0, False),
    ("drop zero sparse", "sum", 60, None, 1.0, True),
    ("impute 51 k=60", "impute", 60, 51, 1.0, False),
    ("max k=60", "max", 60, None, 1.0, False),
    ("sparse weight 1.0", "sum", 60, None, 1.0, False),
    ("sparse weight 0.7", "sum", 60, None, 0.7, False),
    ("sparse weight 0.5", "sum", 60, None, 0.5, False),
    ("sparse weight 0.3", "sum", 60, None, 0.3, False),
    ("sparse weight 0.1", "sum", 60, None, 0.1, False),
    ("sparse weight 0", "sum", 60, None, 0.0, False),
    ("control k=30", "sum", 30, None, 1.0, False),
    ("control k=20", "sum", 20, None, 1.0, False),
    ("control k=10", "sum", 10, None, 1.0, False),
    ("impute 51 k=30", "impute", 30, 51, 1.0, False),
    ("impute 51 k=20", "impute", 20, 51, 1.0, False),
    ("impute 51 k=10", "impute", 10, 51, 1.0, False),
    ("drop zeros and impute", "impute", 60, 51, 1.0, True),
    ("drop zeros k=20", "sum", 20, None, 1.0, True),
]


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "variant string, kind string, k int, miss int, ws double, drop_zero boolean")


def branch_ranks(candidates: DataFrame, group: str, dense: str, sparse: str, tie: str, window: int = 50, eps: float = 1e-9) -> DataFrame:
    """``(group, id, dr, sr, srz)``: ranks in the dense and the sparse window, and in the sparse window without zero scores.

    Each rank is cut at ``window`` before the lists are put together, so no group is ever whole in one task.
    """

    def ranks(score: str, name: str, kept) -> DataFrame:
        w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
        rows = candidates.filter(kept).select(group, tie, score)
        return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= window).select(group, tie, name)

    d = ranks(dense, "dr", F.col(dense).isNotNull())
    s = ranks(sparse, "sr", F.col(sparse).isNotNull())
    z = ranks(sparse, "srz", F.col(sparse).isNotNull() & (F.abs(sparse) > eps))
    return d.join(s, [group, tie], "full_outer").join(z, [group, tie], "full_outer")


def fused(ranks: DataFrame, group: str, tie: str) -> DataFrame:
    """``(variant, group, id, score, place)`` for every variant. The few variants are an array on each row, not a join."""
    v = F.array(*[F.struct(F.lit(a).alias("variant"), F.lit(b).alias("kind"), F.lit(c).alias("k"), F.lit(d).cast("int").alias("miss"), F.lit(e).alias("ws"), F.lit(f).alias("drop_zero")) for a, b, c, d, e, f in VARIANTS])
    rows = ranks.withColumn("v", F.explode(v)).select(group, tie, "dr", F.when(F.col("v.drop_zero"), F.col("srz")).otherwise(F.col("sr")).alias("r"), "v.*")
    rows = rows.filter("dr is not null or r is not null")
    d = F.coalesce(1.0 / (F.col("k") + F.col("dr")), F.lit(0.0))
    s = F.coalesce(F.col("ws") / (F.col("k") + F.col("r")), F.lit(0.0))
    miss = F.col("k") + F.col("miss")
    score = (
        F.when(F.col("kind") == "impute", 1.0 / F.coalesce(F.col("k") + F.col("dr"), miss) + 1.0 / F.coalesce(F.col("k") + F.col("r"), miss))
        .when(F.col("kind") == "max", F.greatest(d, s))
        .otherwise(d + s)
    )
    rows = rows.withColumn("score", F.round(score, 12))
    w = Window.partitionBy("variant", group).orderBy(F.col("score").desc(), F.col("dr").asc_nulls_last(), F.col("r").asc_nulls_last())
    return rows.withColumn("place", F.row_number().over(w)).select("variant", group, tie, "score", "place")


def target_ranks(places: DataFrame, targets: DataFrame, asks: DataFrame, group: str, tie: str) -> DataFrame:
    """``(variant, group, best)``: the best place of any target, null where none is in the list. ``asks`` are the groups that count;
    ``targets`` are ``(group, id)``."""
    hit = places.join(targets, [group, tie], "left_semi").groupBy("variant", group).agg(F.min("place").alias("best"))
    every = asks.select(group).withColumn("variant", F.explode(F.array(*[F.lit(x[0]) for x in VARIANTS])))
    return every.join(hit, ["variant", group], "left")


def summary(best: DataFrame, by: list[str], miss: int = 999) -> DataFrame:
    """Mean reciprocal rank (a miss counts as 0) and true median (a miss counts as ``miss``)."""
    return best.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
        F.percentile(F.coalesce("best", F.lit(miss)).cast("double"), 0.5).alias("median_rank"),
        F.count_if(F.col("best") == 1).alias("first"),
    )


def against_control(best: DataFrame, group: str, control: str = VARIANTS[0][0], miss: int = 999) -> DataFrame:
    """``(variant, worse, worst)``: in how many groups a variant falls behind the control, and by how many places at most."""
    base = best.filter(F.col("variant") == control).select(group, F.coalesce("best", F.lit(miss)).alias("b0"))
    both = best.select("variant", group, F.coalesce("best", F.lit(miss)).alias("b")).join(base, group)
    return both.groupBy("variant").agg(F.count_if(F.col("b") > F.col("b0")).alias("worse"), F.greatest(F.max(F.col("b") - F.col("b0")), F.lit(0)).alias("worst"))
