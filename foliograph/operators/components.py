"""Connected components of links, without gathering any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(id, class)`` for every id in a link: the smallest id of its component.

    Large-star and small-star in turns: each round hangs a vertex's larger neighbours, then its smaller ones, on its least
    neighbour. Rounds grow with the logarithm of the longest path; each is written to the shared folder, which cuts the
    lineage. A vertex's neighbours are never gathered: only their minimum is, on the map side, and joined back.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v")
        small = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        same = edges.join(small, ["u", "v"], "left_anti").isEmpty() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())
