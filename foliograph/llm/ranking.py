"""Problem 2: one ranking from several differently scaled scores (ideal-point ranking).

Within each ask every score is winsorised at two quantiles, vector-normalised and weighted; an item's rank is its
relative closeness to the ideal point (the best of every score) as against the anti-ideal one (the worst).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.session import materialise

SCORES = ("rrf_score", "dense", "sparse", "rerank")


def _usable(c: str):
    x = F.col(f"`{c}`").cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


#: Groups with more rows are worked on by all tasks, over salted copies of their statistics; others in one task each.
HOT = 100_000


def _rows(items: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    usable = [F.when(F.abs(_usable(c)) != float("inf"), _usable(c)).alias(f"s{k}") for k, c in enumerate(scores)]
    return items.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{item}`").alias("_i"), *usable)


def _once(rows: DataFrame, n: int) -> DataFrame:
    return rows.groupBy("_g", "_i").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(n)])


def _cuts(k: int, low: float, high: float) -> dict[str, F.Column]:
    """The worst value and two quantiles, missing scores standing below all others: there the quantile is the worst value."""
    q = F.percentile_approx(F.coalesce(F.col(f"s{k}"), F.lit(float("-inf"))), F.array(F.lit(low), F.lit(high)), 10000)
    return {f"w{k}": F.min(f"s{k}"), f"q{k}": q}


def _winsorised(k: int) -> F.Column:
    worst = F.coalesce(F.col(f"w{k}"), F.lit(0.0))
    return F.greatest(F.least(F.coalesce(F.col(f"s{k}"), worst), F.greatest(F.col(f"q{k}")[1], worst)), F.greatest(F.col(f"q{k}")[0], worst))


def _norms(k: int) -> dict[str, F.Column]:
    return {f"v{k}": F.var_pop(f"s{k}"), f"c{k}": F.count(f"s{k}"), f"b{k}": F.max(f"s{k}"), f"a{k}": F.min(f"s{k}")}


def _closeness(weights: list[float]) -> F.Column:
    """Distances to the ideal and the anti-ideal point, each score in units of its vector norm about the mean."""

    def gap(k: int, end: str):
        norm = F.sqrt(F.col(f"v{k}") * F.col(f"c{k}"))
        span = F.when((F.col(f"b{k}") > F.col(f"a{k}")) & (norm > 0), norm)
        return F.coalesce(weights[k] * (F.col(f"s{k}") - F.col(f"{end}{k}")) / span, F.lit(0.0))

    def distance(end: str):
        total = F.lit(0.0)
        for k in range(len(weights)):
            total = total + gap(k, end) * gap(k, end)
        return F.sqrt(total)

    best, worst = distance("b"), distance("a")
    return F.when(best + worst > 0, worst / (best + worst)).otherwise(0.0)


def _together(rows: DataFrame, weights: list[float], low: float, high: float) -> DataFrame:
    """Groups of bounded size: one shuffle by group serves the copies of a pair, all statistics and the places."""
    n, w = len(weights), Window.partitionBy("_g")
    x = _once(rows.repartition("_g"), n)
    over = lambda columns: {c: e.over(w) for part in columns for c, e in part.items()}
    x = x.withColumns(over(_cuts(k, low, high) for k in range(n)))
    x = x.select("_g", "_i", *[_winsorised(k).alias(f"s{k}") for k in range(n)]).withColumns(over(_norms(k) for k in range(n)))
    return x.select("_g", "_i", _closeness(weights).alias("closeness"))


def _salted(rows: DataFrame, weights: list[float], low: float, high: float, salts: int) -> DataFrame:
    """Groups of any size: statistics are aggregated on the map side and return to the rows over ``salts`` copies of one small
    row per group."""
    n = len(weights)
    x = _once(rows, n).withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(salts)).cast("int"))

    def back(left: DataFrame, columns) -> DataFrame:
        stats = left.groupBy("_g").agg(*[e.alias(c) for part in columns for c, e in part.items()])
        right = stats.withColumn("_hs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("_g", "_h")
        return left.join(right, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_salt") == F.col("_hs"))).drop("_h", "_hs")

    x = back(x, [_cuts(k, low, high) for k in range(n)]).select("_g", "_i", "_salt", *[_winsorised(k).alias(f"s{k}") for k in range(n)])
    return back(x, [_norms(k) for k in range(n)]).select("_g", "_i", _closeness(weights).alias("closeness"))


def ideal_point(items: DataFrame, group: str, item: str, scores: Sequence[str] = SCORES, weights: Sequence[float] | None = None, low: float = 0.1, high: float = 0.9, salts: int = 16) -> DataFrame:
    """Relative closeness of every item of every group: ``(group, item, closeness)``, larger is better.

    * ``items`` holds one row per (group, item); further rows of the same pair count as one, with the largest of
      each score. Other columns are ignored, whatever their names.
    * A null, NaN or infinite score counts as the worst of the group. A score that is missing throughout the group,
      or the same for all, has no say. If no score has one, closeness is 0.
    * Scores are measured from their mean before the vector norm is taken, so that neither the position of the
      zero nor the unit of a scale matters; larger must be better in each.
    * Null groups form a group of their own.

    Groups of more than ``HOT`` rows are found first, by counts with partial sums; they run salted, so a group may hold a
    third of all rows. Quantiles come from a mergeable sketch that is exact up to 10,000 items a group.
    """
    small, large = _near(items, group, item, scores, weights, low, high, salts)
    near = small if large is None else small.unionByName(large)
    return near.select(F.col("_g").alias(group), F.col("_i").alias(item), "closeness")


def _near(items, group, item, scores=SCORES, weights=None, low=0.1, high=0.9, salts=16) -> tuple[DataFrame, DataFrame | None]:
    """Closeness of the groups of bounded size, and of the others if there are any."""
    scores = list(scores)
    weights = [float(w) for w in (weights or [1.0] * len(scores))]
    rows = _rows(items, group, item, scores)
    hot = rows.groupBy("_g").agg(F.count("*").alias("_m")).filter(F.col("_m") > HOT).select(F.col("_g").alias("_h"))
    hot = materialise(hot, "hotgroups")
    if hot.isEmpty():
        return _together(rows, weights, low, high), None
    same = F.col("_g").eqNullSafe(F.col("_h"))
    return _together(rows.join(hot, same, "left_anti"), weights, low, high), _salted(rows.join(hot, same, "left_semi"), weights, low, high, salts)


#: Bands of closeness within which places are counted; the bands before add their totals.
BANDS = 64


def ranked(items: DataFrame, group: str, item: str, top: int | None = None, **kw) -> DataFrame:
    """``ideal_point`` with a position: ``(group, item, closeness, place)``; equal closeness goes to the smaller item.

    With ``top`` only the first places are kept (a top-k report); partial limits per task come before any shuffle. Places of
    groups of more than ``HOT`` rows are counted within bands of closeness, and the sizes of the bands above, at most
    ``BANDS`` small rows a group, are added, so that a large group isn't sorted in one task.
    """
    small, large = _near(items, group, item, **kw)
    order = (F.col("closeness").desc(), F.col("_i"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    out = small.withColumn("place", place)
    if top:
        out = out.filter(F.col("place") <= top)
    if large is not None:
        out = out.unionByName(large.withColumn("place", place).filter(F.col("place") <= top) if top else _banded(large, order))
    return out.select(F.col("_g").alias(group), F.col("_i").alias(item), "closeness", "place")


def _banded(near: DataFrame, order: tuple) -> DataFrame:
    banded = near.withColumn("_band", F.least(F.floor((1 - F.col("closeness")) * BANDS), F.lit(BANDS - 1)))
    before = Window.partitionBy("_gs").orderBy("_bs").rowsBetween(Window.unboundedPreceding, -1)
    sizes = banded.groupBy(F.col("_g").alias("_gs"), F.col("_band").alias("_bs")).agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_above", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    placed = banded.withColumn("_in", F.row_number().over(Window.partitionBy("_g", "_band").orderBy(*order)))
    out = placed.join(sizes, F.col("_g").eqNullSafe(F.col("_gs")) & (F.col("_band") == F.col("_bs")))
    return out.select("_g", "_i", "closeness", (F.col("_above") + F.col("_in")).cast("int").alias("place"))
