"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str, b: str) -> Column:
    """Cosine similarity; null where a vector is null, of another length or has no length."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def usable(v: str, dims: int | None = None) -> Column:
    """Whether a vector has finite values that aren't all zero (and ``dims`` of them)."""
    c = F.col(v)
    ok = c.isNotNull() & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(v, lambda a: a != 0)
    return ok & (F.size(v) == dims) if dims else ok


def sparse_index(weights: str, vocabulary: int = 250_002) -> Column:
    """Token weights with 1-based indices: keys that aren't numbers, out of range or of no positive weight go."""
    kept = F.map_filter(weights, lambda k, w: (w > 0) & k.try_cast("int").isNotNull() & k.try_cast("int").between(0, vocabulary - 1))
    return F.transform_keys(kept, lambda k, w: k.try_cast("int") + 1)


def eight_digits(x: Column) -> Column:
    """A number with eight significant digits and no closing zeros; with an exponent below 1e-4 and from 1e8 on."""
    e = F.format_string("%.7e", x)
    power = F.substring_index(e, "e", -1).cast("int")
    plain = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(7 - power, F.lit(0)).cast("string"), F.lit("f")), x)
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when((power < -4) | (power >= 8), F.regexp_replace(e, r"\.?0+e", "e")).otherwise(plain)


def sparse_literal(weights: str, dims: int = 250_002) -> Column:
    """``{index:weight,...}/dims``, sorted by index, weights with eight significant digits."""
    items = F.array_sort(F.map_entries(weights))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), eight_digits(e["value"].cast("double")))), ","), F.lit(f"}}/{dims}"))
