"""Column expressions with the null, NaN and small-sample rules that the library's results follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308


def finite(x: Column) -> Column:
    """True for a finite number, false for NaN and infinities, null for null."""
    return x.between(F.lit(-LARGEST), F.lit(LARGEST))


def if_finite(x: Column) -> Column:
    return F.when(finite(x), x)


def guarded(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else null: undefined ratios are never filled."""
    return F.when(denominator > 0, numerator / denominator)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def to_number(x: Column) -> Column:
    """A double from text; null where it is not a finite number. Type suffixes such as 1d are not numbers."""
    text = blank_to_null(x)
    value = F.when(~text.rlike("[dDfF]$") | text.rlike("(?i)^[+-]?inf"), text).try_cast("double")
    return if_finite(value)


def skewness(x: Column) -> Column:
    """Bias-corrected sample skewness; null for fewer than three values and for constant ones."""
    n = F.count(x)
    g1 = F.when(F.var_pop(x) > 0, F.skewness(x))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where either side is constant, instead of an error or NaN. Both must be null together."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def quantile(x: Column, p: float) -> Column:
    """Exact quantile, interpolated between the neighbouring order statistics."""
    return F.percentile(x, F.lit(p))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def number_of(mask: Column) -> Column:
    """How many rows meet a condition; a null condition doesn't count."""
    return F.count(F.when(mask, 1))


def average_where(mask: Column, x: Column) -> Column:
    return F.avg(F.when(mask, x))


def hash_bucket(key: Column, buckets: int) -> Column:
    """The bucket of a text key: the leading 64 bits of its SHA-256, modulo the number of buckets."""
    head = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(buckets)).cast("int")


def row_id(match_id: Column, player_name: Column, source_file: Column, source_row: Column) -> Column:
    """SHA-256 of the identity as JSON; lineage takes part only where the player has no name."""
    anonymous = player_name.isNull()
    parts = F.struct(match_id.alias("m"), player_name.alias("p"), F.when(anonymous, source_file).alias("f"), F.when(anonymous, source_row).alias("r"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)
