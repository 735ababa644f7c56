"""Column expressions: hashed randomness, link functions, losses, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 91 thresholds of the F1 sweep, from 0.05 in steps of a hundredth as floating point adds them up.
GRID = tuple(0.05 + k * 0.010000000000000002 for k in range(91))
EPSILON = 1e-8


def hash32(*parts: Column | str | int) -> Column:
    """32 unsigned bits that depend on the parts only, never on partitioning; any SQL engine with md5 gives the same."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """[0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def below(n: Column | int, *parts) -> Column:
    """A whole number from 0 to n - 1."""
    return hash32(*parts) % n


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Without overflow for large negative x."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a.cast("array<double>"), lambda x: x * factor)


def mean_vector(a: Column, b: Column) -> Column:
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x + y) / 2)


def cosine_rate(step: Column, steps: int, rate: float, least: float = 1e-5) -> Column:
    """Learning rate annealed along half a cosine from `rate` to `least`."""
    return F.lit(least) + F.lit(rate - least) * (F.lit(1.0) + F.cos(F.lit(3.141592653589793) * step / F.lit(float(steps)))) / F.lit(2.0)


def decide(probability: Column, threshold: Column | float) -> Column:
    """1 from the threshold on, itself included."""
    return F.when(probability >= threshold, 1).otherwise(0)


def fixed(value: Column, digits: int) -> Column:
    """As Python prints a number with so many digits after the point, without grouping."""
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def number_or_na(value: Column, digits: int = 4) -> Column:
    """As printed in reports: grouped digits, or N/A where there is no number."""
    return F.coalesce(F.when(~F.isnan(value.cast("double")), F.format_number(value.cast("double"), digits)), F.lit("N/A"))
