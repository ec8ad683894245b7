"""Statistics as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n; (0, 1) for n = 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), middle + half))


def cohen_kappa(agree: Column, a: Column, b: Column) -> Column:
    """Kappa from the shares of agreement and of each rater's positives; null where chance agreement is 1."""
    chance = a * b + (1 - a) * (1 - b)
    return F.try_divide(agree - chance, 1 - chance)


def gwet_ac1(agree: Column, a: Column, b: Column) -> Column:
    """AC1; 1 where chance agreement is 1."""
    both = (a + b) / 2
    chance = 2 * both * (1 - both)
    return F.coalesce(F.try_divide(agree - chance, 1 - chance), F.lit(1.0))


def sample_size(p: float, error: float, z: float = Z95) -> int:
    import math

    return math.ceil(z * z * p * (1 - p) / (error * error))
