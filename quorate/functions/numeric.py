"""Column functions over numbers and token probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attempt_seed(attempt: Column, mode: str = "plus", seed: int = 42) -> Column:
    return F.lit(seed) + attempt if mode == "plus" else F.pow(F.lit(seed) + attempt, F.lit(2)).cast("bigint")


def token_entropy(log_probabilities: Column) -> Column:
    """Entropy in bits of one position, over the alternatives that are given."""

    def add(total: Column, lp: Column) -> Column:
        p = F.exp(lp)
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    return F.aggregate(log_probabilities, F.lit(0.0), add)


def mean_entropy(positions: Column) -> Column:
    """Mean over the positions that have alternatives; infinite without any."""
    full = F.filter(positions, lambda p: F.size(p) > 0)
    total = F.aggregate(full, F.lit(0.0), lambda t, p: t + token_entropy(p))
    return F.when(F.size(full) > 0, total / F.size(full)).otherwise(F.lit(float("inf")))


def round_1(x: Column) -> Column:
    """To one decimal, by the number's exact binary value; exact halves go to the even digit."""
    size = F.abs(x.cast("double"))
    tenths = F.floor(size * 10).cast("double")
    # 20 * size - (2 * tenths + 1) has the sign of what lies beyond the half. Size is divided in two
    # parts of few digits, so that the products are exact.
    high = size * 134217729.0 - (size * 134217729.0 - size)
    beyond = (20 * high - (2 * tenths + 1)) + 20 * (size - high)
    up = (beyond > 0) | ((beyond == 0) & (tenths % 2 == 1))
    rounded = F.signum(x.cast("double")) * ((tenths + F.when(up, 1.0).otherwise(0.0)) / 10)
    return F.when(size < 2.0**46, rounded).otherwise(x.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """As text without decimals; exact halves go to the even digit."""
    return F.bround(100.0 * part / whole, 0).cast("long").cast("string")
