"""Number scalars: defaults, safe division, ranges, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double; 0 for null, false, '' and text that is no number."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def safe_div(num: Column, den: Column) -> Column:
    """num / den; 0 where den is not positive."""
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(0.0)


def mean_and_delta(a: Column, b: Column) -> tuple[Column, Column]:
    return (a + b) / 2, a - b


def flag(*conditions: Column) -> Column:
    """1.0 if any condition holds, else 0.0; null counts as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c.cast("boolean"), F.lit(False))
    return out.cast("double")


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def padded_range(low: Column, high: Column, floor: float, ceil: float, pad: float = 0.25, log: bool = False, whole: bool = False) -> tuple[Column, Column]:
    """[low, high] widened by pad of its width (in logarithms if log) and clamped to [floor, ceil]; whole: to integers."""
    a, b = (F.log(low), F.log(high)) if log else (low.cast("double"), high.cast("double"))
    width = (b - a) * pad
    a, b = (F.exp(a - width), F.exp(b + width)) if log else (a - width, b + width)
    a, b = (F.floor(a), F.ceil(b)) if whole else (a, b)
    return clip(a, floor, ceil), clip(b, floor, ceil)


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def logistic(d: Column) -> Column:
    return 1 / (1 + F.exp(-d))


def step_table(c: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """Value of the first step whose bound is above c."""
    chain = F.when(c < steps[0][0], steps[0][1])
    for bound, value in steps[1:]:
        chain = chain.when(c < bound, value)
    return chain.otherwise(otherwise)


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for c, w in parts:
        out = out + F.coalesce(c.cast("double"), F.lit(0.0)) * w
    return out


# Weights of the impact score of a candidate.
IMPACT_WEIGHTS = {"nines": 100000, "eights": 30000, "near": 10000, "incomplete": 500, "coverage": 200, "deficit": -400}


def impact_score(**parts: Column) -> Column:
    return weighted_score([(parts[k], IMPACT_WEIGHTS[k]) for k in IMPACT_WEIGHTS if k in parts])


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def tier_index(rank: Column, divisions: int = 28, per_tier: int = 4) -> Column:
    """Tier of a rank index: four divisions a tier below `divisions`, one rank a tier above."""
    return F.when(rank < divisions, F.floor(rank / per_tier)).otherwise(rank - (divisions - divisions // per_tier)).cast("int")
