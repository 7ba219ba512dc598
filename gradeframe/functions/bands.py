"""Labels for numbers and names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import col


def lookup(c: Column | str, mapping: dict, default: Column | None = None) -> Column:
    """Value of a small literal map, ``default`` (or NULL) for other keys."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    found = F.try_element_at(pairs, col(c))
    return found if default is None else F.coalesce(found, default)


def task_code(task: Column | str) -> Column:
    """Long task name to its code; unknown names stay as they are."""
    return lookup(task, fv.TASK_CODES, col(task))


def task_filter(task: Column | str, fragment: str) -> Column:
    """Case-insensitive containment, false for NULL."""
    return F.coalesce(F.contains(F.lower(col(task)), F.lit(fragment.lower())), F.lit(False))


def bucket(value: Column, limits: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for condition, label in limits:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.when(value.isNotNull(), out.otherwise(otherwise))


def era_bucket(year: Column | str) -> Column:
    """Era of a year, NULL outside every era."""
    y = col(year)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, first, last in fv.ERAS:
        out = out.when((y > first - 1) & (y <= last), label)
    return out


def complexity_tier(score: Column | str) -> Column:
    """Tier of an unrounded complexity score."""
    s = col(score)
    return bucket(s, [(s < 0.2, "Low"), (s < 0.5, "Medium")], "High")


def agreement_band(pct: Column | str) -> Column:
    """P9."""
    p = col(pct)
    return bucket(p, [(p >= 85, "PASS"), (p >= 70, "BORDERLINE")], "REVIEW")


def kappa_band(kappa: Column | str) -> Column:
    """P10."""
    k = col(kappa)
    steps = [(0.0, "poor"), (0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial")]
    return bucket(k, [(k < limit, label) for limit, label in steps], "almost perfect")


def concordance_band(w: Column | str) -> Column:
    """P10, for Kendall's W."""
    v = col(w)
    return bucket(v, [(v > 0.7, "Strong"), (v > 0.4, "Moderate")], "Weak")
