"""Column expressions shared by the operators. All arithmetic is in double precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 9  # result digits; sums in different orders differ beyond them


def out(c: Column | str, digits: int = DIGITS) -> Column:
    """A result's value: rounded, so that the order of summation does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def count_if(c: Column) -> Column:
    return F.sum(c.cast("long"))


def confusion(y: str = "y", pred: str = "pred") -> list[Column]:
    """tp, fp, fn, tn of 0/1 columns; rows with a null decision count nowhere."""
    yy, pp = F.col(y), F.col(pred)
    cells = {"tp": (yy == 1) & (pp == 1), "fp": (yy == 0) & (pp == 1), "fn": (yy == 1) & (pp == 0), "tn": (yy == 0) & (pp == 0)}
    return [F.coalesce(count_if(c), F.lit(0)).alias(k) for k, c in cells.items()]


def _d(*names: str) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def mcc(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> Column:
    """Matthews correlation; 0 where it is not defined. Cast before multiplying: counts overflow."""
    a, b, c, d = _d(tp, fp, fn, tn)
    den = F.sqrt((a + b) * (a + c) * (d + b) * (d + c))
    return F.when(den > 0, (a * d - b * c) / den).otherwise(F.lit(0.0))


def kappa(both_1: str, only_a: str, only_b: str, both_0: str) -> Column:
    """Cohen's kappa of two 0/1 raters; null if they use one value between them, or never disagree by chance."""
    a, b, c, d = _d(both_1, only_a, only_b, both_0)
    n = a + b + c + d
    po = (a + d) / F.nullif(n, F.lit(0.0))
    pe = ((a + b) * (a + c) + (c + d) * (b + d)) / F.nullif(n * n, F.lit(0.0))
    return F.when((a == n) | (d == n), F.lit(None)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))


def accuracy() -> Column:
    tp, fp, fn, tn = _d("tp", "fp", "fn", "tn")
    return (tp + tn) / F.nullif(tp + fp + fn + tn, F.lit(0.0))


def balanced_accuracy() -> Column:
    tp, fp, fn, tn = _d("tp", "fp", "fn", "tn")
    return (tp / F.nullif(tp + fn, F.lit(0.0)) + tn / F.nullif(tn + fp, F.lit(0.0))) / 2


def precision() -> Column:
    tp, fp, _, _ = _d("tp", "fp", "fn", "tn")
    return F.coalesce(tp / F.nullif(tp + fp, F.lit(0.0)), F.lit(0.0))


def recall() -> Column:
    tp, _, fn, _ = _d("tp", "fp", "fn", "tn")
    return F.coalesce(tp / F.nullif(tp + fn, F.lit(0.0)), F.lit(0.0))


def f1() -> Column:
    tp, fp, fn, _ = _d("tp", "fp", "fn", "tn")
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0)), F.lit(0.0))


def dot(x: Column | str, y: Column | str) -> Column:
    """Product of two double arrays, added from the left."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def doubles(c: Column | str) -> Column:
    return F.transform(c, lambda v: v.cast("double"))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def order_hash(*parts: Column | str) -> Column:
    """A reproducible random order: md5 of the parts with colons between."""
    return F.md5(F.concat_ws(":", *parts))
