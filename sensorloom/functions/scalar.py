"""Column expressions: squashing, rounding, distances, ratios and vector products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function of x clipped to [-9, 10]."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-9.0), F.least(F.lit(10.0), x))))


def logit(y: Column) -> Column:
    return -F.log(1 / y - 1)


def ms_to_frame(ms: Column, khz: float, front: int = 0) -> Column:
    """Nearest frame, halves to even, counted from the end of the front buffer."""
    return F.bround(ms * khz).cast("long") - front


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def f1(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def pooled_mean(m1: Column, n1: Column, m2: Column, n2: Column) -> Column:
    return F.try_divide(m1 * n1 + m2 * n2, n1 + n2)


def pooled_std(s1: Column, m1: Column, n1: Column, s2: Column, m2: Column, n2: Column) -> Column:
    """Sample standard deviation of two samples together, from those of each."""
    d = m2 - m1
    squares = s1 * s1 * (n1 - 1) + s2 * s2 * (n2 - 1) + d * d * F.try_divide(n1 * n2, n1 + n2)
    return F.sqrt(F.try_divide(squares, n1 + n2 - 1))


def intervals_overlap(m1: Column, s1: Column, m2: Column, s2: Column, k: float) -> Column:
    """Whether mean +- k std of both touch."""
    return (m1 - k * s1 <= m2 + k * s2) & (m2 - k * s2 <= m1 + k * s1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def confusion(label: Column, predicted: Column) -> list[Column]:
    """Counts fn, tn, fp and tp over rows of 0/1 label and prediction."""
    cases = {"fn": (1, 0), "tn": (0, 0), "fp": (0, 1), "tp": (1, 1)}
    return [F.count_if((label == a) & (predicted == b)).alias(k) for k, (a, b) in cases.items()]


def percents() -> list[Column]:
    """accuracy, recall and precision in percent from columns fn, tn, fp, tp; null where undefined."""
    fn, tn, fp, tp = (F.col(c) for c in ("fn", "tn", "fp", "tp"))
    of = lambda a, b: F.try_divide(100.0 * a, b)
    return [of(tp + tn, fn + tn + fp + tp).alias("accuracy"), of(tp, tp + fn).alias("recall"), of(tp, tp + fp).alias("precision")]


def scaled(raw: Column, gain: Column, offset: Column, fallback: float = 0.195) -> Column:
    """Raw counts in microvolts; the fallback gain where none is known."""
    return raw * F.coalesce(gain, F.lit(fallback)) + F.coalesce(offset, F.lit(0.0))
