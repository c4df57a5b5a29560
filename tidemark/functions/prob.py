"""Three-class probabilities: validity, argmax, losses, temperature, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P3 = ("p_down", "p_flat", "p_up")
LABELS = ("down", "flat", "up")


def vector(names=P3) -> Column:
    return F.array(*[F.col(n) for n in names])


def argmax(p: Column) -> Column:
    """First index of the maximum."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def issue_gate(names=P3, threshold: float = 0.0):
    """valid, issued, label and maximum of three probabilities; ties and bad sums are invalid."""
    cols = [F.col(n) for n in names]
    p = F.array(*cols)
    top = F.greatest(*cols)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(c.between(0, 1), F.lit(False))
    ties = sum((F.when(F.abs(c - top) < 1e-9, 1).otherwise(0) for c in cols[1:]), F.when(F.abs(cols[0] - top) < 1e-9, 1).otherwise(0))
    valid = ok & F.coalesce(F.abs(cols[0] + cols[1] + cols[2] - 1) < 0.01, F.lit(False)) & (ties == 1)
    issued = valid & (top >= threshold)
    name = F.element_at(F.array(*[F.lit(x) for x in LABELS]), argmax(p) + 1)
    label = F.when(issued, name).when(valid, "hold").otherwise("undecided")
    return valid.alias("valid"), issued.alias("issued"), label.alias("call"), F.when(valid, top).alias("max_prob")


def softened(names=P3, temperature: float | Column = 1.0, floor: float = 1e-7):
    """softmax(ln p / T) as three columns, inputs clipped at ``floor``."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = [F.when(F.col(n).isNotNull(), F.exp(F.ln(F.least(F.greatest(F.col(n), F.lit(floor)), F.lit(1.0))) / t)) for n in names]
    total = e[0] + e[1] + e[2]
    return [x / total for x in e]


def log_loss(p: Column, y: Column, floor: float = 1e-7) -> Column:
    return F.when(F.get(p, y).isNotNull(), -F.ln(F.greatest(F.get(p, y), F.lit(floor))))


def brier(p: Column, y: Column) -> Column:
    """Sum of squared differences from the one-hot truth."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)


def conformal_rank(n: Column, coverage: float = 0.8) -> Column:
    """1-based rank ceil((n+1) coverage), capped at n."""
    return F.least(F.ceil((n + 1) * coverage - 1e-12), n).cast("int")


def interval_score(y, lo, hi, coverage: float = 0.8) -> Column:
    """Width plus 2/alpha times the distance outside."""
    alpha = 1 - coverage
    return (hi - lo) + (2 / alpha) * F.greatest(lo - y, F.lit(0.0)) + (2 / alpha) * F.greatest(y - hi, F.lit(0.0))
