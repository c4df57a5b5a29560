"""Rule labels and small numeric rules on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(*conditions) -> Column:
    """The labels that apply, in order, as one comma-separated text."""
    return F.array_join(F.filter(F.array(*conditions), lambda x: x.isNotNull()), ",")


def session_labels(ret, gap, intraday, z, share, index_ret, close_share) -> Column:
    """What carried a session: weak, gap led, one jump, with the index, a closing rush; else a steady trend."""
    same = F.signum(gap) == F.signum(ret)
    labels = listed(
        F.when(F.abs(ret) < 0.003, "weak"),
        F.when((F.abs(gap) > 0.005) & same & (F.abs(gap) >= 0.6 * F.abs(ret)), "gap_led"),
        F.when((z >= 3) & (F.abs(share) >= 0.4), "intraday_jump"),
        F.when((F.abs(ret) >= 0.003) & (F.signum(index_ret) == F.signum(ret))
               & (F.abs(ret - index_ret) <= F.greatest(0.5 * F.abs(ret), F.lit(0.003))), "with_index"),
        F.when((F.abs(close_share) >= 0.3) & (F.abs(intraday) >= 0.003), "closing_rush"),
    )
    return F.when(labels == "", "steady").otherwise(labels)


def forecast_explain(predicted: Column, band: Column, ret: Column, gap: Column, intraday: Column):
    """actual class, hit, class of each leg, the leg that decided, and whether the session undid a right gap."""
    cls = lambda x: F.when(x < -band, 0).when(x > band, 2).otherwise(1)
    actual = cls(ret)
    hit = actual == predicted
    undone = ~hit & (F.signum(gap) == (predicted - 1)) & (F.signum(intraday) != F.signum(gap)) & (F.abs(intraday) > band)
    return (actual.alias("actual"), hit.alias("hit"), cls(gap).alias("gap_class"), cls(intraday).alias("intraday_class"),
            F.when(F.abs(gap) >= F.abs(intraday), "gap").otherwise("intraday").alias("decided_by"), undone.alias("reversed"))


def stage_sides(position: Column, change: Column, favorable: Column, flat: Column, side: float = 0.6):
    """(level, move) as -1, 0, 1: is the position on the good side, is the change an improvement."""
    good = F.when(favorable > 0, position).otherwise(1 - position)
    ok = (favorable != 0) & position.isNotNull() & change.isNotNull()
    level = F.when(good >= side, 1).when(good <= 1 - side, -1).otherwise(0)
    move = favorable * change
    return F.when(ok, level), F.when(ok, F.when(move >= flat, 1).when(move <= -flat, -1).otherwise(0))


def stage(level: Column, move: Column) -> Column:
    return (F.when(level > 0, F.when(move < 0, "caution").otherwise("good"))
            .when(level < 0, F.when(move > 0, "improving").otherwise("bad"))
            .when(level == 0, F.when(move > 0, "improving").when(move < 0, "caution").otherwise("neutral")))


def round_levels(price: Column, count: int = 2) -> Column:
    """The next round prices above: steps of the leading power of ten."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(price)))
    first = (F.floor(price / step) + 1) * step
    return F.when(price > 0, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: first + step * i))


def verdict(metric: Column, lo: Column, hi: Column) -> Column:
    """From an interval: undecided, tie, better or worse; losses improve downwards."""
    better = F.when(metric.isin("log_loss", "mae", "score"), hi < 0).otherwise(lo > 0)
    return F.when(lo.isNull() | hi.isNull(), "undecided").when((lo <= 0) & (hi >= 0), "tie").when(better, "better").otherwise("worse")


def interval_verdict(score_hi, score_lo, block_hi, horizon, coverage, current, target=0.8, band=0.04) -> Column:
    """Adopt an interval rule only when the score gains in both block types and coverage is near or nearer to target."""
    better = (score_hi < 0) & ((horizon == 1) | (block_hi < 0))
    off, off_now = F.abs(coverage - target), F.abs(current - target)
    near = (off <= band + 1e-12) | ((off_now > band + 1e-12) & (off < off_now))
    return F.when(better & near, "adopt").when(better, "coverage_failed").when(score_lo > 0, "worse").otherwise(F.when(near, "tie").otherwise("tie_coverage_failed"))


def conformal_bounds(point: Column, half: Column, floor: float):
    """point -+ half * max(|point|, floor)."""
    width = half * F.greatest(F.abs(point), F.lit(floor))
    return point - width, point + width


def split_estimate(segment, other, add_low, add_high, ratio, elasticity):
    """Low and high of the next total: the segment grown at a fixed margin and with leverage, plus the rest."""
    e = F.least(F.greatest(elasticity, F.lit(0.5)), F.lit(2.5))
    a = (segment + add_low) * ratio + other
    b = (segment + add_high) * F.pow(ratio, e) + other
    return F.least(a, b), F.greatest(a, b)
