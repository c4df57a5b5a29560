"""Moment algebra: training sets as differences of prefix moments, validation losses as quadratic forms.

A moment array holds the upper triangle, row by row, of the sum of weight * (1, x, y)(1, x, y)'. Rows fold to one array per
(group, day) with a partial aggregation; a running sum over days gives the moments of all rows before any date, and
a difference of two such sums those of any window. From there settings, feature sets, windows and folds cost no scan.

Rows that several sums read are written once as a table, so that no sum plans the chain behind them again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import evaluate as E
from .frames import names, series

ALPHAS = (1.0, 10.0, 100.0, 1_000.0, 10_000.0)


def size_of(k: int) -> int:
    """Entries of a moment array over k columns besides the constant."""
    return (k + 1) * (k + 2) // 2


def place(i: int, j: int, k: int) -> int:
    """Where the product of columns i and j stands (0 is the constant) in a moment array over k columns."""
    i, j = min(i, j), max(i, j)
    return i * (k + 1) - i * (i - 1) // 2 + j - i


def sums_before(rows_: DataFrame, cuts: DataFrame, by, order: str, sums: dict[str, Column], cut: str = "cut") -> DataFrame:
    """by..., ``cut`` and the sums over all rows of the group with ``order`` before the cut (0 where there are none).

    Rows fold to days first, so a window partition holds the days and cuts of a group, whatever the number of rows.
    """
    by = names(by)
    days = rows_.filter(F.col(order).isNotNull()).groupBy(*by, F.col(order).alias("_day")).agg(*[F.sum(c).cast("double").alias(k) for k, c in sums.items()]).withColumn("_row", F.lit(1))
    marks = cuts.select(*by, F.col(cut).alias("_day")).distinct().withColumns({k: F.lit(0.0) for k in sums}).withColumn("_row", F.lit(0))
    run = Window.partitionBy(*by).orderBy("_day", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return days.unionByName(marks).select(*by, F.col("_day").alias(cut), "_row", *[F.sum(k).over(run).alias(k) for k in sums]).filter("_row = 0").drop("_row")


def moments_before(rows_: DataFrame, cuts: DataFrame, by, order: str, x: Sequence[str], y: str, weight: Column | None = None) -> DataFrame:
    """by..., ``cut`` and the moment array ``m`` of all rows of the group with ``order`` before the cut.

    Rows with a missing column are left out. One window sum per moment.
    """
    cols = [*x, y]
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    w = weight if weight is not None else F.lit(1.0)
    sums = {f"_s{place(i, j, len(cols))}": w * z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))}
    before = sums_before(rows_.dropna(subset=cols), cuts, by, order, sums)
    return before.select(*names(by), "cut", F.array(*[F.col(f"_s{i}") for i in range(size_of(len(cols)))]).alias("m"))


def minus(a, b) -> Column:
    """The moments of a window: those before its end less those before its start; without a start, all."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda u, v: u - v))


def count_of(m) -> Column:
    return F.get(m, F.lit(0))


def ridge_solutions(k: int, settings: Sequence[tuple[Sequence[int], float]], least: float = 2):
    """Pandas UDF: moments over k inputs and a target -> one [intercept, slopes] per setting (columns, alpha).

    Ridge on inputs standardised by the window's own means and deviations; columns outside a setting have slope 0. Under
    ``least`` rows the answer is missing. A row is one window, so what reaches Python are small matrices.
    """
    upper = np.triu_indices(k + 2)

    def one(a: np.ndarray) -> list[list[float]]:
        full = np.zeros((k + 2, k + 2))
        full[upper] = a
        full = full + np.triu(full, 1).T
        n = full[0, 0]
        mean = full[0, 1:] / n
        c = full[1:, 1:] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(c)[:k] / n, 0.0))
        # A column that never moves has a rounding error for a deviation; it gets no slope.
        live = scale > 1e-9 * np.sqrt(np.maximum(np.diag(full)[1:k + 1] / n, 1e-300))
        scale = np.where(live, scale, 1.0)
        out = []
        for columns, alpha in settings:
            use = [i for i in columns if live[i]]
            beta = np.zeros(k)
            if use:
                s = scale[use]
                a_mat = c[np.ix_(use, use)] / np.outer(s, s) + alpha * np.eye(len(use))
                beta[use] = np.linalg.lstsq(a_mat, c[use, k] / s, rcond=None)[0] / s
            out.append([float(mean[k] - beta @ mean[:k]), *beta.tolist()])
        return out

    @F.pandas_udf("array<array<double>>")
    def run(m: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or a[0] < least else one(np.asarray(a, float)) for a in m])

    return run


def form(m, left: Sequence[Column], right: Sequence[Column], k: int) -> Column:
    """left' M right for a moment array over k columns; both sides start with the constant's entry."""
    out = F.lit(0.0)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out = out + a * b * F.get(m, F.lit(place(i, j, k)))
    return out


def squared_error(m, coef: Column, p: int) -> Column:
    """Sum of squared errors of the model over the rows behind ``m`` (p inputs and the target): no row is read."""
    v = [-F.get(coef, F.lit(i)) for i in range(p + 1)] + [F.lit(1.0)]
    return F.greatest(form(m, v, v, p + 1), F.lit(0.0))


def shrinkage(m, coef: Column, p: int) -> tuple[Column, Column]:
    """Sums of prediction * target and prediction squared over the rows behind ``m``."""
    b = [F.get(coef, F.lit(i)) for i in range(p + 1)]
    target = [F.lit(0.0)] * (p + 1) + [F.lit(1.0)]
    return form(m, b, target, p + 1), form(m, b, b, p + 1)


def linear(coef: Column, x: Sequence[str]) -> Column:
    out = F.get(coef, F.lit(0))
    for i, c in enumerate(x):
        out = out + F.get(coef, F.lit(i + 1)) * F.col(c)
    return out


def inner_spans(folds: DataFrame, by, blocks: int = 3, months: int = 6, years: int | None = None) -> DataFrame:
    """Validation blocks before each development fold, with the start of the block's training window (null: expanding)."""
    f = E.inner_blocks(folds, by, blocks, months).join(folds.select(*names(by), "fold", "t0"), [*names(by), "fold"])
    return f.withColumn("u0", F.add_months("v0", -12 * years) if years else F.lit(None).cast("date"))


def _at(table: DataFrame, moments: DataFrame, by, column: str, out: str) -> DataFrame:
    """The prefix moments at the dates in ``column``, as ``out``; missing where the date is."""
    return table.join(moments.withColumnsRenamed({"cut": column, "m": out}), [*names(by), column], "left")


def _dates(by, *pairs: tuple[DataFrame, str]) -> DataFrame:
    out = None
    for frame, column in pairs:
        part = frame.select(*names(by), F.col(column).alias("cut"))
        out = part if out is None else out.unionByName(part)
    return out.filter("cut is not null").distinct()


def chosen_settings(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, x: Sequence[str], y: str, alphas=ALPHAS, years: int | None = 5,
                    blocks: int = 3, months: int = 6, least: int = 100) -> DataFrame:
    """The penalty of each fold with the least mean squared error over the inner blocks before it (the larger of equals).

    A block trains on rows whose label matured before it, from the last ``years`` on, and is judged on its own rows whose
    label matured before the fold. Both are differences of prefix moments, and the loss is a quadratic form, so the grid
    costs no scan. Blocks with too few rows are left out; without any block the penalty is the middle one.
    """
    by, x, p = names(by), list(x), len(x)
    spans = inner_spans(folds, by, blocks, months, years)
    by_label = moments_before(rows_, _dates(by, (spans, "v0"), (spans, "t0")), by, matures, x, y)
    by_date = moments_before(rows_, _dates(by, (spans, "v0"), (spans, "v1"), (spans, "u0")), by, date, x, y)
    f = _at(_at(spans, by_label, by, "v0", "_fit"), by_date, by, "u0", "_old")
    f = _at(_at(f, by_date, by, "v0", "_a"), by_date, by, "v1", "_b")
    f = _at(f, by_label, by, "t0", "_known")
    # The block next to the fold also holds labels that mature inside the fold; those are not known at its start.
    f = f.withColumn("_val", F.when(F.col("v1") >= F.col("t0"), minus("_known", "_a")).otherwise(minus("_b", "_a")))
    f = f.withColumn("_coef", ridge_solutions(p, [(range(p), a) for a in alphas], least)(minus("_fit", "_old")))
    f = f.filter(F.col("_coef").isNotNull() & (count_of("_val") >= 1))
    tried = f.select(*by, "fold", "_val", F.posexplode("_coef").alias("_i", "_c"))
    loss = tried.groupBy(*by, "fold", "_i").agg((F.sum(squared_error("_val", F.col("_c"), p)) / F.sum(count_of("_val"))).alias("loss"), F.count(F.lit(1)).alias("inner_blocks"))
    best = loss.groupBy(*by, "fold").agg(F.min(F.struct(F.round("loss", 12).alias("loss"), (-F.col("_i")).alias("i"), "inner_blocks")).alias("b"))
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    out = folds.filter("fold <> 'lock'").join(best, [*by, "fold"], "left")
    at = F.when(F.col("b").isNull(), F.lit(len(alphas) // 2)).otherwise(-F.col("b.i"))
    return out.select(*by, "fold", "t0", "t1", at.cast("int").alias("setting"), F.get(grid, at.cast("int")).alias("alpha"), F.col("b.loss").alias("inner_loss"),
                      F.coalesce("b.inner_blocks", F.lit(0).cast("long")).alias("inner_blocks"))


def scheduled_refits(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, x: Sequence[str], y: str, sigma: str, every: int = 21, alphas=ALPHAS,
                     years: int = 5, blocks: int = 3, months: int = 6, least: int = 100) -> DataFrame:
    """Settings fixed at the start of each fold, coefficients refit on every ``every``-th test date of the fold.

    The target is ``y`` over ``sigma``. A refit sees rows of the last ``years`` whose label matured before its date, and
    holds until the next; with under ``least`` rows the model before stays. Dates are counted, not rows, so a group may
    be a panel of many instruments that share one model; all rows of a date are on one side of every boundary.
    """
    by, x, p = names(by), list(x), len(x)
    z, folds = cut_lineage(rows_.withColumn("_z", F.col(y) / F.greatest(F.col(sigma), F.lit(1e-6)))), cut_lineage(folds)
    settings = cut_lineage(chosen_settings(z, folds, by, date, matures, x, "_z", alphas, years, blocks, months, least))
    test = z.dropna(subset=x).join(settings, by).filter((F.col(date) >= F.col("t0")) & (F.col(date) < F.col("t1")))
    days = cut_lineage(test.select(*by, "fold", "setting", date).distinct().withColumn("_i", F.row_number().over(series([*by, "fold"], date)) - 1))
    marks = days.filter(F.col("_i") % every == 0).select(*by, "fold", "setting", F.col(date).alias("cut"), F.add_months(date, -12 * years).alias("since"))
    now = moments_before(z, _dates(by, (marks, "cut")), by, matures, x, "_z")
    old = moments_before(z, _dates(by, (marks, "since")), by, date, x, "_z")
    m = _at(_at(marks, now, by, "cut", "_now"), old, by, "since", "_old").withColumn("_m", minus("_now", "_old"))
    m = m.withColumn("_c", F.get(ridge_solutions(p, [(range(p), a) for a in alphas], least)("_m"), F.col("setting")))
    m = m.filter("_c is not null").withColumn("model_version", F.row_number().over(series([*by, "fold"], "cut")))
    models = m.select(*by, "fold", F.col("cut").alias(date), F.struct(F.col("cut").alias("trained_at"), count_of("_m").cast("bigint").alias("n_train"), "model_version", "_c").alias("_model"))
    # The newest model of the fold holds on each test date.
    held = F.last("_model", ignorenulls=True).over(series([*by, "fold"], date).rowsBetween(Window.unboundedPreceding, 0))
    serving = days.join(models, [*by, "fold", date], "left").withColumn("_model", held).select(*by, "fold", date, "_model.*")
    out = test.join(serving, [*by, "fold", date]).withColumn("prediction", linear(F.col("_c"), x) * F.col(sigma))
    return out.filter("prediction is not null").drop("_z", "_c", "setting", "t0", "t1", "inner_loss")


def feature_sets(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, sets: dict[str, Sequence[str]], y: str, sigma: str, alpha: float = 100.0,
                 reference: str | None = None, blocks: int = 3, months: int = 6, least: int = 500, least_rows: int = 8, least_wins: int = 2) -> DataFrame:
    """Feature sets on the same rows and folds: errors outside and inside, the inner slope, coverage, and the choice.

    Every set is a sub-block of one moment array. Models of a fold train on labels matured before it, those of the inner
    blocks on labels matured before the block. ``slope`` is the sum of prediction * target over that of prediction squared on
    the inner blocks, inside 0 to 1; it comes from moments weighted by sigma squared, so it is known before any row is read.
    One scan then gives raw and shrunk errors of all sets, the blocks' errors and the coverage (the share of the fold's
    rows that have the set's features; of the rows that have the reference's; 0 under ``least_rows``). ``chosen``: the set
    with the least mean inner error that beats the reference in ``least_wins`` blocks, else the reference.
    """
    by, names_ = names(by), list(sets)
    reference = reference or names_[0]
    x = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    p = len(x)
    inside = [[x.index(c) for c in cols] for cols in sets.values()]
    z = cut_lineage(rows_.withColumn("_z", F.col(y) / F.greatest(F.col(sigma), F.lit(1e-6))).withColumn("_w", F.pow(F.greatest(F.col(sigma), F.lit(1e-6)), 2)))
    dev = cut_lineage(folds.filter("fold <> 'lock'"))
    spans = inner_spans(dev, by, blocks, months)
    fits = moments_before(z, _dates(by, (dev, "t0"), (spans, "v0")), by, matures, x, "_z")
    solve = ridge_solutions(p, [(cols, alpha) for cols in inside], least)
    models = cut_lineage(fits.select(*by, "cut", solve("m").alias("_coef"), count_of("m").cast("bigint").alias("n_train")).filter("_coef is not null"))
    # Inner slopes, from the moments of the validation blocks (labels known at the fold's start).
    known = moments_before(z, _dates(by, (spans, "t0")), by, matures, x, "_z", F.col("_w"))
    dated = moments_before(z, _dates(by, (spans, "v0"), (spans, "v1")), by, date, x, "_z", F.col("_w"))
    v = spans.join(models.select(*by, F.col("cut").alias("v0"), "_coef"), [*by, "v0"])
    v = _at(_at(_at(v, dated, by, "v0", "_a"), dated, by, "v1", "_b"), known, by, "t0", "_known")
    v = v.withColumn("_val", F.when(F.col("v1") >= F.col("t0"), minus("_known", "_a")).otherwise(minus("_b", "_a")))
    v = v.select(*by, "fold", "_val", F.posexplode("_coef").alias("_i", "_c"))
    py, pp = shrinkage("_val", F.col("_c"), p)
    slope = F.least(F.greatest(F.coalesce(F.try_divide(F.sum(py), F.sum(pp)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    slopes = v.groupBy(*by, "fold", "_i").agg(slope.alias("slope"))
    listed = cut_lineage(slopes.groupBy(*by, "fold").agg(F.map_from_entries(F.collect_list(F.struct("_i", "slope"))).alias("_slopes")))
    # One scan: a row serves one fold outside and at most ``blocks`` inside.
    outer = dev.select(*by, "fold", F.lit(0).alias("k"), F.col("t0").alias("cut"), F.col("t1").alias("until"), F.lit(None).cast("date").alias("known_by"))
    inner = spans.select(*by, "fold", "k", F.col("v0").alias("cut"), F.col("v1").alias("until"), F.col("t0").alias("known_by"))
    roles = outer.unionByName(inner).join(models, [*by, "cut"]).join(listed, [*by, "fold"], "left")
    f = z.join(roles, by).filter((F.col(date) >= F.col("cut")) & (F.col(date) < F.col("until")) & (F.col("known_by").isNull() | (F.col(matures) < F.col("known_by"))))
    full = F.lit(True)
    for c in [*x, "_z"]:
        full = full & F.col(c).isNotNull()
    has = {}
    for name, cols in sets.items():
        h = F.lit(True)
        for c in cols:
            h = h & F.col(c).isNotNull()
        has[name] = h
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    base = has[reference] & F.col(y).isNotNull()
    cells = []
    for i, name in enumerate(names_):
        guess = linear(F.get("_coef", F.lit(i)), x) * F.col(sigma)
        s = F.coalesce(F.try_element_at("_slopes", F.lit(i)), F.lit(0.0))
        err = lambda q: F.avg(F.when(full, F.abs(F.col(y) - q)))
        cells.append(F.struct(F.lit(name).alias("candidate"), F.lit(i).alias("i"), err(guess).alias("mae"), err(s * guess).alias("shrunk_mae"),
                              one(base & has[name]).alias("present"), F.max(s).alias("slope")))
    g = f.groupBy(*by, "fold", "k").agg(one(full).alias("n"), one(base).alias("base"), F.avg(F.when(full, F.abs(y))).alias("zero_mae"), F.max("n_train").alias("n_train"), F.array(*cells).alias("_e"))
    g = cut_lineage(g.select(*by, "fold", "k", "n", "base", "zero_mae", "n_train", F.explode("_e").alias("e")).select("*", "e.*").drop("e"))
    own = g.filter("k > 0 and n > 0")
    rival = own.filter(F.col("candidate") == reference).select(*by, "fold", "k", F.col("mae").alias("_ref"))
    inner_side = own.join(rival, [*by, "fold", "k"]).groupBy(*by, "fold", "candidate").agg(F.avg("mae").alias("inner_mae"), one(F.col("mae") < F.col("_ref")).alias("inner_wins"))
    eligible = F.when((F.col("inner_wins") >= least_wins) | (F.col("candidate") == reference), F.struct(F.col("inner_mae").alias("e"), (F.col("candidate") != reference).alias("o"), "i", "candidate"))
    out = g.filter(f"k = 0 and n >= {least_rows}").join(inner_side, [*by, "fold", "candidate"], "left")
    pick = F.min(eligible).over(Window.partitionBy(*by, "fold"))
    coverage = F.when(F.col("present") >= least_rows, F.try_divide(F.col("present").cast("double"), F.col("base"))).otherwise(0.0)
    return out.withColumn("_pick", pick).select(*by, "fold", "candidate", "n_train", "n", coverage.alias("coverage"), "slope", "mae", "shrunk_mae", "zero_mae", "inner_mae", "inner_wins",
                                                (F.coalesce(F.col("_pick.candidate"), F.lit(reference)) == F.col("candidate")).alias("chosen"))


def nested_choice(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, bucket: str, y: str, windows=(2, 3, 5, 0), half_lives=(0, 126, 252, 504),
                  inner_months: int = 6, default: tuple[int, int] = (5, 0), least_inner: int = 20, least_train: int = 500) -> DataFrame:
    """Training window (years; 0: all) and half life of recency weights (days; 0: none) of each fold, chosen together.

    A candidate is the weighted class share per rule bucket (one row added to each class), fitted on labels that matured
    before the last ``inner_months`` of the training rows and judged by log loss on these months. Weighted counts are prefix
    sums a (group, bucket): a window is the difference of two, and the age at the cut is one factor, as weights are powers
    of the date. Losses need the inner counts by bucket and class only, so no candidate reads a row. A window with fewer than
    ``least_train`` rows is no candidate; with too few inner rows or no candidate the default holds.
    """
    by = names(by)
    key = [*by, bucket]
    f = cut_lineage(rows_.dropna(subset=[date, matures, bucket, y]).select(*names(by), date, matures, bucket, y))
    folds = cut_lineage(folds)
    spans = folds.select(*by, "fold", "t0", F.add_months("t0", -inner_months).alias("cut"))
    spans = spans.withColumns({f"_u{i}": F.add_months("cut", -12 * w) for i, w in enumerate(windows) if w})
    buckets = f.select(*key).distinct()
    at = cuts = cut_lineage(buckets.join(spans, by))
    age = lambda h: F.pow(F.lit(2.0), F.unix_date(F.col(date)) / F.lit(float(h))) if h else F.lit(1.0)
    sums = {f"c{j}_{k}": F.when(F.col(y) == k, age(h)).otherwise(0.0) for j, h in enumerate(half_lives) for k in range(3)}
    sums["n"] = F.lit(1.0)
    whole = F.struct(*[F.col(c) for c in sums])
    by_label = sums_before(f, cuts, key, matures, sums).select(*key, "cut", whole.alias("_now"))
    at = at.join(by_label, [*key, "cut"])
    olds = sums_before(f, _dates(key, *[(cuts, f"_u{i}") for i, w in enumerate(windows) if w]), key, date, sums).select(*key, "cut", whole.alias("_s"))
    for i, w in enumerate(windows):
        if w:
            at = at.join(olds.withColumnsRenamed({"cut": f"_u{i}", "_s": f"_o{i}"}), [*key, f"_u{i}"])
    # Inner counts by class, and the sizes of the fold.
    known = sums_before(f, spans.withColumnRenamed("cut", "_c").withColumnRenamed("t0", "cut"), by, matures, {"n_train": F.lit(1.0)}).withColumnRenamed("cut", "t0")
    inner_sums = {f"i{k}": F.when(F.col(y) == k, 1.0).otherwise(0.0) for k in range(3)}
    upto = sums_before(f, cuts.select(*key, F.col("t0").alias("cut")), key, matures, inner_sums).withColumnsRenamed({"cut": "t0", **{k: f"_b{k}" for k in inner_sums}})
    since = sums_before(f, cuts, key, date, inner_sums)
    at = at.join(upto, [*key, "t0"]).join(since, [*key, "cut"]).withColumns({k: F.col(f"_b{k}") - F.col(k) for k in inner_sums})
    fitted = {}
    for i, w in enumerate(windows):
        fitted[f"_n{i}"] = F.col("_now.n") - (F.col(f"_o{i}.n") if w else F.lit(0.0))
        for j, h in enumerate(half_lives):
            decay = F.pow(F.lit(2.0), -F.unix_date("cut") / F.lit(float(h))) if h else F.lit(1.0)
            fitted[f"_c{i}_{j}"] = F.array(*[F.greatest((F.col(f"_now.c{j}_{k}") - (F.col(f"_o{i}.c{j}_{k}") if w else F.lit(0.0))) * decay, F.lit(0.0)) + 1 for k in range(3)])
    at = at.select(*by, "fold", "i0", "i1", "i2", *[c.alias(n) for n, c in fitted.items()])
    cells = [F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(i * len(half_lives) + j).alias("i"), F.col(f"_c{i}_{j}").alias("c"), F.col(f"_n{i}").alias("n"))
             for i, w in enumerate(windows) for j, h in enumerate(half_lives)]
    inner_rows = F.col("i0") + F.col("i1") + F.col("i2")
    share = lambda k: F.get("e.c", F.lit(k)) / (F.get("e.c", F.lit(0)) + F.get("e.c", F.lit(1)) + F.get("e.c", F.lit(2)))
    loss = sum((F.col(f"i{k}") * -F.ln(F.greatest(share(k), F.lit(1e-7))) for k in range(3)), F.lit(0.0))
    tried = at.select(*by, "fold", "i0", "i1", "i2", F.explode(F.array(*cells)).alias("e")).groupBy(*by, "fold", "e.w", "e.h", "e.i").agg(
        F.sum(loss).alias("loss"), F.sum("e.n").alias("n"), F.sum(inner_rows).alias("inner"))
    g = tried.groupBy(*by, "fold").agg(F.max("inner").cast("bigint").alias("n_inner"), F.min(F.when(F.col("n") >= least_train, F.struct(
        F.round(F.col("loss") / F.col("inner"), 12).alias("loss"), "i", "w", "h"))).alias("b"))
    j = folds.select(*by, "fold", "t0").join(known, [*by, "t0"]).join(g, [*by, "fold"])
    use = (F.col("n_inner") >= least_inner) & (F.col("n_train") >= least_train) & F.col("b").isNotNull()
    return j.select(*by, "fold", F.col("n_train").cast("bigint").alias("n_train"), "n_inner", F.when(use, F.col("b.w")).otherwise(default[0]).alias("window_years"),
                    F.when(use, F.col("b.h")).otherwise(default[1]).alias("half_life"), F.when(use, F.col("b.loss")).alias("inner_loss"))
