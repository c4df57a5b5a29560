"""Walk-forward folds with purge, block bootstrap, multiple-testing adjustment, publication gates."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from . import ranks
from .frames import names, series

DRAWS = 2000
SPREAD = 32


def draw(b: Column, slot: Column, n: Column) -> Column:
    """Block number of a draw: the same digits on every engine and every run."""
    h = F.md5(F.concat_ws("-", b.cast("string"), slot.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), n)


def _total(cells: str, key: str) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, e: acc + F.coalesce(e[key], F.lit(0.0)))


def block_bootstrap(df: DataFrame, by, block: str, sums: dict[str, Column], statistic, draws: int = DRAWS, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a statistic of block sums, blocks drawn with replacement.

    Rows fold to one row per (group, block) first; a group keeps its blocks (calendar months) in one array, and each
    draw adds up array cells, so the work is draws times blocks, whatever the number of rows. ``statistic`` maps
    {name: summed column} to a column.
    """
    by, keys = names(by), list(sums)
    g = df.groupBy(*by, block).agg(*[F.sum(c).cast("double").alias(k) for k, c in sums.items()])
    a = g.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(block, *keys))).alias("_b"))
    a = a.withColumn("_n", F.size("_b"))
    point = {k: _total("_b", k) for k in keys}
    # A group is one row here; its draws are spread over the session's tasks before they are unrolled.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = -(-draws // SPREAD)
    a = a.withColumn("point", statistic(point)).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    a = a.repartition(tasks, *by, "_c").withColumn("_lo", F.col("_c") * size)
    d = a.filter(F.col("_lo") < draws).withColumn("_d", F.explode(F.sequence("_lo", F.least(F.col("_lo") + size, F.lit(draws)) - 1)))
    d = d.withColumn("_p", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda s: F.get("_b", draw(F.col("_d"), s, F.col("_n")).cast("int"))))
    d = d.withColumn("_s", statistic({k: _total("_p", k) for k in keys}))
    q = F.percentile("_s", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    r = d.groupBy(*by).agg(F.first("point").alias("point"), F.first("_n").alias("blocks"), q.alias("_q"),
                           F.avg((F.col("_s") >= 0).cast("double")).alias("_ge"), F.avg((F.col("_s") <= 0).cast("double")).alias("_le"))
    return r.select(*by, "point", "blocks", F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(1)).alias("hi"),
                    F.least(F.lit(1.0), 2 * F.least("_ge", "_le")).alias("p_value"))


def _auc(ups: np.ndarray, downs: np.ndarray) -> np.ndarray:
    """Area under the curve of histograms (rows) over rising scores; ties count half."""
    below = np.cumsum(downs, axis=1) - downs
    with np.errstate(invalid="ignore", divide="ignore"):
        return (ups * (below + downs / 2)).sum(axis=1) / (ups.sum(axis=1) * downs.sum(axis=1))


def auc_bootstrap(df: DataFrame, by, block: str, score: str, positive: str, low: float = -1.0, high: float = 1.0, bins: int = 1000, draws: int = DRAWS,
                  alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the area under the curve, blocks drawn with replacement like ``block_bootstrap`` draws them.

    A rank statistic is no function of block sums, but it is one of joint histograms: rows fold to counts per (block, score
    cell, class), a draw adds up the histograms of its blocks, and the area follows from running sums. Scores are told apart
    to one of ``bins`` cells between ``low`` and ``high``; ties count half. A group keeps blocks times cells, whatever its
    rows, and its draws are spread over all tasks. Draws without one of the classes say nothing.
    """
    by = names(by)
    cell = F.least(F.greatest(F.floor((F.col(score) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    rows_ = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    up = F.col(positive).cast("boolean").cast("bigint")
    cells = rows_.groupBy(*by, block, cell.alias("_x")).agg(F.sum(up).alias("_p"), F.sum(1 - up).alias("_q"))
    cells = cells.withColumn("_i", F.dense_rank().over(Window.partitionBy(*by).orderBy(block)) - 1)
    one = cells.groupBy(*by).agg(F.collect_list(F.struct(F.col("_i").cast("bigint").alias("i"), F.col("_x").cast("bigint").alias("x"), "_p", "_q")).alias("_e"), (F.max("_i") + 1).alias("blocks"))
    one = one.select(*by, "blocks", *[F.col(f"_e.{c}").alias(f"_a{k}") for k, c in enumerate(("i", "x", "_p", "_q"))])
    size = -(-draws // SPREAD)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = one.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(size)))).repartition(tasks, *by, "_lo")

    @F.pandas_udf("array<double>")
    def drawn(blocks: pd.Series, lo: pd.Series, i: pd.Series, x: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for n, first, rows, at, ups, downs in zip(blocks, lo, i, x, p, q):
            hist = np.zeros((2, n, bins))
            hist[0, rows, at], hist[1, rows, at] = ups, downs
            last = min(first + size, draws)
            weight = np.zeros((last - first, n))
            for d in range(first, last):
                for s in range(n):
                    weight[d - first, int(hashlib.md5(f"{d}-{s}".encode()).hexdigest()[:8], 16) % n] += 1
            # The first number is the area of the rows themselves.
            out.append([None if np.isnan(a) else float(a) for a in np.concatenate([_auc(*hist.sum(axis=1, keepdims=True)), _auc(weight @ hist[0], weight @ hist[1])])])
        return pd.Series(out)

    d = spread.withColumn("_s", drawn("blocks", "_lo", *[f"_a{k}" for k in range(4)]))
    d = d.select(*by, "blocks", F.get("_s", F.lit(0)).alias("point"), F.explode(F.slice("_s", 2, draws)).alias("_v"))
    q = F.percentile("_v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return d.groupBy(*by).agg(F.first("point").alias("point"), F.first("blocks").alias("blocks"), q.alias("_q")).select(
        *by, "point", "blocks", F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(1)).alias("hi"))


# Statistics by name, as expressions over block sums; a caller may pass any other function of the same shape.
STATISTICS = {
    "mean": lambda s: F.try_divide(s["x"], s["n"]),
    "ratio": lambda s: F.try_divide(s["x"], s["z"]),
    "root_mean_square": lambda s: F.sqrt(F.try_divide(s["xx"], s["n"])),
}


def month(date: str) -> Column:
    return F.date_format(date, "yyyy-MM")


def paired_ci(df: DataFrame, by, block: str, a: str, b: str, draws: int = DRAWS, least: int = 10) -> DataFrame:
    """Mean difference of two absolute errors on the same rows with its interval; missing under ``least`` rows."""
    f = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = {"x": F.abs(a) - F.abs(b), "n": F.lit(1.0)}
    r = block_bootstrap(f, by, block, sums, STATISTICS["mean"], draws)
    n = f.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("rows"))
    j = r.join(n, names(by))
    return j.select(*names(by), "rows", *[F.when(F.col("rows") >= least, F.col(c)).alias(c) for c in ("point", "lo", "hi", "p_value")])


def holm(df: DataFrame, family, p: str = "p_value", tie=()) -> DataFrame:
    """Step-down adjusted p values inside each family."""
    family = names(family)
    w = Window.partitionBy(*family).orderBy(p, *names(tie))
    f = df.withColumn("_k", F.row_number().over(w) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    step = F.max((F.col("_m") - F.col("_k")) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("p_holm", F.least(F.lit(1.0), step)).drop("_k", "_m")


# ---- folds -------------------------------------------------------------------------------


def fold_table(rows_: DataFrame, by, date: str, first_test: str, test_months: int = 6, lock_months: int = 12) -> DataFrame:
    """Test blocks per group from ``first_test`` to the start of the locked last months, and the locked block itself."""
    by = names(by)
    g = rows_.groupBy(*by).agg(F.max(date).alias("_last"))
    g = g.withColumn("_lock", F.date_add(F.add_months("_last", -lock_months), 1)).filter(F.col("_lock") > F.lit(first_test).cast("date"))
    starts = F.expr(f"filter(sequence(date'{first_test}', _lock, interval {test_months} month), d -> d < _lock)")
    dev = g.select(*by, "_last", "_lock", F.posexplode(starts).alias("_i", "t0"))
    dev = dev.select(*by, F.format_string("dev_%02d", F.col("_i") + 1).alias("fold"), "t0", F.least(F.add_months("t0", test_months), "_lock").alias("t1"))
    lock = g.select(*by, F.lit("lock").alias("fold"), F.col("_lock").alias("t0"), F.date_add("_last", 1).alias("t1"))
    return dev.unionByName(lock)


def inner_blocks(folds: DataFrame, by, blocks: int = 3, months: int = 6) -> DataFrame:
    """The ``blocks`` half years before each development block, for choices made on the past only."""
    f = folds.filter("fold <> 'lock'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(blocks))))
    return f.select(*names(by), "fold", "k", F.expr(f"add_months(t0, -{months} * k)").alias("v0"), F.expr(f"add_months(t0, -{months} * (k - 1))").alias("v1"))


def with_roles(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, t0="t0", t1="t1") -> DataFrame:
    """Every row in every fold it serves: test inside the block, train when its label matured before the block."""
    role = F.when((F.col(date) >= F.col(t0)) & (F.col(date) < F.col(t1)), "test").when(F.col(matures) < F.col(t0), "train")
    return rows_.join(folds, names(by)).withColumn("role", role).filter("role is not null")


def fold_summary(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, least_train: int = 500, least_test: int = 60) -> DataFrame:
    """Row counts and spans of each fold, with the reason a fold is left out."""
    by = names(by)
    n = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0))
    c = with_roles(rows_, folds, by, date, matures).groupBy(*by, "fold").agg(
        n("train").alias("train_rows"), n("test").alias("test_rows"), F.min(F.when(F.col("role") == "train", F.col(date))).alias("train_start"),
        F.max(F.when(F.col("role") == "train", F.col(date))).alias("train_end"))
    j = folds.join(c, [*by, "fold"], "left").na.fill(0, ["train_rows", "test_rows"])
    why = F.when(F.col("test_rows") == 0, "no_test_rows").when((F.col("test_rows") < least_test) & F.col("fold").startswith("dev"), "few_test_rows").when(
        F.col("train_rows") < least_train, "few_train_rows").otherwise("")
    return j.withColumn("excluded", why)


def purge_check(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, origin: str, trained_by: str | None = None) -> DataFrame:
    """Folds whose newest training label matures after the first test row's information date.

    ``trained_by`` names the date that decided which rows train (default: maturity, which cannot leak).
    """
    by = names(by)
    r = with_roles(rows_, folds, by, date, trained_by or matures).groupBy(*by, "fold").agg(
        F.max(F.when(F.col("role") == "train", F.col(matures))).alias("train_matures"), F.min(F.when(F.col("role") == "test", F.col(origin))).alias("test_origin"))
    return r.filter(F.col("train_matures") > F.col("test_origin"))


def panel_roles(rows_: DataFrame, date: str, label: str, t0: str, t1: str, target: Column, years: int = 5) -> DataFrame:
    """One outer fold of a panel: labels before the test start within the last years train, target rows in the span test."""
    a, b = F.lit(t0).cast("date"), F.lit(t1).cast("date")
    role = F.when((F.col(label) < a) & (F.col(date) >= F.add_months(a, -12 * years)), "train").when(target & F.col(date).between(a, b), "test")
    return rows_.withColumn("role", role).filter("role is not null")


def date_blocks(rows_: DataFrame, date: str, splits: int = 3, block: int = 126) -> DataFrame:
    """The last ``splits`` blocks of dates as validation in turn; all rows of a date are on one side.

    Only the distinct dates (bounded by the calendar) are ranked; rows meet their block by date.
    """
    days = rows_.select(F.col(date).alias("_day")).distinct().withColumn("_one", F.lit(1))
    back = F.row_number().over(Window.partitionBy("_one").orderBy(F.col("_day").desc())) - 1
    size = F.greatest(F.least(F.lit(block), F.floor(F.count(F.lit(1)).over(Window.partitionBy("_one")) / (splits + 2))), F.lit(1))
    d = days.withColumn("_k", F.floor(back / size).cast("int"))
    use = F.filter(F.sequence(F.lit(0), F.lit(splits - 1)), lambda s: F.col("_k") >= s)
    d = d.select("_day", F.explode(F.transform(use, lambda s: F.struct((F.lit(splits) - s).alias("split"), F.when(F.col("_k") == s, "validate").otherwise("train").alias("side")))).alias("e"))
    return rows_.join(d.select(F.col("_day").alias(date), "e.*"), date)


def one_hot(df: DataFrame, column: str, values) -> DataFrame:
    return df.withColumns({f"is_{v}": (F.col(column) == v).cast("int") for v in values})


def train_windows(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, years=(2, 3, 5)) -> DataFrame:
    """Training rows of each fold under trailing windows of N years and under the expanding one."""
    by = names(by)
    t = with_roles(rows_, folds, by, date, matures).filter("role = 'train'")
    n = lambda y: F.sum((F.col(date) >= F.add_months("t0", -12 * y)).cast("bigint")).alias(f"rows_{y}y")
    return t.groupBy(*by, "fold").agg(*[n(y) for y in years], F.count(F.lit(1)).alias("rows_expanding"))


def retrain_positions(test: DataFrame, by, date: str, every=(1, 5, 21)) -> DataFrame:
    """Which test rows refit the model under each schedule."""
    i = F.row_number().over(series(by, date)) - 1
    return test.withColumn("_i", i).withColumns({f"refit_{k}": (F.col("_i") % k == 0) for k in every}).drop("_i")


# ---- publication -------------------------------------------------------------------------


def slope_gate(oof: DataFrame, by, date: str, h: int, y="y", p="p", sigma="sigma", coverage: float = 0.8, draws: int = DRAWS) -> DataFrame:
    """Shrink, gate and size a price forecast: slope on the oldest half, publication on the next quarter, report on the last.

    Rows whose labels overlap a boundary are left out. The gate is the upper bound of the paired error difference.
    """
    by = names(by)
    f = oof.withColumn("_i", F.row_number().over(series(by, date)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    c1, c2, gap = F.floor(F.col("_n") / 2), F.floor(F.col("_n") * 3 / 4), h - 1
    part = F.when(F.col("_i") < c1 - gap, "calibrate").when((F.col("_i") >= c1) & (F.col("_i") < c2 - gap), "gate").when(F.col("_i") >= c2, "evaluate")
    f = f.withColumn("part", part).filter("part is not null")
    cal = f.filter("part = 'calibrate'").groupBy(*by).agg(
        F.least(F.greatest(F.coalesce(F.try_divide(F.sum(F.col(p) * F.col(y)), F.sum(F.col(p) * F.col(p))), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("slope0"))
    f = f.join(cal, by)
    gain = F.abs(F.col(y) - F.col("slope0") * F.col(p)) - F.abs(y)
    gate = block_bootstrap(f.filter("part = 'gate'").withColumn("_m", month(date)), by, "_m", {"x": gain, "n": F.lit(1.0)}, STATISTICS["mean"], draws)
    gate = gate.select(*by, F.col("hi").alias("gate_hi"), (F.col("hi") < 0).alias("published"))
    f = f.join(gate, by).withColumn("slope", F.when(F.col("published"), F.col("slope0")).otherwise(0.0))
    f = f.withColumn("_s", F.abs(F.col(y) - F.col("slope") * F.col(p)) / F.greatest(sigma, F.lit(1e-6)))
    q = ranks.quantiles(f.filter("part = 'calibrate'"), by, "_s", {"band_q": coverage})
    e = f.filter("part = 'evaluate'").join(q, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_evaluation"), F.first("slope0").alias("calibration_slope"), F.first("slope").alias("slope"), F.first("gate_hi").alias("gate_hi"),
        F.first("published").alias("published"), F.first("band_q").alias("band_q"), F.avg(F.abs(y)).alias("zero_mae"),
        F.avg(F.abs(F.col(y) - F.col(p))).alias("raw_mae"), F.avg(F.abs(F.col(y) - F.col("slope") * F.col(p))).alias("shrunk_mae"),
        F.avg((F.col("_s") <= F.col("band_q")).cast("double")).alias("coverage"))
    return e


def nowcast_policy(oof: DataFrame, by, order: str, truth: str, models=("level", "residual"), baselines=("naive", "seasonal")) -> DataFrame:
    """Choose a model on the first half of the out-of-fold rows, report on the second; publish only if it beats every baseline."""
    by = names(by)
    f = oof.dropna(subset=[truth, *models, *baselines]).withColumn("_i", F.row_number().over(series(by, order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    err = lambda m, c: F.avg(F.when(c, F.abs(F.col(m) - F.col(truth))))
    g = f.groupBy(*by).agg(F.max("_n").alias("n"), *[err(m, first).alias(f"_a_{m}") for m in models], *[err(m, ~first).alias(f"_b_{m}") for m in (*models, *baselines)],
                           F.max(truth).alias("past_max"))
    pick = F.array_min(F.array(*[F.struct(F.col(f"_a_{m}").alias("e"), F.lit(i).alias("i"), F.lit(m).alias("m"), F.col(f"_b_{m}").alias("b")) for i, m in enumerate(models)]))
    g = g.withColumn("_p", pick)
    beats = F.lit(True)
    for b in baselines:
        beats = beats & (F.col("_p.b") < F.col(f"_b_{b}"))
    return g.select(*by, "n", F.col("_p.m").alias("chosen"), F.col("_p.b").alias("mae"), *[F.col(f"_b_{b}").alias(f"mae_{b}") for b in baselines], beats.alias("published"), "past_max")


def model_comparison(pnl: DataFrame, by, model: str, date: str, value: str, split, least_days: int = 60, least_trades: int = 20) -> DataFrame:
    """Best model of the selection period reported on the evaluation period, over the dates all models share.

    pnl: one row per (by, model, date), value missing when not traded.
    """
    by = names(by)
    members = pnl.groupBy(*by).agg(F.countDistinct(model).alias("_m"))
    days = pnl.groupBy(*by, date).agg(F.countDistinct(model).alias("_k")).join(members, by).filter("_k = _m").select(*by, date)
    c = pnl.join(days, [*by, date], "left_semi").withColumn("late", F.col(date) >= split)
    s = c.groupBy(*by, model, "late").agg(F.count(F.lit(1)).alias("days"), F.count(value).alias("trades"), F.avg(value).alias("mean"))
    ok = s.filter((~F.col("late")) & (F.col("days") >= least_days) & (F.col("trades") >= least_trades))
    best = ok.groupBy(*by).agg(F.max(F.struct("mean", model)).alias("b")).select(*by, F.col(f"b.{model}").alias(model), F.col("b.mean").alias("selection_mean"))
    return best.join(s.filter("late"), [*by, model]).select(*by, F.col(model), "selection_mean", F.col("days").alias("evaluation_days"), F.col("trades").alias("evaluation_trades"), F.col("mean").alias("evaluation_mean"))


verdict = labels.verdict
