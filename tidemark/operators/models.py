"""Linear models from moment sums: ridge per fold, expanding refits, volatility and autoregressive forecasts.

Rows fold to first and second moments per (group, block) in one partial aggregation; expanding training sets are
running sums of those moments over blocks. Only the small normal equations reach Python, one per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bars as B
from .asof import asof_join
from .frames import names, series

M = "_mom"


def moments(df: DataFrame, by, x: Sequence[str], y: Sequence[str] | str, weight: Column | None = None) -> DataFrame:
    """Sums of 1, z, z z' for z = (x, y), as one array per group (upper triangle, row by row)."""
    cols = [*x, *names(y)]
    w = weight if weight is not None else F.lit(1.0)
    terms = [w, *[w * F.col(c) for c in cols]]
    terms += [w * F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i:]]
    return df.groupBy(*names(by)).agg(*[F.sum(t).alias(f"_s{i}") for i, t in enumerate(terms)]).select(
        *names(by), F.array(*[F.col(f"_s{i}") for i in range(len(terms))]).alias(M))


def accumulate(mom: DataFrame, by, order: str, k: int) -> DataFrame:
    """Running sums of moment arrays over k columns, one window sum a moment, over blocks of a group."""
    w = series(by, order).rowsBetween(Window.unboundedPreceding, 0)
    n = (k + 1) * (k + 2) // 2
    return mom.select(*[c for c in mom.columns if c != M], *[F.sum(F.get(M, F.lit(i))).over(w).alias(f"_s{i}") for i in range(n)]).select(
        *[c for c in mom.columns if c != M], F.array(*[F.col(f"_s{i}") for i in range(n)]).alias(M))


def _unpack(m, k: int):
    """(n, mean, second moment matrix) of a moment array over k columns."""
    n = m[0]
    s = np.asarray(m[1:1 + k])
    q = np.zeros((k, k))
    q[np.triu_indices(k)] = m[1 + k:]
    return n, s / n, q + np.triu(q, 1).T


def solve(p: int, alpha: float = 0.0, scale: bool = False, least: int = 2):
    """Pandas UDF: moment array -> [intercept, slopes]; ridge on standardised inputs when ``scale``; missing under ``least`` rows."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        out = []
        for a in m:
            if a is None or a[0] < least:
                out.append(None)
                continue
            n, mean, q = _unpack(np.asarray(a, float), p + 1)
            c = q - n * np.outer(mean, mean)
            sxx, sxy = c[:p, :p], c[:p, p]
            s = np.sqrt(np.maximum(np.diag(sxx) / n, 0.0)) if scale else np.ones(p)
            s = np.where(s > 0, s, 1.0)
            a_mat = sxx / np.outer(s, s) + alpha * np.eye(p)
            try:
                beta = np.linalg.solve(a_mat, sxy / s) / s
            except np.linalg.LinAlgError:
                beta = np.linalg.lstsq(a_mat, sxy / s, rcond=None)[0] / s
            out.append([float(mean[p] - beta @ mean[:p]), *beta.tolist()])
        return pd.Series(out)

    return run


def dot(coef: str, x: Sequence[str]) -> Column:
    out = F.get(coef, F.lit(0))
    for i, c in enumerate(x):
        out = out + F.get(coef, F.lit(i + 1)) * F.col(c)
    return out


# ---- folds -------------------------------------------------------------------------------


def expanding_coefficients(rows_: DataFrame, cuts: DataFrame, by, matures: str, x, y: str, alpha: float, least: int = 500) -> DataFrame:
    """Coefficients per (group, cut) from all rows whose label matured before the cut date.

    cuts: by..., cut, t0. A row enters at the first cut after its maturity; later cuts add up.
    """
    by = names(by)
    starts = cuts.groupBy(*by).agg(F.array_sort(F.collect_list("t0")).alias("_t"))
    f = rows_.dropna(subset=[*x, y, matures]).join(starts, by)
    f = f.withColumn("_k", F.size(F.filter("_t", lambda t: t <= F.col(matures))) + 1).filter(F.col("_k") <= F.size("_t"))
    mom = moments(f, [*by, "_k"], x, y)
    every = starts.select(*by, F.posexplode("_t").alias("_i", "t0")).select(*by, (F.col("_i") + 1).alias("_k"), "t0")
    full = every.join(mom, [*by, "_k"], "left")
    zeros = F.array_repeat(F.lit(0.0), 1 + (len(x) + 1) + (len(x) + 1) * (len(x) + 2) // 2)
    full = accumulate(full.withColumn(M, F.coalesce(M, zeros)), by, "_k", len(x) + 1)
    coef = full.withColumn("n_train", F.get(M, F.lit(0)).cast("bigint")).withColumn("coef", solve(len(x), alpha, True, least)(M))
    return cuts.join(coef.select(*by, "t0", "n_train", "coef"), [*by, "t0"])


def ridge_folds(rows_: DataFrame, folds: DataFrame, by, date: str, matures: str, x, y: str, sigma: str, alpha: float = 1e4, least: int = 500) -> DataFrame:
    """Out-of-fold predictions: ridge on y / sigma of matured rows, times sigma of the test row."""
    z = rows_.withColumn("_z", F.col(y) / F.greatest(sigma, F.lit(1e-6)))
    coef = expanding_coefficients(z, folds, by, matures, x, "_z", alpha, least)
    test = z.dropna(subset=list(x)).join(coef, names(by)).filter((F.col(date) >= F.col("t0")) & (F.col(date) < F.col("t1")))
    return test.withColumn("prediction", dot("coef", x) * F.col(sigma)).filter("prediction is not null").drop("_z")


def expanding_ridge(rows_: DataFrame, by, order: str, known: Column, x, y: str, alpha: float = 10.0, least: int = 60, offset: str | None = None) -> DataFrame:
    """Refit every period on rows whose target is known by then (``known``: first period that may use the row).

    ``offset`` is taken off the target before the fit and added back.
    """
    by = names(by)
    f = rows_.withColumn("_y", F.col(y) - F.col(offset) if offset else F.col(y)).withColumn("_k", known)
    mom = moments(f.dropna(subset=[*x, "_y", "_k"]), [*by, "_k"], x, "_y")
    acc = accumulate(mom, by, "_k", len(x) + 1).withColumnRenamed("_k", "_at")
    j = asof_join(rows_, acc, order, "_at", by, [M], chunk_days=3650)
    c = j.withColumn("coef", solve(len(x), alpha, True, least)(M)).withColumn("n_train", F.get(M, F.lit(0)).cast("bigint")).drop(M)
    p = dot("coef", x)
    return c.withColumn("prediction", p + F.col(offset) if offset else p)


def har_sigma(bars: DataFrame, h: int, refit: int = 60, least: int = 500) -> DataFrame:
    """Forecast of the h-session return scale from daily, weekly and monthly variance, refit every ``refit`` sessions.

    Training rows end h sessions before the refit, so their targets are realised.
    """
    K, T = "instrument", "session"
    f = bars.withColumn("v", F.pow(B.change("close", K, T), 2)).withColumn("i", F.row_number().over(series(K, T)) - 1)
    # greatest() skips missing values, so the guard keeps a missing variance missing.
    safe = lambda c: F.when(c.isNotNull(), F.ln(F.greatest(c, F.lit(1e-12))))
    f = f.withColumns({"xd": safe(B.lagged("v")), "_w": B.roll(F.avg, "v", 5), "_m": B.roll(F.avg, "v", 22)})
    fwd = series(K, T).rowsBetween(0, h - 1)
    f = f.withColumns({"xw": safe(B.lagged("_w")), "xm": safe(B.lagged("_m")),
                       "y": safe(F.sqrt(F.when(F.count("v").over(fwd) == h, F.sum("v").over(fwd))))})
    x = ["xd", "xw", "xm"]
    ok = F.col("xd").isNotNull() & F.col("xw").isNotNull() & F.col("xm").isNotNull()
    # The fit at row i uses rows before i - h; rows are grouped by the refit number they first serve.
    usable = f.filter(ok & F.col("y").isNotNull())
    seen = F.row_number().over(series(K, "i"))
    first = usable.withColumn("_s", seen).filter(F.col("_s") == least).select(K, F.greatest(F.col("i") + 1 + h, F.lit(least + 1 + h)).alias("i0"))
    block = F.greatest(F.ceil((F.col("i") + 1 + h - F.col("i0")) / refit), F.lit(0)).cast("int")
    mom = moments(usable.join(first, K).withColumn("_k", block), [K, "_k"], x, "y")
    coef = accumulate(mom, K, "_k", 4).withColumn("coef", solve(3, 0.0, False, least)(M)).select(K, "_k", "coef")
    now = f.filter(ok).join(first, K).filter("i >= i0").withColumn("_k", F.floor((F.col("i") - F.col("i0")) / refit).cast("int"))
    return now.join(coef, [K, "_k"]).select(K, T, F.exp(dot("coef", x)).alias("sigma_har"), F.exp("y").alias("realised"))


# ---- autoregressions ---------------------------------------------------------------------


def _lags(df: DataFrame, by, order: str, value: str, lags: int, difference: bool) -> DataFrame:
    d = F.col(value) - F.lag(value).over(series(by, order)) if difference else F.col(value)
    f = df.withColumn("_d", d)
    return f.withColumns({f"_l{k}": F.lag("_d", k).over(series(by, order)) for k in range(1, lags + 1)})


def companion_path(series_: int, lags: int, steps: int, difference: bool = True):
    """Pandas UDF: coefficients of each series, recent changes (newest lag first) and level -> the first series' path.

    The recursion is one matrix: the companion of constant, changes and their lags. It is applied to all rows at once, a
    step at a time, so every horizon up to ``steps`` comes from one pass.
    """
    width = 1 + series_ * lags

    @F.pandas_udf("array<double>")
    def path(coefs: pd.Series, near: pd.Series, level: pd.Series) -> pd.Series:
        n = len(level)
        if not n:
            return pd.Series([], dtype=object)
        a = np.zeros((n, width, width))
        a[:, 0, 0] = 1.0
        a[:, 1:1 + series_] = np.array([[np.asarray(c, float) for c in row] for row in coefs])
        a[:, 1 + series_:, 1:width - series_] = np.eye(width - 1 - series_)
        z = np.concatenate([np.ones((n, 1)), np.array(near.tolist(), float)], axis=1)
        at, out = level.to_numpy(float).copy(), np.empty((n, steps))
        for k in range(steps):
            z = np.einsum("nij,nj->ni", a, z)
            at = at + z[:, 1] if difference else z[:, 1]
            out[:, k] = at
        return pd.Series(list(out))

    return path


def ar_forecasts(df: DataFrame, by, order: str, value: str, horizons=(1, 3, 6, 12), lags: int = 2, difference: bool = True, least: int = 48) -> DataFrame:
    """At every origin the AR forecast beside the random walk and the drift, for each horizon; expanding refits.

    Moments of (lags, value) accumulate over origins; the recursion of a few steps runs in one Pandas UDF.
    """
    by = names(by)
    f = _lags(df, by, order, value, lags, difference)
    x = [f"_l{k}" for k in range(1, lags + 1)]
    use = f.dropna(subset=[*x, "_d"])
    acc = accumulate(moments(use, [*by, order], x, "_d"), by, order, lags + 1).withColumn("coef", solve(lags, 0.0, False, least)(M))
    recent = F.array(F.col("_d"), *[F.col(c) for c in x[:-1]])
    j = f.join(acc.select(*by, order, "coef"), [*by, order]).filter("coef is not null").withColumn("_recent", recent)
    top = max(horizons)

    path = companion_path(1, lags, top, difference)
    drift = F.avg("_d").over(series(by, order).rowsBetween(Window.unboundedPreceding, 0)) if difference else F.lit(0.0)
    j = j.withColumn("_path", path(F.array("coef"), "_recent", value)).withColumn("_drift", drift)
    w = series(by, order)
    items = F.array(*[F.struct(F.lit(h).alias("horizon"), F.get("_path", F.lit(h - 1)).alias("ar"), F.col(value).alias("rw"),
                               (F.col(value) + h * F.col("_drift")).alias("drift"), F.col(f"_a{h}").alias("actual")) for h in horizons])
    j = j.withColumns({f"_a{h}": F.lead(value, h).over(w) for h in horizons}).withColumn("_e", F.explode(items))
    return j.select(*by, order, "_e.*")


def var_paths(df: DataFrame, by, order: str, values, horizons=(1, 3, 6, 12), lags: int = 2, least: int = 48) -> DataFrame:
    """VAR on differences at every origin; the first series is forecast at all ``horizons`` from one recursion."""
    by, values = names(by), list(values)
    w = series(by, order)
    f = df.withColumns({f"_d{i}": F.col(v) - F.lag(v).over(w) for i, v in enumerate(values)})
    f = f.withColumns({f"_l{i}_{k}": F.lag(f"_d{i}", k).over(w) for i in range(len(values)) for k in range(1, lags + 1)})
    x = [f"_l{i}_{k}" for k in range(1, lags + 1) for i in range(len(values))]
    out = None
    for i in range(len(values)):
        acc = accumulate(moments(f.dropna(subset=[*x, f"_d{i}"]), [*by, order], x, f"_d{i}"), by, order, len(x) + 1)
        part = acc.withColumn(f"_c{i}", solve(len(x), 0.0, False, least)(M)).select(*by, order, f"_c{i}")
        out = part if out is None else out.join(part, [*by, order])
    near = F.array(*[F.col(f"_d{i}") for i in range(len(values))], *[F.col(f"_l{i}_{k}") for k in range(1, lags) for i in range(len(values))])
    j = f.withColumns({f"_a{h}": F.lead(values[0], h).over(w) for h in horizons}).join(out, [*by, order]).filter("_c0 is not null").withColumn("_near", near)
    j = j.withColumn("_path", companion_path(len(values), lags, max(horizons))(F.array(*[F.col(f"_c{i}") for i in range(len(values))]), "_near", F.col(values[0])))
    items = F.array(*[F.struct(F.lit(h).alias("horizon"), F.get("_path", F.lit(h - 1)).alias("var"), F.col(f"_a{h}").alias("actual")) for h in horizons])
    return j.select(*by, order, F.explode(items).alias("_e")).select(*by, order, "_e.*")


def var_forecasts(df: DataFrame, by, order: str, values, horizon: int, lags: int = 2, least: int = 48) -> DataFrame:
    """The same at one horizon."""
    return var_paths(df, by, order, values, (horizon,), lags, least).drop("horizon")


def error_bands(oof: DataFrame, by, month: str, point: str, actual: str, horizons, low: float = 0.1, high: float = 0.9, least: int = 20) -> DataFrame:
    """Rows with ``low``, ``high`` and ``n_errors``: the point less the quantiles of errors that were known at its origin.

    oof: by..., ``month``, horizon, point, actual. An error of horizon h is known h months after its origin, so an origin
    uses those of origins at least h months before; under ``least`` of them there is no band. Origins of a series are months.
    """
    by = names(by)
    f = oof.withColumn("_m", F.year(month) * 12 + F.month(month)).withColumn("_e", F.col(point) - F.col(actual))
    out = None
    for h in horizons:
        w = Window.partitionBy(*by).orderBy("_m").rangeBetween(Window.unboundedPreceding, -h)
        part = f.filter(F.col("horizon") == h).withColumn("_q", F.percentile("_e", F.array(F.lit(low), F.lit(high))).over(w)).withColumn("n_errors", F.count("_e").over(w))
        out = part if out is None else out.unionByName(part)
    band = lambda i: F.when(F.col("n_errors") >= least, F.col(point) - F.get("_q", F.lit(i)))
    return out.withColumns({"low": band(1), "high": band(0)}).drop("_m", "_e", "_q")


def overlay_horizon(ends: DataFrame, target_last: Column, horizon: int) -> DataFrame:
    """Steps a series that ends early must be pushed to reach the same target months."""
    return ends.withColumn("horizon", (F.months_between(target_last, "last_month") + horizon).cast("int"))


def variance_shares(df: DataFrame, by, order: str, values, horizons=(1, 3, 6, 12), most_lags: int = 6) -> DataFrame:
    """Generalised forecast error variance shares of a VAR on differences, lag chosen by BIC, rows normalised.

    A group is one monthly system (a few hundred rows), so it is solved whole in numpy.
    """
    by, values = names(by), list(values)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.diff(pdf.sort_values(order)[values].to_numpy(float), axis=0)
        k, best = d.shape[1], None
        for p in range(1, most_lags + 1):
            y = d[most_lags:]
            x = np.column_stack([np.ones(len(y)), *[d[most_lags - j:len(d) - j] for j in range(1, p + 1)]])
            if len(y) <= x.shape[1] + 5:
                break
            b = np.linalg.lstsq(x, y, rcond=None)[0]
            cov = (y - x @ b).T @ (y - x @ b) / len(y)
            bic = np.log(np.linalg.det(cov)) + np.log(len(y)) * p * k * k / len(y)
            if best is None or bic < best[0]:
                best = (bic, p, b, cov)
        out = []
        if best is not None:
            _, p, b, cov = best
            a = [b[1 + j * k:1 + (j + 1) * k].T for j in range(p)]
            psi = [np.eye(k)]
            for s in range(1, max(horizons)):
                psi.append(sum(a[j] @ psi[s - 1 - j] for j in range(min(p, s))))
            for h in horizons:
                top = sum((m @ cov) ** 2 for m in psi[:h]) / np.diag(cov)
                share = top / top.sum(axis=1, keepdims=True)
                out += [(*[pdf[c].iloc[0] for c in by], h, p, values[i], values[j], float(share[i, j])) for i in range(k) for j in range(k)]
        return pd.DataFrame(out, columns=[*by, "horizon", "lags", "target", "shock", "share"])

    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", horizon int, lags int, target string, shock string, share double"
    return df.dropna(subset=values).groupBy(*by).applyInPandas(run, schema)


def series_kernel(df: DataFrame, by, fn, schema: str) -> DataFrame:
    """User hook: any pandas function per group with a declared output schema. Groups must be bounded series."""
    return df.groupBy(*names(by)).applyInPandas(fn, schema)


def linear_contributions(rows_: DataFrame, coef: str, means: dict[str, Column], x, key, k: int = 5) -> DataFrame:
    """Largest contributions slope * (value - mean) of each row, signed, by absolute size."""
    items = F.array(*[F.struct((F.get(coef, F.lit(i + 1)) * (F.col(c) - means[c])).alias("contribution"), F.lit(c).alias("feature")) for i, c in enumerate(x)])
    ordered = F.array_sort(F.transform(items, lambda e: F.struct((-F.abs(e["contribution"])).alias("o"), e["feature"].alias("feature"), e["contribution"].alias("contribution"))))
    return rows_.select(*names(key), F.posexplode(F.slice(ordered, 1, k)).alias("rank", "e")).select(*names(key), "rank", "e.feature", "e.contribution")


def gap_mixture(rows_: DataFrame, center: str, scale: str, z: Sequence[float], probabilities, key) -> DataFrame:
    """Mean class probabilities over equally likely gaps center + scale * z; ``probabilities`` maps a gap column to three columns."""
    pts = rows_.withColumn("_gap", F.explode(F.transform(F.array(*[F.lit(float(v)) for v in z]), lambda q: F.col(center) + F.col(scale) * q)))
    p = probabilities(F.col("_gap"))
    return pts.withColumns({f"_p{i}": c for i, c in enumerate(p)}).groupBy(*names(key)).agg(*[F.avg(f"_p{i}").alias(n) for i, n in enumerate(("p_down", "p_flat", "p_up"))])
