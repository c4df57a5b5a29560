"""Window features, labels and paths over bars and monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import intraday as I
from ..operators import macro as M
from ..operators import paths as P
from ..operators.asof import asof_backward
from ..operators.calendar import session_spine
from ..operators.frames import change, rolling
from .registry import query
from .rounding import rd, rounded

W = "PARTITION BY instrument ORDER BY session"
SW = "PARTITION BY series_id ORDER BY month"


def full(agg: str, x: str, n: int, shift: int = 0, part: str = W, least: int | None = None) -> str:
    """SQL for a guarded trailing frame."""
    frame = f"OVER ({part} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {agg}({x}) {frame} END"


def lag(x: str, k: int = 1, part: str = W) -> str:
    return f"lag({x}, {k}) OVER ({part})"


def lead(x: str, k: int = 1, part: str = W) -> str:
    return f"lead({x}, {k}) OVER ({part})"


@query("returns_and_legs", f"""SELECT instrument, session, {rd('ret gap intraday')} FROM (
 SELECT instrument, session, close / {lag('close')} - 1 AS ret, open / {lag('close')} - 1 AS gap, close / open - 1 AS intraday
 FROM v_bars)""")
def returns_and_legs(v):
    return rounded(B.returns_and_legs(v.bars))


@query("instrument_features", f"""SELECT instrument, session,
 {rd('ret_1 ret_2 ret_3 mom_5 mom_10 mom_20 mom_60 vol_20 vol_ratio ma50_gap ma200_gap high252_gap turnover_ratio_20')} FROM (
 SELECT instrument, session, ret AS ret_1, {lag('ret')} AS ret_2, {lag('ret', 2)} AS ret_3,
 {', '.join(f"close / {lag('close', n)} - 1 AS mom_{n}" for n in (5, 10, 20, 60))}, vol20 AS vol_20,
 {full('stddev_samp', 'ret', 5)} / nullif(vol20, 0) AS vol_ratio,
 close / ({full('avg', 'close', 50)}) - 1 AS ma50_gap, close / ({full('avg', 'close', 200)}) - 1 AS ma200_gap,
 close / ({full('max', 'close', 252)}) - 1 AS high252_gap,
 close * volume / ({full('avg', '(close * volume)', 20)}) AS turnover_ratio_20 FROM v_vol)""")
def instrument_features(v):
    return rounded(B.instrument_features(v.bars))


@query("band_label", f"""SELECT instrument, session, {rd('target_ret band')},
 CASE WHEN target_ret IS NULL OR band IS NULL THEN NULL WHEN target_ret < -band THEN 0 WHEN target_ret > band THEN 2 ELSE 1 END AS y
 FROM (SELECT instrument, session, {lead('close')} / close - 1 AS target_ret, 0.3 * vol20 AS band FROM v_vol)""")
def band_label(v):
    return rounded(B.band_label(v.bars))


@query("horizon_target", " UNION ALL ".join(f"""SELECT instrument, session AS prediction_date, {h} AS h, {rd('future_return sigma')}, matures FROM (
 SELECT instrument, session, {lead('close', h - 1)} / {lag('close')} - 1 AS future_return,
 {lag('vol20')} * sqrt({h}) AS sigma, {lead('session', h - 1)} AS matures FROM v_vol)
 WHERE future_return IS NOT NULL AND sigma IS NOT NULL AND matures IS NOT NULL""" for h in (1, 5, 21)))
def horizon_target(v):
    parts = [B.horizon_target(v.bars, h).withColumn("h", F.lit(h)) for h in (1, 5, 21)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("leg_label_sums", f"""SELECT instrument, session, {rd('log_overnight log_intraday')} FROM (
 SELECT instrument, session,
 CASE WHEN count(lo) OVER f = 5 THEN sum(lo) OVER f END AS log_overnight, CASE WHEN count(li) OVER f = 5 THEN sum(li) OVER f END AS log_intraday
 FROM (SELECT *, ln(open / {lag('close')}) AS lo, ln(close / open) AS li FROM v_bars)
 WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))""")
def leg_label_sums(v):
    return rounded(B.leg_label_sums(v.bars, 5))


_legs = ", ".join(f"exp({full('sum', 'lo', k)}) - 1 AS o{k}, exp({full('sum', 'li', k)}) - 1 AS i{k}" for k in (5, 20, 60))


@query("cum_leg_features", f"""SELECT instrument, session, {rd(' '.join(f'ovn_{k} intra_{k} ovn_minus_intra_{k}' for k in (5, 20, 60)))} FROM (
 SELECT instrument, session, {', '.join(f"{lag(f'o{k}')} AS ovn_{k}, {lag(f'i{k}')} AS intra_{k}, {lag(f'o{k}')} - {lag(f'i{k}')} AS ovn_minus_intra_{k}" for k in (5, 20, 60))}
 FROM (SELECT instrument, session, {_legs} FROM (SELECT *, ln(open / {lag('close')}) AS lo, ln(close / open) AS li FROM v_bars)))""")
def cum_leg_features(v):
    return rounded(B.cum_leg_features(v.bars))


@query("cross_asset_features", f"""WITH own AS (SELECT instrument AS asset, session AS src_day, close / {lag('close', 5)} - 1 AS cum_5,
  close / {lag('close', 20)} - 1 AS cum_20, vol AS vol_20 FROM (SELECT *, {full('stddev_samp', 'ret', 20)} AS vol
   FROM (SELECT *, close / {lag('close')} - 1 AS ret FROM v_thin))),
 span AS (SELECT asset, min(src_day) AS a, max(src_day) AS b FROM own GROUP BY 1),
 grid AS (SELECT asset, session FROM span JOIN v_cal ON session BETWEEN a AND b)
 SELECT g.asset, g.session, {rd('cum_5 cum_20 vol_20')} FROM (
  SELECT g.*, CASE WHEN date_diff('day', src_day, session) <= 6 THEN cum_5 END AS cum_5, CASE WHEN date_diff('day', src_day, session) <= 6 THEN cum_20 END AS cum_20,
  CASE WHEN date_diff('day', src_day, session) <= 6 THEN vol_20 END AS vol_20 FROM grid g ASOF LEFT JOIN own o ON g.asset = o.asset AND g.session > o.src_day) g""")
def cross_asset_features(v):
    own = B.with_vol20(v.thin)
    own = own.select("instrument", "session", B.change("close", "instrument", "session", 5).alias("cum_5"),
                     B.change("close", "instrument", "session", 20).alias("cum_20"), F.col("vol20").alias("vol_20"))
    grid = session_spine(v.thin, v.calendar).drop("ordinal")
    right = own.withColumnRenamed("session", "at")
    return rounded(P.align_before(grid, right, "session", "at", "instrument", ["cum_5", "cum_20", "vol_20"])
                   .withColumnRenamed("instrument", "asset"))


_asof_thin = """grid AS (SELECT instrument, session FROM (SELECT instrument, min(session) a, max(session) b FROM v_thin GROUP BY 1)
   JOIN v_cal ON session BETWEEN a AND b),
 lvl AS (SELECT g.instrument, g.session, CASE WHEN date_diff('day', o.avail, g.session) <= 7 THEN close END AS value,
   CASE WHEN date_diff('day', o.avail, g.session) <= 7 THEN o.source_date END AS source_date
   FROM grid g ASOF LEFT JOIN (SELECT instrument, session + 1 AS avail, session AS source_date, close FROM v_thin) o
   ON g.instrument = o.instrument AND g.session >= o.avail)"""


@query("asof_cumulative", f"""WITH {_asof_thin}
 SELECT instrument, session, {rd('cum_ret')}, new_session, age_days FROM (SELECT instrument, session,
 value / {lag('value')} - 1 AS cum_ret,
 CASE WHEN source_date IS NOT NULL THEN CAST(source_date IS DISTINCT FROM {lag('source_date')} AS INT) END AS new_session,
 date_diff('day', source_date, session) AS age_days FROM lvl)""")
def asof_cumulative(v):
    grid = session_spine(v.thin, v.calendar).drop("ordinal")
    return rounded(P.asof_cumulative(grid, v.thin, "instrument", "session", "close"))


@query("overseas_rebuild", f"""WITH {_asof_thin},
 home AS (SELECT session, close / lag(close) OVER (ORDER BY session) - 1 AS home_ret FROM v_bars WHERE instrument = 'A')
 SELECT instrument, session, {rd('asset_ret receipt_minus_home')} FROM (SELECT l.instrument, l.session, asset_ret, asset_ret - home_ret AS receipt_minus_home
 FROM (SELECT instrument, session, value / {lag('value')} - 1 AS asset_ret FROM lvl) l LEFT JOIN home h USING (session))""")
def overseas_rebuild(v):
    grid = session_spine(v.thin, v.calendar).drop("ordinal")
    home = B.returns_and_legs(v.bars.filter("instrument = 'A'")).select("session", F.col("ret").alias("home_ret"))
    cum = P.asof_cumulative(grid, v.thin, "instrument", "session", "close")
    return rounded(cum.join(home, "session", "left").select(
        "instrument", "session", F.col("cum_ret").alias("asset_ret"), (F.col("cum_ret") - F.col("home_ret")).alias("receipt_minus_home")))


@query("gap_group_features", f"""SELECT instrument, session, {rd('gap_0 gap_over_band gap_z60 gap_abs gap_up_band gap_down_band')} FROM (
 SELECT instrument, session, gap_0, gap_0 / band AS gap_over_band, (gap_0 - ({full('avg', 'gap_0', 60, 1)})) / nullif({full('stddev_samp', 'gap_0', 60, 1)}, 0) AS gap_z60,
 abs(gap_0) AS gap_abs, CASE WHEN gap_0 IS NOT NULL AND band IS NOT NULL THEN CAST(gap_0 > band AS DOUBLE) END AS gap_up_band,
 CASE WHEN gap_0 IS NOT NULL AND band IS NOT NULL THEN CAST(gap_0 < -band AS DOUBLE) END AS gap_down_band
 FROM (SELECT instrument, session, open / {lag('close')} - 1 AS gap_0, nullif(0.3 * {lag('vol20')}, 0) AS band FROM v_vol))""")
def gap_group_features(v):
    return rounded(B.gap_group_features(v.bars))


@query("causal_channels", f"""SELECT instrument, session, {rd('close_ret open_gap high_rel low_rel volume_rel')} FROM (
 SELECT instrument, session, close / pc - 1 AS close_ret, open / pc - 1 AS open_gap, high / pc - 1 AS high_rel, low / pc - 1 AS low_rel,
 volume / mv - 1 AS volume_rel FROM (SELECT *, {lag('close')} AS pc, {full('avg', 'volume', 20, 1)} AS mv FROM v_bars))""")
def causal_channels(v):
    return rounded(B.causal_channels(v.bars))


_runs = f"""runs AS (SELECT *, row_number() OVER (PARTITION BY instrument, island ORDER BY session) AS run FROM (
 SELECT *, sum(turn) OVER ({W}) AS island FROM (SELECT *, CASE WHEN dir IS NOT DISTINCT FROM {lag('dir')} AND {lag('instrument')} IS NOT NULL THEN 0 ELSE 1 END AS turn
 FROM (SELECT *, CASE WHEN ret < 0 THEN -1 WHEN ret > 0 THEN 1 ELSE 0 END AS dir, close / {lag('close', 5)} - 1 AS ret_5d,
  close / ({full('max', 'close', 20)}) - 1 AS off_high FROM v_vol))))"""


@query("signed_streak", f"""WITH {_runs} SELECT instrument, session, {rd('close ret ret_5d off_high')},
 CASE WHEN dir = -1 THEN run ELSE 0 END AS down_run, CASE WHEN dir = 1 THEN run ELSE 0 END AS up_run,
 dir = -1 AND run >= 3 AS down_streak, coalesce(ret_5d <= -0.08, false) AS drop_5d, coalesce(ret <= -0.04, false) AS drop_1d,
 coalesce(off_high <= -0.10, false) AS off_high_20d, dir = 1 AND run >= 3 AS up_streak, coalesce(ret_5d >= 0.08, false) AS rise_5d,
 coalesce(ret >= 0.04, false) AS rise_1d FROM runs""")
def signed_streak(v):
    return rounded(B.chart_signals(v.bars))


@query("flow_features", f"""WITH f AS (SELECT *, foreign_net / v20 AS frgn, inst_net / v20 AS inst, sign(foreign_net) AS sgn FROM (
   SELECT *, {full('avg', 'volume', 20, least=10)} AS v20 FROM v_flows)),
 r AS (SELECT *, row_number() OVER (PARTITION BY instrument, island ORDER BY session) AS run FROM (SELECT *, sum(turn) OVER ({W}) AS island FROM (
   SELECT *, CASE WHEN sgn = {lag('sgn')} THEN 0 ELSE 1 END AS turn FROM f))),
 o AS (SELECT instrument, session AS src_day, frgn AS flow_frgn_1, {full('sum', 'frgn', 5, least=3)} AS flow_frgn_5, {full('sum', 'frgn', 20, least=10)} AS flow_frgn_20,
   CAST(run * sgn AS BIGINT) AS flow_frgn_streak, {full('sum', 'inst', 5, least=3)} AS flow_inst_5, foreign_ratio - {lag('foreign_ratio', 20)} AS flow_frgn_ratio_chg_20 FROM r)
 SELECT instrument, session, {rd('flow_frgn_1 flow_frgn_5 flow_frgn_20 flow_inst_5 flow_frgn_ratio_chg_20')}, flow_frgn_streak FROM (
  SELECT b.instrument, b.session, {', '.join(f"CASE WHEN date_diff('day', src_day, session) <= 6 THEN {c} END AS {c}" for c in 'flow_frgn_1 flow_frgn_5 flow_frgn_20 flow_frgn_streak flow_inst_5 flow_frgn_ratio_chg_20'.split())}
  FROM v_bars b ASOF LEFT JOIN o ON b.instrument = o.instrument AND b.session > o.src_day)""")
def flow_features(v):
    f = B.flow_features(v.flows).withColumnRenamed("session", "at")
    cols = [c for c in f.columns if c.startswith("flow_")]
    return rounded(P.align_before(v.bars.select("instrument", "session"), f, "session", "at", "instrument", cols))


@query("rolling_position", f"""SELECT instrument, session, {rd('position_20 ma_gap_20 position_60 ma_gap_60 position_120 ma_gap_120 drawdown')} FROM (
 SELECT instrument, session, {', '.join(f"CASE WHEN hi{n} > lo{n} THEN (close - lo{n}) / (hi{n} - lo{n}) WHEN hi{n} = lo{n} THEN 0.5 END AS position_{n}, close / ma{n} - 1 AS ma_gap_{n}" for n in (20, 60, 120))},
 close / max(close) OVER ({W} ROWS 755 PRECEDING) - 1 AS drawdown
 FROM (SELECT *, {', '.join(f"{full('min', 'close', n)} AS lo{n}, {full('max', 'close', n)} AS hi{n}, {full('avg', 'close', n)} AS ma{n}" for n in (20, 60, 120))} FROM v_bars))""")
def rolling_position(v):
    return rounded(B.rolling_position(v.bars))


@query("moving_average_touch", f"""WITH m AS ({' UNION ALL '.join(f"SELECT instrument, session, low, high, close, {n} AS ma, {full('avg', 'close', n, 1)} AS level FROM v_bars" for n in (5, 20, 60))}),
 k AS (SELECT *, CASE WHEN low BETWEEN level * 0.99 AND level * 1.005 AND close > level * 1.005 THEN 'support'
  WHEN high BETWEEN level * 0.995 AND level * 1.01 AND close < level * 0.995 THEN 'resistance'
  WHEN low < level * 0.99 AND close > level THEN 'reclaim' WHEN high > level * 1.01 AND close < level THEN 'fail' END AS kind FROM m WHERE level IS NOT NULL)
 SELECT instrument, session, ma, kind, round(level, 6) AS level, round(CASE WHEN kind IN ('support','reclaim') THEN low ELSE high END, 6) AS price FROM k WHERE kind IS NOT NULL""")
def moving_average_touch(v):
    return rounded(B.moving_average_touch(v.bars))


@query("price_context", f"""WITH j AS (SELECT b.*, p.close AS peer_close FROM v_bars b LEFT JOIN (SELECT session, close FROM v_bars WHERE instrument = 'A') p USING (session))
 SELECT instrument, session, {rd('prior_high_20 distance_20 prior_high_60 distance_60 excess_5 excess_20 excess_60')},
 close_breakout_20, intraday_breakout_20, close_breakout_60, intraday_breakout_60 FROM (SELECT instrument, session,
 {', '.join(f"t{n} AS prior_high_{n}, close / t{n} - 1 AS distance_{n}, close > t{n} AS close_breakout_{n}, high > t{n} AS intraday_breakout_{n}" for n in (20, 60))},
 {', '.join(f"CASE WHEN n{n} = {n + 1} THEN close / {lag('close', n)} - 1 - (peer_close / {lag('peer_close', n)} - 1) END AS excess_{n}" for n in (5, 20, 60))}
 FROM (SELECT *, {', '.join(f"{full('max', 'high', n, 1)} AS t{n}" for n in (20, 60))},
  {', '.join(f"count(peer_close) OVER ({W} ROWS {n} PRECEDING) AS n{n}" for n in (5, 20, 60))} FROM j))""")
def price_context(v):
    peer = v.bars.filter("instrument = 'A'").select("session", F.col("close").alias("peer_close"))
    return rounded(B.price_context(v.bars, peer))


@query("foreign_pressure", f"""WITH f AS (SELECT instrument, session, sum(foreign_net) OVER a AS b0, sum(foreign_net) OVER z AS b1, sum(volume) OVER a AS v0, sum(volume) OVER z AS v1,
  count(*) OVER (PARTITION BY instrument ORDER BY session ROWS 9 PRECEDING) AS n FROM v_flows
  WINDOW a AS ({W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), z AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
 SELECT instrument, session, round(b0 / v0, 6) AS previous_ratio, round(b1 / v1, 6) AS recent_ratio,
 CASE WHEN b0 < 0 AND b1 < 0 THEN CASE WHEN abs(b0 / v0 - b1 / v1) <= 1e-12 + 1e-9 * abs(b1 / v1) THEN 'selling_unchanged' WHEN b1 / v1 > b0 / v0 THEN 'selling_eased' ELSE 'selling_intensified' END
 WHEN b0 <= 0 AND b1 > 0 THEN 'turned_buying' WHEN b0 >= 0 AND b1 < 0 THEN 'turned_selling' ELSE 'other' END AS state FROM f WHERE n = 10""")
def foreign_pressure(v):
    return rounded(B.foreign_pressure(v.flows))


@query("max_drawdown", f"""SELECT instrument, round(min(dd), 6) AS max_drawdown FROM (SELECT instrument, close / max(close) OVER ({W}) - 1 AS dd FROM v_bars) GROUP BY 1""")
def max_drawdown(v):
    return rounded(B.max_drawdown(v.bars))


@query("expanding_z", f"""SELECT instrument, session, {rd('z')} FROM (SELECT instrument, session,
 CASE WHEN count(ret) OVER w >= 60 THEN (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) END AS z FROM v_vol WINDOW w AS ({W}))""")
def expanding_z(v):
    return rounded(B.expanding_z(B.with_vol20(v.bars), "ret").select("instrument", "session", "z"))


_monthly = f"""monthly AS (SELECT *, value / {lag('value', 12, SW)} - 1 AS yoy FROM (
 SELECT g.series_id, CAST(g.month AS DATE) AS month, s.value FROM (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month
  FROM (SELECT series_id, CAST(min(month) AS TIMESTAMP) a, CAST(max(month) AS TIMESTAMP) b FROM v_series GROUP BY 1)) g LEFT JOIN v_series s ON s.series_id = g.series_id AND s.month = g.month)),
 mf AS (SELECT series_id, month, value, value - 100 AS level_100, value - {lag('value', 1, SW)} AS diff_1, value - {lag('value', 3, SW)} AS diff_3, value - {lag('value', 6, SW)} AS diff_6,
 ln(value) AS log_value, yoy, value / {lag('value', 1, SW)} - 1 AS mom, {full('avg', 'yoy', 3, part=SW)} AS yoy_3m,
 yoy - {lag('yoy', 1, SW)} AS yoy_change_1m, yoy - {lag('yoy', 3, SW)} AS yoy_change_3m,
 (value - ({full('avg', 'value', 60, part=SW)})) / nullif({full('stddev_samp', 'value', 60, part=SW)}, 0) AS z60 FROM monthly)"""


@query("monthly_macro_features", f"""WITH {_monthly} SELECT series_id, month,
 {rd('value level_100 diff_1 diff_3 diff_6', 2)}, {rd('log_value yoy mom yoy_3m yoy_change_1m yoy_change_3m z60')} FROM mf""")
def monthly_macro_features(v):
    f = M.monthly_features(v.series)
    money = ["value", "level_100", "diff_1", "diff_3", "diff_6"]
    return rounded(f.select(*[F.round(c, 2).alias(c) if c in money else F.col(c) for c in f.columns]))


_long = f"""{_monthly}, px AS (SELECT series_id, month, value AS price, ln(value) AS lp FROM v_series2 WHERE value > 0),
 lf0 AS (SELECT px.*, exp(log_value) AS exports, yoy_3m FROM px LEFT JOIN mf ON px.series_id = mf.series_id AND px.month = CAST(mf.month + INTERVAL 2 MONTH AS DATE)),
 lf AS (SELECT series_id, month, price, lp - {lag('lp', 12, SW)} AS mom_12m, price / ({full('max', 'price', 36, part=SW, least=12)}) - 1 AS drawdown_36m,
  (rel - ({full('avg', 'rel', 60, part=SW, least=24)})) / nullif({full('stddev_samp', 'rel', 60, part=SW, least=24)}, 0) AS price_to_exports_z,
  yoy_3m AS exports_cycle, accel AS exports_accel,
  CASE WHEN yoy_3m IS NULL OR accel IS NULL THEN NULL WHEN yoy_3m < 0 THEN CASE WHEN accel > 0 THEN 'recovery' ELSE 'contraction' END WHEN accel > 0 THEN 'expansion' ELSE 'slowdown' END AS phase,
  {', '.join(f"{lead('lp', k, SW)} - lp AS fwd_{k}m" for k in (3, 6, 12))}
  FROM (SELECT *, lp - ln({full('avg', 'exports', 12, part=SW, least=6)}) AS rel, yoy_3m - {lag('yoy_3m', 3, SW)} AS accel FROM lf0))"""


@query("longterm_frame", f"""WITH {_long} SELECT series_id, month, phase, {rd('price mom_12m drawdown_36m price_to_exports_z exports_cycle exports_accel fwd_3m fwd_6m fwd_12m')} FROM lf""")
def longterm_frame(v):
    return rounded(M.longterm_frame(v.series2, v.series))


def _fk(table: str, out: str) -> str:
    return f"""SELECT series_id, CAST(year(month) * 4 + quarter(month) - 1 AS INT) AS quarter_ord, CASE WHEN count(value) = 2 THEN avg(value) END AS {out}
 FROM {table} WHERE (month(month) - 1) % 3 + 1 <= 2 GROUP BY ALL"""


QW = "PARTITION BY series_id ORDER BY quarter_ord"
_quarter = f"""pf AS (SELECT series_id, CAST(year(month) * 4 + quarter(month) - 1 AS INT) AS quarter_ord, round(sum(value), 2) AS profit FROM v_series2 GROUP BY ALL),
 q AS (SELECT series_id, quarter_ord, exports_k, rate_k FROM ({_fk('v_series', 'exports_k')}) FULL JOIN ({_fk('v_series2', 'rate_k')}) USING (series_id, quarter_ord)),
 qs AS (SELECT series_id, CAST(unnest(generate_series(min(quarter_ord), max(quarter_ord))) AS INT) AS quarter_ord FROM q GROUP BY series_id),
 qf AS (SELECT *, exports_k / {lag('exports_k', 4, QW)} - 1 AS exports_yoy, exports_k / {lag('exports_k', 1, QW)} - 1 AS exports_qoq FROM (
   SELECT qs.series_id, qs.quarter_ord, exports_k, exports_k * rate_k / 1e6 AS exports_krw_k, profit FROM qs LEFT JOIN q USING (series_id, quarter_ord) LEFT JOIN pf USING (series_id, quarter_ord)))"""


@query("quarter_frame", f"""WITH {_quarter} SELECT series_id, quarter_ord, {rd('exports_k exports_krw_k profit profit_lag1 profit_lag3 profit_lag4 profit_next scale_x_growth scale_x_yoy profit_export_anchor', 3)}, {rd('exports_yoy exports_qoq')} FROM (
 SELECT *, {lag('profit', 1, QW)} AS profit_lag1, {lag('profit', 3, QW)} AS profit_lag3, {lag('profit', 4, QW)} AS profit_lag4, {lead('profit', 1, QW)} AS profit_next,
 exports_krw_k * exports_qoq AS scale_x_growth, exports_krw_k * exports_yoy AS scale_x_yoy,
 {lag('profit', 1, QW)} * exports_krw_k / CASE WHEN {lag('exports_krw_k', 1, QW)} > 0 THEN {lag('exports_krw_k', 1, QW)} END AS profit_export_anchor FROM qf)""")
def quarter_frame(v):
    profit = v.series2.groupBy("series_id", M.quarter_ordinal("month").alias("quarter_ord")).agg(F.round(F.sum("value"), 2).alias("profit"))
    rate = v.series2.withColumn("value", F.col("value") / 1e6)
    f = M.quarter_frame(v.series, rate, profit, 2)
    return rounded(f.select(*[F.round(c, 6).alias(c) if c in ("exports_yoy", "exports_qoq") else F.round(c, 3).alias(c)
                              if t == "double" else F.col(c) for c, t in f.dtypes]))


@query("implied_vol_scale", f"""SELECT instrument, session, {rd('scale')} FROM (SELECT instrument, session,
 CASE WHEN m IS NOT NULL AND vol20 IS NOT NULL THEN least(greatest(vol20 / m, 0.5), 3.0) END AS scale FROM (SELECT *, CASE WHEN count(vol20) OVER w >= 125 THEN quantile_cont(vol20, 0.5) OVER w END AS m
 FROM v_vol WINDOW w AS ({W} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)))""")
def implied_vol_scale(v):
    return rounded(B.implied_vol_scale(B.with_vol20(v.bars), "vol20"))


@query("wave_signal", f"""WITH f AS (SELECT *, ma20 / ma20_5 - 1 AS slope, (pc - lo) / (hi - lo) AS position FROM (SELECT instrument, session, close, row_number() OVER ({W}) AS seen,
  {full('min', 'low', 20, 2)} AS lo, {full('max', 'high', 20, 2)} AS hi, {lag('close')} AS pc, {lag('high')} AS ph, {full('avg', 'close', 20)} AS ma20, {full('avg', 'close', 60)} AS ma60,
  {full('avg', 'close', 20, 1)} AS ma20_prev, {full('avg', 'close', 20, 5)} AS ma20_5, {full('min', 'low', 5)} AS stop FROM v_bars) WHERE seen >= 65 AND hi > lo),
 r AS (SELECT *, 'range_rebound' AS strategy, CASE WHEN abs(slope) <= 0.01 THEN 'range' ELSE 'trend' END AS regime,
  concat_ws(',', CASE WHEN NOT abs(slope) <= 0.01 THEN 'not_sideways' END, CASE WHEN NOT position BETWEEN 0 AND 0.2 THEN 'outside_lower_range' END, CASE WHEN close <= ph THEN 'rebound_unconfirmed' END) AS rs FROM f
  UNION ALL SELECT *, 'trend_pullback', CASE WHEN slope > 0 AND ma20 > ma60 THEN 'uptrend' ELSE 'other' END,
  concat_ws(',', CASE WHEN NOT (slope > 0 AND ma20 > ma60) THEN 'not_uptrend' END, CASE WHEN pc > ma20_prev THEN 'no_pullback' END, CASE WHEN close <= ma20 THEN 'average_not_recovered' END, CASE WHEN close <= ph THEN 'rebound_unconfirmed' END) FROM f)
 SELECT instrument, session, strategy, regime, CASE WHEN rs = '' THEN 'enter' ELSE 'wait' END AS action, CASE WHEN rs = '' THEN strategy || '_confirmed' ELSE rs END AS reason_codes,
 round(position, 6) AS position, round(stop, 6) AS reference_stop FROM r""")
def wave_signal(v):
    return rounded(B.wave_signal(v.bars))


@query("credit_gauge", f"""WITH f AS (SELECT instrument, session, (vol20 - ({full('min', 'vol20', 60)})) * 100 AS off_low_bp, ({full('avg', 'vol20', 10)}) - ({full('avg', 'vol20', 10, 10)}) AS trend FROM v_vol)
 SELECT instrument, session, {rd('off_low_bp trend')}, CASE WHEN off_low_bp >= 15 AND trend > 0 THEN 'rising' WHEN off_low_bp < 5 AND trend <= 0 THEN 'calm' ELSE 'mixed' END AS label
 FROM f WHERE off_low_bp IS NOT NULL AND trend IS NOT NULL""")
def credit_gauge(v):
    return rounded(B.credit_gauge(B.with_vol20(v.bars), "vol20"))


@query("phase_state", f"""WITH {_monthly}, d AS (SELECT series_id, month, value, sign(value - {lag('value', 1, SW)}) AS d, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS back FROM monthly),
 t AS (SELECT *, sum(CASE WHEN d IS NOT DISTINCT FROM pd AND pm IS NOT NULL THEN 0 ELSE 1 END) OVER ({SW}) AS island FROM (SELECT *, {lag('d', 1, SW)} AS pd, {lag('month', 1, SW)} AS pm FROM d)),
 r AS (SELECT *, row_number() OVER (PARTITION BY series_id, island ORDER BY month) AS run FROM t),
 top AS (SELECT series_id, arg_max(month, {{'v': value, 'm': month}}) AS peak_month, arg_max(month, {{'v': -value, 'm': month}}) AS trough_month, max(value) AS peak, min(value) AS trough
  FROM d WHERE back <= 24 AND value IS NOT NULL GROUP BY 1),
 j AS (SELECT r.series_id, month AS last_month, value AS level, d, CASE WHEN coalesce(d, 0) = 0 THEN 0 ELSE run END AS months, top.* EXCLUDE (series_id) FROM r JOIN top USING (series_id) WHERE back = 1 AND value IS NOT NULL),
 k AS (SELECT *, CAST(last_month - to_months(CAST(months AS INT)) AS DATE) AS since FROM j)
 SELECT series_id, since, months, last_month, level, date_diff('month', peak_month, last_month) AS months_since_peak, date_diff('month', trough_month, last_month) AS months_since_trough, peak_month, peak, trough_month, trough,
 CASE WHEN d IS NULL THEN 'no_previous_month' WHEN d = 0 THEN 'flat'
  WHEN d > 0 THEN CASE WHEN last_month = peak_month THEN 'rising_at_peak' WHEN since = trough_month THEN CASE WHEN months = 1 THEN 'possible_trough' ELSE 'upturn' END ELSE 'rebound' END
  ELSE CASE WHEN last_month = trough_month THEN 'falling_at_trough' WHEN since = peak_month THEN CASE WHEN months = 1 THEN 'possible_peak' ELSE 'downturn' END ELSE 'renewed_fall' END END AS state FROM k""")
def phase_state(v):
    return M.phase_state(v.series)


@query("evening_reconstruction", f"""SELECT instrument, session, {rd('home_ret overseas_mom_5 cross_ret')} FROM (SELECT instrument, session, ret AS home_ret,
 {lag('m5')} AS overseas_mom_5, {lag('m5')} - ret AS cross_ret FROM (SELECT *, close / {lag('close', 5)} - 1 AS m5 FROM v_vol))""")
def evening_reconstruction(v):
    f = B.with_vol20(v.bars).withColumn("m5", change("close", "instrument", "session", 5))
    return rounded(P.evening_frame(f, {"home_ret": ("home", "ret"), "overseas_mom_5": ("overseas", "m5"), "cross_ret": ("cross", ("m5", "ret"))}))


_feats = ("mom_12m", "drawdown_36m")


@query("similar_periods", f"""WITH {_long}, x AS (SELECT * FROM lf WHERE mom_12m IS NOT NULL AND drawdown_36m IS NOT NULL),
 st AS (SELECT series_id, count(*) AS n, avg(mom_12m) AS m1, stddev_samp(mom_12m) AS s1, avg(drawdown_36m) AS m2, stddev_samp(drawdown_36m) AS s2, max(month) AS last, arg_max(mom_12m, month) AS c1, arg_max(drawdown_36m, month) AS c2 FROM x GROUP BY 1),
 e AS (SELECT x.series_id, {{'distance': sqrt(pow((mom_12m - c1) / s1, 2) + pow((drawdown_36m - c2) / s2, 2)), 'date': month, 'fwd': fwd_6m}} AS e FROM x JOIN st USING (series_id)
  WHERE n >= 36 AND last = (SELECT max(month) FROM lf WHERE lf.series_id = x.series_id) AND month <= last - INTERVAL 6 MONTH),
 l AS (SELECT series_id, list(e ORDER BY e) AS es FROM e GROUP BY 1),
 g AS (SELECT series_id, list_reduce(es, lambda acc, y: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda p: abs(date_diff('day', p.date, y.date)) < 360)) > 0 THEN acc ELSE list_append(acc, y) END, es[1:0]) AS picked FROM l)
 SELECT series_id, i - 1 AS rank, p.date, round(p.distance, 6) AS distance, round(p.fwd, 6) AS fwd FROM (SELECT series_id, unnest(picked) AS p, generate_subscripts(picked, 1) AS i FROM g)""")
def similar_periods(v):
    return rounded(M.similar_periods(M.longterm_frame(v.series2, v.series), list(_feats), "fwd_6m", 6))


# Runs of a phase, folded like the operator does: each run is a list of one, and a list of episodes grows by it.
_episodes = f"""{_long}, pr AS (SELECT series_id, phase, month, sum(new) OVER (PARTITION BY series_id ORDER BY month) AS run FROM (SELECT *, CASE WHEN phase <> lag(phase) OVER (PARTITION BY series_id ORDER BY month) THEN 1 ELSE 0 END AS new FROM lf WHERE phase IS NOT NULL)),
 rn AS (SELECT series_id, run, any_value(phase) AS phase, min(month) AS s, max(month) AS e, count(*) AS m FROM pr GROUP BY ALL),
 fd AS (SELECT series_id, list_reduce(list([{{'phase': phase, 's': s, 'e': e, 'm': m}}] ORDER BY run), lambda done, r: CASE WHEN done[len(done)].m < 3 OR r[1].m < 3 OR r[1].phase = done[len(done)].phase
   THEN list_append(done[1:len(done) - 1], {{'phase': CASE WHEN done[len(done)].m < 3 THEN r[1].phase ELSE done[len(done)].phase END, 's': done[len(done)].s, 'e': r[1].e, 'm': done[len(done)].m + r[1].m}}) ELSE list_append(done, r[1]) END) AS es FROM rn GROUP BY 1),
 ep AS MATERIALIZED (SELECT series_id, x.phase AS phase, x.s AS start, x.e AS "end", x.m AS months, i = n AS ongoing FROM (SELECT series_id, unnest(es) AS x, unnest(range(1, len(es) + 1)) AS i, len(es) AS n FROM fd)),
 nw AS (SELECT series_id, phase, start AS since, "end" AS as_of, months AS age FROM ep WHERE ongoing), dn AS (SELECT * FROM ep WHERE NOT ongoing)"""


def episodes_of(v):
    f = M.longterm_frame(v.series2, v.series)
    return f, M.phase_episodes(f)


@query("phase_episodes", f"WITH {_episodes} SELECT * FROM ep")
def phase_episodes(v):
    return episodes_of(v)[1]


@query("remaining_life", f"""WITH {_episodes}, g AS (SELECT nw.*, count(d.months) AS n_past, count(*) FILTER (d.months > age) AS n_conditional, quantile_cont(d.months, 0.5) AS median_total,
  quantile_cont(d.months - age, 0.5) FILTER (d.months > age) AS m, quantile_cont(d.months - age, 0.25) FILTER (d.months > age) AS a, quantile_cont(d.months - age, 0.75) FILTER (d.months > age) AS b FROM nw LEFT JOIN dn d ON d.series_id = nw.series_id AND d.phase = nw.phase GROUP BY ALL)
 SELECT series_id, phase, since, as_of, age, n_past, n_conditional, n_past - n_conditional AS n_shorter, median_total, CASE WHEN n_conditional >= 1 THEN m END AS remaining_median, CASE WHEN n_conditional >= 1 THEN a END AS remaining_q25, CASE WHEN n_conditional >= 1 THEN b END AS remaining_q75,
  CASE WHEN n_conditional >= 1 THEN CAST(as_of + to_months(CAST(round_even(m, 0) AS INT)) AS DATE) END AS expected_end FROM g""")
def remaining_life(v):
    """With one survivor enough, as the series here are short."""
    return M.remaining_life(episodes_of(v)[1], least=1)


_curve = """sv AS (SELECT phase, age, at_risk, ended, ended / at_risk::DOUBLE AS hazard, CASE WHEN at_risk = ended THEN 0.0 ELSE exp(sum(CASE WHEN at_risk = ended THEN 0 ELSE ln(1 - ended / at_risk::DOUBLE) END) OVER (PARTITION BY phase ORDER BY age)) END AS survival
 FROM (SELECT phase, months AS age, count(*) FILTER (NOT ongoing) AS ended, (SELECT count(*) FROM ep o WHERE o.phase = ep.phase AND o.months >= ep.months) AS at_risk FROM ep GROUP BY phase, months) WHERE ended > 0)"""


@query("phase_survival", f"WITH {_episodes}, {_curve} SELECT phase, age, at_risk, ended, {rd('hazard survival')} FROM sv")
def phase_survival(v):
    """All series of a phase together."""
    return rounded(M.phase_survival(episodes_of(v)[1], "phase"))


@query("conditional_life", f"""WITH {_episodes.replace('ep AS MATERIALIZED', 'ep0 AS MATERIALIZED').replace('nw AS (SELECT', "ep AS (SELECT series_id || ':' || phase AS phase, start, months, ongoing FROM ep0), nw AS (SELECT").replace('FROM ep WHERE ongoing', 'FROM ep0 WHERE ongoing').replace('SELECT * FROM ep WHERE NOT', 'SELECT * FROM ep0 WHERE NOT')}, {_curve}
 SELECT nw.series_id, nw.phase, nw.age AS months_so_far, sv.age - nw.age AS more_months, at_risk, ended, round(survival / coalesce((SELECT min(survival) FROM sv o WHERE o.phase = nw.series_id || ':' || nw.phase AND o.age <= nw.age), 1.0), 6) + 0.0::DOUBLE AS still_on
 FROM nw JOIN sv ON sv.phase = nw.series_id || ':' || nw.phase AND sv.age > nw.age""")
def conditional_life(v):
    return rounded(M.conditional_life(episodes_of(v)[1]))


@query("life_by_sign", f"""WITH {_episodes}, j AS (SELECT nw.series_id, nw.phase, nw.age, d.months - nw.age AS rest, lf.exports_accel <= 0 AS inverted FROM nw JOIN dn d ON d.series_id = nw.series_id AND d.phase = nw.phase AND d.months > nw.age
   JOIN lf ON lf.series_id = nw.series_id AND lf.month = CAST(d.start + to_months(CAST(nw.age - 1 AS INT)) AS DATE) WHERE lf.exports_accel IS NOT NULL)
 SELECT j.series_id, j.phase, j.age, count(*) FILTER (inverted) AS n_inverted, quantile_cont(rest, 0.5) FILTER (inverted) AS inverted_median, count(*) FILTER (NOT inverted) AS n_normal, quantile_cont(rest, 0.5) FILTER (NOT inverted) AS normal_median, any_value(l.exports_accel <= 0) AS now_inverted
 FROM j JOIN nw USING (series_id) LEFT JOIN lf l ON l.series_id = j.series_id AND l.month = nw.as_of GROUP BY j.series_id, j.phase, j.age""")
def life_by_sign(v):
    f, e = episodes_of(v)
    return M.life_by_sign(e, f, "exports_accel")


@query("event_detection", f"""WITH b AS (SELECT *, row_number() OVER w AS i, coalesce(close / lag(close) OVER w - 1, 0.0) AS ret FROM v_intraday WINDOW w AS (PARTITION BY instrument, session ORDER BY ts)),
 s AS (SELECT instrument, session, count(*) AS n, quantile_cont(ret, 0.5) AS mid, stddev_pop(ret) AS dev, quantile_cont(volume, 0.5) FILTER (volume > 0) AS vol_mid, arg_min(open, ts) AS fo, arg_max(close, ts) AS lc FROM b GROUP BY ALL),
 m AS (SELECT instrument, session, quantile_cont(abs(ret - mid), 0.5) AS mad FROM b JOIN s USING (instrument, session) GROUP BY ALL),
 p AS (SELECT b.*, n, fo, lc / fo - 1 AS move, close / fo - 1 AS cum, abs(ret) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN dev > 0 THEN dev ELSE 1e-9 END AS z, coalesce(volume / nullif(vol_mid, 0), 0) AS vr
  FROM b JOIN s USING (instrument, session) JOIN m USING (instrument, session) WHERE n >= 12),
 c AS (SELECT *, z + CASE WHEN vr >= 3 THEN 1.0 ELSE 0.0 END + least(vr, 5.0) / 5 AS score FROM (SELECT *, coalesce(lag(cum) OVER (PARTITION BY instrument, session ORDER BY ts), 0.0) AS cum_before FROM p) WHERE z >= 3 OR (vr >= 3 AND i > 1 AND z >= 1)),
 l AS (SELECT instrument, session, list({{'o': -round(score, 9), 'ts': ts, 'ret': ret, 'z': z, 'vr': vr, 'cb': cum_before, 'ca': cum, 'sh': CASE WHEN abs(move) > 1e-9 THEN ret / move END}} ORDER BY -round(score, 9), ts) AS es FROM c GROUP BY ALL),
 g AS (SELECT instrument, session, unnest(list_reduce(es, lambda acc, y: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda k: abs(epoch(k.ts) - epoch(y.ts)) <= 900)) > 0 THEN acc ELSE list_append(acc, y) END, es[1:1])) AS e FROM l)
 SELECT instrument, session, e.ts AS ts, round(e.ret, 6) AS ret, round(e.z, 2) AS z, round(e.vr, 2) AS volume_ratio, round(e.cb, 6) AS cum_before, round(e.ca, 6) AS cum_after, round(e.sh, 6) AS session_share, round(-e.o, 6) AS score FROM g""")
def event_detection(v):
    return rounded(I.detect_events(v.intraday, 3.0, 3.0, 15, 3))


@query("after_hours_move", f"""WITH b AS (SELECT *, CAST(ts AS DATE) AS day, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%H:%M') AS clock FROM v_intraday),
 r AS (SELECT *, max(CASE WHEN clock >= '09:30' AND clock < '16:00' THEN ts END) OVER (PARTITION BY instrument, day) AS reg_end FROM b),
 d AS (SELECT instrument, day, max(reg_end) AS re, arg_max(close, ts) FILTER (ts = reg_end) AS reg, min(close) FILTER (reg_end IS NULL OR ts > reg_end) AS lo, max(close) FILTER (reg_end IS NULL OR ts > reg_end) AS hi,
  arg_max(close, ts) FILTER (reg_end IS NULL OR ts > reg_end) AS en, max(ts) FILTER (reg_end IS NULL OR ts > reg_end) AS ets FROM r GROUP BY ALL),
 i AS (SELECT *, count(reg) OVER (PARTITION BY instrument ORDER BY day) AS island FROM d),
 g AS (SELECT instrument, day + 1 AS session, first_value(reg) OVER w AS regular_close, last_value(en IGNORE NULLS) OVER w AS last, min(lo) OVER w AS lo, max(hi) OVER w AS hi, last_value(ets IGNORE NULLS) OVER w AS last_time FROM i WINDOW w AS (PARTITION BY instrument, island ORDER BY day))
 SELECT instrument, session, last_time, {rd('regular_close last ret low_ret high_ret')} FROM (SELECT *, last / regular_close - 1 AS ret, lo / regular_close - 1 AS low_ret, hi / regular_close - 1 AS high_ret FROM g WHERE regular_close > 0 AND last IS NOT NULL)""")
def after_hours_move(v):
    return rounded(I.after_hours_move(v.intraday))


@query("cutoff_returns", f"""WITH c AS (SELECT DISTINCT event_type AS instrument, CAST(ts AS DATE) + 1 AS session, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 11 HOUR AS cutoff FROM events WHERE value > 0),
 n AS (SELECT c.*, h.close AS now_close, h.ts AS now_ts, CAST((cutoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS cut_day FROM c ASOF LEFT JOIN (SELECT *, ts + INTERVAL 1 HOUR AS bar_end FROM v_hourly) h ON c.instrument = h.instrument AND c.cutoff >= h.bar_end),
 r AS (SELECT instrument, CAST(l AS DATE) AS reg_day, arg_max(close, ts) AS reg_close, max(ts) AS reg_ts FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM v_hourly) WHERE hour(l) < 17 GROUP BY ALL),
 ro AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY reg_day) AS ord FROM r),
 a AS (SELECT n.*, ro.ord FROM n ASOF LEFT JOIN ro ON n.instrument = ro.instrument AND n.cut_day > ro.reg_day)
 SELECT a.instrument, a.session, a.cutoff, k AS sessions_back, round(CASE WHEN now_ts > q.reg_ts THEN now_close / q.reg_close - 1 END, 6) AS ret
 FROM a CROSS JOIN (SELECT unnest([1, 5]) AS k) LEFT JOIN ro q ON q.instrument = a.instrument AND q.ord = a.ord - (k - 1)""")
def cutoff_returns(v):
    days = v.events.filter("value > 0").select(F.col("event_type").alias("instrument"), F.col("ts").cast("date").alias("d")).distinct()
    cut = days.select("instrument", F.date_add("d", 1).alias("session"),
                      (F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(11))).alias("cutoff"))
    parts = [I.cutoff_returns(v.hourly, cut, k).withColumn("sessions_back", F.lit(k)) for k in (1, 5)]
    return rounded(parts[0].unionByName(parts[1]))


def _scores(v):
    t = B.horizon_target(v.bars, 5)
    return t.select("instrument", F.col("prediction_date").alias("made"), "matures",
                    (F.abs("future_return") / F.greatest("sigma", F.lit(1e-6))).alias("score"))


_score_sql = f"""sc AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY made, matures) AS pos FROM (SELECT instrument, session AS made, matures, abs(fr) / greatest(sg, 1e-6) AS score FROM (
  SELECT instrument, session, {lead('close', 4)} / {lag('close')} - 1 AS fr, {lag('vol20')} * sqrt(5) AS sg, {lead('session', 4)} AS matures FROM v_vol) WHERE fr IS NOT NULL AND sg IS NOT NULL AND matures IS NOT NULL)),
 mt AS (SELECT a.*, coalesce(b.pos, 0) AS matured FROM sc a ASOF LEFT JOIN (SELECT instrument, matures AS m, pos FROM sc) b ON a.instrument = b.instrument AND a.made > b.m)"""
_frame = lambda n: f"(PARTITION BY instrument ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_ranked = lambda n: f"list_sort(list(score) OVER {_frame(n)})[CAST(least(ceil((count(score) OVER {_frame(n)} + 1) * 0.8 - 1e-12), count(score) OVER {_frame(n)}) AS INT)]"


@query("trailing_q_path", f"""WITH {_score_sql}, q AS (SELECT instrument, pos AS p, {', '.join(f"quantile_cont(score, 0.8) OVER {_frame(n)} AS quantile_{n}, {_ranked(n)} AS conformal_{n}" for n in (250, 500))} FROM sc)
 SELECT mt.instrument, made, matured, {rd('quantile_250 conformal_250 quantile_500 conformal_500')} FROM mt LEFT JOIN q ON q.instrument = mt.instrument AND q.p = mt.matured AND mt.matured >= 100""")
def trailing_q_path(v):
    q = P.trailing_q(_scores(v), "instrument")
    return rounded(q.select("instrument", "made", F.col("matured").cast("bigint").alias("matured"), "quantile_250", "conformal_250", "quantile_500", "conformal_500"))


@query("aci_path")
def aci_path(v):
    return P.adaptive_q(_scores(v), "instrument")


@query("interval_candidates")
def interval_candidates(v):
    return P.candidates(_scores(v), "instrument")
