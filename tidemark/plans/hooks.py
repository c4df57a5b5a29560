"""Where a caller's function is taken: per-series kernels, loaders, event rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import intraday as I
from ..operators import models as G
from ..sources import readers as R
from .registry import query
from .rounding import rounded


@query("series_kernel")
def series_kernel(v):
    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        return pdf.assign(value=pdf["value"].ewm(span=6).mean())[["series_id", "month", "value"]]

    return G.series_kernel(v.series, "series_id", smooth, "series_id string, month date, value double")


@query("source_hook", """SELECT series_id, month, coalesce(f.value, a.value) AS value, CASE WHEN f.value IS NOT NULL THEN 'fresh' ELSE 'archive' END AS source, o.value AS offline_value
 FROM (SELECT * FROM v_series WHERE year(month) >= 1999) f FULL JOIN v_series2 a USING (series_id, month) LEFT JOIN v_series2 o USING (series_id, month)""")
def source_hook(v):
    key = ["series_id", "month"]

    def offline():
        raise ConnectionError("no network")

    live = R.load_series(lambda: v.series.filter("year(month) >= 1999"), v.series2, key)
    down = R.load_series(offline, v.series2, key).select(*key, F.col("value").alias("offline_value"))
    return live.join(down, key, "left")


@query("event_udtf", """WITH b AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument, session ORDER BY ts) - 1 AS ret FROM v_intraday)
 SELECT instrument, session, ts, kind, round(v, 6) AS value FROM (SELECT instrument, session, ts, 'move' AS kind, ret AS v FROM b WHERE abs(ret) > 0.5 UNION ALL SELECT instrument, session, ts, 'volume', volume FROM b WHERE volume > 1 UNION ALL SELECT instrument, session, ts, 'flat', 0.0 FROM b WHERE ret = 0)""")
def event_udtf(v):
    return rounded(I.event_rows(v.intraday, 0.5, 1.0))
