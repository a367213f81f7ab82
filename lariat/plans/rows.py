"""Queries of row order, time and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lariat.functions import datetimes
from lariat.operators import missing, windows
from lariat.operators.aggregate import GroupBy
from lariat.plans.frames import six
from lariat.plans.registry import query
from lariat.streaming import events

O = ["ts", "event_id"]
#: Decimals that keep means off the halves between two results.
_DIGITS = {"mean": 6, "cov": 5, "median": 6}
W = "OVER (ORDER BY ts, event_id)"
WU = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _frame(w: str, frame: str) -> str:
    return w[:-1] + f" ROWS BETWEEN {frame})"


def _v(t):
    return t.events.withColumn("v", F.when(F.col("value") >= 30, F.col("value")))


_NULL = "(SELECT *, CASE WHEN value >= 30 THEN value END AS v FROM events)"
_u = lambda t: GroupBy(t.events, ["user_id"], O)

for _name, _w, _by in (("", W, ()), ("groupby_", WU, ("user_id",))):
    query(f"{_name}shift", f"SELECT event_id, lag(value, 2) {_w} AS x FROM events", lambda t, b=_by: windows.shift(t.events, "value", 2, O, b, name="x").select("event_id", "x"))
    query(f"{_name}diff", f"SELECT event_id, round(value - lag(value) {_w}, 6) AS x FROM events", lambda t, b=_by: six(windows.diff(t.events, "value", 1, O, b, "x"), "x").select("event_id", "x"))
    query(f"{_name}pct_change", f"SELECT event_id, round((value - lag(value) {_w}) / nullif(lag(value) {_w}, 0), 6) AS x FROM events", lambda t, b=_by: six(windows.pct_change(t.events, "value", 1, O, b, "x"), "x").select("event_id", "x"))
    for _k, _f in (("sum", "round(sum(v) {w}, 4)"), ("max", "max(v) {w}"), ("min", "min(v) {w}")):
        query(f"{_name}cum{_k}", f"SELECT event_id, CASE WHEN v IS NOT NULL THEN {_f.format(w=_frame(_w, 'UNBOUNDED PRECEDING AND CURRENT ROW'))} END AS x FROM {_NULL}",
              lambda t, k=_k, b=_by: windows.cumulative(_v(t), "v", k, O, b, "x").select("event_id", (F.round("x", 4) if k == "sum" else F.col("x")).alias("x")))
    query(f"{_name}cumprod", f"SELECT event_id, round(product(1 + value / 1000000) {_frame(_w, 'UNBOUNDED PRECEDING AND CURRENT ROW')}, 6) AS x FROM events", lambda t, b=_by: six(windows.cumulative(t.events.withColumn("p", 1 + F.col("value") / 1000000), "p", "prod", O, b, "x"), "x").select("event_id", "x"))
    query(f"{_name}cumcount", f"SELECT event_id, count(v) {_frame(_w, 'UNBOUNDED PRECEDING AND CURRENT ROW')} AS x FROM {_NULL}", lambda t, b=_by: windows.cumulative(_v(t), "v", "count", O, b, "x").select("event_id", "x"))
    query(f"{_name}ffill", f"SELECT event_id, last_value(v IGNORE NULLS) {_frame(_w, 'UNBOUNDED PRECEDING AND CURRENT ROW')} AS x FROM {_NULL}", lambda t, b=_by: windows.fill(_v(t), "v", O, b, name="x").select("event_id", "x"))
    query(f"{_name}bfill", f"SELECT event_id, first_value(v IGNORE NULLS) {_frame(_w, 'CURRENT ROW AND UNBOUNDED FOLLOWING')} AS x FROM {_NULL}", lambda t, b=_by: windows.fill(_v(t), "v", O, b, back=True, name="x").select("event_id", "x"))
    query(f"{_name}ffill_limit", f"SELECT event_id, last_value(v IGNORE NULLS) {_frame(_w, '2 PRECEDING AND CURRENT ROW')} AS x FROM {_NULL}", lambda t, b=_by: windows.fill(_v(t), "v", O, b, limit=2, name="x").select("event_id", "x"))
    _p = "PARTITION BY user_id " if _by else ""
    _r = {
        "min": f"rank() OVER ({_p}ORDER BY k)", "max": f"rank() OVER ({_p}ORDER BY k) + count(*) OVER (PARTITION BY {'user_id, ' if _by else ''}k) - 1", "dense": f"dense_rank() OVER ({_p}ORDER BY k)",
        "average": f"rank() OVER ({_p}ORDER BY k) + (count(*) OVER (PARTITION BY {'user_id, ' if _by else ''}k) - 1) / 2.0", "first": f"row_number() OVER ({_p}ORDER BY k, ts, event_id)",
    }
    for _m, _f in _r.items():
        query(f"{_name}rank_{_m}", f"SELECT event_id, ({_f})::DOUBLE AS rank FROM (SELECT *, floor(value / 10)::BIGINT AS k FROM events)",
              lambda t, m=_m, b=_by: windows.rank(t.events.withColumn("k", F.floor(F.col("value") / 10)), "k", m, b, O).select("event_id", "rank"))
    query(f"{_name}rank_pct", f"SELECT event_id, round(({_r['average']}) / count(*) OVER ({_p}), 6) AS rank FROM (SELECT *, floor(value / 10)::BIGINT AS k FROM events)", lambda t, b=_by: six(windows.rank(t.events.withColumn("k", F.floor(F.col("value") / 10)), "k", "average", b, O, pct=True), "rank").select("event_id", "rank"))
    for _k, _f in {"sum": "sum(value) {w}", "mean": "avg(value) {w}", "min": "min(value) {w}", "max": "max(value) {w}", "std": "stddev_samp(value) {w}", "var": "var_samp(value) {w}", "median": "median(value) {w}", "quantile": "quantile_cont(value, 0.3) {w}",
                   "skew": "skewness(value) {w}", "kurt": "kurtosis(value) {w}", "sem": "stddev_samp(value) {w} / sqrt(count(value) {w})", "corr": "corr(value, event_id) {w}", "cov": "covar_samp(value, event_id) {w}"}.items():
        _wf = _frame(_w, "7 PRECEDING AND CURRENT ROW")
        query(f"{_name}rolling_{_k}", f"SELECT event_id, CASE WHEN count(value) {_wf} >= 8 THEN round({_f.format(w=_wf)}, {_DIGITS.get(_k, 3)}) END AS x FROM events",
              lambda t, k=_k, b=_by: windows.rolling(t.events, "value", 8, k, O, b, q=0.3, other="event_id", name="x").select("event_id", F.round("x", _DIGITS.get(k, 3)).alias("x")))
    _wf = _frame(_w, "4 PRECEDING AND CURRENT ROW")
    query(f"{_name}rolling_count", f"SELECT event_id, count(v) {_wf} AS x FROM {_NULL}", lambda t, b=_by: windows.rolling(_v(t), "v", 5, "count", O, b, name="x").select("event_id", "x"))
    for _k, _f in {"sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "std": "stddev_samp(value)", "var": "var_samp(value)"}.items():
        # a hair above keeps sums in another order from falling on either side of a half
        query(f"{_name}expanding_{_k}", f"SELECT event_id, round({_f} {_frame(_w, 'UNBOUNDED PRECEDING AND CURRENT ROW')} + 1e-7, 4) AS x FROM events",
              lambda t, k=_k, b=_by: windows.expanding(t.events, "value", k, O, b, name="x").select("event_id", F.round(F.col("x") + 1e-7, 4).alias("x")))
query("rolling_min_periods", f"SELECT event_id, CASE WHEN count(v) {_frame(W, '4 PRECEDING AND CURRENT ROW')} >= 2 THEN round(sum(v) {_frame(W, '4 PRECEDING AND CURRENT ROW')}, 4) END AS x FROM {_NULL}", lambda t: windows.rolling(_v(t), "v", 5, "sum", O, min_periods=2, name="x").select("event_id", F.round("x", 4).alias("x")))
query("rolling_center", f"SELECT event_id, CASE WHEN count(value) {_frame(W, '2 PRECEDING AND 2 FOLLOWING')} >= 5 THEN round(avg(value) {_frame(W, '2 PRECEDING AND 2 FOLLOWING')}, 4) END AS x FROM events", lambda t: windows.rolling(t.events, "value", 5, "mean", O, center=True, name="x").select("event_id", F.round("x", 4).alias("x")))
query("rolling_closed_left", f"SELECT event_id, CASE WHEN count(value) {_frame(W, '3 PRECEDING AND 1 PRECEDING')} >= 3 THEN round(sum(value) {_frame(W, '3 PRECEDING AND 1 PRECEDING')}, 4) END AS x FROM events", lambda t: windows.rolling(t.events, "value", 3, "sum", O, closed="left", name="x").select("event_id", F.round("x", 4).alias("x")))
query("rolling_weighted", f"SELECT event_id, round((lag(value, 2) {W} * 1 + lag(value) {W} * 2 + value * 3) / 6, 4) AS x FROM events", lambda t: windows.rolling(t.events, "value", 3, "weighted", O, weights=[1, 2, 3], name="x").select("event_id", F.round("x", 4).alias("x")))
query("moving_average", f"SELECT event_id, CASE WHEN count(*) {_frame(W, '2 PRECEDING AND CURRENT ROW')} = 3 THEN round(avg(value) {_frame(W, '2 PRECEDING AND CURRENT ROW')}, 4) END AS x FROM events", lambda t: windows.rolling(t.events, "value", 3, "mean", O, name="x").select("event_id", F.round("x", 4).alias("x")))
_E = "WITH e AS (SELECT event_id, value AS v, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)"
query("ewm_mean_adjusted", f"{_E} SELECT a.event_id, round(sum(b.v * power(0.5, a.i - b.i)) / sum(power(0.5, a.i - b.i)), 4) AS x FROM e a JOIN e b ON b.i <= a.i AND b.i > a.i - 60 GROUP BY 1", lambda t: windows.ewm(t.events, "value", 0.5, "mean", O, name="x").select("event_id", F.round("x", 4).alias("x")))
query("ewm_mean_recursive", f"{_E} SELECT a.event_id, round(sum(b.v * power(0.5, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE 0.5 END), 4) AS x FROM e a JOIN e b ON b.i <= a.i AND b.i > a.i - 60 GROUP BY 1", lambda t: windows.ewm(t.events, "value", 0.5, "mean", O, adjust=False, name="x").select("event_id", F.round("x", 4).alias("x")))
query("ewm_var", f"{_E}, p AS (SELECT a.event_id, b.v, power(0.5, a.i - b.i) AS w FROM e a JOIN e b ON b.i <= a.i AND b.i > a.i - 60), m AS (SELECT event_id, sum(v * w) / sum(w) AS m FROM p GROUP BY 1) SELECT event_id, CASE WHEN count(*) > 1 THEN round(sum(w * (v - m) * (v - m)) * sum(w) / nullif(sum(w) * sum(w) - sum(w * w), 0), 2) END AS x FROM p JOIN m USING (event_id) GROUP BY 1",
      lambda t: windows.ewm(t.events, "value", 0.5, "var", O, name="x").select("event_id", F.round("x", 2).alias("x")))
query("interpolate", f"WITH e AS (SELECT event_id, ts, v, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM {_NULL}), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e) SELECT k.event_id, round(CASE WHEN k.v IS NOT NULL THEN k.v WHEN x.v IS NULL THEN NULL WHEN y.v IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (k.i - k.a) / (k.b - k.a) END, 4) AS v FROM k LEFT JOIN e x ON x.i = k.a LEFT JOIN e y ON y.i = k.b",
      lambda t: missing.interpolate(_v(t), "v", O).select("event_id", (F.round(F.col("v") * 10000) / 10000).alias("v")))  # fmt: skip  halves as SQL rounds them
for _n, _rule, _sql in (("5min", "5 minutes", "time_bucket(INTERVAL '5 minutes', ts)"), ("hour", "hour", "date_trunc('hour', ts)"), ("day", "day", "date_trunc('day', ts)::TIMESTAMP"), ("week", "week", "date_trunc('week', ts)::TIMESTAMP"), ("month", "month", "date_trunc('month', ts)::TIMESTAMP")):
    query(f"resample_{_n}", f"SELECT {_sql} AS bucket, count(*) AS n, round(avg(value), 4) AS m FROM events GROUP BY 1", lambda t, r=_rule: datetimes.resample(t.events, "ts", r, {"n": F.count("*"), "m": F.round(F.avg("value"), 4)}))
query("groupby_resample", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket, round(sum(value), 4) AS s FROM events GROUP BY ALL", lambda t: datetimes.resample(t.events, "ts", "day", {"s": F.round(F.sum("value"), 4)}, ["event_type"]))
query("asfreq", "WITH d AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) SELECT g.h AS h, d.n FROM (SELECT unnest(generate_series((SELECT min(h) FROM d), (SELECT max(h) FROM d), INTERVAL '1 hour')) AS h) g LEFT JOIN d ON g.h = d.h",
      lambda t: datetimes.asfreq(datetimes.resample(t.events, "ts", "hour", {"n": F.count("*")}).withColumnRenamed("bucket", "h"), "h", "1 hour", ["n"]))
query("between_time", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:00:00' AND '17:30:00'", lambda t: datetimes.between_time(t.events, "ts", "09:00:00", "17:30:00").select("event_id"))
query("date_range", "SELECT unnest(generate_series(TIMESTAMP '2024-01-15', TIMESTAMP '2024-12-31', INTERVAL '1 month')) AS ts", lambda t: datetimes.date_range(t.spark, "2024-01-15", "2024-12-31", "1 month"))
query("bdate_range", "SELECT ts FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-03-15', INTERVAL '1 day')) AS ts) WHERE isodow(ts) < 6", lambda t: datetimes.bdate_range(t.spark, "2024-02-01", "2024-03-15"))
_PARTS = {"year": "year(d)", "month": "month(d)", "day": "day(d)", "hour": "hour(d)", "minute": "minute(d)", "second": "second(d)", "quarter": "quarter(d)", "dayofyear": "dayofyear(d)", "weekday": "isodow(d) - 1", "days_in_month": "day(last_day(d))", "microsecond": "microsecond(d) % 1000000",
          "is_month_start": "day(d) = 1", "is_month_end": "d::DATE = last_day(d)", "is_year_start": "dayofyear(d) = 1", "is_year_end": "month(d) = 12 AND day(d) = 31", "is_leap_year": "day(last_day(make_date(year(d), 2, 1))) = 29", "day_name": "dayname(d)", "month_name": "monthname(d)", "date": "d::DATE", "normalize": "date_trunc('day', d)::TIMESTAMP"}
for _k, _s in _PARTS.items():
    query(f"dt_{_k}", f"SELECT event_id, {_s} AS x FROM (SELECT event_id, ts AS d FROM events)", lambda t, k=_k: t.events.select("event_id", (lambda c: c.cast("timestamp_ntz") if k == "normalize" else c)(datetimes.parts(F.col("ts"))[k]).alias("x")))
query("dt_floor", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS x FROM events", lambda t: t.events.select("event_id", datetimes.floor(F.col("ts"), 15, "min").alias("x")))
query("dt_ceil", "SELECT event_id, CASE WHEN time_bucket(INTERVAL '15 minutes', ts) = ts THEN ts ELSE time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' END AS x FROM events", lambda t: t.events.select("event_id", datetimes.ceil(F.col("ts"), 15, "min").alias("x")))
query("dt_strftime", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS x FROM events", lambda t: t.events.select("event_id", F.date_format("ts", "yyyy/MM/dd HH:mm").alias("x")))
query("to_datetime", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS x FROM orders", lambda t: t.orders.select("o_orderkey", F.try_to_timestamp(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("dd.MM.yyyy")).cast("timestamp_ntz").alias("x")))
query("offsets_month_end", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL '1 month') ELSE last_day(o_orderdate) END AS x FROM orders", lambda t: t.orders.select("o_orderkey", datetimes.month_end(F.col("o_orderdate")).alias("x")))
query("offsets_business_day", "SELECT o_orderkey, (d + (CASE WHEN isodow(d) <= 2 THEN 3 WHEN isodow(d) <= 5 THEN 5 WHEN isodow(d) = 6 THEN 4 ELSE 3 END)::INT) AS x FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)", lambda t: t.orders.select("o_orderkey", datetimes.business_days(F.col("o_orderdate"), 3).alias("x")))

query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL", lambda t: events.windowed(t.events, "ts", "1 hour", {"n": F.count("*")}, ["event_type"], delay="1 hour"))
query("stream_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) GROUP BY 1", lambda t: events.windowed(t.events, "ts", "1 hour", {"n": F.count("*")}, slide="30 minutes"))
query("stream_session", "WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) SELECT min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, s",
      lambda t: events.sessions(t.events, "ts", "6 hours", {"n": F.count("*")}, ["user_id"]))
query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events", lambda t: events.dedupe(t.events.select("user_id", "event_type"), ["user_id", "event_type"]))
query("chunked_pipeline", "SELECT event_type, round(sum(value * 2), 4) AS s FROM events WHERE value > 10 GROUP BY 1", lambda t: events.Pipeline().filter("value > 10").map(lambda d: d.withColumn("value", F.col("value") * 2)).reduce(F.round(F.sum("value"), 4).alias("s"), by=["event_type"])(t.events))
