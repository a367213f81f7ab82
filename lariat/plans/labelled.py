"""Queries of labels and positions, aligned frames, categories, intervals, periods, offsets and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from lariat.functions import datetimes, values
from lariat.operators import aggregate, labels, reshape, windows
from lariat.operators.aggregate import GroupBy
from lariat.plans.frames import _trip, six
from lariat.plans.registry import query
from lariat.sources import files

C = F.col
_E = "(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)"
_O = ["ts", "event_id"]

query("loc_labels", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8)", lambda t: labels.loc(t.customer, "c_custkey", [3, 5, 8], cols=["c_custkey", "c_name"]))
query("loc_slice", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 10 AND 20", lambda t: labels.loc(t.customer, "c_custkey", start=10, stop=20, cols=["c_custkey", "c_acctbal"]))
query("iloc_slice", f"SELECT event_id, ts FROM {_E} WHERE i >= 10 AND i < 40 AND (i - 10) % 3 = 0", lambda t: labels.iloc(t.events.select("event_id", "ts"), _O, slice(10, 40, 3)))
query("iloc_end", f"SELECT event_id FROM {_E} WHERE i IN ((SELECT count(*) - 1 FROM events), (SELECT count(*) - 4 FROM events), 2)", lambda t: labels.iloc(t.events.select("event_id", "ts"), _O, [2, -1, -4], [0]))
query("at", "SELECT c_acctbal FROM customer WHERE c_custkey = 7", lambda t: labels.at(t.customer, "c_custkey", 7, "c_acctbal"))
query("iat", f"SELECT event_id FROM {_E} WHERE i = 5", lambda t: labels.iat(t.events.select("event_id", "ts"), _O, 5, 0))
query("loc_assign", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'debt' END AS note FROM customer", lambda t: labels.loc_set(labels.loc_set(t.customer, C("c_acctbal") < 0, {"note": "debt"}), C("c_acctbal") < 0, {"c_acctbal": 0.0}).select("c_custkey", "c_acctbal", "note"))
query("iloc_assign", f"SELECT event_id, CASE WHEN i IN (1, 3) THEN -1.0 ELSE value END AS value FROM {_E}", lambda t: labels.iloc_set(t.events, _O, [1, 3], {"value": -1.0}).select("event_id", "value"))
query("set_index", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders", lambda t: labels.set_index(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_custkey", "o_orderkey"], verify=True))
query("reset_index", f"SELECT i AS \"index\", event_id FROM {_E}", lambda t: labels.reset_index(t.events.select("event_id", "ts"), _O).drop("ts"))
query("reindex", "SELECT k AS s_suppkey, coalesce(s_acctbal, 0.0) AS s_acctbal FROM (SELECT unnest(generate_series(0, 30, 2))::BIGINT AS k) LEFT JOIN supplier ON k = s_suppkey", lambda t: labels.reindex(t.supplier.select("s_suppkey", "s_acctbal"), "s_suppkey", t.spark.range(0, 31, 2).toDF("s_suppkey"), fill=0.0))
query("reindex_ffill", "SELECT g.h AS ts, e.event_id FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-20', INTERVAL '1 day')) AS h) g ASOF LEFT JOIN (SELECT ts, event_id FROM events) e ON g.h >= e.ts",
      lambda t: labels.reindex(t.events.select("ts", "event_id"), "ts", datetimes.date_range(t.spark, "2024-01-01", "2024-01-20"), "ffill"))
query("reindex_bfill", "SELECT g.h AS ts, e.event_id FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-20', INTERVAL '1 day')) AS h) g ASOF LEFT JOIN (SELECT ts, event_id FROM events) e ON g.h <= e.ts",
      lambda t: labels.reindex(t.events.select("ts", "event_id"), "ts", datetimes.date_range(t.spark, "2024-01-01", "2024-01-20"), "bfill"))
query("reindex_like", "SELECT n.n_nationkey, r.r_name AS r_name FROM nation n LEFT JOIN (SELECT r_regionkey AS n_nationkey, r_name FROM region) r USING (n_nationkey)", lambda t: labels.reindex_like(t.region.select(C("r_regionkey").alias("n_nationkey"), "r_name"), "n_nationkey", t.nation.select("n_nationkey", C("n_name").alias("r_name"))))
query("rename", "SELECT r_regionkey AS key, r_name AS name FROM region", lambda t: labels.rename(t.region, {"r_regionkey": "key", "r_name": "name"}))
query("rename_function", "SELECT r_regionkey AS \"R_REGIONKEY\", r_name AS \"R_NAME\" FROM region", lambda t: labels.rename(t.region, str.upper))
query("add_prefix", "SELECT r_regionkey AS x_r_regionkey, r_name AS x_r_name FROM region", lambda t: labels.add_prefix(t.region, "x_"))
query("add_suffix", "SELECT r_regionkey, r_name AS r_name_y FROM region", lambda t: labels.add_suffix(t.region, "_y", ["r_regionkey"]))
query("filter_like", "SELECT c_custkey, c_nationkey FROM customer", lambda t: labels.filter_names(t.customer, like="key"))
query("filter_regex", "SELECT c_custkey, c_nationkey FROM customer", lambda t: labels.filter_names(t.customer, regex="key$"))
query("drop", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 2)", lambda t: labels.drop(t.nation, ["n_regionkey"], "n_nationkey", [1, 2]))
query("pop", "SELECT n_nationkey, n_regionkey FROM nation", lambda t: labels.pop(t.nation, "n_name")[0])
query("insert", "SELECT s_suppkey, s_acctbal * 2 AS twice, s_acctbal FROM supplier", lambda t: labels.insert(t.supplier.select("s_suppkey", "s_acctbal"), 1, "twice", C("s_acctbal") * 2))
query("xs", "SELECT l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 3", lambda t: labels.xs(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 3))
query("lookup", "SELECT 1::INT AS label, 'n_name' AS \"column\", n_name AS value FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 4, 'n_regionkey', n_regionkey::VARCHAR FROM nation WHERE n_nationkey = 4", lambda t: labels.lookup(t.nation, "n_nationkey", [(1, "n_name"), (4, "n_regionkey")]))
query("truncate", "SELECT p_partkey FROM part WHERE p_partkey >= 20 AND p_partkey <= 50", lambda t: labels.truncate(t.part, "p_partkey", 20, 50).select("p_partkey"))
query("first_span", "SELECT event_id FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL '2 days'", lambda t: labels.first_span(t.events, "ts", "2 days").select("event_id"))
query("last_span", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '2 days'", lambda t: labels.first_span(t.events, "ts", "2 days", last=True).select("event_id"))
query("at_time", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%H:%M:%S') = '00:00:00'", lambda t: labels.at_time(t.orders, "o_orderdate", "00:00:00").select("o_orderkey"))
query("sort_columns", "SELECT n_name, n_nationkey, n_regionkey FROM nation", lambda t: labels.sort_columns(t.nation))
query("align", "SELECT coalesce(c_custkey, s_suppkey) AS k, c_acctbal AS a, NULL::DOUBLE AS b FROM customer FULL JOIN supplier ON c_custkey = s_suppkey", lambda t: labels.align(t.customer.selectExpr("c_custkey k", "c_acctbal a"), t.supplier.selectExpr("s_suppkey k", "s_acctbal b"), "k")[0])
query("update", "SELECT c_custkey AS k, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS v FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey", lambda t: labels.update(t.customer.selectExpr("c_custkey k", "c_acctbal v"), t.supplier.selectExpr("s_suppkey k", "case when s_acctbal > 0 then s_acctbal end v"), "k"))
query("combine", "SELECT coalesce(c_custkey, s_suppkey) AS k, greatest(c_acctbal, s_acctbal) AS v FROM customer FULL JOIN supplier ON c_custkey = s_suppkey", lambda t: labels.combine(t.customer.selectExpr("c_custkey k", "c_acctbal v"), t.supplier.selectExpr("s_suppkey k", "s_acctbal v"), "k", F.greatest))
query("equals", "SELECT true AS equal", lambda t: labels.equals(t.orders, t.orders.orderBy(F.desc("o_orderkey"))))
query("equals_not", "SELECT false AS equal", lambda t: labels.equals(t.orders, t.orders.withColumn("o_totalprice", C("o_totalprice") + 1)))
query("repeat", "SELECT r_name FROM region, generate_series(1, 3)", lambda t: labels.repeat(t.region.select("r_name"), 3))
query("searchsorted", "SELECT v AS value, (SELECT count(*) FROM part WHERE p_size < v) AS \"at\" FROM (SELECT unnest([5, 17, 60])::INT AS v)", lambda t: labels.searchsorted(t.part, "p_size", [5, 17, 60]))
query("argsort", "WITH s AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), r AS (SELECT i AS argsort, row_number() OVER (ORDER BY s_acctbal, i) - 1 AS p FROM s) SELECT s_suppkey, argsort FROM s JOIN r ON i = p", lambda t: labels.argsort(t.supplier, "s_acctbal", ["s_suppkey"]).select("s_suppkey", "argsort"))
query("index_monotonic", "SELECT true AS increasing, false AS decreasing, true AS \"unique\"", lambda t: labels.monotonic(t.orders, "o_orderkey", ["o_orderkey"]))
query("index_get_loc", f"SELECT i AS position FROM {_E} WHERE event_type = 'purchase'", lambda t: labels.get_loc(t.events, "event_type", "purchase", _O))
query("multiindex_product", "SELECT r_regionkey, n_nationkey FROM region, nation", lambda t: labels.product_of(t.region.select("r_regionkey"), t.nation.select("n_nationkey")))
query("multiindex_codes", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus_code, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_code FROM orders", lambda t: labels.level_codes(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"]).drop("o_orderstatus", "o_orderpriority"))

_A = "(SELECT c_custkey, c_acctbal AS x, CASE WHEN c_nationkey > 5 THEN c_nationkey - 12 END AS y FROM customer)"
_a = lambda t: t.customer.select("c_custkey", C("c_acctbal").alias("x"), F.when(C("c_nationkey") > 5, C("c_nationkey") - 12).alias("y"))
for _n, _sql in (("add", "x + coalesce(y, 1)"), ("sub", "x - coalesce(y, 1)"), ("mul", "x * coalesce(y, 1)"), ("div", "x / nullif(coalesce(y, 1), 0)")):
    query(f"arith_{_n}_fill", f"SELECT c_custkey, round({_sql}, 6) AS v FROM {_A}", lambda t, n=_n: _a(t).select("c_custkey", F.round(values.arith(C("x"), C("y"), n, 1), 6).alias("v")))
for _n, _sql in (("rsub", "y - x"), ("rdiv", "y / nullif(x, 0)"), ("radd", "y + x"), ("rmul", "y * x")):
    query(f"arith_{_n}", f"SELECT c_custkey, round({_sql}, 6) AS v FROM {_A}", lambda t, n=_n: _a(t).select("c_custkey", F.round(values.arith(C("x"), C("y"), n[1:], swapped=True), 6).alias("v")))
for _n, _sql in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"compare_{_n}", f"SELECT c_custkey, x {_sql} y AS v FROM {_A}", lambda t, n=_n: _a(t).select("c_custkey", values.arith(C("x"), C("y"), n).alias("v")))
query("divmod", f"SELECT c_custkey, floor(x / nullif(y, 0))::BIGINT AS q, round(x - floor(x / nullif(y, 0)) * y, 4) AS r FROM {_A}", lambda t: _a(t).select("c_custkey", values.divmod_(C("x"), C("y")).alias("d")).select("c_custkey", C("d.quotient").alias("q"), F.round("d.remainder", 4).alias("r")))
query("math_mod", f"SELECT c_custkey, round(x - floor(x / 7) * 7, 4) AS v FROM {_A}", lambda t: _a(t).select("c_custkey", F.round(values.mod(C("x"), F.lit(7)), 4).alias("v")))
query("math_maximum", f"SELECT c_custkey, CASE WHEN y IS NOT NULL THEN greatest(x, y) END AS v FROM {_A}", lambda t: _a(t).select("c_custkey", values.maximum(C("x"), C("y").cast("double")).alias("v")))
query("math_minimum", f"SELECT c_custkey, CASE WHEN y IS NOT NULL THEN least(x, y) END AS v FROM {_A}", lambda t: _a(t).select("c_custkey", values.minimum(C("x"), C("y").cast("double")).alias("v")))
query("math_round", f"SELECT c_custkey, round(x, 1) AS v FROM {_A}", lambda t: _a(t).select("c_custkey", F.round("x", 1).alias("v")))
query("math_tan", f"SELECT c_custkey, round(tan(x / 10000), 6) AS v FROM {_A}", lambda t: _a(t).select("c_custkey", F.round(F.tan(C("x") / 10000), 6).alias("v")))
query("bit_xor", "SELECT p_partkey, xor(p_partkey, p_size::BIGINT) AS v FROM part", lambda t: t.part.select("p_partkey", values.xor(C("p_partkey"), C("p_size").cast("bigint")).alias("v")))
query("bit_lshift", "SELECT p_partkey, p_size * 8 AS v FROM part", lambda t: t.part.select("p_partkey", values.lshift(C("p_size"), 3).alias("v")))
query("bit_rshift", "SELECT p_partkey, p_size // 4 AS v FROM part", lambda t: t.part.select("p_partkey", values.rshift(C("p_size"), 2).alias("v")))

query("any_all", "SELECT bool_or(c_acctbal > 9000) AS a_any, bool_and(c_acctbal > 9000) AS a_all, bool_or(c_custkey > 0) AS b_any, bool_and(c_custkey > 0) AS b_all FROM customer", lambda t: aggregate.reduce(t.customer.select((C("c_acctbal") > 9000).alias("a"), (C("c_custkey") > 0).alias("b")), ["a", "b"], ["any", "all"]))
query("kendall", "SELECT round((sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2) / sqrt((sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) / 2.0) * (sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) / 2.0)), 6) AS tau FROM (SELECT p_size AS x, p_size % 7 AS y FROM part) a, (SELECT p_size AS x, p_size % 7 AS y FROM part) b",
      lambda t: six(aggregate.kendall(t.part.select("p_size", (C("p_size") % 7).alias("y")), "p_size", "y"), "tau"))
query("corrwith", "SELECT 'v' AS \"column\", round(corr(c_acctbal, s_acctbal), 6) AS corr FROM customer JOIN supplier ON c_custkey = s_suppkey", lambda t: six(aggregate.corrwith(t.customer.selectExpr("c_custkey k", "c_acctbal v"), t.supplier.selectExpr("s_suppkey k", "s_acctbal v"), ["k"], ["v"]), "corr"))
query("dot", "SELECT round(sum(c_acctbal * s_acctbal), 2) AS s_acctbal FROM customer JOIN supplier ON c_custkey = s_suppkey", lambda t: aggregate.dot(t.customer, t.supplier.select(C("s_suppkey").alias("c_custkey"), "s_acctbal"), "c_custkey", "c_acctbal", ["s_acctbal"]).select(F.round("s_acctbal", 2).alias("s_acctbal")))
query("first_valid_index", "SELECT min(event_id) AS first_valid FROM events WHERE value >= 30", lambda t: aggregate.valid_index(t.events.withColumn("v", F.when(C("value") >= 30, C("value"))), "v", "event_id"))
query("last_valid_index", "SELECT max(event_id) AS last_valid FROM events WHERE value >= 30", lambda t: aggregate.valid_index(t.events.withColumn("v", F.when(C("value") >= 30, C("value"))), "v", "event_id", last=True))
query("autocorr", f"SELECT round(corr(value, b), 6) AS corr FROM (SELECT value, lag(value) OVER (ORDER BY i) AS b FROM {_E})", lambda t: six(windows.shift(t.events, "value", 1, _O, name="b").agg(windows.correlation(F.col("value"), F.col("b")).alias("corr")), "corr"))
query("groupby_groups", "SELECT o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS size FROM orders GROUP BY 1", lambda t: GroupBy(t.orders, ["o_orderstatus"]).groups("o_orderkey"))
query("groupby_fillna", "SELECT event_id, coalesce(CASE WHEN value >= 30 THEN value END, -1.0) AS v FROM events", lambda t: GroupBy(t.events.withColumn("v", F.when(C("value") >= 30, C("value"))), ["user_id"]).fillna("v", -1.0).select("event_id", "v"))
query("groupby_missing_keys", "SELECT k, count(*) AS size FROM (SELECT CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS k FROM orders) GROUP BY 1", lambda t: GroupBy(t.orders.select(F.when(C("o_custkey") % 3 > 0, C("o_custkey") % 3).alias("k")), ["k"], dropna=False).size())
query("groupby_transform_missing_keys", "SELECT o_orderkey, count(*) OVER (PARTITION BY k) AS n FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS k FROM orders)", lambda t: GroupBy(t.orders.select("o_orderkey", F.when(C("o_custkey") % 3 > 0, C("o_custkey") % 3).alias("k")), ["k"], dropna=False).transform("o_orderkey", "count", "n").select("o_orderkey", "n"))
query("lreshape", "SELECT s_suppkey, unnest([s_acctbal, s_acctbal * 2]) AS v FROM supplier", lambda t: reshape.lreshape(t.supplier.selectExpr("s_suppkey", "s_acctbal a", "s_acctbal * 2 b"), {"v": ["a", "b"]}))
query("rolling_apply", f"SELECT event_id, CASE WHEN count(*) OVER w = 4 THEN round(max(value) OVER w - min(value) OVER w, 4) END AS x FROM {_E} WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", lambda t: windows.rolling_apply(t.events, "value", 4, lambda a: F.array_max(a) - F.array_min(a), _O, name="x").select("event_id", F.round("x", 4).alias("x")))
_P = f"WITH p AS (SELECT a.event_id, b.value AS x, b.event_id AS y, power(0.5, a.i - b.i) AS w FROM {_E} a JOIN {_E} b ON b.i <= a.i AND b.i > a.i - 60), m AS (SELECT event_id, sum(x * w) / sum(w) AS mx, sum(y * w) / sum(w) AS my FROM p GROUP BY 1)"
query("ewm_cov", f"{_P} SELECT event_id, CASE WHEN count(*) > 1 THEN round(sum(w * (x - mx) * (y - my)) * sum(w) / nullif(sum(w) * sum(w) - sum(w * w), 0), 2) END AS v FROM p JOIN m USING (event_id) GROUP BY 1", lambda t: windows.ewm(t.events, "value", 0.5, "cov", _O, other="event_id", name="v").select("event_id", F.round("v", 2).alias("v")))
query("groupby_ewm", "WITH e AS (SELECT event_id, user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id, round(sum(b.v * power(0.5, a.i - b.i)) / sum(power(0.5, a.i - b.i)), 4) AS x FROM e a JOIN e b ON b.user_id = a.user_id AND b.i <= a.i AND b.i > a.i - 60 GROUP BY 1", lambda t: GroupBy(t.events, ["user_id"], _O).ewm("value", 0.5, name="x").select("event_id", F.round("x", 4).alias("x")))
query("ewm_long_reach", f"SELECT a.event_id, round(sum(b.value * power(0.999, a.i - b.i)) / sum(power(0.999, a.i - b.i)), 4) AS x FROM {_E} a JOIN {_E} b ON b.i <= a.i WHERE a.i % 97 = 0 GROUP BY 1", lambda t: windows.ewm(t.events, "value", 0.001, "mean", _O, name="x").join(labels.reset_index(t.events.select("event_id", "ts"), _O, "i").where("i % 97 = 0").select("event_id"), "event_id").select("event_id", F.round("x", 4).alias("x")))

query("dt_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS x FROM events", lambda t: t.events.select("event_id", F.date_format("ts", "HH:mm:ss").alias("x")))
query("dt_round", "SELECT event_id, CASE WHEN epoch_us(ts) % 3600000000 > 1800000000 OR (epoch_us(ts) % 3600000000 = 1800000000 AND (epoch_us(ts) // 3600000000) % 2 = 1) THEN date_trunc('hour', ts) + INTERVAL '1 hour' ELSE date_trunc('hour', ts) END AS x FROM events", lambda t: t.events.select("event_id", datetimes.round_(C("ts"), 1, "h").alias("x")))
query("tz_localize", "SELECT event_id, ts - INTERVAL '3 hours' AS x FROM events", lambda t: t.events.select("event_id", datetimes.tz_localize(C("ts"), "+03:00").alias("x")))
query("tz_convert", "SELECT event_id, ts - INTERVAL '5 hours' AS x FROM events", lambda t: t.events.select("event_id", datetimes.tz_convert(C("ts"), "-05:00").alias("x")))
query("total_seconds", "SELECT event_id, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS x FROM events", lambda t: t.events.select("event_id", datetimes.total_seconds(C("ts"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("x")))
query("timedelta_components", "SELECT event_id, s // 86400 AS days, (s % 86400) // 3600 AS hours, (s % 3600) // 60 AS minutes, s % 60 AS seconds FROM (SELECT event_id, floor(epoch(ts) - epoch(TIMESTAMP '2020-01-01'))::BIGINT AS s FROM events)", lambda t: t.events.select("event_id", *(v.alias(k) for k, v in datetimes.components(datetimes.total_seconds(C("ts"), F.lit("2020-01-01").cast("timestamp_ntz"))).items())))
query("to_timedelta", "SELECT p_partkey, (p_size * 86400 + 3 * 3600 + 4 * 60 + 5)::DOUBLE AS x, NULL::DOUBLE AS bad FROM part", lambda t: t.part.select("p_partkey", datetimes.to_timedelta(F.concat(C("p_size").cast("string"), F.lit(" days 03:04:05"))).alias("x"), datetimes.to_timedelta(C("p_type")).alias("bad")))
query("timedelta_range", "SELECT 60 + 90 * unnest(generate_series(0, 9)) AS seconds", lambda t: datetimes.timedelta_range(t.spark, 60, 10, 90))
query("period_range", "SELECT unnest(generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-06-01', INTERVAL '1 month')) AS period", lambda t: datetimes.period_range(t.spark, "2023-11-01", "2024-06-15"))
query("infer_freq", "SELECT 7200.0::DOUBLE AS seconds", lambda t: datetimes.infer_freq(datetimes.date_range(t.spark, "2024-01-01", "2024-01-09", "2 hours"), "ts"))
query("offsets_day", "SELECT o_orderkey, o_orderdate::DATE + 3 AS x FROM orders", lambda t: t.orders.select("o_orderkey", datetimes.day(C("o_orderdate"), 3).alias("x")))
query("offsets_month_start", "SELECT o_orderkey, (date_trunc('month', o_orderdate) + INTERVAL '1 month')::DATE AS x FROM orders", lambda t: t.orders.select("o_orderkey", datetimes.month_start(C("o_orderdate")).alias("x")))
query("offsets_year_start", "SELECT o_orderkey, make_date(year(o_orderdate) + 1, 1, 1) AS x FROM orders", lambda t: t.orders.select("o_orderkey", datetimes.year_start(C("o_orderdate")).alias("x")))
query("offsets_year_end", "SELECT o_orderkey, CASE WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 31 THEN make_date(year(o_orderdate) + 1, 12, 31) ELSE make_date(year(o_orderdate), 12, 31) END AS x FROM orders", lambda t: t.orders.select("o_orderkey", datetimes.year_end(C("o_orderdate")).alias("x")))
query("date_offset", "SELECT o_orderkey, ((o_orderdate::DATE + INTERVAL '14 months')::DATE + 5) AS x FROM orders", lambda t: t.orders.select("o_orderkey", datetimes.date_offset(C("o_orderdate"), 1, 2, 5).alias("x")))
query("resample_first_last", "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY 1", lambda t: datetimes.resample(t.events, "ts", "day", {"a": F.min_by("value", F.struct("ts", "event_id")), "b": F.max_by("value", F.struct("ts", "event_id"))}))
for _f, _s, _l in (("month", "1 month", "strftime(ts, '%Y-%m')"), ("quarter", "3 months", "year(ts) || 'Q' || quarter(ts)"), ("year", "1 year", "year(ts)::VARCHAR")):
    query(f"period_{_f}", f"SELECT event_id, date_trunc('{_f}', ts)::TIMESTAMP AS start_time, date_trunc('{_f}', ts)::TIMESTAMP + INTERVAL '{_s}' - INTERVAL '1 microsecond' AS end_time, {_l} AS label FROM events", lambda t, f=_f: t.events.select("event_id", *(v.alias(k) for k, v in values.period(C("ts"), f).items())))
query("interval_parts", "SELECT p_partkey, p_size + 2.5 AS mid, 5 AS length, 20 > p_size AND 20 <= p_size + 5 AS hit, p_size < 15 AND 10 < p_size + 5 AS over FROM part", lambda t: (lambda i: t.part.select("p_partkey", i.mid().alias("mid"), i.length().alias("length"), i.contains(F.lit(20)).alias("hit"), i.overlaps(values.Interval(F.lit(10), F.lit(15))).alias("over")))(values.Interval(C("p_size"), C("p_size") + 5)))

_CATS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "none")
_cat = values.Categorical(_CATS, True)
query("cat_codes", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE -1 END AS code FROM orders", lambda t: t.orders.select("o_orderkey", _cat.codes(C("o_orderpriority")).alias("code")))
query("cat_values", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS v FROM orders", lambda t: t.orders.select("o_orderkey", _cat.values(_cat.codes(C("o_orderpriority"))).alias("v")))
query("cat_rename", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' ELSE o_orderpriority END AS v FROM orders", lambda t: t.orders.select("o_orderkey", _cat.rename(C("o_orderpriority"), {"1-URGENT": "now"})[1].alias("v")))
query("cat_less", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda t: t.orders.where(_cat.less(C("o_orderpriority"), "3-MEDIUM")).select("o_orderkey"))
query("cat_counts", "SELECT c AS category, (SELECT count(*) FROM orders WHERE o_orderpriority = c) AS count FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', 'none', 'new']) AS c)", lambda t: _cat.add_categories("new").counts(t.orders, "o_orderpriority"))
query("cat_remove_unused", "SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS category", lambda t: t.spark.createDataFrame([(c,) for c in _cat.remove_unused(t.orders, "o_orderpriority").categories], "category string"))
query("cat_categories", "SELECT DISTINCT o_orderstatus AS category FROM orders", lambda t: t.spark.createDataFrame([(c,) for c in values.Categorical.of(t.orders, "o_orderstatus").categories], "category string"))

query("kinds", "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS \"column\", unnest(['integer', 'string', 'integer', 'float', 'string']) AS kind", lambda t: values.kinds(t.customer).select("column", "kind"))
query("memory_usage", "SELECT 'n_nationkey' AS \"column\", count(*) * 4 AS bytes FROM nation UNION ALL SELECT 'n_name', sum(octet_length(encode(n_name)))::BIGINT FROM nation", lambda t: values.memory_usage(t.nation, ["n_nationkey", "n_name"]))
query("infer_objects", "SELECT c_custkey AS a, c_acctbal AS b, c_name AS c FROM customer", lambda t: files.infer(t.customer.selectExpr("cast(c_custkey as string) a", "cast(c_acctbal as string) b", "c_name c")))
query("csv_options", "SELECT n_nationkey AS k, CASE WHEN n_name = 'CHINA' THEN NULL ELSE n_name END AS n, n_regionkey AS r FROM nation WHERE n_nationkey <> 0", lambda t: files.read_csv(t.spark, _trip(t, t.nation.where("n_nationkey <> 0").toDF("k", "n", "r").coalesce(1), "csv", header=True), dtype="k int, n string, r int", na_values=["CHINA"], header=True))
