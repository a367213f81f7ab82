"""Queries of selection, joins, aggregation, shape, missing data and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lariat.operators import aggregate, missing, quality, relational, reshape
from lariat.operators.aggregate import GroupBy
from lariat.operators.order import shared_folder
from lariat.plans.lazy import LazyFrame
from lariat.plans.registry import Tables, query
from lariat.sources import files

L = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def six(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _folder(t: Tables) -> str:
    """A folder for round trips, under the session's shared one."""
    return f"{shared_folder(t.spark)}/roundtrip-{t.spark.sparkContext.applicationId}"


def _trip(t: Tables, df, kind: str, **more):
    path = f"{_folder(t)}/{kind}-{df.schema.fieldNames()[0]}"
    files.write(df, path, kind, "overwrite", **more)
    return path


ALL_N = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders", lambda t: files.read_parquet(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"]))
query("csv_roundtrip", ALL_N, lambda t: files.read_csv(t.spark, _trip(t, t.nation, "csv", header=True), dtype="n_nationkey int, n_name string, n_regionkey int"))
query("json_roundtrip", ALL_N, lambda t: files.read_json(t.spark, _trip(t, t.nation, "json"), schema="n_nationkey int, n_name string, n_regionkey int"))
query("orc_roundtrip", ALL_N, lambda t: files.read_orc(t.spark, _trip(t, t.nation, "orc")))
query("xml_roundtrip", ALL_N, lambda t: files.read_xml(t.spark, _trip(t, t.nation, "xml", rowTag="n"), "n").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int")))
query("select_columns", "SELECT c_name, c_acctbal FROM customer", lambda t: t.customer.select("c_name", "c_acctbal"))
query("filter_mask", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'", lambda t: t.orders.where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O")).select("o_orderkey"))
query("query_expr", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 30 AND (p_retailprice / 2 > 500 OR p_brand IN ('Brand#11', 'Brand#12'))",
      lambda t: relational.query(t.part, "10 < p_size <= @top and (p_retailprice / 2 > 500 or p_brand in ['Brand#11', 'Brand#12'])", top=30).select("p_partkey"))
query("eval_expr", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
      lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(relational.expression("l_extendedprice * (1 - l_discount)"), 4).alias("net")))
query("assign", "SELECT *, s_acctbal * 2 AS twice FROM supplier", lambda t: t.supplier.withColumn("twice", F.col("s_acctbal") * 2))
query("where_mask", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS c_acctbal FROM customer", lambda t: relational.where(t.customer, ["c_acctbal"], F.col("c_acctbal") > 0, 0.0).select("c_custkey", "c_acctbal"))
query("mask", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer", lambda t: relational.where(t.customer, ["c_acctbal"], F.col("c_acctbal") >= 0).select("c_custkey", "c_acctbal"))
query("isin", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS hit FROM customer", lambda t: t.customer.select("c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("hit")))
query("between", "SELECT p_partkey, p_size BETWEEN 5 AND 15 AS hit FROM part", lambda t: t.part.select("p_partkey", F.col("p_size").between(5, 15).alias("hit")))
query("select_dtypes", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer", lambda t: relational.select_dtypes(t.customer, ["number"]))
query("slice_rows", "SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 100", lambda t: relational.slice_rows(t.events, ["event_id"], 100, 150).select("event_id"))
query("sample", "SELECT * FROM orders WHERE substr(md5('7|' || o_orderkey), 1, 8) < '19999999'", lambda t: relational.sample(t.orders, 0.1, 7, ["o_orderkey"]))

_J = "FROM customer JOIN orders ON c_custkey = o_custkey"
query("merge_inner", f"SELECT c_custkey, o_orderkey, o_totalprice {_J}", lambda t: relational.merge(t.customer, t.orders, left_on=["c_custkey"], right_on=["o_custkey"]).select("c_custkey", "o_orderkey", "o_totalprice"))
for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    query(f"merge_{_how}", f"SELECT s_suppkey, p_partkey FROM supplier {_sql} JOIN part ON s_nationkey = p_size",
          lambda t, how=_how: relational.merge(t.supplier, t.part, how=how, left_on=["s_nationkey"], right_on=["p_size"]).select("s_suppkey", "p_partkey"))
query("merge_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", lambda t: relational.merge(t.region, t.nation, how="cross").select("r_name", "n_name"))
query("merge_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", lambda t: relational.merge(t.customer, t.orders.where("o_totalprice > 200000"), how="semi", left_on=["c_custkey"], right_on=["o_custkey"]).select("c_custkey"))
query("merge_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", lambda t: relational.merge(t.customer, t.orders, how="anti", left_on=["c_custkey"], right_on=["o_custkey"]).select("c_custkey"))
_ab = lambda t: (t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_tax").alias("v")), t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("v")))
query("merge_multi_key", "SELECT a.l_orderkey, a.l_linenumber, a.l_tax AS v_x, b.l_discount AS v_y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
      lambda t: relational.merge(*_ab(t), on=["l_orderkey", "l_linenumber"]))
query("merge_suffixes", "SELECT a.n_regionkey, a.n_name AS n_name_l, b.n_name AS n_name_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
      lambda t: relational.merge(t.nation.drop("n_nationkey"), t.nation.drop("n_nationkey"), on=["n_regionkey"], suffixes=("_l", "_r")))
query("merge_indicator", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS _merge FROM (SELECT DISTINCT c_nationkey + 5 AS k FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k",
      lambda t: relational.merge(t.customer.select((F.col("c_nationkey") + 5).alias("k")).distinct(), t.supplier.select(F.col("s_nationkey").alias("k")).distinct(), on=["k"], how="outer", indicator=True))
query("concat_rows", "SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
      lambda t: relational.concat([t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))]))
query("combine_first", "SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, s_acctbal) AS v FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
      lambda t: relational.combine_first(t.customer.selectExpr("c_custkey k", "case when c_acctbal > 0 then c_acctbal end v"), t.supplier.selectExpr("s_suppkey k", "s_acctbal v"), ["k"]))
query("compare", "SELECT p_partkey, p_size AS p_size_self, least(p_size, 20) AS p_size_other FROM part WHERE p_size <> least(p_size, 20)",
      lambda t: relational.compare(t.part, t.part.withColumn("p_size", F.least("p_size", F.lit(20))), ["p_partkey"], ["p_size"]))
_ASOF = "SELECT a.event_id, b.event_id AS event_id_right FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON {by}a.ts {op} b.ts"
_two = lambda t: (t.events.where("event_type = 'click'").select("event_id", "user_id", "ts"), t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"))
for _name, _op in (("backward", ">="), ("forward", "<=")):
    query(f"merge_asof_{_name}", _ASOF.format(by="", op=_op), lambda t, d=_name: relational.merge_asof(_two(t)[0], _two(t)[1].drop("user_id"), "ts", direction=d).select("event_id", "event_id_right"))
query("merge_asof_nearest", """WITH a AS (SELECT event_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'),
 x AS (SELECT a.event_id, a.ts, b.event_id AS e1, b.ts AS t1 FROM a ASOF LEFT JOIN b ON a.ts >= b.ts), y AS (SELECT a.event_id, b.event_id AS e2, b.ts AS t2 FROM a ASOF LEFT JOIN b ON a.ts <= b.ts)
 SELECT event_id, CASE WHEN t1 IS NULL THEN e2 WHEN t2 IS NULL THEN e1 WHEN ts - t1 <= t2 - ts THEN e1 ELSE e2 END AS event_id_right FROM x JOIN y USING (event_id)""",
      lambda t: relational.merge_asof(_two(t)[0], _two(t)[1].drop("user_id"), "ts", direction="nearest").select("event_id", "event_id_right"))
query("merge_asof_by", _ASOF.format(by="a.user_id = b.user_id AND ", op=">="), lambda t: relational.merge_asof(*_two(t), "ts", ["user_id"]).select("event_id", "event_id_right"))
query("merge_asof_tolerance", "SELECT event_id, CASE WHEN epoch(ts) - epoch(t1) <= 3600 THEN e1 END AS event_id_right FROM (SELECT a.event_id, a.ts, b.event_id AS e1, b.ts AS t1 FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.ts >= b.ts)",
      lambda t: relational.merge_asof(_two(t)[0], _two(t)[1].drop("user_id"), "ts", tolerance=F.lit(3600)).select("event_id", "event_id_right"))

_RED = {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(v)", "std": "stddev_samp(v)", "var": "var_samp(v)", "median": "median(v)", "sem": "stddev_samp(v) / sqrt(count(v))", "nunique": "count(DISTINCT v)", "skew": "skewness(v)", "kurt": "kurtosis(v)"}
_r = lambda x, k: x if k in ("count", "nunique", "min", "max") else f"round({x}, 6)"
query("reduce_all", "SELECT " + ", ".join(f"{_r(x, k)} AS v_{k}" for k, x in _RED.items()) + " FROM (SELECT l_quantity AS v FROM lineitem)",
      lambda t: six(aggregate.reduce(t.lineitem.select(F.col("l_quantity").alias("v")), ["v"], list(_RED)), *(f"v_{k}" for k in _RED if k not in ("count", "nunique", "min", "max"))))
query("reduce_prod", "SELECT round(product(1 + l_discount / 100000), 6) AS v_prod FROM lineitem", lambda t: six(aggregate.reduce(t.lineitem.select((1 + F.col("l_discount") / 100000).alias("v")), ["v"], ["prod"]), "v_prod"))
query("mad", "SELECT round(avg(abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders))), 4) AS o_totalprice_mad FROM orders", lambda t: aggregate.mad(t.orders, "o_totalprice").withColumn("o_totalprice_mad", F.round("o_totalprice_mad", 4)))
query("quantile", "SELECT round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders", lambda t: aggregate.quantile(t.orders, {"q25": ("o_totalprice", 0.25), "q90": ("o_totalprice", 0.9)}).select(F.round("q25", 4).alias("q25"), F.round("q90", 4).alias("q90")))
_D = (("count", "count(p_retailprice)::DOUBLE"), ("mean", "avg(p_retailprice)"), ("std", "stddev_samp(p_retailprice)"), ("min", "min(p_retailprice)"), ("25%", "quantile_cont(p_retailprice, 0.25)"), ("50%", "quantile_cont(p_retailprice, 0.5)"), ("75%", "quantile_cont(p_retailprice, 0.75)"), ("max", "max(p_retailprice)"))
query("describe", " UNION ALL ".join(f"SELECT '{n}' AS stat, round({x}, 4) AS p_retailprice FROM part" for n, x in _D), lambda t: aggregate.describe(t.part, ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 4)))
query("value_counts", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1", lambda t: aggregate.value_counts(t.customer, ["c_mktsegment"]))
query("value_counts_normalize", "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM events GROUP BY 1", lambda t: six(aggregate.value_counts(t.events, ["event_type"], normalize=True), "proportion"))
query("mode", "SELECT p_size FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size))", lambda t: aggregate.mode(t.part, "p_size"))
_P = [(a, b) for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")]
for _k, _f in (("corr", "corr"), ("cov", "covar_samp")):
    query(_k, " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({_f}({a}, {b}), 4) AS value FROM lineitem" for a, b in _P),
          lambda t, k=_k: aggregate.pairwise(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "cov" if k == "cov" else "pearson").withColumn("value", F.round("value", 4)))
query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT 'p_size' AS x, 'p_size' AS y, 1.0::DOUBLE AS value UNION ALL SELECT 'p_size', 'p_retailprice', round(corr(a, b), 6) FROM r UNION ALL SELECT 'p_retailprice', 'p_size', round(corr(a, b), 6) FROM r UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0",
      lambda t: six(aggregate.pairwise(t.part, ["p_size", "p_retailprice"], "spearman"), "value"))
query("idxmax", "SELECT min(o_orderkey) AS idxmax FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)", lambda t: aggregate.idx(t.orders, "o_totalprice", "o_orderkey"))
query("idxmin", "SELECT min(o_orderkey) AS idxmin FROM orders WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders)", lambda t: aggregate.idx(t.orders, "o_totalprice", "o_orderkey", most=False))

_g = lambda t: GroupBy(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
_GD = {"mean": 6, "median": 6, "var": 0}
for _k, _x in _RED.items():
    _exact = _k in ("count", "nunique", "min", "max")
    query(f"groupby_{_k}", f"SELECT o_custkey, {_x.replace('(v)', '(o_totalprice)').replace('DISTINCT v', 'DISTINCT o_totalprice') if _exact else 'round(' + _x.replace('(v)', '(o_totalprice)') + f', {_GD.get(_k, 3)})'} AS o_totalprice_{_k} FROM orders GROUP BY 1" + (" HAVING count(*) > 3" if _k in ("skew", "kurt") else ""),
          lambda t, k=_k, e=_exact: (lambda out: out if e else out.withColumn(f"o_totalprice_{k}", F.round(f"o_totalprice_{k}", _GD.get(k, 3))))((lambda g: GroupBy(g.filter("o_orderkey", "count", lambda n: n > 3), ["o_custkey"]) if k in ("skew", "kurt") else g)(_g(t)).reduce(k, "o_totalprice")))
query("groupby_prod", "SELECT l_returnflag, round(product(1 + l_tax / 100000), 6) AS v_prod FROM lineitem GROUP BY 1", lambda t: six(GroupBy(t.lineitem.withColumn("v", 1 + F.col("l_tax") / 100000), ["l_returnflag"]).reduce("prod", "v"), "v_prod"))
query("groupby_mad", "SELECT o_orderstatus, round(avg(abs(o_totalprice - m)), 3) AS o_totalprice_mad FROM orders JOIN (SELECT o_orderstatus AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_orderstatus = s GROUP BY 1", lambda t: GroupBy(t.orders, ["o_orderstatus"]).reduce("mad", "o_totalprice").withColumn("o_totalprice_mad", F.round("o_totalprice_mad", 3)))
query("groupby_first", "SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice_first FROM orders GROUP BY 1", lambda t: _g(t).reduce("first", "o_totalprice"))
query("groupby_last", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice_last FROM orders GROUP BY 1", lambda t: _g(t).reduce("last", "o_totalprice"))
_N = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS m FROM orders)"
for _k, _c, _f in (("nth", "n = 2", lambda g: g.nth(1)), ("head", "n <= 3", lambda g: g.head(3)), ("tail", "m <= 2", lambda g: g.tail(2))):
    query(f"groupby_{_k}", f"SELECT o_custkey, o_orderkey FROM {_N} WHERE {_c}", lambda t, f=_f: f(_g(t)).select("o_custkey", "o_orderkey"))
query("groupby_size", "SELECT o_orderpriority, o_orderstatus, count(*) AS size FROM orders GROUP BY ALL", lambda t: GroupBy(t.orders, ["o_orderpriority", "o_orderstatus"]).size())
query("groupby_quantile", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.8), 4) AS o_totalprice_quantile FROM orders GROUP BY 1", lambda t: GroupBy(t.orders, ["o_orderstatus"]).quantile("o_totalprice", 0.8).withColumn("o_totalprice_quantile", F.round("o_totalprice_quantile", 4)))
query("groupby_describe", "SELECT p_brand, count(p_size) AS p_size_count, round(avg(p_size), 6) AS p_size_mean, round(stddev_samp(p_size), 6) AS p_size_std, min(p_size) AS p_size_min, quantile_cont(p_size, 0.25) AS p_size_q25, quantile_cont(p_size, 0.5) AS p_size_q50, quantile_cont(p_size, 0.75) AS p_size_q75, max(p_size) AS p_size_max FROM part GROUP BY 1",
      lambda t: six(GroupBy(t.part, ["p_brand"]).describe("p_size"), "p_size_mean", "p_size_std"))
query("groupby_agg_multi", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, round(sum(revenue), 2) AS revenue_sum, count(l_orderkey) AS l_orderkey_count FROM (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02') GROUP BY ALL",
      lambda t: GroupBy(t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount"))), ["l_returnflag", "l_linestatus"]).agg({"l_quantity": ["sum", "mean"], "revenue": "sum", "l_orderkey": "count"}).withColumns({"l_quantity_sum": F.round("l_quantity_sum", 2), "l_quantity_mean": F.round("l_quantity_mean", 6), "revenue_sum": F.round("revenue_sum", 2)}))
query("groupby_corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1", lambda t: six(GroupBy(t.lineitem, ["l_returnflag"]).corr("l_quantity", "l_extendedprice"), "corr"))
query("groupby_cov", "SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov FROM lineitem GROUP BY 1", lambda t: GroupBy(t.lineitem, ["l_returnflag"]).cov("l_quantity", "l_extendedprice").withColumn("cov", F.round("cov", 3)))
query("groupby_idxmax", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS idxmax FROM orders GROUP BY 1", lambda t: _g(t).idxmax("o_totalprice", "o_orderkey"))
query("groupby_idxmin", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS idxmin FROM orders GROUP BY 1", lambda t: _g(t).idxmin("o_totalprice", "o_orderkey"))
query("groupby_ngroup", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS ngroup FROM orders", lambda t: _g(t).ngroup().select("o_orderkey", "ngroup"))
query("groupby_get_group", "SELECT o_orderkey FROM orders WHERE o_custkey = 7", lambda t: _g(t).get_group(7).select("o_orderkey"))
query("groupby_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000)", lambda t: _g(t).filter("o_totalprice", "sum", lambda v: v > 1000000).select("o_orderkey"))
query("groupby_transform", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS centred FROM orders", lambda t: _g(t).transform("o_totalprice", "mean").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("o_totalprice_mean"), 6).alias("centred")))


def _spread(x):
    v = x.groupby("o_custkey")["o_totalprice"]
    return (v.max() - v.min()).map(lambda d: round(float(d), 4)).rename("spread").reset_index()


query("groupby_apply", "SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY 1", lambda t: GroupBy(t.orders.select("o_custkey", "o_totalprice"), ["o_custkey"]).apply(_spread, "o_custkey bigint, spread double", many=True))

_LO = "ORDER BY " + ", ".join(L)
query("sort_values", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey DESC", lambda t: relational.sort_values(t.orders, ["o_custkey", "-o_orderkey"]).select("o_orderkey", "o_custkey"))
query("nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda t: relational.nlargest(t.orders, 10, "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_totalprice"))
query("nsmallest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10", lambda t: relational.nsmallest(t.orders, 10, "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_totalprice"))
query("head", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 5", lambda t: relational.head(t.events, 5, ["ts", "event_id"]).select("event_id"))
query("tail", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5", lambda t: relational.tail(t.events, 5, ["ts", "event_id"]).select("event_id"))
for _k, _c in (("first", "n = 1"), ("last", "m = 1"), ("none", "c = 1")):
    query(f"drop_duplicates_{_k}", f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS m, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS c FROM orders) WHERE {_c}",
          lambda t, k=_k: relational.drop_duplicates(t.orders, ["o_custkey", "o_orderstatus"], ["o_orderkey"], k).select("o_orderkey"))
query("duplicated", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS duplicated FROM orders", lambda t: relational.duplicated(t.orders, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "duplicated"))
_I = {"union": "SELECT c_nationkey + 3 AS k FROM customer UNION SELECT s_nationkey FROM supplier", "intersection": "SELECT c_nationkey + 3 AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "difference": "SELECT c_nationkey + 3 AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier"}
_I["symmetric_difference"] = f"({_I['union']}) EXCEPT ({_I['intersection']})"
for _k, _s in _I.items():
    query(f"index_{_k}", _s, lambda t, k=_k: relational.index_op(t.customer.select((F.col("c_nationkey") + 3).alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), "k", k))

query("melt", "SELECT s_suppkey, unnest(['s_nationkey', 's_acctbal']) AS variable, unnest([s_nationkey::DOUBLE, s_acctbal]) AS value FROM supplier", lambda t: reshape.melt(t.supplier.withColumn("s_nationkey", F.col("s_nationkey").cast("double")), ["s_suppkey"], ["s_nationkey", "s_acctbal"]))
_flags = ["A", "N", "R"]
_PT = lambda fn, cast="": ", ".join(f"{fn} FILTER (l_returnflag = '{v}') AS \"{v}\"" for v in _flags)
query("pivot", "SELECT l_linestatus, " + _PT("max(n)") + " FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1", lambda t: reshape.pivot(t.lineitem.groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n")), ["l_linestatus"], "l_returnflag", "n", _flags))
query("pivot_table", "SELECT l_linenumber, " + ", ".join(f"round(avg(l_quantity) FILTER (l_returnflag = '{v}'), 6) AS \"{v}\"" for v in _flags) + " FROM lineitem GROUP BY 1", lambda t: six(reshape.pivot_table(t.lineitem, ["l_linenumber"], "l_returnflag", "l_quantity"), *_flags))
query("pivot_table_margins", "SELECT coalesce(l_linestatus, 'All') AS l_linestatus, " + ", ".join(f"round(sum(l_quantity) FILTER (l_returnflag = '{v}'), 2) AS \"{v}\"" for v in _flags) + ", round(sum(l_quantity), 2) AS \"All\" FROM lineitem GROUP BY ROLLUP (l_linestatus)",
      lambda t: reshape.pivot_table(t.lineitem, ["l_linestatus"], "l_returnflag", "l_quantity", "sum", margins=True, names=_flags).withColumns({c: F.round(c, 2) for c in [*_flags, "All"]}))
query("stack", "SELECT * FROM (SELECT c_custkey, unnest(['a', 'b']) AS level, unnest([CASE WHEN c_acctbal > 0 THEN c_acctbal END, c_nationkey::DOUBLE]) AS value FROM customer) WHERE value IS NOT NULL",
      lambda t: reshape.stack(t.customer.selectExpr("c_custkey", "case when c_acctbal > 0 then c_acctbal end a", "cast(c_nationkey as double) b"), ["c_custkey"], ["a", "b"]))
query("unstack", "SELECT o_orderstatus, " + ", ".join(f"sum(CASE WHEN o_orderpriority LIKE '{i}%' THEN 1 END)::BIGINT AS \"{i}\"" for i in "12345") + " FROM orders GROUP BY 1",
      lambda t: reshape.unstack(t.orders.groupBy("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count("*").alias("n")), ["o_orderstatus"], "p", "n"))
query("crosstab", "SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (l_returnflag = '{v}') AS \"{v}\"" for v in _flags) + " FROM lineitem GROUP BY 1", lambda t: reshape.crosstab(t.lineitem, "l_linestatus", "l_returnflag"))
query("crosstab_normalize", "SELECT l_linestatus, " + ", ".join(f"round(count(*) FILTER (l_returnflag = '{v}') / count(*), 6) AS \"{v}\"" for v in _flags) + " FROM lineitem GROUP BY 1", lambda t: six(reshape.crosstab(t.lineitem, "l_linestatus", "l_returnflag", "index"), *_flags))
query("explode", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part", lambda t: reshape.explode(t.part.select("p_partkey", F.split("p_type", " ").alias("word")), "word"))
query("wide_to_long", "SELECT s_suppkey, unnest([1, 2]) AS j, unnest([s_acctbal, s_acctbal * 2]) AS bal, unnest([s_nationkey, s_nationkey + 1]) AS nat FROM supplier",
      lambda t: reshape.wide_to_long(t.supplier.selectExpr("s_suppkey", "s_acctbal bal_1", "s_acctbal * 2 bal_2", "s_nationkey nat_1", "s_nationkey + 1 nat_2"), ["bal", "nat"], ["s_suppkey"], [1, 2], "j"))
query("transpose", "SELECT 'r_regionkey' AS \"column\", " + ", ".join(f"max(r_regionkey::DOUBLE) FILTER (r_name = '{n}') AS \"{n}\"" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM region", lambda t: reshape.transpose(t.region, "r_name", ["r_regionkey"]))
query("get_dummies", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS o_orderstatus_{v}" for v in "FOP") + " FROM orders", lambda t: reshape.get_dummies(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", list("FOP")))
query("cut", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'low' WHEN p_size > 10 AND p_size <= 25 THEN 'mid' WHEN p_size > 25 AND p_size <= 40 THEN 'high' END AS bin FROM part", lambda t: t.part.select("p_partkey", reshape.cut(F.col("p_size"), [0, 10, 25, 40], ["low", "mid", "high"]).alias("bin")))
query("qcut", "WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.5) b, quantile_cont(o_totalprice, 0.75) c FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END AS bin FROM orders, e", lambda t: reshape.qcut(t.orders, "o_totalprice", 4).select("o_orderkey", "bin"))
query("factorize", "SELECT o_orderkey, dense_rank() OVER (ORDER BY f) - 1 AS code FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS f FROM orders)", lambda t: reshape.factorize(t.orders, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "code"))

_null = lambda t: t.events.withColumn("v", F.when(F.col("value") >= 30, F.col("value")))
_NULL = "(SELECT *, CASE WHEN value >= 30 THEN value END AS v FROM events)"
query("fillna", f"SELECT event_id, coalesce(v, 0.0) AS v FROM {_NULL}", lambda t: missing.fillna(_null(t), {"v": 0.0}).select("event_id", "v"))
query("dropna", f"SELECT event_id FROM {_NULL} WHERE v IS NOT NULL", lambda t: missing.dropna(_null(t), ["v"]).select("event_id"))
query("dropna_thresh", f"SELECT event_id FROM (SELECT event_id, v, CASE WHEN user_id > 20 THEN user_id END AS u FROM {_NULL}) WHERE (event_id IS NOT NULL)::INT + (v IS NOT NULL)::INT + (u IS NOT NULL)::INT >= 2", lambda t: missing.dropna(_null(t).select("event_id", "v", F.when(F.col("user_id") > 20, F.col("user_id")).alias("u")), thresh=2).select("event_id"))
query("isna", f"SELECT event_id, v IS NULL AS v_isna FROM {_NULL}", lambda t: missing.isna(_null(t), ["v"]).select("event_id", "v_isna"))
query("replace_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS s FROM orders", lambda t: t.orders.select("o_orderkey", missing.replace_map(F.col("o_orderstatus"), {"F": "done", "O": "open"}).alias("s")))
query("clip", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS c FROM customer", lambda t: t.customer.select("c_custkey", missing.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("c")))
query("astype", "SELECT o_orderkey::VARCHAR AS k, o_totalprice::BIGINT AS p FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)", lambda t: t.orders.select(F.col("o_orderkey").cast("string").alias("k"), F.floor("o_totalprice").cast("bigint").alias("p")))
query("to_numeric", "SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS n, try_cast(p_type AS DOUBLE) AS bad FROM part", lambda t: t.part.select("p_partkey", missing.to_numeric(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("n"), missing.to_numeric(F.col("p_type")).alias("bad")))

_num = lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, count(DISTINCT {c}) AS \"unique\" FROM customer"
query("profile", f"{_num('c_custkey')} UNION ALL {_num('c_acctbal')}", lambda t: quality.profile(t.customer.select("c_custkey", "c_acctbal")).select("column", "count", F.round("mean", 4).alias("mean"), "unique"))
query("validate", "SELECT 'c_acctbal' AS \"column\", 'min' AS rule, count(*) FILTER (c_acctbal < 0) AS violations FROM customer", lambda t: quality.validate(t.customer, {"c_acctbal": {"min": 0, "dtype": "double"}, "c_custkey": {"non_null": True}}))
query("detect_outliers_iqr", "WITH s AS (SELECT o_totalprice v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), q AS (SELECT max(v) FILTER (i = n // 4) AS a, max(v) FILTER (i = 3 * n // 4) AS b FROM s) SELECT o_orderkey, o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a) AS o_totalprice_outlier FROM orders, q", lambda t: quality.detect_outliers(t.orders, ["o_totalprice"]).select("o_orderkey", "o_totalprice_outlier"))
query("detect_outliers_zscore", "SELECT o_orderkey, abs((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()) > 2 AS o_totalprice_outlier FROM orders", lambda t: quality.detect_outliers(t.orders, ["o_totalprice"], "zscore").select("o_orderkey", "o_totalprice_outlier"))
query("normalize_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part", lambda t: six(quality.normalize(t.part, ["p_retailprice"]), "p_retailprice").select("p_partkey", "p_retailprice"))
query("normalize_zscore", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part", lambda t: six(quality.normalize(t.part, ["p_retailprice"], "zscore"), "p_retailprice").select("p_partkey", "p_retailprice"))
query("normalize_robust", "WITH s AS (SELECT p_retailprice v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), q AS (SELECT max(v) FILTER (i = n // 4) AS a, max(v) FILTER (i = n // 2) AS m, max(v) FILTER (i = 3 * n // 4) AS b FROM s) SELECT p_partkey, round((p_retailprice - m) / (b - a), 6) AS p_retailprice FROM part, q", lambda t: six(quality.normalize(t.part, ["p_retailprice"], "robust"), "p_retailprice").select("p_partkey", "p_retailprice"))
query("standardize_names", "SELECT r_regionkey AS region_key, r_name AS region_name FROM region", lambda t: quality.standardize_names(t.region.toDF(" Region Key", "Region--Name ")))
query("clean", "SELECT DISTINCT n_regionkey AS n_regionkey FROM nation", lambda t: quality.clean(t.nation.select("n_regionkey")))
query("lazy_chain", "SELECT l_returnflag, round(sum(l_quantity * 2), 2) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY 1", lambda t: LazyFrame(t.lineitem).filter("l_quantity > 10").with_column("twice", "l_quantity * 2").groupby("l_returnflag").agg(total=("twice", "sum")).with_column("total", F.round("total", 2)).collect())
