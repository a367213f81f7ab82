from __future__ import annotations

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lariat.functions import datetimes, values
from lariat.operators import aggregate, labels, missing, quality, relational, reshape, windows
from lariat.operators import order as order_module
from lariat.operators.order import numbered, over, running
from lariat.sources import files
from lariat.streaming import events


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(1, 3.0, "a"), (2, None, "a"), (3, 2.0, None), (4, 1.0, "b"), (5, 3.0, "b")], "i int, v double, g string")


def col(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.orderBy("i").select(*names).collect()]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_blocks_do_not_change_results(five, size):
    assert sorted(r[0] for r in numbered(five, ["-i"]).select("__pos").collect()) == [0, 1, 2, 3, 4]
    got = over(five, {"x": lambda w: F.lag("v", 2).over(w), "y": lambda w: F.lead("i").over(w)}, ["i"], before=2, after=1, size=size)
    assert col(got, "x", "y") == [(None, 2), (None, 3), (3.0, 4), (None, 5), (2.0, None)]
    made = {"s": ("sum", "v"), "n": ("count", "v"), "m": ("max", "v"), "l": ("last", "v"), "f": ("first", "v"), "p": ("prod", "v"), "k": ("min", "v")}
    got = running(five, made, ["i"], size=size)
    assert col(got, "s", "n", "l", "p", "k") == [(3.0, 1, 3.0, 3.0, 3.0), (3.0, 1, 3.0, 3.0, 3.0), (5.0, 2, 2.0, 6.0, 2.0), (6.0, 3, 1.0, 6.0, 1.0), (9.0, 4, 3.0, 18.0, 1.0)]


def test_ranks_with_ties_and_nulls(five):
    want = {"average": [3.5, None, 2, 1, 3.5], "min": [3, None, 2, 1, 3], "max": [4, None, 2, 1, 4], "dense": [3, None, 2, 1, 3], "first": [3, None, 2, 1, 4]}
    for method, ranks in want.items():
        assert col(windows.rank(five, "v", method, order=["i"]), "rank") == ranks
    assert col(windows.rank(five, "v", "min", ascending=False), "rank") == [1, None, 3, 4, 1]


def test_windows(spark, five):
    n = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "i int, v double")
    assert col(windows.rolling(n, "v", 3, "sum", ["i"], name="x"), "x") == [None, None, 6, 9, 12]
    assert col(windows.expanding(n.where("i < 4"), "v", "sum", ["i"], name="x"), "x") == [1, 3, 6]
    assert col(windows.ewm(n.where("i < 4"), "v", 0.5, "mean", ["i"], adjust=False, name="x"), "x") == [1, 1.5, 2.25]
    assert col(windows.fill(five, "v", ["i"]), "v") == [3, 3, 2, 1, 3]
    assert col(windows.fill(five, "v", ["i"], back=True), "v") == [3, 2, 2, 1, 3]
    assert col(missing.interpolate(five, "v", ["i"]), "v") == [3, 2.5, 2, 1, 3]
    assert windows.cumulative(five.limit(0), "v", "sum", ["i"]).collect() == []


def test_groups_leave_out_missing_keys(five):
    g = aggregate.GroupBy(five, ["g"], ["i"])
    assert sorted(tuple(r) for r in g.reduce("sum", "v").collect()) == [("a", 3.0), ("b", 4.0)]
    assert sorted(tuple(r) for r in g.reduce("last", "v").collect()) == [("a", 3.0), ("b", 3.0)]


def test_merge(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", 10), ("x", 20), (None, 30), ("y", 40)], "k string, v int")
    assert sorted(tuple(r) for r in relational.merge(a, b, ["k"]).collect()) == [("x", 1, 10), ("x", 1, 20), ("x", 2, 10), ("x", 2, 20)]
    out = relational.merge(a, b, ["k"], "outer", indicator=True)
    assert out.columns == ["k", "v_x", "v_y", "_merge"] and out.where("_merge = 'right_only'").count() == 2
    with pytest.raises(ValueError):
        relational.merge(a, b, ["k"], validate="1:m")


def test_expressions_run_no_code(five):
    for bad in ("__import__('os')", "v.real", "(lambda: 1)()", "[x for x in v]"):
        with pytest.raises((ValueError, SyntaxError)):
            relational.expression(bad)
    assert relational.query(five, "not (v > 1) and g in @gs", gs=["b"]).count() == 1


def test_pivots(spark, five):
    wide = reshape.pivot(five.where("v is not null and g is not null"), ["i"], "g", "v")
    assert col(wide, "a", "b") == [(3.0, None), (None, 1.0), (None, 3.0)]
    with pytest.raises(ValueError):
        reshape.pivot(five.withColumn("j", F.lit(1)), ["j"], "g", "v")
    back = reshape.stack(wide, ["i"], ["a", "b"])
    assert col(back, "i", "level", "value") == [(1, "a", 3.0), (4, "b", 1.0), (5, "b", 3.0)]


def test_quality(five):
    assert [tuple(r) for r in quality.validate(five, {"v": {"non_null": True, "max": 2.5}, "i": {"dtype": "string"}}).collect()] == [("v", "non_null", 1), ("v", "max", 2), ("i", "dtype", 1)]
    assert quality.clean(five.toDF("A b", "A  b", "C")).columns == ["a_b", "a_b_2", "c"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    made = {"n": F.count("*")}
    steps = events.Pipeline().filter("value > 10").map(lambda d: events.windowed(d, "ts", "1 day", made, ["event_type"]))
    got = steps.collect(events.read(spark, str(tmp_path / "in")), "days", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps(batch).collect()))


def test_missing_and_odd_values(spark, five):
    at = spark.createDataFrame([("a@b", 1), (None, 2), ("c", 3)], "k string, i int")
    assert col(relational.query(at, "k == 'a@b'"), "i") == [1]
    assert col(relational.query(at, "k not in ['c'] and i < @top", top=3), "i") == [1, 2]
    g = aggregate.GroupBy(five, ["g"], ["i"], dropna=False)
    assert col(g.transform("i", "count", "n"), "n") == [2, 2, 1, 2, 2] and g.filter("i", "count", lambda n: n == 1).count() == 1
    assert col(g.ngroup(), "ngroup") == [0, 0, 2, 1, 1] and g.reduce("mad", "v").count() == 3
    assert aggregate.idx(five.where("g is not null"), "g", "i").first()[0] == 4 and aggregate.idx(five, "v", "i").first()[0] == 1
    assert aggregate.idx(five, "v", "i", most=False).first()[0] == 4
    with pytest.raises(ValueError):
        reshape.transpose(spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int"), "k", ["v"])
    text = reshape.transpose(spark.createDataFrame([("x", "1"), ("y", "2")], "k string, v string"), "k", ["v"]).first()
    assert (text.x, text.y) == ("1", "2")
    for keep, want in (("first", [1, 3, 4]), ("last", [2, 3, 5]), ("none", [3])):
        assert col(relational.drop_duplicates(five, ["g"], ["i"], keep), "i") == want
        assert sorted(r.i for r in relational.duplicated(five, ["g"], ["i"], keep).where("not duplicated").collect()) == want
    assert files.to_text(at, "latex").startswith("\\begin{tabular}") and "a@b & 1" in files.to_text(at, "latex")


def test_missing_values_with_sql(spark):
    """Operators on columns with nulls, against SQL on the same rows."""
    rows = [(i, None if i % 4 == 0 else float((i * 37) % 11), None if i % 5 == 0 else "xyz"[i % 3]) for i in range(60)]
    df, sql = spark.createDataFrame(rows, "i int, v double, g string"), duckdb.connect()
    sql.execute("CREATE TABLE t (i INT, v DOUBLE, g VARCHAR)")
    sql.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    for method, x in (("average", "rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0"), ("min", "rank() OVER (ORDER BY v)"), ("dense", "dense_rank() OVER (ORDER BY v)")):
        want = dict(sql.execute(f"SELECT i, ({x})::DOUBLE FROM t WHERE v IS NOT NULL").fetchall())
        assert {r.i: r["rank"] for r in windows.rank(df, "v", method).collect()} == {i: want.get(i) for i, _, _ in rows}
    want = sql.execute("SELECT quantile_cont(v, 0.1), median(v), quantile_cont(v, 0.77) FROM t").fetchone()
    assert aggregate.quantiles(df, "v", [0.1, 0.5, 0.77]) == pytest.approx(want)
    want = sorted(sql.execute("SELECT i, count(*) OVER (PARTITION BY g) FROM t").fetchall())
    assert sorted((r.i, r.n) for r in aggregate.GroupBy(df, ["g"], dropna=False).transform("i", "count", "n").collect()) == want


def test_quantiles_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "HELD", 40)
    rnd = random.Random(3)
    for values in ([rnd.gauss(0, 1) for _ in range(5000)], [float(i % 7) for i in range(3000)], [1.0] * 500, [2.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.25, 0.5, 0.993, 1.0):
            assert aggregate.quantiles(df, "v", [q])[0] == pytest.approx(float(np.quantile(values, q)))
    assert aggregate.quantiles(df.where("false"), "v", [0.5]) == [None]


@pytest.mark.parametrize("alpha", [1.0, 0.5, 0.01, 1e-5])
def test_exponential_windows_against_pandas(spark, alpha):
    rnd = random.Random(5)
    rows = [(i, None if i in (0, 7, 8) or rnd.random() < 0.1 else rnd.gauss(100, 5), rnd.gauss(0, 1), "ab"[i % 2]) for i in range(700)]
    df, p = spark.createDataFrame(rows, "i int, v double, u double, g string"), pd.DataFrame(rows, columns=["i", "v", "u", "g"])
    own = p.v.astype(float).ewm(alpha=alpha)
    for size in (50, 200_000):
        for kind in ("mean", "var", "std", "cov", "corr"):
            got = np.array(col(_sized(size, lambda k=kind: windows.ewm(df, "v", alpha, k, ["i"], name="x", other="u" if k in ("cov", "corr") else None)), "x"), float)
            want = getattr(own, kind)(p.u) if kind in ("cov", "corr") else getattr(own, kind)()
            known = p.v.notna().to_numpy() & ~np.isnan(got)
            if alpha < 1 or kind == "mean":
                assert np.allclose(got[known], want.to_numpy()[known], rtol=1e-6, atol=1e-6), (kind, size)
    if alpha == 1:  # nothing is left of the rows before one without a value
        return
    got = col(windows.ewm(df, "v", alpha, "mean", ["i"], ["g"], name="x"), "x")
    want = p.groupby("g").v.transform(lambda x: x.astype(float).ewm(alpha=alpha).mean())
    assert np.allclose(np.array(got, float)[2:], want[2:], equal_nan=True)


def _sized(size, make):
    old, order_module.decayed.__defaults__ = order_module.decayed.__defaults__, ((), size)
    try:
        return make()
    finally:
        order_module.decayed.__defaults__ = old


def test_interpolation_over_blocks(spark):
    rows = [(i, None if i % 7 in (2, 3, 4) or i > 44 else float(i * i), "ab"[i % 2]) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, v double, g string")
    want = pd.Series([r[1] for r in rows], dtype=float).interpolate().tolist()
    old, order_module.around.__defaults__ = order_module.around.__defaults__, ((), order_module.POS, 6)
    try:
        assert col(missing.interpolate(df, "v", ["i"]), "v") == pytest.approx(want)
    finally:
        order_module.around.__defaults__ = old
    by_group = pd.DataFrame(rows, columns=["i", "v", "g"]).groupby("g").v.transform(lambda x: x.astype(float).interpolate())
    got = np.array(col(missing.interpolate(df, "v", ["i"], ["g"]), "v"), float)
    assert np.allclose(got, by_group, equal_nan=True)


def test_joins_that_split_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(order_module, "FEW", 2)
    rows = spark.range(4000).selectExpr("id", "case when id < 2500 then 0 else id end k")
    table = rows.groupBy("k").count().selectExpr("k kk", "count n", "k * 2 twice")
    got = order_module.looked_up(rows, table, "k", "kk", "n")
    assert got.count() == 4000 and got.where("twice <> k * 2").count() == 0


def test_csv_options(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("note\nk,n,b,d\n1,\"1,234\",yes,7\n2,none,no,\n# c\n3,5,yes,9\nend\n")
    got = files.read_csv(spark, str(path), skiprows=1, skipfooter=1, comment="#", na_values=["none"], thousands=",", true_values=["yes"], false_values=["no"], converters={"d": lambda c: c.cast("int") * 2})
    assert got.dtypes == [("k", "bigint"), ("n", "bigint"), ("b", "boolean"), ("d", "int")]
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, 1234, True, 14), (2, None, False, None), (3, 5, True, 18)]
    typed = files.read_csv(spark, str(path), dtype="k int, n string, b string, d double", skiprows=lambda no: no.isin(0, 4, 6), na_values=["none"], nrows=2)
    assert [tuple(r) for r in typed.orderBy("k").collect()] == [(1, "1,234", "yes", 7.0), (2, None, "no", None)]


def test_labels_positions_and_categories(spark, five):
    assert col(labels.iloc(five, ["i"], slice(-3, None)), "i") == [3, 4, 5] and col(labels.iloc(five, ["-i"], [0, -1]), "i") == [1, 5]
    with pytest.raises(ValueError):
        labels.set_index(five, ["g"], verify=True)
    with pytest.raises(ValueError):
        labels.insert(five, 0, "v", 1)
    assert labels.equals(five, five.limit(4)).first()[0] is False and labels.equals(five.limit(0), five.limit(0)).first()[0] is True
    left, right = labels.align(five.select("i", "v"), spark.createDataFrame([(9, "z")], "i int, w string"), "i")
    assert left.columns == right.columns == ["i", "v", "w"] and left.count() == right.count() == 6
    cat = values.Categorical.of(five, "g")
    assert cat.categories == ("a", "b") and col(five.select("i", cat.codes(F.col("g")).alias("c")), "c") == [0, 0, -1, 1, 1]
    with pytest.raises(ValueError):
        cat.less(F.col("g"), "b")
    assert col(five.where(cat.as_ordered().less(F.col("g"), "b")), "i") == [1, 2]
    assert values.is_kind(five, "v", "numeric") and not values.is_kind(five, "g", "numeric")
    tau = aggregate.kendall(five.select("i", F.col("v")), "i", "v").first()[0]
    assert tau == pytest.approx(-1 / (6 * 5) ** 0.5)


def test_offsets(spark):
    dates = spark.createDataFrame([("2024-01-01",), ("2024-12-31",), ("2024-05-17",)], "d string").select(F.to_date("d").alias("d"))
    made = {"ms": datetimes.month_start(F.col("d")), "back": datetimes.month_start(F.col("d"), -1), "ye": datetimes.year_end(F.col("d")), "yb": datetimes.year_end(F.col("d"), -1), "ys": datetimes.year_start(F.col("d")), "yf": datetimes.year_start(F.col("d"), -1)}
    offsets = {"ms": pd.offsets.MonthBegin(1), "back": pd.offsets.MonthBegin(-1), "ye": pd.offsets.YearEnd(1), "yb": pd.offsets.YearEnd(-1), "ys": pd.offsets.YearBegin(1), "yf": pd.offsets.YearBegin(-1)}
    for r in dates.select("d", *(c.alias(k) for k, c in made.items())).collect():
        for k, o in offsets.items():
            assert pd.Timestamp(r[k]) == pd.Timestamp(r.d) + o, (k, r.d)
    got = spark.createDataFrame([("1 days 00:00:10",), ("02:00:00",), ("-1 days",), ("x",), ("",), (None,)], "t string").select(datetimes.to_timedelta(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == [86410, 7200, -86400, None, None, None]


def test_correlation_where_a_side_does_not_vary(spark):
    rows = [(i, "ab"[i > 4], 5.0 if i < 3 else None if i == 3 else float(i * i % 7), i) for i in range(9)]
    df = spark.createDataFrame(rows, "i int, g string, v double, w int")
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i INT, g TEXT, v DOUBLE, w INT)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    same = lambda got, want: np.allclose(np.array(got, float), np.array(want, float), equal_nan=True)
    want = [r[0] for r in c.execute("SELECT corr(v, w) OVER (PARTITION BY g ORDER BY i ROWS 2 PRECEDING) FROM t ORDER BY i").fetchall()]
    for by in (["g"], []):
        got = col(windows.rolling(df.where("g = 'a'") if not by else df, "v", 3, "corr", ["i"], by, min_periods=0, other="w", name="x"), "x")
        assert same(got, want[: len(got)])
    flat = df.withColumn("v", F.lit(1.0))
    assert np.isnan(aggregate.GroupBy(flat, ["g"]).corr("v", "w").first()["corr"])
    assert {r.x + r.y: bool(np.isnan(r.value)) for r in aggregate.pairwise(flat, ["v", "w"]).collect()} == {"vv": True, "vw": True, "wv": True, "ww": False}
    assert np.isnan(aggregate.corrwith(flat, df, ["i"], ["v"]).first()["corr"])
    assert aggregate.GroupBy(df.where("v is null"), ["g"]).corr("v", "w").first()["corr"] is None


def test_interpolation_reads_no_frame_again_for_each_row(spark):
    rows = spark.range(300_000).selectExpr("id i", "id % 1 g", "case when id % 3 = 0 then id * 2.0 end v")
    for by in ([], ["g"]):
        began = time.monotonic()
        got = missing.interpolate(rows, "v", ["i"], by)
        assert got.where("v <> least(i, 299997) * 2.0 or v is null").count() == 0
        assert time.monotonic() - began < 40  # frames read again took over 100 s for 100,000 rows


@pytest.mark.parametrize("how", ["outer", "left", "right", "inner"])
def test_merge_deals_out_the_pairs_of_a_crowded_key(spark, monkeypatch, how):
    monkeypatch.setattr(relational, "PAIRS", 100, raising=False)
    monkeypatch.setattr(relational, "PIECE", 10, raising=False)
    left = [(i, "crowded" if i < 100 else None if i % 5 == 0 else "many" if i % 5 == 1 else f"l{i % 9}", i % 3) for i in range(200)]
    right = [(i, "crowded" if i < 120 else None if i % 5 == 0 else "many" if i % 5 == 1 else f"l{i % 7}", i % 3) for i in range(220)] + [(7, "crowded", 0)] * 30
    a, b = spark.createDataFrame(left, "x int, k string, m int"), spark.createDataFrame(right, "y int, j string, n bigint")
    c = duckdb.connect()
    c.execute("CREATE TABLE a (x INT, k TEXT, m INT)")
    c.execute("CREATE TABLE b (y INT, j TEXT, n BIGINT)")
    c.executemany("INSERT INTO a VALUES (?, ?, ?)", left)
    c.executemany("INSERT INTO b VALUES (?, ?, ?)", right)
    for lk, rk in ((["k"], ["j"]), (["k", "m"], ["j", "n"])):
        got = relational.merge(a, b, how=how, left_on=lk, right_on=rk)
        on = " AND ".join(f"a.{x} = b.{y}" for x, y in zip(lk, rk, strict=True))
        want = c.execute(f"SELECT * FROM a {'FULL' if how == 'outer' else how} JOIN b ON {on}").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        tasks = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(tasks) < len(want) / 5


def test_apply_to_frames_of_whole_groups(spark):
    rows = [(k, m, i) for k, (m, n) in enumerate([("a", 1), ("a", 7), ("b", 14), (None, 7), ("c", 30), ("c", 3), ("d", 2), ("d", 1)] * 3) for i in range(n)]
    df = spark.createDataFrame([(k if k % 8 != 3 else None, m, i) for k, m, i in rows], "k int, m string, i int")

    def sums(x):
        out = x.groupby(["k", "m"], dropna=False, as_index=False).agg(s=("i", "sum"), n=("i", "size"))
        return out.assign(calls=[1] + [0] * (len(out) - 1))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = aggregate.GroupBy(df.coalesce(1), ["k", "m"], dropna=False).apply(sums, "k int, m string, s long, n long, calls int", many=True).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = df.groupBy("k", "m").agg(F.sum("i").alias("s"), F.count("*").alias("n")).toPandas()
    plain = lambda f: sorted((repr(None if pd.isna(r.k) else int(r.k)), repr(r.m), r.s, r.n) for r in f.itertuples())
    assert plain(got) == plain(want)
    few = aggregate.GroupBy(df, ["k", "m"], dropna=False).apply(sums, "k int, m string, s long, n long, calls int", many=True).toPandas()
    assert plain(few) == plain(want) and few.calls.sum() < len(want)
