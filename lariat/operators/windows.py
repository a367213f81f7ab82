"""Row-order functions: shifts, running values, ranks, rolling, expanding and exponential windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lariat.operators.order import cut, decayed, keys, looked_up, numbered, over, running, turned

Names = Sequence[str]


def shift(df: DataFrame, col: str, n: int, order: Names, by: Names = (), fill: object = None, name: str | None = None) -> DataFrame:
    """The value n rows before (after, if negative)."""
    return over(df, {name or col: lambda w: F.lag(col, n, fill).over(w)}, order, by, before=max(n, 0), after=max(-n, 0))


def diff(df: DataFrame, col: str, n: int, order: Names, by: Names = (), name: str | None = None) -> DataFrame:
    """The value less the one n rows before."""
    return over(df, {name or col: lambda w: F.col(col) - F.lag(col, n).over(w)}, order, by, before=max(n, 0), after=max(-n, 0))


def pct_change(df: DataFrame, col: str, n: int, order: Names, by: Names = (), name: str | None = None) -> DataFrame:
    """Relative change to n rows before; null where that is 0."""
    return over(df, {name or col: lambda w: F.try_divide(F.col(col) - F.lag(col, n).over(w), F.lag(col, n).over(w))}, order, by, before=max(n, 0), after=max(-n, 0))


def cumulative(df: DataFrame, col: str, kind: str, order: Names, by: Names = (), name: str | None = None) -> DataFrame:
    """Running sum, prod, max, min or count; null where the own value is null."""
    out = running(df, {"__run": (kind, col)}, order, by)
    value = F.col("__run") if kind == "count" else F.when(F.col(col).isNotNull(), F.col("__run"))
    return out.withColumn(name or col, value).drop("__run")


def fill(df: DataFrame, col: str, order: Names, by: Names = (), back: bool = False, limit: int | None = None, name: str | None = None) -> DataFrame:
    """Nulls replaced by the last value before them (the next after them); limit: of so many rows in a run at most."""
    order = turned(order) if back else order
    if limit is None:
        out = running(df, {"__run": ("last", col)}, order, by)
        return out.withColumn(name or col, F.col("__run")).drop("__run")
    return over(df, {name or col: lambda w: F.last(col, ignorenulls=True).over(w.rowsBetween(-limit, 0))}, order, by, before=limit)


def rank(df: DataFrame, col: str, method: str = "average", by: Names = (), order: Names = (), ascending: bool = True, pct: bool = False, name: str = "rank") -> DataFrame:
    """Ranks from 1: average, min, max, first (ties by `order`) or dense; nulls have none.

    Without groups the distinct values are numbered and counted, so no task sees all rows.
    """
    own = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    if by:
        w = Window.partitionBy(*by).orderBy(own)
        ties = F.count("*").over(Window.partitionBy(*by, col))
        low = F.rank().over(w)
        value = {"min": low, "max": low + ties - 1, "average": low + (ties - 1) / 2, "dense": F.dense_rank().over(w)}.get(method)
        value = F.row_number().over(Window.partitionBy(*by).orderBy(own, *keys(order))) if method == "first" else value
        whole = F.count(col).over(Window.partitionBy(*by))
        out = df.withColumn(name, F.when(F.col(col).isNotNull(), value.cast("double")))
        if pct and method == "dense":
            whole = F.max(F.when(F.col(col).isNotNull(), F.col(name))).over(Window.partitionBy(*by))
        return out.withColumn(name, F.col(name) / whole) if pct else out
    known = df.where(F.col(col).isNotNull())
    if method == "first":
        out = numbered(known, [own, *keys(order)], "__n").withColumn(name, (F.col("__n") + 1).cast("double")).drop("__n")
        out = out.withColumn(name, F.col(name) / F.lit(float(max(1, known.count())))) if pct else out
        return out.unionByName(df.where(F.col(col).isNull()).withColumn(name, F.lit(None).cast("double")))
    values = numbered(known.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n")), [F.col("__v").asc() if ascending else F.col("__v").desc()], "__d")
    values = cut(running(values, {"__upto": ("sum", "__n")}, ["__d"]))
    last = F.col("__upto")
    value = {"max": last, "min": last - F.col("__n") + 1, "average": last - (F.col("__n") - 1) / 2, "dense": F.col("__d") + 1}[method].cast("double")
    if pct:
        whole = values.agg(F.max(F.col("__d") + 1 if method == "dense" else last)).first()[0] or 1
        value = value / F.lit(float(whole))
    values = values.select("__v", value.alias(name), "__n")
    out = looked_up(known, values, col, "__v", "__n").drop("__v", "__n")
    return out.unionByName(df.where(F.col(col).isNull()).withColumn(name, F.lit(None).cast("double")))


def _bounds(window: int, center: bool, closed: str) -> tuple[int, int]:
    if center:
        ahead = (window - 1) // 2
        return -(window - 1 - ahead), ahead
    first = {"right": 1 - window, "both": -window, "left": -window, "neither": 1 - window}[closed]
    return first, -1 if closed in ("left", "neither") else 0


def _moment(col: Column, kind: str, w) -> Column:
    """Bias-corrected skewness or excess kurtosis of a frame."""
    n = F.count(col).over(w).cast("double")
    if kind == "skew":
        return F.when(n > 2, F.skewness(col).over(w) * F.sqrt(n * (n - 1)) / (n - 2))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col).over(w) + 6))


def correlation(a: Column, b: Column, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the pairs without a null, as an aggregate or over a window; NaN where one of the two does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    of = (lambda c: c.over(w)) if w is not None else lambda c: c
    scale = of(F.stddev_pop(x)) * of(F.stddev_pop(y))  # corr() itself divides by 0 there, an error in ANSI mode
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(F.try_divide(of(F.covar_pop(x, y)), scale))


def _frame(col: str, kind: str, w, q: float = 0.5, other: str | None = None, weights: Sequence[float] = ()) -> Column:
    c = F.col(col).cast("double")
    if kind in ("skew", "kurt"):
        return _moment(c, kind, w)
    if kind == "sem":
        return F.stddev_samp(c).over(w) / F.sqrt(F.count(c).over(w))
    if kind in ("corr", "cov"):
        return correlation(c, F.col(other), w) if kind == "corr" else F.covar_samp(c, F.col(other).cast("double")).over(w)
    if kind == "weighted":
        got = F.collect_list(F.struct(c.alias("v"))).over(w)
        scaled = F.zip_with(got, F.array(*map(F.lit, map(float, weights))), lambda x, k: x["v"] * k)
        return F.when(F.size(got) == len(weights), F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x) / F.lit(float(sum(weights))))
    if kind == "quantile":
        got = F.array_sort(F.collect_list(c).over(w))
        at = (F.size(got) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(got, low), F.get(got, F.least(low + 1, F.size(got) - 1))
        return a + (b - a) * (at - low)
    plain = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count}
    return plain[kind](c).over(w)


def rolling(
    df: DataFrame, col: str, window: int, kind: str, order: Names, by: Names = (), min_periods: int | None = None, center: bool = False, closed: str = "right", q: float = 0.5,
    other: str | None = None, weights: Sequence[float] = (), name: str | None = None,
) -> DataFrame:
    """A function of the last `window` rows: sum, mean, min, max, std, var, median, count, quantile, skew, kurt, sem, corr, cov or weighted.

    Null with fewer than min_periods values (the window, unless given; 0 for count).
    """
    first, last = _bounds(window, center, closed)
    least = (0 if kind == "count" else window) if min_periods is None else min_periods
    kind, q = ("quantile", 0.5) if kind == "median" else (kind, q)

    def make(w):
        frame = w.rowsBetween(first, last)
        value = _frame(col, kind, frame, q, other, weights)
        return F.when(F.count(col).over(frame) >= least, value) if least else value

    return over(df, {name or f"{col}_{kind}": make}, order, by, before=max(0, -first), after=max(0, last))


def rolling_apply(df: DataFrame, col: str, window: int, function: Callable[[Column], Column], order: Names, by: Names = (), name: str | None = None) -> DataFrame:
    """A function of the array of the last `window` values, of which nulls are no part; null before so many rows."""
    made = lambda w: F.when(F.count("*").over(w.rowsBetween(1 - window, 0)) == window, function(F.collect_list(col).over(w.rowsBetween(1 - window, 0))))
    return over(df, {name or f"{col}_apply": made}, order, by, before=window - 1)


def expanding(df: DataFrame, col: str, kind: str, order: Names, by: Names = (), min_periods: int = 1, name: str | None = None) -> DataFrame:
    """A function of all rows up to the own one: sum, mean, min, max, count, var, std."""
    made = {"__n": ("count", col)}
    df = df.withColumn("__x", F.col(col).cast("double"))
    if kind in ("var", "std"):
        centre = df.agg(F.avg("__x")).first()[0] or 0.0  # moments about the mean keep their digits
        df = df.withColumn("__x", F.col("__x") - F.lit(centre)).withColumn("__xx", F.col("__x") * F.col("__x"))
        made |= {"__s": ("sum", "__x"), "__q": ("sum", "__xx")}
    else:
        made |= {"__s": ({"mean": "sum"}.get(kind, kind), "__x")}
    out = running(df, made, order, by)
    n, s = F.col("__n"), F.col("__s")
    value = {"mean": F.try_divide(s, n.cast("double")), "count": n.cast("double")}.get(kind, s)
    if kind in ("var", "std"):
        value = F.when(n > 1, F.greatest((F.col("__q") - s * s / F.greatest(n, F.lit(1))) / (n - 1), F.lit(0.0)))
        value = F.sqrt(value) if kind == "std" else value
    return out.withColumn(name or f"{col}_{kind}", F.when(n >= min_periods, value)).drop("__n", "__s", "__q", "__x", "__xx")


def _weighted(df: DataFrame, made: dict[str, Column], col: str, keep: float, order: Names, by: Names, skip: bool) -> DataFrame:
    """df with decayed sums; skip: rows without a value do not age the others."""
    w = Window.partitionBy(*by).orderBy(*keys(order)) if by else None
    if not skip:
        rows = df.withColumn("__i", (F.row_number().over(w) - 1).cast("bigint")) if by else numbered(df, order, "__i")
    elif by:
        rows = df.withColumn("__i", F.count(col).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    else:
        rows = running(df, {"__i": ("count", col)}, order).withColumn("__i", F.col("__i") - 1)
    rows = rows.withColumn("__i", F.greatest("__i", F.lit(0)))
    return decayed(rows, made, keep, "__i", by)


def ewm(df: DataFrame, col: str, alpha: float, kind: str = "mean", order: Names = (), by: Names = (), adjust: bool = True, name: str | None = None, other: str | None = None) -> DataFrame:
    """Exponentially weighted mean, var, std, cov or corr with another column; all but the mean are bias-corrected.

    Weights shrink by 1 - alpha with each row, over all rows so far. Nulls weigh nothing; pairs
    count where both values are known.
    """
    keep, out = 1.0 - alpha, name or f"{col}_ewm"
    x = F.col(col).cast("double")
    one = lambda c: F.when(c.isNotNull(), 1.0).otherwise(0.0)
    if kind == "mean" and not adjust:
        first = F.when(F.col("__i") == 0, x).otherwise(x * alpha)
        rows = _weighted(df, {"__s": first, "__n": one(x)}, col, keep, order, by, True)
        return rows.withColumn(out, F.when(F.col("__n") > 0, F.col("__s"))).drop("__s", "__n", "__i")
    if kind == "mean":
        rows = _weighted(df, {"__s": x, "__w": one(x)}, col, keep, order, by, False)
        return rows.withColumn(out, F.try_divide(F.col("__s"), F.col("__w"))).drop("__s", "__w", "__i")
    y = F.col(other).cast("double") if other else x
    both = x.isNotNull() & y.isNotNull()
    middle = df.agg(F.avg(F.when(both, x)), F.avg(F.when(both, y))).first()  # moments about the mean keep their digits
    a, b = (F.when(both, c - F.lit(m or 0.0)) for c, m in zip((x, y), middle, strict=True))
    made = {"__w": one(a), "__x": a, "__y": b, "__xx": a * a, "__yy": b * b, "__xy": a * b}
    rows = _weighted(df, made, col, keep, order, by, False)
    squares = _weighted(df, {"__ww": one(a)}, col, keep * keep, order, by, False)
    rows = rows.withColumns({"__x": F.try_divide("__x", "__w"), "__y": F.try_divide("__y", "__w")})
    moment = lambda s, u, v: F.try_divide(F.col(s), F.col("__w")) - F.col(u) * F.col(v)
    if kind == "corr":
        value = F.try_divide(moment("__xy", "__x", "__y"), F.sqrt(F.greatest(moment("__xx", "__x", "__x") * moment("__yy", "__y", "__y"), F.lit(0.0))))
        return rows.withColumn(out, value).drop("__i", *made)
    # the sum of squared weights follows from their number alone where no value is missing
    w, ww = F.col("__w"), F.col("__ww")
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by] + [F.col("r.__i") == F.col("q.__i")]
    rows = rows.alias("r").join(squares.select(*by, "__i", "__ww").alias("q"), reduce(Column.__and__, match)).select("r.*", "q.__ww")
    value = F.when(w * w > ww * (1 + 1e-12), F.greatest(moment("__xy", "__x", "__y"), F.lit(0.0)) if kind != "cov" else moment("__xy", "__x", "__y")) * F.try_divide(w * w, w * w - ww)
    value = F.sqrt(value) if kind == "std" else value
    return rows.withColumn(out, value).drop("__i", "__ww", *made)
