"""Rows by label and by position, labels that change, and frames that labels align.

A label is the value of one or more columns; a position is a row's number in a given order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.operators.order import keys, numbered, over
from lariat.operators.relational import merge_asof

_AT = "__position"


def loc(df: DataFrame, key: str, labels: Sequence | None = None, start: object = None, stop: object = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with these labels, or with labels from start to stop, both included."""
    out = df if labels is None else df.where(F.col(key).isin(list(labels)))
    out = out if start is None else out.where(F.col(key) >= F.lit(start))
    out = out if stop is None else out.where(F.col(key) <= F.lit(stop))
    return out.select(*cols) if cols else out


def iloc(df: DataFrame, order: Sequence[str], rows: int | slice | Sequence[int], cols: Sequence[int] | None = None) -> DataFrame:
    """Rows by position, from the end if negative, and columns by place."""
    own = numbered(df, order, _AT)
    at = F.col(_AT)
    if isinstance(rows, slice):
        size = own.count() if any(x is not None and x < 0 for x in (rows.start, rows.stop)) else 1 << 62
        start, stop, step = rows.indices(size)
        out = own.where((at >= start) & (at < stop) & ((at - start) % step == 0))
    else:
        places = [rows] if isinstance(rows, int) else list(rows)
        size = own.count() if min(places, default=0) < 0 else 0
        out = own.where(at.isin([p + size if p < 0 else p for p in places]))
    out = out.drop(_AT)
    return out.select(*(df.columns[c] for c in cols)) if cols else out


def at(df: DataFrame, key: str, label: object, col: str) -> DataFrame:
    return loc(df, key, [label], cols=[col])


def iat(df: DataFrame, order: Sequence[str], row: int, col: int) -> DataFrame:
    return iloc(df, order, row, [col])


def loc_set(df: DataFrame, which: Column, values: dict[str, object]) -> DataFrame:
    """Values put into columns, new ones too, where a condition holds; missing conditions don't."""
    hit = F.coalesce(which, F.lit(False))
    put = lambda c, v: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c) if c in df.columns else F.lit(None))
    return df.withColumns({c: put(c, v) for c, v in values.items()})


def iloc_set(df: DataFrame, order: Sequence[str], rows: Sequence[int], values: dict[str, object]) -> DataFrame:
    return loc_set(numbered(df, order, _AT), F.col(_AT).isin(list(rows)), values).drop(_AT)


def set_index(df: DataFrame, key: Sequence[str], verify: bool = False) -> DataFrame:
    """Label columns first; verify: ValueError if labels repeat."""
    if verify and not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"labels in {list(key)} repeat")
    return df.select(*key, *(c for c in df.columns if c not in key))


def reset_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Positions as a first column."""
    return numbered(df, order, name).select(name, *df.columns)


def reindex(df: DataFrame, key: str, labels: DataFrame, method: str | None = None, fill: object = None, limit: Column | None = None) -> DataFrame:
    """A row for each of the labels; absent ones are null, filled by a value, or by the last (ffill) or next (bfill) label's row.

    limit: how far such a label may be away.
    """
    cols = [c for c in df.columns if c != key]
    if method:
        met = merge_asof(labels.select(key), df, key, direction={"ffill": "backward", "bfill": "forward", "nearest": "nearest"}[method], tolerance=limit)
        return met.select(key, *cols)
    out = labels.select(key).join(df, key, "left").select(key, *cols)
    return out if fill is None else out.fillna(fill, cols)


def reindex_like(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """The other frame's labels and columns."""
    out = reindex(df, key, other)
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).alias(c) for c in other.columns))


def rename(df: DataFrame, columns: dict[str, str] | Callable[[str], str]) -> DataFrame:
    return df.toDF(*((columns.get(c, c) if isinstance(columns, dict) else columns(c)) for c in df.columns))


def add_prefix(df: DataFrame, text: str, key: Sequence[str] = ()) -> DataFrame:
    return rename(df, lambda c: c if c in key else text + c)


def add_suffix(df: DataFrame, text: str, key: Sequence[str] = ()) -> DataFrame:
    return rename(df, lambda c: c if c in key else c + text)


def filter_names(df: DataFrame, items: Sequence[str] | None = None, like: str | None = None, regex: str | None = None) -> DataFrame:
    keep = (lambda c: c in items) if items is not None else (lambda c: like in c) if like is not None else re.compile(regex or "").search
    return df.select(*(c for c in df.columns if keep(c)))


def drop(df: DataFrame, cols: Sequence[str] = (), key: str | None = None, labels: Sequence = ()) -> DataFrame:
    """Without these columns, and without the rows of these labels; rows without a label stay."""
    out = df if key is None else df.where(F.col(key).isNull() | ~F.col(key).isin(list(labels)))
    return out.drop(*cols)


def pop(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(col), df.select(col)


def insert(df: DataFrame, place: int, name: str, value: object) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    cols: list = [*df.columns]
    cols.insert(place, (value if isinstance(value, Column) else F.lit(value)).alias(name))
    return df.select(*cols)


def xs(df: DataFrame, key: str, label: object) -> DataFrame:
    """The rows of one label of a level, without that level."""
    return df.where(F.col(key) == F.lit(label)).drop(key)


def lookup(df: DataFrame, key: str, pairs: Sequence[tuple[object, str]]) -> DataFrame:
    """label, column and value, as text, of each pair."""
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for label, c in pairs))
    return df.where(F.col(key).isin([p[0] for p in pairs])).select(F.col(key).alias("__k"), F.inline(rows)).where("__k = label").drop("__k")


def truncate(df: DataFrame, key: str, before: object = None, after: object = None) -> DataFrame:
    return loc(df, key, start=before, stop=after)


def first_span(df: DataFrame, ts: str, span: str, last: bool = False) -> DataFrame:
    """Rows within an interval of the first (last) time, that end excluded."""
    end = df.agg((F.max if last else F.min)(ts).alias("__e"))
    edge = F.expr(f"__e {'-' if last else '+'} interval {span}")
    return df.crossJoin(F.broadcast(end)).where(F.col(ts) > edge if last else F.col(ts) < edge).drop("__e")  # one row


def at_time(df: DataFrame, ts: str, time: str) -> DataFrame:
    return df.where(F.date_format(ts, "HH:mm:ss") == time)


def sort_columns(df: DataFrame, reverse: bool = False) -> DataFrame:
    return df.select(*sorted(df.columns, reverse=reverse))


def align(left: DataFrame, right: DataFrame, on: str, how: str = "outer") -> tuple[DataFrame, DataFrame]:
    """Both frames with the same labels, and with the columns of both, in one order."""
    labels = left.select(on).join(right.select(on), on, how).distinct() if how != "outer" else left.select(on).union(right.select(on)).distinct()
    names = sorted({*left.columns, *right.columns} - {on})
    full = lambda df, other: reindex(df, on, labels).select(on, *(F.col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in names))
    return full(left, right), full(right, left)


def update(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left with the values of right where these are known."""
    cols = [c for c in left.columns if c in right.columns and c != on]
    r = right.select(F.col(on).alias("__k"), *(F.col(c).alias(f"__r_{c}") for c in cols))
    out = left.join(r, F.col(on) == F.col("__k"), "left")
    return out.select(*(F.coalesce(f"__r_{c}", c).alias(c) if c in cols else c for c in left.columns))


def combine(left: DataFrame, right: DataFrame, on: str, function: Callable[[Column, Column], Column]) -> DataFrame:
    """A function of both frames' values at each label of either."""
    cols = [c for c in left.columns if c in right.columns and c != on]
    l, r = (df.select(on, *(F.col(c).alias(f"__{side}_{c}") for c in cols)) for side, df in (("l", left), ("r", right)))
    return l.join(r, on, "full").select(on, *(function(F.col(f"__l_{c}"), F.col(f"__r_{c}")).alias(c) for c in cols))


def equals(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, equal: whether columns, types and rows, each as often, are the same."""
    if left.dtypes != right.dtypes:
        return left.sparkSession.range(1).select(F.lit(False).alias("equal"))
    both = left.withColumn("__n", F.lit(1)).unionByName(right.withColumn("__n", F.lit(-1)))
    odd = both.groupBy(*left.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return odd.agg((F.count("*") == 0).alias("equal"))


def repeat(df: DataFrame, times: int | Column) -> DataFrame:
    count = times if isinstance(times, Column) else F.lit(times)
    return df.withColumn("__i", F.explode(F.array_repeat(F.lit(1), count))).drop("__i")


def searchsorted(df: DataFrame, col: str, values: Sequence, side: str = "left") -> DataFrame:
    """value, at: where each value would stand in the sorted column; one pass."""
    below = lambda v: F.col(col) < F.lit(v) if side == "left" else F.col(col) <= F.lit(v)
    rows = F.array(*(F.struct(F.lit(v).alias("value"), F.count(F.when(below(v), 1)).alias("at")) for v in values))
    return df.agg(rows.alias("r")).select(F.inline("r"))


def argsort(df: DataFrame, col: str, order: Sequence[str], name: str = "argsort") -> DataFrame:
    """df with, at each position, the position of the value that belongs there when the column is sorted."""
    rows = numbered(df, order, _AT)
    placed = numbered(rows.select(F.col(_AT).alias(name), F.col(col).alias("__v")), ["__v", name], "__p").select("__p", name)
    return rows.join(placed, F.col(_AT) == F.col("__p")).drop(_AT, "__p")


def monotonic(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """One row: increasing, decreasing and unique, of a column in a given order."""
    rows = over(df, {"__b": lambda w: F.lag(col).over(w)}, order, before=1)
    steps = rows.agg(F.coalesce(F.min(F.col(col) >= F.col("__b")), F.lit(True)).alias("increasing"), F.coalesce(F.min(F.col(col) <= F.col("__b")), F.lit(True)).alias("decreasing"))
    twice = df.groupBy(col).agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("unique"))
    return steps.crossJoin(twice)  # one row each


def get_loc(df: DataFrame, key: str, label: object, order: Sequence[str]) -> DataFrame:
    """The positions of a label."""
    return numbered(df, order, "position").where(F.col(key) == F.lit(label)).select("position")


def product_of(*levels: DataFrame) -> DataFrame:
    """All combinations of levels: the operator is the product."""
    return reduce(DataFrame.crossJoin, levels)


def level_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df with c_code: the place of each value among the sorted different values of its level; -1 for null."""
    for c in cols:
        known = numbered(df.select(F.col(c).alias("__v")).where(F.col("__v").isNotNull()).distinct(), ["__v"], f"{c}_code")
        df = df.join(known, F.col(c) == F.col("__v"), "left").drop("__v").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1).cast("bigint")))
    return df


def head_of_each(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys(order)))).where(F.col("__n") <= n).drop("__n")
