"""Long to wide and back, tables of counts, bins and codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.operators.aggregate import PLAIN, quantiles
from lariat.operators.order import numbered

#: A pivot makes at most so many columns; more is an error, never a loss.
WIDEST = 1000


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """A row for each row and value column."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


def levels(df: DataFrame, col: str) -> list:
    """The distinct values of a column, sorted; an error beyond WIDEST."""
    got = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(WIDEST + 1).collect()]
    if len(got) > WIDEST:
        raise ValueError(f"{col} has more than {WIDEST} values")
    return sorted(got)


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, values: str, kind: str = "mean", fill: object = None, margins: bool = False, names: Sequence | None = None) -> DataFrame:
    """A row for each index value, a column for each value of `columns`; margins adds a column and a row All.

    names: the column values, if they are known; else they are read, in one pass more.
    """
    names = list(names) if names is not None else levels(df, columns)
    made = [PLAIN[kind](F.when(F.col(columns) == F.lit(v), F.col(values))).alias(str(v)) for v in names]
    if margins:
        made.append(PLAIN[kind](F.col(values)).alias("All"))
    out = df.groupBy(*index).agg(*made)
    if margins:
        label = [F.lit("All").alias(c) for c in index]
        out = out.select(*(F.col(c).cast("string").alias(c) for c in index), *(F.col(str(v)) for v in names), "All").unionByName(df.agg(*made).select(*label, *(F.col(str(v)) for v in names), "All"))
    return out if fill is None else out.fillna(fill, [str(v) for v in names])


def pivot(df: DataFrame, index: Sequence[str], columns: str, values: str, names: Sequence | None = None) -> DataFrame:
    """pivot_table of entries that are unique; ValueError if some are not."""
    if not df.groupBy(*index, columns).count().where("count > 1").isEmpty():
        raise ValueError("the index has duplicate entries")
    return pivot_table(df, index, columns, values, "max", names=names)


def stack(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """melt() without the missing values, as columns level and value."""
    return melt(df, ids, values, "level", "value").where(F.col("value").isNotNull())


def unstack(df: DataFrame, ids: Sequence[str], level: str, value: str, names: Sequence | None = None) -> DataFrame:
    return pivot(df, ids, level, value, names)


def crosstab(df: DataFrame, a: str, b: str, normalize: str | None = None, names: Sequence | None = None) -> DataFrame:
    """Counts of pairs, 0 where none; normalize: all, index or columns."""
    names = list(names) if names is not None else levels(df, b)
    out = df.groupBy(a).agg(*(F.count(F.when(F.col(b) == F.lit(v), 1)).alias(str(v)) for v in names))
    cols = [str(v) for v in names]
    if normalize == "index":
        return out.select(a, *(F.try_divide(F.col(c), sum((F.col(x) for x in cols[1:]), F.col(cols[0]))).alias(c) for c in cols))
    if normalize:
        totals = out.agg(*(F.sum(c) for c in cols)).first()
        whole = float(sum(t or 0 for t in totals))
        return out.select(a, *(F.try_divide(F.col(c), F.lit(whole if normalize == "all" else float(t or 0))).alias(c) for c, t in zip(cols, totals, strict=True)))
    return out


def explode(df: DataFrame, col: str) -> DataFrame:
    """A row for each element; an empty or null list gives one row with null."""
    return df.withColumn(col, F.explode_outer(col))


def wide_to_long(df: DataFrame, stubs: Sequence[str], ids: Sequence[str], suffixes: Sequence, j: str, sep: str = "_") -> DataFrame:
    """A row for each row and suffix, with a column for each stub."""
    rows = F.array(*(F.struct(F.lit(s).alias(j), *(F.col(f"{stub}{sep}{s}").alias(stub) for stub in stubs)) for s in suffixes))
    return df.select(*ids, F.inline(rows))


def transpose(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Columns as rows, and rows, named by their label, as columns; bounded by WIDEST rows.

    Numbers stay numbers, columns of several kinds become text; ValueError if labels repeat or are missing.
    """
    if not df.groupBy(label).count().where(F.col("count") > 1).isEmpty() or not df.where(F.col(label).isNull()).isEmpty():
        raise ValueError(f"labels in {label} repeat or are missing")
    names, types = levels(df, label), {t for c, t in df.dtypes if c in cols}
    kind = "double" if types <= {"tinyint", "smallint", "int", "bigint", "float", "double"} else types.pop() if len(types) == 1 else "string"
    long = melt(df.select(label, *(F.col(c).cast(kind).alias(c) for c in cols)), [label], cols, "column", "__v")
    return long.groupBy("column").agg(*(F.max(F.when(F.col(label) == F.lit(n), F.col("__v"))).alias(str(n)) for n in names))


def lreshape(df: DataFrame, groups: dict[str, Sequence[str]], dropna: bool = True) -> DataFrame:
    """A row for each row and place in the lists: name -> the columns that become one of that name."""
    keep = [c for c in df.columns if c not in {x for g in groups.values() for x in g}]
    rows = [F.struct(*(F.col(g[i]).alias(n) for n, g in groups.items())) for i in range(len(next(iter(groups.values()))))]
    out = df.select(*keep, F.inline(F.array(*rows)))
    return out.dropna(subset=list(groups)) if dropna else out


def get_dummies(df: DataFrame, col: str, names: Sequence | None = None, prefix: str | None = None) -> DataFrame:
    """A column of 0 and 1 for each value, in place of the column."""
    names = list(names) if names is not None else levels(df, col)
    made = [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix or col}_{v}") for v in names]
    return df.select(*(c for c in df.columns if c != col), *made)


def cut(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None, right: bool = True, lowest: bool = False) -> Column:
    """The label (or number from 0) of the bin; null outside of all."""
    out = F.lit(None)
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        inside = (c > a) & (c <= b) if right else (c >= a) & (c < b)
        if lowest and right and i == 0:
            inside = (c >= a) & (c <= b)
        out = F.when(inside, F.lit(labels[i] if labels else i)).otherwise(out)
    return out


def qcut(df: DataFrame, col: str, q: int, name: str = "bin") -> DataFrame:
    """Number of the quantile bin of each value; edges by linear interpolation."""
    edges = [e for e in quantiles(df, col, [i / q for i in range(q + 1)]) if e is not None]
    return df.withColumn(name, cut(F.col(col), edges, lowest=True).cast("int") if edges else F.lit(None).cast("int"))


def factorize(df: DataFrame, col: str, order: Sequence[str], name: str = "code") -> DataFrame:
    """Codes of values in the order of their first rows; -1 for null. The distinct values are numbered, not the rows."""
    seen = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.min(F.struct(*order)).alias("__at"))
    codes = numbered(seen, [F.col("__at").asc()], name).drop("__at")
    return df.join(codes, F.col(col) == F.col("__v"), "left").drop("__v").withColumn(name, F.coalesce(name, F.lit(-1).cast("bigint")))
