"""Missing values, replacement and limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.operators.order import around


def nan_to_null(df: DataFrame) -> DataFrame:
    """The rule for data that comes in: NaN is missing."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("float", "double")})


def fillna(df: DataFrame, values: object, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls replaced by a value, by a value for each column, or by Columns."""
    spec = values if isinstance(values, dict) else dict.fromkeys(cols or df.columns, values)
    return df.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in spec.items()})


def dropna(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any", thresh: int | None = None) -> DataFrame:
    """Rows without nulls (any), with a value at all (all), or with `thresh` values at least."""
    return df.na.drop(how=how, thresh=thresh, subset=list(subset) if subset else None)


def isna(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_isna": F.col(c).isNull() for c in cols})


def interpolate(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = (), at: str | None = None, name: str | None = None) -> DataFrame:
    """Nulls between values on the line between them, by row number or by a column `at`; after the last value it stays, before the first they stay null."""
    x = F.col(at or "__row").cast("double")
    known = F.when(F.col(col).isNotNull(), F.struct(x.alias("x"), F.col(col).cast("double").alias("y")))
    rows = around(df, known, order, by, "__row")
    a, b = F.col("__before"), F.col("__after")
    line = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])
    value = F.when(F.col(col).isNotNull(), F.col(col).cast("double")).when(a.isNull(), None).when(b.isNull(), a["y"]).otherwise(line)
    return rows.withColumn(name or col, value).drop("__before", "__after", "__row")


def replace_map(c: Column, values: dict) -> Column:
    """Values exchanged by a table; others stay."""
    return reduce(lambda out, kv: F.when(c.eqNullSafe(F.lit(kv[0])), F.lit(kv[1])).otherwise(out), list(values.items())[::-1], c)


def clip(c: Column, low: object = None, high: object = None) -> Column:
    """Values moved into the limits; nulls stay."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def to_numeric(c: Column, errors: str = "coerce") -> Column:
    """Text as double: null for what is none (coerce), or an error (raise)."""
    text = F.trim(c.cast("string"))
    return text.try_cast("double") if errors == "coerce" else text.cast("double")
