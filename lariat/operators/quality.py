"""Profiles, rules, outliers and scaling; one aggregation for all columns of a frame."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: dtype, count, missing, missing_rate, unique, mean, std, min, max (as text)."""
    rows = []
    for c, t in df.dtypes:
        number = t in ("tinyint", "smallint", "int", "bigint", "float", "double")
        value = F.col(c).cast("double") if number else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count(c).alias("count"), (F.count("*") - F.count(c)).alias("missing"),
                F.try_divide((F.count("*") - F.count(c)).cast("double"), F.count("*").cast("double")).alias("missing_rate"), F.count_distinct(c).alias("unique"),
                F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def validate(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """A row for each rule that rows break: column, rule (dtype, non_null, min, max) and how many do."""
    types, rows = dict(df.dtypes), []
    for c, rules in schema.items():
        for rule, want in rules.items():
            if rule == "dtype":
                broken = F.lit(0 if types.get(c) == want else 1).cast("bigint")
            else:
                bad = {"non_null": F.col(c).isNull() & F.lit(bool(want)), "min": F.col(c) < F.lit(want), "max": F.col(c) > F.lit(want)}[rule]
                broken = F.count(F.when(bad, 1))
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), broken.alias("violations")))
    return df.agg(F.count("*"), F.array(*rows).alias("rows")).select(F.inline("rows")).where("violations > 0")


def _row(df: DataFrame, made: list) -> tuple:
    return tuple(df.agg(*made).first())


def detect_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr") -> DataFrame:
    """c_outlier: beyond 1.5 interquartile ranges from the quartiles, or over 2 population deviations from the mean.

    Quartiles are the values at ranks n // 4 and 3 n // 4 of the sorted column.
    """
    out = {}
    for c in cols:
        if method == "zscore":
            mean, std = _row(df, [F.avg(c), F.stddev_pop(c)])
            out[f"{c}_outlier"] = F.abs((F.col(c) - F.lit(mean)) / F.lit(std)) > 2 if std else F.lit(False)
        else:
            low, high = _at(df, c, (0.25, 0.75))
            reach = None if low is None else 1.5 * (high - low)
            out[f"{c}_outlier"] = F.lit(False) if low is None else (F.col(c) < F.lit(low - reach)) | (F.col(c) > F.lit(high + reach))
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in out.items()})


def _at(df: DataFrame, col: str, shares: Sequence[float]) -> list:
    """The values at rank floor(share * n) of a sorted column, from counts of its values."""
    from lariat.operators.order import cut, running

    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    upto = cut(running(counts, {"u": ("sum", "n")}, ["v"]))
    total = upto.agg(F.max("u")).first()[0] or 0
    return [upto.where(F.col("u") > int(s * total)).agg(F.min("v")).first()[0] for s in shares]


def normalize(df: DataFrame, cols: Sequence[str], method: str = "minmax") -> DataFrame:
    """Columns scaled by minmax, zscore (population) or robust (median and quartile range); 0.0 where the range is 0."""
    out = {}
    for c in cols:
        if method == "minmax":
            low, high = _row(df, [F.min(c), F.max(c)])
            centre, width = low, None if low is None else high - low
        elif method == "zscore":
            centre, width = _row(df, [F.avg(c), F.stddev_pop(c)])
        else:
            low, centre, high = _at(df, c, (0.25, 0.5, 0.75))
            width = None if low is None else high - low
        out[c] = F.when(F.col(c).isNotNull(), (F.col(c) - F.lit(centre)) / F.lit(float(width)) if width else F.lit(0.0))
    return df.withColumns(out)


def standard_name(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower())).strip("_")


def standardize_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with single underscores; repeated ones get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = standard_name(c) or "column"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def clean(df: DataFrame) -> DataFrame:
    """Standard names, no repeated rows, no rows without a value."""
    return standardize_names(df).dropDuplicates().na.drop("all")
