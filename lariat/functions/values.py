"""Arithmetic with fill values, bits, intervals, periods, categories and kinds of types, as column functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {
    "integer": ("tinyint", "smallint", "int", "bigint"), "float": ("float", "double"), "string": ("string",), "bool": ("boolean",),
    "datetime": ("timestamp", "timestamp_ntz", "date"), "complex": (), "list": ("array",), "dict": ("map", "struct"),
}


def floordiv(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for a divisor of 0."""
    return a - floordiv(a, b) * b


def divmod_(a: Column, b: Column) -> Column:
    return F.struct(floordiv(a, b).alias("quotient"), mod(a, b).alias("remainder"))


_OPS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "floordiv": floordiv, "mod": mod,
    "pow": lambda a, b: F.pow(a, b), "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}


def arith(a: Column, b: Column, op: str, fill: object = None, swapped: bool = False) -> Column:
    """An operation; a value that is missing on one side counts as `fill`. swapped: b op a, as the r-methods do."""
    if fill is not None:
        both = a.isNull() & b.isNull()
        a, b = F.when(~both, F.coalesce(a, F.lit(fill))), F.when(~both, F.coalesce(b, F.lit(fill)))
    return _OPS[op](b, a) if swapped else _OPS[op](a, b)


def maximum(a: Column, b: Column) -> Column:
    """The greater of two; missing if one is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def lshift(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def rshift(a: Column, n: int) -> Column:
    return F.shiftright(a, n)


@dataclass(frozen=True)
class Interval:
    """Two columns as an interval; closed: right, left, both or neither."""

    left: Column
    right: Column
    closed: str = "right"

    def mid(self) -> Column:
        return (self.left + self.right) / 2

    def length(self) -> Column:
        return self.right - self.left

    def is_empty(self) -> Column:
        return (self.left == self.right) & F.lit(self.closed != "both")

    def contains(self, x: Column) -> Column:
        low = x >= self.left if self.closed in ("left", "both") else x > self.left
        return low & (x <= self.right if self.closed in ("right", "both") else x < self.right)

    def overlaps(self, other: Interval) -> Column:
        touch = self.closed == "both" and other.closed == "both" or (self.closed, other.closed) in (("both", "right"), ("right", "both"), ("left", "both"), ("both", "left"))
        return (self.left <= other.right) & (other.left <= self.right) if touch else (self.left < other.right) & (other.left < self.right)


def period(c: Column, freq: str) -> dict[str, Column]:
    """start_time, end_time (its last microsecond) and label of the day, month, quarter or year that a time lies in."""
    start = F.date_trunc(freq, c).cast("timestamp_ntz")
    step = {"day": "1 day", "month": "1 month", "quarter": "3 months", "year": "1 year", "week": "7 days"}[freq]
    label = {"day": F.date_format(c, "yyyy-MM-dd"), "month": F.date_format(c, "yyyy-MM"), "quarter": F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string")), "year": F.year(c).cast("string"), "week": F.date_format(F.date_trunc("week", c), "yyyy-MM-dd")}[freq]
    return {"start_time": start, "end_time": start + F.expr(f"interval {step}") - F.expr("interval 1 microsecond"), "label": label}


@dataclass(frozen=True)
class Categorical:
    """Known values of a text column in their order; other values count as missing."""

    categories: tuple[str, ...]
    ordered: bool = False

    @classmethod
    def of(cls, df: DataFrame, col: str, most: int = 10_000) -> Categorical:
        """The different values, sorted; an error if there are more than `most`."""
        got = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
        if len(got) > most:
            raise ValueError(f"{col} has more than {most} values")
        return cls(tuple(sorted(got)))

    def codes(self, c: Column) -> Column:
        """Places from 0; -1 for what is missing."""
        return (F.coalesce(F.array_position(F.array(*map(F.lit, self.categories)), c), F.lit(0)) - 1).cast("bigint")

    def values(self, codes: Column) -> Column:
        return F.when(codes >= 0, F.get(F.array(*map(F.lit, self.categories)), codes.cast("int")))

    def known(self, c: Column) -> Column:
        """The value, or null where it is no category."""
        return F.when(c.isin(list(self.categories)), c)

    def add_categories(self, *more: str) -> Categorical:
        if clash := {*more} & {*self.categories}:
            raise ValueError(f"{sorted(clash)} are categories already")
        return Categorical((*self.categories, *more), self.ordered)

    def set_categories(self, *own: str) -> Categorical:
        return Categorical(own, self.ordered)

    def remove_unused(self, df: DataFrame, col: str) -> Categorical:
        used = {r[0] for r in df.select(col).where(F.col(col).isin(list(self.categories))).distinct().collect()}  # categories at most
        return Categorical(tuple(c for c in self.categories if c in used), self.ordered)

    def rename(self, c: Column, names: dict[str, str]) -> tuple[Categorical, Column]:
        return Categorical(tuple(names.get(x, x) for x in self.categories), self.ordered), F.coalesce(*(F.when(c == F.lit(a), F.lit(b)) for a, b in names.items()), c)

    def as_ordered(self) -> Categorical:
        return Categorical(self.categories, True)

    def as_unordered(self) -> Categorical:
        return Categorical(self.categories, False)

    def less(self, c: Column, than: str) -> Column:
        if not self.ordered:
            raise ValueError("the categories have no order")
        return (self.codes(c) >= 0) & (self.codes(c) < self.categories.index(than))

    def counts(self, df: DataFrame, col: str) -> DataFrame:
        """category and count, 0 for those that no row has."""
        names = df.sparkSession.createDataFrame([(c,) for c in self.categories], "category string")
        own = df.groupBy(F.col(col).alias("category")).agg(F.count("*").alias("n"))
        return names.join(own, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("bigint")).alias("count"))


def is_kind(df: DataFrame, col: str, kind: str) -> bool:
    """Whether a column's type is numeric, integer, float, string, bool, datetime, list or dict."""
    base = dict(df.dtypes)[col].split("<")[0]
    numeric = base in _KINDS["integer"] + _KINDS["float"] or base.startswith("decimal")
    return numeric if kind == "numeric" else base in _KINDS[kind]


def kinds(df: DataFrame) -> DataFrame:
    """column, dtype and kind of each column."""
    own = [(c, t, next((k for k in ("integer", "float", "string", "bool", "datetime", "list", "dict") if is_kind(df, c, k)), "numeric" if is_kind(df, c, "numeric") else "object")) for c, t in df.dtypes]
    return df.sparkSession.createDataFrame(own, "column string, dtype string, kind string")


def memory_usage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column and bytes: of texts their UTF-8 bytes, of other values the width of their type; one pass."""
    width = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
    size = lambda c, t: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) if t == "string" else F.count("*") * width[t]
    rows = [F.struct(F.lit(c).alias("column"), size(c, t).cast("bigint").alias("bytes")) for c, t in df.dtypes if c in cols]
    return df.agg(F.count("*"), F.array(*rows).alias("r")).select(F.inline("r"))
