"""A lazy frame: recorded steps are Spark's own logical plan, so they keep their written order and its optimiser moves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.operators import relational


class LazyFrame:
    def __init__(self, df: DataFrame, order: tuple[str, ...] = ()):
        self.df, self.order = df, order

    def _with(self, df: DataFrame) -> LazyFrame:
        return LazyFrame(df, self.order)

    def filter(self, condition: str | Column) -> LazyFrame:
        return self._with(relational.query(self.df, condition) if isinstance(condition, str) else self.df.where(condition))

    def select(self, *cols) -> LazyFrame:
        return self._with(self.df.select(*cols))

    def with_column(self, name: str, value: Column | str) -> LazyFrame:
        return self._with(self.df.withColumn(name, relational.expression(value) if isinstance(value, str) else value))

    def with_columns(self, **made: Column) -> LazyFrame:
        return self._with(self.df.withColumns(made))

    def drop(self, *cols: str) -> LazyFrame:
        return self._with(self.df.drop(*cols))

    def sort_by(self, *order: str) -> LazyFrame:
        return LazyFrame(relational.sort_values(self.df, order), order)

    def head(self, n: int) -> LazyFrame:
        return self._with(self.df.limit(n) if not self.order else relational.head(self.df, n, self.order))

    def tail(self, n: int) -> LazyFrame:
        return self._with(relational.tail(self.df, n, self.order))

    def groupby(self, *by: str) -> LazyGroup:
        return LazyGroup(self, by)

    def explain(self) -> str:
        return self.df._jdf.queryExecution().toString()

    def collect(self) -> DataFrame:
        return self.df


class LazyGroup:
    def __init__(self, frame: LazyFrame, by: tuple[str, ...]):
        self.frame, self.by = frame, by

    def agg(self, **made: tuple[str, str]) -> LazyFrame:
        from lariat.operators.aggregate import PLAIN

        return LazyFrame(self.frame.df.groupBy(*self.by).agg(*(PLAIN[k](F.col(c)).alias(n) for n, (c, k) in made.items())))
