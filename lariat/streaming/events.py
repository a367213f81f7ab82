"""Event-time processing; each function takes a streaming or a batch frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files to a micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def windowed(df: DataFrame, ts: str, length: str, made: dict[str, Column], by: Sequence[str] = (), slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Aggregates by tumbling windows, or sliding ones."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = _late(df, ts, delay).groupBy(w.alias("w"), *by).agg(*(c.alias(n) for n, c in made.items()))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, *made)


def sessions(df: DataFrame, ts: str, gap: str, made: dict[str, Column], by: Sequence[str], delay: str | None = None) -> DataFrame:
    """Aggregates by sessions: spells of a key without a gap of that length."""
    out = _late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*(c.alias(n) for n, c in made.items()))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *by, *made)


def dedupe(df: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key; with a delay, state is dropped behind the watermark."""
    if df.isStreaming and ts and delay:
        return _late(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


class Pipeline:
    """Steps that are recorded, and applied to a stream, to a batch, or chunk by chunk."""

    def __init__(self, steps: Sequence[Callable[[DataFrame], DataFrame]] = ()):
        self.steps = list(steps)

    def map(self, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline([*self.steps, step])

    def filter(self, condition: str | Column) -> Pipeline:
        return self.map(lambda df: df.where(condition))

    def reduce(self, *made: Column, by: Sequence[str] = ()) -> Pipeline:
        return self.map(lambda df: df.groupBy(*by).agg(*made))

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

    def collect(self, df: DataFrame, table: str, mode: str = "append") -> DataFrame:
        """Runs over what a stream has now; the result as a table in memory."""
        out = self(df)
        out.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return df.sparkSession.table(table)
