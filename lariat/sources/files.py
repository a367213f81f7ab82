"""Readers and writers; what is read lies on storage that all executors see."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lariat.operators.order import cut, numbered

#: Texts that stand for missing data.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, names: Sequence[str] | None = None, usecols: Sequence[str] | None = None, dtype: str | None = None,
    na_values: Sequence[str] = (), comment: str | None = None, quote: str = '"', encoding: str = "UTF-8", thousands: str | None = None, parse_dates: dict[str, str] | None = None, multiline: bool = False,
    skiprows: int | Callable[[Column], Column] = 0, skipfooter: int = 0, nrows: int | None = None, converters: dict[str, Callable[[Column], Column]] | None = None, true_values: Sequence[str] = (), false_values: Sequence[str] = (),
) -> DataFrame:
    """CSV with default and own missing tokens. dtype: a schema, which saves the pass that infers one.

    Own tokens and separators of thousands go before values get their types. skiprows (a number,
    or a test of line numbers from 0), skipfooter and nrows choose lines, which are then numbered
    over all files. converters: column -> function of the text's Column; true_values and
    false_values: texts of booleans.
    """
    given = StructType.fromDDL(dtype) if dtype else None
    late = bool(na_values or thousands or converters or true_values or false_values or skiprows or skipfooter or nrows is not None)
    if skiprows or skipfooter or nrows is not None:
        df = _chosen_lines(spark, path, sep, header, quote, comment, skiprows, skipfooter, nrows)
    else:
        reader = spark.read.option("sep", sep).option("header", header).option("quote", quote).option("escape", quote).option("encoding", encoding).option("multiLine", multiline)
        reader = reader.option("comment", comment) if comment else reader
        reader = reader.schema(given) if given is not None and not late else reader.option("inferSchema", not late)
        df = reader.csv(path)
    df = df.toDF(*names) if names else df.toDF(*given.names) if given is not None and late else df
    df = df.select(*usecols) if usecols else df
    tokens = [*MISSING, *na_values]
    df = df.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c, t in df.dtypes if t == "string"})
    if thousands:
        df = df.withColumns({c: F.when(F.col(c).rlike(rf"^[-+]?\d[\d{re.escape(thousands)}]*(\.\d+)?$"), F.replace(F.col(c), F.lit(thousands), F.lit(""))).otherwise(F.col(c)) for c, t in df.dtypes if t == "string"})
    if true_values or false_values:
        told = lambda c: F.when(F.col(c).isin(list(true_values)), F.lit("true")).when(F.col(c).isin(list(false_values)), F.lit("false")).otherwise(F.col(c))
        df = df.withColumns({c: told(c) for c, t in df.dtypes if t == "string"})
    df = df.withColumns({c: f(F.col(c)) for c, f in (converters or {}).items()})
    if given is not None and late:
        df = df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in given.fields if f.name in df.columns and f.name not in (converters or {})})
    elif late:
        df = infer(df)
    if parse_dates:
        df = df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(f)).cast("timestamp_ntz") for c, f in parse_dates.items()})
    return df


def _chosen_lines(spark: SparkSession, path: str, sep: str, header: bool, quote: str, comment: str | None, skiprows: int | Callable[[Column], Column], skipfooter: int, nrows: int | None) -> DataFrame:
    """Lines that are chosen by their number, as columns of text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    lines = cut(numbered(lines, ["f", "b", "m"], "no").select("value", "no"))
    whole = lines.count()
    gone = skiprows(F.col("no")) if callable(skiprows) else F.col("no") < skiprows
    left = lines.where(~gone & (F.col("no") < whole - skipfooter))
    left = left.where(~F.startswith("value", F.lit(comment))) if comment else left
    top = left.orderBy("no").limit(1).collect()
    parts = next(csv.reader([top[0][0]], delimiter=sep, quotechar=quote)) if top else []
    names = parts if header else [f"_c{i}" for i in range(len(parts))]
    left = left.where(F.col("no") > top[0][1]) if header and top else left
    left = left.orderBy("no").limit(nrows) if nrows is not None else left
    row = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep, "quote": quote, "escape": quote})
    return left.select(row.alias("r")).select("r.*")


def infer(df: DataFrame) -> DataFrame:
    """Columns of text as bigint, double, boolean or timestamp_ntz, where all their values are such; one pass."""
    texts = [c for c, t in df.dtypes if t == "string"]
    kinds = ("bigint", "double", "boolean", "timestamp_ntz")
    if not texts:
        return df
    fits = [F.array(F.count(c) > 0, *(F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), 1)) == 0 for k in kinds)).alias(c) for c in texts]
    row = df.agg(*fits).first()
    chosen = {c: next((k for k, ok in zip(kinds, row[c][1:], strict=True) if ok), None) for c in texts if row[c][0]}
    return df.withColumns({c: F.col(c).cast(k) for c, k in chosen.items() if k}) if any(chosen.values()) else df


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", by: Sequence[str] = (), **options) -> None:
    """parquet, csv, json, orc, xml or text files; by: columns that partition the folder."""
    out = df.write.mode(mode).options(**options)
    (out.partitionBy(*by) if by else out).format(format).save(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, lines: bool = True, orient: str = "records", schema: str | None = None) -> DataFrame:
    """JSON lines or one document of records. Other orients hold whole columns in one value: see from_columns()."""
    if orient != "records":
        return from_columns(spark, path)
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def from_columns(spark: SparkSession, path: str) -> DataFrame:
    """A document of orient columns: {name: {label: value}}, whose size one task has to hold by its format."""
    text = spark.read.option("wholetext", True).text(path)
    outer = text.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("name", "cells"))
    cells = outer.select("name", F.explode("cells").alias("label", "v"))
    return cells.groupBy("label").pivot("name").agg(F.first("v"))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_xml(spark: SparkSession, path: str, row: str) -> DataFrame:
    return spark.read.option("rowTag", row).xml(path)


def read_sql(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table or query over JDBC; partitionColumn and bounds among the options make it parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file, read on the driver: for tables that fit there."""
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(path))


def to_feather(df: DataFrame, path: str, compression: str = "uncompressed") -> None:
    """An Arrow IPC file, written on the driver."""
    import pyarrow.feather as feather

    feather.write_feather(df.toArrow(), path, compression=compression)


def to_text(df: DataFrame, kind: str = "csv", rows: int = 10_000) -> str:
    """A frame of at most so many rows as csv, json, html, markdown, latex or string; more is an error."""
    got = df.limit(rows + 1).toPandas()
    if len(got) > rows:
        raise ValueError(f"over {rows} rows; write files instead")
    if kind == "json":
        return got.to_json(orient="records")
    if kind == "csv":
        return got.to_csv(index=False)
    if kind == "markdown":
        head = [f"| {' | '.join(map(str, got.columns))} |", f"|{'---|' * len(got.columns)}"]
        return "\n".join([*head, *(f"| {' | '.join(map(str, r))} |" for r in got.itertuples(index=False))])
    if kind == "latex":
        lines = [" & ".join(re.sub(r"([&%$#_{}])", r"\\\1", str(v)) for v in r) + r" \\" for r in [got.columns, *got.itertuples(index=False)]]
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(got.columns)}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])
    return {"html": got.to_html, "string": got.to_string}[kind](index=False)
