"""Row order: dense numbers, windows of bounded reach, and running values, without a task that holds all rows.

With partition keys a window function does. Without, rows are numbered once and cut into blocks
of numbers: a window of bounded reach gets copies of the rows around its block, and a running
value is made of one inside the block and a carry from the blocks before, one row for each block.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

POS, BLOCK = "__pos", "__block"
#: Rows to a block.
SIZE = 200_000


#: Rows of a few values that may be broadcast.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; only a local session may lack it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the session's checkpoint folder; sets one only for a local session without it."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/lariat-checkpoints")
    return df.checkpoint(eager=True)


def turned(order: Sequence[str | Column]) -> list[str]:
    """The keys of an order the other way round."""
    if any(isinstance(k, Column) for k in order):
        raise ValueError("an order that is turned round is given by names")
    return [k[1:] if k.startswith("-") else f"-{k}" for k in order]


def looked_up(rows: DataFrame, table: DataFrame, on: str, key: str, n: str) -> DataFrame:
    """rows joined with table, where on is key, for keys that all rows have; n tells how many rows have a key.

    A table of many keys is joined by a shuffle, but for the keys that so many rows have that there
    can't be more than FEW of them; these are broadcast, so that no task gets all rows of one.
    """
    size, whole = table.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    if size <= FEW:
        return rows.join(F.broadcast(table), F.col(on) == F.col(key))
    often = F.col(n) > max(1000, whole // FEW)
    hot = table.where(often)
    rare = rows.join(F.broadcast(hot.select(F.col(key).alias("__hot"))), F.col(on) == F.col("__hot"), "left_anti").join(table.where(~often), F.col(on) == F.col(key))
    return rare.unionByName(rows.join(F.broadcast(hot), F.col(on) == F.col(key)))


def keys(order: Sequence[str | Column]) -> list[Column]:
    """Sort keys, missing values last; a name with a minus sign descends."""
    out = []
    for k in order:
        if isinstance(k, Column):
            out.append(k)
        else:
            out.append(F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last())
    return out


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = POS) -> DataFrame:
    """df with dense numbers from 0 in the given order; rows that agree in it are numbered in any order."""
    part, at = "__part", "__at"
    done = cut(df.sort(*keys(order)).withColumn(at, F.monotonically_increasing_id()))
    done = done.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    starts, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in done.groupBy(part).count().collect()):  # one row for each partition
        starts.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(starts, f"{part} bigint, __start bigint")
    return done.join(F.broadcast(table), part).withColumn(name, F.col(at) + F.col("__start")).drop(part, at, "__start")


def over(df: DataFrame, made: dict[str, Callable[[WindowSpec], Column]], order: Sequence[str | Column], by: Sequence[str] = (), before: int = 0, after: int = 0, size: int = SIZE) -> DataFrame:
    """df with columns that window functions make which look at most `before` rows back and `after` rows ahead."""
    if by:
        w = Window.partitionBy(*by).orderBy(*keys(order))
        return df.withColumns({n: f(w) for n, f in made.items()})
    size = max(size, before + after)
    rows = numbered(df, order)
    home = F.floor(F.col(POS) / size).cast("bigint")
    first, last = F.floor((F.col(POS) - after) / size).cast("bigint"), F.floor((F.col(POS) + before) / size).cast("bigint")
    rows = rows.withColumn("__home", home).withColumn(BLOCK, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    w = Window.partitionBy(BLOCK).orderBy(POS)
    return rows.withColumns({n: f(w) for n, f in made.items()}).where(F.col("__home") == F.col(BLOCK)).drop(POS, BLOCK, "__home")


_WHOLE = {
    "sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "prod": F.product,
    "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True),
}


def _joined(kind: str, carry: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
    if kind == "prod":
        return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry * own)
    if kind == "last":
        return F.coalesce(own, carry)
    if kind == "first":
        return F.coalesce(carry, own)
    return F.greatest(carry, own) if kind == "max" else F.least(carry, own)


def running(df: DataFrame, made: dict[str, tuple[str, str]], order: Sequence[str | Column], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """df with running values: name -> (kind, column), over all rows up to and with the own one; nulls are passed over."""
    if by:
        w = Window.partitionBy(*by).orderBy(*keys(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: _WHOLE[kind](F.col(c)).over(w) for n, (kind, c) in made.items()})
    rows = numbered(df, order).withColumn(BLOCK, F.floor(F.col(POS) / size).cast("bigint"))
    w = Window.partitionBy(BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: _WHOLE[kind](F.col(c)).over(w) for n, (kind, c) in made.items()})
    ends = rows.groupBy(BLOCK).agg(*(F.max_by(F.struct(F.col(n).alias("v")), POS)["v"].alias(n) for n in made))
    over_blocks = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each SIZE rows
    carries = ends.select(BLOCK, *(_WHOLE["sum" if kind == "count" else kind](F.col(n)).over(over_blocks).alias(f"__c_{n}") for n, (kind, _) in made.items()))
    out = rows.join(carries, BLOCK)
    out = out.withColumns({n: _joined(kind, F.col(f"__c_{n}"), F.col(n)) for n, (kind, _) in made.items()})
    return out.drop(POS, BLOCK, *(f"__c_{n}" for n in made))


def decayed(rows: DataFrame, made: dict[str, Column], keep: float, at: str, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """rows with sums over all rows up to the own one, in which a value weighs keep ** (own number - its number).

    at: numbers from 0, without gaps and not falling in the order of the rows, in each group of
    `by`; null values count as 0. Sums are made in blocks in which the weights stay in range, and a
    block gets what is left of the blocks before it, as far back as a double can tell.
    """
    fall = -math.log(keep) if 0 < keep < 1 else math.inf if keep <= 0 else 0.0
    length = size if not fall else max(1, min(size, math.ceil(69 / fall)))  # 69: a weight of 1e-30
    reach = max(1, math.ceil(69 / (length * fall))) if fall else 1 << 30
    rows = rows.withColumn(BLOCK, F.floor(F.col(at) / length).cast("bigint"))
    j = F.col(at) - F.col(BLOCK) * length
    w = Window.partitionBy(*by, BLOCK).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    weight = lambda k: F.pow(F.lit(float(keep)), k)
    grown = (lambda x: x) if keep <= 0 else lambda x: x / weight(j)
    rows = rows.withColumns({n: F.sum(grown(F.coalesce(v, F.lit(0.0)))).over(w) * (weight(j) if keep > 0 else F.lit(1.0)) for n, v in made.items()})
    ends = cut(rows.groupBy(*by, BLOCK).agg(*(F.max_by(n, at).alias(f"__c_{n}") for n in made)))
    last = ends.agg(F.max(BLOCK)).first()[0]
    if not last:
        return rows.drop(BLOCK)
    steps = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(reach).cast("bigint"), F.lit(last) - F.col(BLOCK)))
    on = ends.where(F.col(BLOCK) < last).withColumn("__k", F.explode(steps))
    left = weight((F.col("__k") - 1) * length) if keep > 0 else F.when(F.col("__k") == 1, 1.0).otherwise(0.0)
    on = on.groupBy(*by, (F.col(BLOCK) + F.col("__k")).alias(BLOCK)).agg(*(F.sum(F.col(f"__c_{n}") * left).alias(f"__c_{n}") for n in made))
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by] + [F.col(f"r.{BLOCK}") == F.col(f"o.{BLOCK}")]
    out = rows.alias("r").join(on.alias("o"), reduce(Column.__and__, match), "left").select("r.*", *(F.col(f"o.__c_{n}") for n in made))
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0.0)) * (weight(j + 1) if keep > 0 else F.lit(0.0)) for n in made})
    return out.drop(BLOCK, *(f"__c_{n}" for n in made))


def around(df: DataFrame, known: Column, order: Sequence[str | Column], by: Sequence[str] = (), at: str = POS, size: int = SIZE) -> DataFrame:
    """df with `at`, its row numbers from 0 (in each group), and __before and __after: the last known value up to a row and the next from it on.

    known: a value that may use `at`; null where none is known. The next one is the last on the way
    back: a frame from a row to the end is read again for each row.
    """
    held, upto = "__held", (Window.unboundedPreceding, 0)
    if by:
        rows = df.withColumn(at, (F.row_number().over(Window.partitionBy(*by).orderBy(*keys(order))) - 1).cast("bigint"))
        group = Window.partitionBy(*by)
    else:
        rows = numbered(df, order, at).withColumn(BLOCK, F.floor(F.col(at) / size).cast("bigint"))
        group = Window.partitionBy(BLOCK)
    rows = rows.withColumn(held, known)
    ways = {"__before": F.col(at).asc(), "__after": F.col(at).desc()}
    for n, way in ways.items():
        rows = rows.withColumn(n, F.last(held, ignorenulls=True).over(group.orderBy(way).rowsBetween(*upto)))
    if by:
        return rows.drop(held)
    place = F.when(F.col(held).isNotNull(), F.col(at))
    ends = rows.groupBy(BLOCK).agg(F.max_by(held, place).alias("__l"), F.min_by(held, place).alias("__f"))
    over_blocks = {n: Window.orderBy(way).rowsBetween(Window.unboundedPreceding, -1) for n, way in (("__l", F.col(BLOCK).asc()), ("__f", F.col(BLOCK).desc()))}  # a row for each SIZE rows
    ends = ends.select(BLOCK, *(F.last(n, ignorenulls=True).over(w).alias(n) for n, w in over_blocks.items()))
    out = rows.join(F.broadcast(ends), BLOCK)
    return out.withColumns({"__before": F.coalesce("__before", "__l"), "__after": F.coalesce("__after", "__f")}).drop(BLOCK, held, "__l", "__f")
