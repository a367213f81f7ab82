"""A reproducible shuffle of all rows into shards of one size.

Rows are numbered 0 to n - 1 in the order of a key. A Feistel network permutes the numbers: it
works on pairs of digits of bases a and b with a * b >= n, and numbers that land at n or beyond
walk on along their cycle until they are back inside. Shard and slot are remainder and quotient
of the permuted number, so both follow from a row's number alone, and the number from them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import OWN, cut

ROUNDS = 8


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of good avalanche, keyed by addition."""
    x = x.astype(np.uint64) + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A bijection of 0 .. n - 1 that a seed determines."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = n
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = [(seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64) for r in range(rounds)]

    def _once(self, x: np.ndarray, sign: int) -> np.ndarray:
        left, right = (x // self.b).astype(np.int64), (x % self.b).astype(np.int64)
        steps = list(enumerate(self.keys))
        for r, key in steps[::sign]:
            if r % 2:
                right = (right + sign * (_mix(left, key) % np.uint64(self.b)).astype(np.int64)) % self.b
            else:
                left = (left + sign * (_mix(right, key) % np.uint64(self.a)).astype(np.int64)) % self.a
        return left * self.b + right

    def _walk(self, x: np.ndarray, sign: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self._once(np.asarray(x, dtype=np.int64), sign)
            while (out := x >= self.n).any():
                x[out] = self._once(x[out], sign)
        return x

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, 1)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, -1)

    def place(self, row: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers."""
        at = self.forward(row)
        return at % shards, at // shards

    def row(self, shard: np.ndarray, slot: np.ndarray, shards: int) -> np.ndarray:
        """The row numbers that lie at these places."""
        return self.backward(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64))


def number(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with its rows numbered from 0 in the given order (nulls first), and their number.

    The sorted rows are written once, by a checkpoint; the numbers of the partitions, one count
    each, are all that meets in one place. Rows that agree in the whole order are interchangeable.
    """
    part, at = f"{OWN}part", f"{OWN}at"
    done = cut(df.sort(*order).withColumn(at, F.monotonically_increasing_id()))
    done = done.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = done.groupBy(part).count().collect()  # a row for each partition
    starts, total = [], 0
    for p, size in sorted(tuple(r) for r in sizes):
        starts.append((p, total))
        total += size
    table = df.sparkSession.createDataFrame(starts, f"{part} bigint, {OWN}start bigint")
    return done.join(F.broadcast(table), part).withColumn(name, F.col(at) + F.col(f"{OWN}start")).drop(part, at, f"{OWN}start"), total


def shards(df: DataFrame, order: list[str], count: int, seed: int = 0) -> DataFrame:
    """df with shard (int, 0 to count - 1) and slot (long, gapless from 0 in each shard).

    Shards differ by one row at most, whatever the rows hold. Nulls in the order come first;
    repeated rows take places of their own; no rows give no rows. df must not have columns
    shard and slot.
    """
    if clash := {"shard", "slot"} & {*df.columns}:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    rows, total = number(df, order, f"{OWN}row")
    permutation = Permutation(total, seed)

    @F.pandas_udf("shard int, slot bigint")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in parts:
            shard, slot = permutation.place(x.to_numpy(), count)
            yield pd.DataFrame({"shard": shard.astype("int32"), "slot": slot})

    return rows.withColumn(f"{OWN}p", place(f"{OWN}row")).select(*df.columns, f"{OWN}p.shard", f"{OWN}p.slot")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc): 16 bytes besides the UTF-8 bytes of the text, and its CRC-32. Null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
