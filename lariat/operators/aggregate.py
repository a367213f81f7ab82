"""Reductions of whole frames and of groups."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.operators import windows
from lariat.operators.order import cut, keys

#: Different values of each column that a table of pairs may have.
LEVELS = 1000


def _skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


#: Reductions that are one aggregate expression, so that any number of them is one pass.
PLAIN: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "median": F.median,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)), "prod": F.product, "nunique": F.count_distinct, "skew": _skew, "kurt": _kurt,
    "any": lambda c: F.max(c.cast("boolean")), "all": lambda c: F.min(c.cast("boolean")),
}


#: Values that one percentile may hold at once.
HELD = 2_000_000


def quantile_of(c: Column, q: float | list[float]) -> Column:
    """Linear interpolation between the values on either side; for groups, whose values meet in one buffer."""
    return F.percentile(c, q if isinstance(q, float) else F.array(*map(F.lit, q)))


def quantiles(df: DataFrame, col: str, shares: Sequence[float]) -> list[float | None]:
    """The exact quantiles of a whole column, with linear interpolation.

    Few values are ranked at once. Of many, sketches of bounded size give bounds between which each
    quantile lies; what lies between is counted, bounded again while it is too much, and ranked.
    """
    own = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    whole = own.count()
    if not whole:
        return [None] * len(shares)
    if whole <= HELD:
        return list(own.agg(F.percentile("v", F.array(*map(F.lit, map(float, shares))))).first()[0])
    return [_between(own, whole, (whole - 1) * q) for q in shares]


def _between(own: DataFrame, size: int, place: float) -> float:
    """The value at a place, from 0, of the sorted values, on the line between its neighbours."""
    while size > HELD:
        near = [min(1.0, max(0.0, place / size + d)) for d in (-3e-4, 3e-4)]
        low, high = own.agg(F.percentile_approx("v", F.array(*map(F.lit, near)), 10_000)).first()[0]
        inside = F.col("v").between(low, high)
        below, within = own.agg(F.count(F.when(F.col("v") < low, 1)), F.count(F.when(inside, 1))).first()
        if not below <= math.floor(place) <= math.ceil(place) < below + within or within == size:
            break  # many equal values: few different ones are left
        own, size, place = own.where(inside), within, place - below
    return own.agg(F.percentile("v", place / max(1, size - 1))).first()[0]


def quantile(df: DataFrame, made: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a quantile for each name: name -> (column, share)."""
    values = {n: quantiles(df, c, [q])[0] for n, (c, q) in made.items()}
    return df.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(n) for n, v in values.items()))


def reduce(df: DataFrame, cols: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """One row with col_kind for each pair; all but medians in one pass."""
    out = df.agg(F.count("*").alias("__n"), *(PLAIN[k](F.col(c)).alias(f"{c}_{k}") for c in cols for k in kinds if k != "median"))
    if "median" in kinds:
        out = out.withColumns({f"{c}_median": F.lit(quantiles(df, c, [0.5])[0]).cast("double") for c in cols})
    return out.select(*(f"{c}_{k}" for c in cols for k in kinds))


def mad(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute deviation from the mean, as col_mad: means first, then deviations, both pre-aggregated."""
    if not by:
        centre = df.agg(F.avg(col)).first()[0]
        return df.agg(F.avg(F.abs(F.col(col) - F.lit(centre))).alias(f"{col}_mad"))
    means = df.groupBy(*by).agg(F.avg(col).alias("__mean")).select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), "__mean")
    match = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)])
    return df.join(means, match).groupBy(*by).agg(F.avg(F.abs(F.col(col) - F.col("__mean"))).alias(f"{col}_mad"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max as rows, a column each."""
    names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    quarters = {c: [F.lit(v).cast("double") for v in quantiles(df, c, (0.25, 0.5, 0.75))] for c in cols}
    made = [F.array(F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), *quarters[c], F.max(c).cast("double")).alias(c) for c in cols]
    row = df.agg(*made).withColumn("stat", F.array(*map(F.lit, names)))
    return row.select(F.inline(F.arrays_zip("stat", *cols)))


def value_counts(df: DataFrame, cols: Sequence[str], normalize: bool = False, dropna: bool = True) -> DataFrame:
    """count (or proportion) of each value, the most frequent first, then by value."""
    own = df.dropna(subset=list(cols)) if dropna else df
    out = own.groupBy(*cols).agg(F.count("*").alias("count"))
    if normalize:
        out = out.select(*cols, (F.col("count") / F.lit(float(max(1, own.count())))).alias("proportion"))
    return out.orderBy(F.desc("proportion" if normalize else "count"), *cols)


def mode(df: DataFrame, col: str) -> DataFrame:
    """All values of the greatest count, ascending."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("m"))
    return counts.join(F.broadcast(most), F.col("n") == F.col("m")).select(col).orderBy(col)


def pairwise(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation (pearson, spearman) or covariance (cov) matrix as rows x, y, value; pairs with a null are left out, pair by pair."""
    if method == "spearman":
        for c in cols:
            df = windows.rank(df, c, "average", name=f"__r_{c}")
        df = df.select(*(F.col(f"__r_{c}").alias(c) for c in cols))
    made = []
    for a in cols:
        for b in cols:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
            made.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (F.covar_samp(x, y) if method == "cov" else windows.correlation(x, y)).alias("value")))
    return df.agg(F.array(*made).alias("m")).select(F.inline("m"))


def idx(df: DataFrame, col: str, label: str, most: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The label of the greatest (least) value, of any type that has an order; of equals the least label."""
    values = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("__v")).agg(F.min(label).alias("__l"))
    return values.groupBy(*by).agg((F.max_by if most else F.min_by)("__l", "__v").alias(f"idx{'max' if most else 'min'}"))


def corrwith(left: DataFrame, right: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """column, corr: the correlation of equally named columns of two frames that a key aligns; in one pass."""
    r = right.select(*on, *(F.col(c).cast("double").alias(f"__r_{c}") for c in cols))
    made = [F.struct(F.lit(c).alias("column"), windows.correlation(F.col(c), F.col(f"__r_{c}")).alias("corr")) for c in cols]
    return left.join(r, list(on)).agg(F.array(*made).alias("m")).select(F.inline("m"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau: Kendall's rank correlation with ties, tau-b, from the counts of the different pairs of values.

    Pairs of rows are counted from a table of the values' counts, of which each column may have LEVELS
    different ones: its running sums are all that is needed.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    cells = cut(both.groupBy("a", "b").agg(F.count("*").cast("double").alias("n")))
    levels = cells.agg(F.count_distinct("a"), F.count_distinct("b")).first()
    if max(levels) > LEVELS:
        raise ValueError(f"more than {LEVELS} different values; put them into bins first")
    names = sorted(r[0] for r in cells.select("b").distinct().collect())  # bounded by LEVELS
    wide = cells.groupBy("a").agg(*(F.coalesce(F.sum(F.when(F.col("b") == F.lit(v), F.col("n"))), F.lit(0.0)).alias(f"c{i}") for i, v in enumerate(names)))
    rows = wide.orderBy("a").collect()  # at most LEVELS rows of LEVELS numbers
    above, concordant, discordant = [0.0] * len(names), 0.0, 0.0
    for r in rows:
        left, right = 0.0, sum(above)
        for i, n in enumerate(r[1:]):
            right -= above[i]
            concordant += n * left
            discordant += n * right
            left += above[i]
        above = [x + n for x, n in zip(above, r[1:], strict=True)]
    total = sum(above)
    pairs = lambda counts: sum(n * (n - 1) / 2 for n in counts)
    scale = ((pairs([total]) - pairs([sum(r[1:]) for r in rows])) * (pairs([total]) - pairs(above))) ** 0.5
    return df.sparkSession.range(1).select(F.lit((concordant - discordant) / scale if scale else None).cast("double").alias("tau"))


def valid_index(df: DataFrame, col: str, label: str, last: bool = False) -> DataFrame:
    """The label of the first (last) row, in the order of labels, that has a value."""
    own = F.when(F.col(col).isNotNull(), F.col(label))
    return df.agg((F.max if last else F.min)(own).alias("last_valid" if last else "first_valid"))


def dot(left: DataFrame, right: DataFrame, on: str, col: str, cols: Sequence[str]) -> DataFrame:
    """The products of a column with each column of another frame that a key aligns, summed, as one row."""
    r = right.select(F.col(on).alias("__k"), *(F.col(c).alias(f"__r_{c}") for c in cols))
    return left.join(r, F.col(on) == F.col("__k")).agg(*(F.sum(F.col(col) * F.col(f"__r_{c}")).alias(c) for c in cols))


def _whole_groups(function: Callable, by: Sequence[str]) -> Callable:
    """The function over batches of rows sorted by keys, of which each frame gets whole groups; the last group of a batch waits for the next."""

    def tail(batch):
        """Rows before the first one that has the last row's keys."""
        same = True
        for c in by:
            key = batch[c].iloc[-1]
            same &= batch[c].isna() if pd.isna(key) else batch[c] == key
        return len(batch) - int(same.sum())

    def over(batches):
        held = []
        for batch in batches:
            if not len(batch):
                continue
            if held and tail(pd.concat([held[-1].tail(1), batch.head(1)])):
                yield function(pd.concat(held))
                held = []
            if n := tail(batch):
                yield function(pd.concat([*held, batch.head(n)]))
                held = []
            held.append(batch.iloc[n:])
        if held:
            yield function(pd.concat(held))

    return over


class GroupBy:
    """Groups of the rows of a frame by keys; rows with a missing key belong to none.

    order: keys that say what first, last, shift and the like mean; they should tell all rows apart.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str] = (), dropna: bool = True):
        self.by, self.order = list(by), list(order)
        self.df = df.dropna(subset=self.by) if dropna else df

    def _order(self) -> Column:
        if not self.order:
            raise ValueError("this needs an order of the rows")
        return F.struct(*(F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("v")) for k in self.order))

    def agg(self, spec: dict[str, str | Sequence[str]]) -> DataFrame:
        """col_kind for each column and kind."""
        pairs = [(c, k) for c, ks in spec.items() for k in ([ks] if isinstance(ks, str) else ks)]
        return self.df.groupBy(*self.by).agg(*(self._one(c, k).alias(f"{c}_{k}") for c, k in pairs))

    def _one(self, col: str, kind: str) -> Column:
        c = F.col(col)
        if kind in ("first", "last"):
            pick = F.min_by if kind == "first" else F.max_by
            return pick(c, F.when(c.isNotNull(), self._order()))
        return PLAIN[kind](c)

    def reduce(self, kind: str, *cols: str) -> DataFrame:
        return mad(self.df, cols[0], self.by) if kind == "mad" else self.agg({c: kind for c in cols})

    def size(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.count("*").alias("size"))

    def quantile(self, col: str, q: float) -> DataFrame:
        return self.df.groupBy(*self.by).agg(quantile_of(F.col(col), q).alias(f"{col}_quantile"))

    def describe(self, col: str) -> DataFrame:
        c = F.col(col)
        quarters = [F.percentile(c, q).alias(f"{col}_q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
        return self.df.groupBy(*self.by).agg(F.count(c).alias(f"{col}_count"), F.avg(c).alias(f"{col}_mean"), F.stddev_samp(c).alias(f"{col}_std"), F.min(c).alias(f"{col}_min"), *quarters, F.max(c).alias(f"{col}_max"))

    def corr(self, a: str, b: str) -> DataFrame:
        return self.df.groupBy(*self.by).agg(windows.correlation(F.col(a), F.col(b)).alias("corr"))

    def cov(self, a: str, b: str) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.covar_samp(a, b).alias("cov"))

    def idxmax(self, col: str, label: str) -> DataFrame:
        return idx(self.df, col, label, True, self.by)

    def idxmin(self, col: str, label: str) -> DataFrame:
        return idx(self.df, col, label, False, self.by)

    def ngroup(self, name: str = "ngroup") -> DataFrame:
        """Number of each row's group in the order of the keys; the distinct keys are numbered, not the rows."""
        from lariat.operators.order import numbered

        groups = numbered(self.df.select(*self.by).distinct(), self.by, name)
        return self._joined(groups)

    def _joined(self, made: DataFrame, how: str = "inner") -> DataFrame:
        """The rows with what each group has, missing keys equal."""
        keyed = made.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(self.by)), *(c for c in made.columns if c not in self.by))
        match = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(self.by)])
        out = self.df.join(keyed, match, how)
        return out if how == "left_semi" else out.drop(*(f"__g{i}" for i in range(len(self.by))))

    def groups(self, label: str) -> DataFrame:
        """first, last and size of the labels of each group."""
        return self.df.groupBy(*self.by).agg(F.min(label).alias("first"), F.max(label).alias("last"), F.count("*").alias("size"))

    def corrwith(self, col: str, other: str) -> DataFrame:
        return self.corr(col, other)

    def fillna(self, col: str, value: object, name: str | None = None) -> DataFrame:
        return self.df.withColumn(name or col, F.coalesce(F.col(col), F.lit(value)))

    def _window(self):
        return Window.partitionBy(*self.by).orderBy(*keys(self.order))

    def cumcount(self, name: str = "cumcount") -> DataFrame:
        return self.df.withColumn(name, (F.row_number().over(self._window()) - 1).cast("bigint"))

    def nth(self, n: int) -> DataFrame:
        """The nth row of each group, from 0; from the end if negative."""
        w = self._window() if n >= 0 else Window.partitionBy(*self.by).orderBy(*keys([k[1:] if k.startswith("-") else f"-{k}" for k in self.order]))
        at = n + 1 if n >= 0 else -n
        return self.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == at).drop("__n")

    def head(self, n: int) -> DataFrame:
        return self.df.withColumn("__n", F.row_number().over(self._window())).where(F.col("__n") <= n).drop("__n")

    def tail(self, n: int) -> DataFrame:
        w = Window.partitionBy(*self.by).orderBy(*keys([k[1:] if k.startswith("-") else f"-{k}" for k in self.order]))
        return self.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")

    def get_group(self, *key) -> DataFrame:
        out = self.df
        for c, v in zip(self.by, key, strict=True):
            out = out.where(F.col(c) == F.lit(v))
        return out

    def transform(self, col: str, kind: str, name: str | None = None) -> DataFrame:
        """The group's reduction at each of its rows: aggregated first, so that only results are joined back."""
        made = self.reduce(kind, col).withColumnRenamed(f"{col}_{kind}", name or f"{col}_{kind}")
        return self._joined(made)

    def filter(self, col: str, kind: str, test: Callable[[Column], Column]) -> DataFrame:
        """The rows of the groups whose reduction passes the test."""
        made = (self.size().withColumnRenamed("size", "__v") if kind == "size" else self.reduce(kind, col).withColumnRenamed(f"{col}_{kind}", "__v")).where(test(F.col("__v"))).select(*self.by)
        return self._joined(made, "left_semi")

    def apply(self, function: Callable, schema: str, many: bool = False) -> DataFrame:
        """A function of each group as a pandas frame; a group must fit into a task.

        many: of frames that hold several whole groups, for functions that tell these apart
        themselves; a call for each group takes milliseconds.
        """
        if not many:
            return self.df.groupBy(*self.by).applyInPandas(function, schema)
        return self.df.repartition(*self.by).sortWithinPartitions(*self.by).mapInPandas(_whole_groups(function, self.by), schema)

    def shift(self, col: str, n: int = 1, name: str | None = None) -> DataFrame:
        return windows.shift(self.df, col, n, self.order, self.by, name=name)

    def diff(self, col: str, n: int = 1, name: str | None = None) -> DataFrame:
        return windows.diff(self.df, col, n, self.order, self.by, name)

    def pct_change(self, col: str, n: int = 1, name: str | None = None) -> DataFrame:
        return windows.pct_change(self.df, col, n, self.order, self.by, name)

    def cumulative(self, col: str, kind: str, name: str | None = None) -> DataFrame:
        return windows.cumulative(self.df, col, kind, self.order, self.by, name)

    def ffill(self, col: str, name: str | None = None) -> DataFrame:
        return windows.fill(self.df, col, self.order, self.by, name=name)

    def bfill(self, col: str, name: str | None = None) -> DataFrame:
        return windows.fill(self.df, col, self.order, self.by, back=True, name=name)

    def rank(self, col: str, method: str = "average", name: str = "rank") -> DataFrame:
        return windows.rank(self.df, col, method, self.by, self.order, name=name)

    def rolling(self, col: str, window: int, kind: str, **more) -> DataFrame:
        return windows.rolling(self.df, col, window, kind, self.order, self.by, **more)

    def expanding(self, col: str, kind: str, **more) -> DataFrame:
        return windows.expanding(self.df, col, kind, self.order, self.by, **more)

    def ewm(self, col: str, alpha: float, kind: str = "mean", **more) -> DataFrame:
        return windows.ewm(self.df, col, alpha, kind, self.order, self.by, **more)
