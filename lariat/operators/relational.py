"""Selection, joins, stacking, duplicates and sorting."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.operators.order import cut, keys, running, turned

_NUMBER = ("tinyint", "smallint", "int", "bigint", "float", "double")
_KINDS = {"number": _NUMBER, "integer": _NUMBER[:4], "float": _NUMBER[4:], "object": ("string",), "string": ("string",), "bool": ("boolean",), "datetime": ("timestamp", "timestamp_ntz", "date")}


def select_dtypes(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Columns of kinds such as number, integer, float, string, bool, datetime, or of Spark types."""
    of = lambda names: {t for n in names for t in _KINDS.get(n, (n,))}
    return df.select(*(c for c, t in df.dtypes if (not include or t in of(include)) and t not in of(exclude)))


def query(df: DataFrame, text: str, **names) -> DataFrame:
    """Rows for which a Python-like condition holds; @x stands for an argument."""
    return df.where(expression(text, names))


def _named(text: str) -> str:
    """@x as a name; what stands in a literal stays."""
    marks = [t.start[1] for t in tokenize.generate_tokens(io.StringIO(text.replace("\n", " ")).readline) if t.type == tokenize.OP and t.string == "@"]
    return "".join("__at_" if i in marks else c for i, c in enumerate(text.replace("\n", " ")))


def expression(text: str, names: dict | None = None) -> Column:
    """A Column of a Python-like expression over column names: arithmetic, comparison chains, and, or, not, in, abs and the like. Nothing is evaluated as code."""
    names = names or {}
    tree = ast.parse(_named(text.strip()), mode="eval").body
    binary = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Mod: "__mod__", ast.Pow: "__pow__", ast.BitAnd: "__and__", ast.BitOr: "__or__"}
    compare = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}

    def of(node: ast.AST) -> Column:
        if isinstance(node, ast.Name):
            return F.lit(names[node.id[5:]]) if node.id.startswith("__at_") else F.col(node.id)
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.BoolOp):
            return reduce(Column.__and__ if isinstance(node.op, ast.And) else Column.__or__, map(of, node.values))
        if isinstance(node, ast.UnaryOp):
            return -of(node.operand) if isinstance(node.op, ast.USub) else ~of(node.operand) if isinstance(node.op, (ast.Not, ast.Invert)) else of(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = of(node.left), of(node.right)
            if isinstance(node.op, ast.Div):
                return F.try_divide(a.cast("double"), b.cast("double"))
            if isinstance(node.op, ast.FloorDiv):
                return F.floor(F.try_divide(a, b))
            if type(node.op) in binary:
                return getattr(a, binary[type(node.op)])(b)
        if isinstance(node, ast.Compare):
            parts, left = [], node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, (ast.In, ast.NotIn)):
                    values = names[right.id[5:]] if isinstance(right, ast.Name) else [x.value for x in right.elts]
                    hit = F.coalesce(of(left).isin(list(values)), F.lit(False))  # a missing value is in no list
                    parts.append(~hit if isinstance(op, ast.NotIn) else hit)
                else:
                    parts.append(getattr(of(left), compare[type(op)])(of(right)))
                left = right
            return reduce(Column.__and__, parts)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("abs", "sqrt", "exp", "log", "floor", "ceil", "round"):
            return getattr(F, node.func.id)(*map(of, node.args))
        raise ValueError(f"{ast.dump(node)} is not known in a query")

    return of(tree)


def where(df: DataFrame, cols: Sequence[str], condition: Column, other: object = None) -> DataFrame:
    """Values of the columns where the condition holds, else `other`."""
    return df.withColumns({c: F.when(condition, F.col(c)).otherwise(other if isinstance(other, Column) else F.lit(other)) for c in cols})


#: Pairs of a key's rows that may be made in one place; rows of a side that meet at once for keys with more; the most tasks for these.
PAIRS, PIECE, TASKS = 250_000, 2_000, 4_096


def _crowded(l: DataFrame, r: DataFrame, lk: list[str], rk: list[str]) -> DataFrame | None:
    """The keys that make more than PAIRS pairs, as l_0.. and r_0.., with __a and __b, how many pieces either side has, and __first, the number of their first pair of pieces."""
    whole, kinds = _NUMBER[:4], (dict(l.dtypes), dict(r.dtypes))
    if any(kinds[0][a] != kinds[1][b] and not (kinds[0][a] in whole and kinds[1][b] in whole) for a, b in zip(lk, rk, strict=True)):
        return None  # different keys may be equal once converted
    x = l.groupBy(*(F.col(c).alias(f"l_{i}") for i, c in enumerate(lk))).agg(F.count("*").alias("__a"))
    y = r.groupBy(*(F.col(c).alias(f"r_{i}") for i, c in enumerate(rk))).agg(F.count("*").alias("__b"))
    met = x.join(y, _equal(x, [f"l_{i}" for i in range(len(lk))], y, [f"r_{i}" for i in range(len(rk))])).where(F.col("__a").cast("double") * F.col("__b") > PAIRS)
    met = met.withColumns({n: F.ceil(F.col(n) / PIECE) for n in ("__a", "__b")})
    before = Window.orderBy(*(f"l_{i}" for i in range(len(lk)))).rowsBetween(Window.unboundedPreceding, -1)  # a row for each crowded key, of which there are few
    return cut(met.withColumn("__first", F.coalesce(F.sum(F.col("__a") * F.col("__b")).over(before), F.lit(0))))


def _equal(a: DataFrame, ka: Sequence[str], b: DataFrame, kb: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[x] == b[y] for x, y in zip(ka, kb, strict=True)])


def _paired(l: DataFrame, r: DataFrame, lk: list[str], rk: list[str], how: str) -> DataFrame:
    """The join of l and r, without a task that makes all pairs of a key that many rows of both have.

    The rows of such a key are dealt into pieces by a hash, and each piece of one side meets each of
    the other as a group of its own. All these rows have a partner, so they are joined inner, however
    the hash falls; the other rows are joined as usual. A full join would also hold a key's pairs at once.
    """
    crowded = None if l.isStreaming or r.isStreaming else _crowded(l, r, lk, rk)
    pieces = 0 if crowded is None else crowded.agg(F.sum(F.col("__a") * F.col("__b"))).first()[0]
    if not pieces:
        return l.join(r, _equal(l, lk, r, rk), how)
    sides, rest, tasks = [], [], min(TASKS, pieces)
    for side, ks, mark, own, other in ((l, lk, "l_", "__a", "__b"), (r, rk, "r_", "__b", "__a")):
        hot = F.broadcast(crowded.select(*(F.col(f"{mark}{i}").alias(f"__k{i}") for i in range(len(ks))), "__a", "__b", "__first"))
        on = _equal(side, ks, hot, [f"__k{i}" for i in range(len(ks))])
        piece = F.pmod(F.xxhash64(*(c for c, t in side.dtypes if "map<" not in t and "variant" not in t)), F.col(own))
        rows = side.join(hot, on).withColumn("__i", piece).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        place = F.col("__first") + (F.col("__i") * F.col("__b") + F.col("__j") if own == "__a" else F.col("__j") * F.col("__b") + F.col("__i"))
        sides.append(rows.select(*side.columns, place.alias(f"__p{own}")).repartition(tasks, f"__p{own}"))  # by number, so that they are not put together for their few bytes
        rest.append(side.join(hot, on, "left_anti"))
    dense = sides[0].hint("merge").join(sides[1], F.col("__p__a") == F.col("__p__b")).drop("__p__a", "__p__b")
    return dense.unionByName(rest[0].join(rest[1], _equal(rest[0], lk, rest[1], rk), how))


def merge(
    left: DataFrame, right: DataFrame, on: Sequence[str] = (), how: str = "inner", left_on: Sequence[str] = (), right_on: Sequence[str] = (), suffixes: tuple[str, str] = ("_x", "_y"),
    indicator: bool = False, validate: str | None = None,
) -> DataFrame:
    """An equi-join: inner, left, right, outer, cross, semi or anti. Null keys match nothing.

    Columns on both sides that are no common key get the suffixes; common keys appear once, from
    whichever side has the row. indicator adds _merge; validate ("1:1", "1:m", "m:1") raises
    ValueError if keys repeat where they may not.
    """
    lk, rk = list(on or left_on), list(on or right_on)
    sides = {"1:1": ((left, lk), (right, rk)), "1:m": ((left, lk),), "m:1": ((right, rk),)}.get(validate or "m:m", ())
    for side, k in sides:
        if not side.groupBy(*k).count().where("count > 1").isEmpty():
            raise ValueError(f"keys {k} are not unique, as {validate} asks")
    if how in ("semi", "anti"):
        right = right.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(rk)))
        return left.join(right, reduce(Column.__and__, [left[c] == right[f"__k{i}"] for i, c in enumerate(lk)]), f"left_{how}")
    common = set(left.columns) & set(right.columns) - set(on)
    l = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), F.lit(True).alias("__l"))
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.lit(True).alias("__r"))
    if how == "cross":
        out = l.crossJoin(r)
    else:
        out = _paired(l, r, [f"l_{c}" for c in lk], [f"r_{c}" for c in rk], {"outer": "full"}.get(how, how))
    cols = [F.coalesce(f"l_{c}", f"r_{c}").alias(c) if c in on else F.col(f"l_{c}").alias(c + suffixes[0] if c in common else c) for c in left.columns]
    cols += [F.col(f"r_{c}").alias(c + suffixes[1] if c in common else c) for c in right.columns if c not in on]
    if indicator:
        cols.append(F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both").alias("_merge"))
    return out.select(*cols)


def merge_asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), direction: str = "backward", tolerance: Column | None = None, exact: bool = True, right_on: str | None = None) -> DataFrame:
    """Each left row with the right row whose key is the last at or before it (forward: the first at or after; nearest: the closer, the earlier of equals).

    Both sides are stacked and ordered by the key, and the right rows are carried along: one
    sort, no product of the sides. Right columns come with the key as `on`_right. tolerance: the
    greatest distance of keys.
    """
    key = right_on or on
    extra = [c for c in right.columns if c not in by and c != key]
    held = F.struct(F.col(key).alias("k"), *(F.col(c) for c in extra))
    shape = right.select(held.alias("r")).schema["r"].dataType
    side = lambda df, at, mine, rest: df.select(F.col(at).alias("__k"), *by, F.lit(mine).alias("__side"), *rest)
    whole = F.struct(*(F.col(c) for c in left.columns))
    stacked = side(left, on, 1, [whole.alias("__l"), F.lit(None).cast(shape).alias("__b")]).withColumn("__f", F.col("__b"))
    rows = right.where(F.col(key).isNotNull()).select("*", held.alias("__h"))
    none = F.lit(None).cast(left.select(whole.alias("l")).schema["l"].dataType)
    stacked = stacked.unionByName(side(rows, key, 0, [none.alias("__l"), F.col("__h").alias("__b"), F.col("__h").alias("__f")]))
    tie = lambda first: F.col("__side").asc() if first == exact else F.col("__side").desc()
    if direction in ("backward", "nearest"):
        stacked = running(stacked, {"__back": ("last", "__b")}, [F.col("__k").asc_nulls_first(), tie(True)], by)
    if direction in ("forward", "nearest"):
        stacked = running(stacked, {"__fore": ("last", "__f")}, [F.col("__k").desc_nulls_first(), tie(True)], by)
    number = lambda c: c.cast("timestamp").cast("double") if dict(left.dtypes)[on].startswith("timestamp") else c.cast("double")
    far = lambda c: F.abs(number(F.col("__k")) - number(c))
    best = {"backward": lambda: F.col("__back"), "forward": lambda: F.col("__fore")}.get(direction)
    if best is None:
        b, f = F.col("__back"), F.col("__fore")
        pick = F.when(b.isNull(), f).when(f.isNull(), b).when(far(b["k"]) <= far(f["k"]), b).otherwise(f)
    else:
        pick = best()
    out = stacked.where(F.col("__side") == 1).withColumn("__p", pick)
    if tolerance is not None:
        out = out.withColumn("__p", F.when(far(F.col("__p.k")) <= tolerance, F.col("__p")))
    clash = set(left.columns)
    return out.select("__l.*", F.col("__p.k").alias(f"{on}_right"), *(F.col(f"__p.{c}").alias(f"{c}_right" if c in clash else c) for c in extra))


def concat(frames: Sequence[DataFrame], join: str = "outer", keys_: Sequence[str] | None = None) -> DataFrame:
    """Frames below each other by column name; join inner keeps common columns, outer all. keys_ adds a column key."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)] if join == "inner" else list(dict.fromkeys(c for f in frames for c in f.columns))
    own = [f.select(*(c for c in names if c in f.columns), *([F.lit(k).alias("key")] if keys_ else [])) for f, k in zip(frames, keys_ or [None] * len(frames), strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def combine_first(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of both by key; values of the left, and of the right where these are null."""
    r = right.select(*on, *(F.col(c).alias(f"__r_{c}") for c in right.columns if c not in on))
    out = left.join(r, list(on), "full")
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    value = lambda c: F.coalesce(*(F.col(x) for x in (c, f"__r_{c}") if x in out.columns)).alias(c)
    return out.select(*(F.col(c) if c in on else value(c) for c in names))


def compare(left: DataFrame, right: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys at which a column differs, with c_self and c_other; null where equal."""
    r = right.select(*on, *(F.col(c).alias(f"__r_{c}") for c in cols))
    out = left.select(*on, *cols).join(r, list(on))
    differ = {c: ~F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols}
    made = [x for c in cols for x in (F.when(differ[c], F.col(c)).alias(f"{c}_self"), F.when(differ[c], F.col(f"__r_{c}")).alias(f"{c}_other"))]
    return out.where(reduce(Column.__or__, differ.values())).select(*on, *made)


def duplicated(df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str = "first", name: str = "duplicated") -> DataFrame:
    """Whether a row repeats one before it (after it; or, for keep none, any other), nulls equal."""
    group = Window.partitionBy(*subset)
    if keep == "none":
        return df.withColumn(name, F.count("*").over(group) > 1)
    return df.withColumn(name, F.row_number().over(group.orderBy(*keys(order if keep == "first" else turned(order)))) > 1)


def drop_duplicates(df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """The first (last) row of each group of equal values, or those that no other row equals (none).

    One shuffle; of a group no task gets more than one row from each task before it.
    """
    if keep == "none":
        rows = df.groupBy(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(subset))).agg(F.first(F.struct(*df.columns)).alias("__r"), F.count("*").alias("__n"))
        return rows.where("__n = 1").select("__r.*")
    place = F.row_number().over(Window.partitionBy(*subset).orderBy(*keys(order if keep == "first" else turned(order))))
    return df.withColumn("__n", place).where("__n = 1").drop("__n")


def sort_values(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sorted, missing values last in either direction."""
    return df.orderBy(*keys(order))


def nlargest(df: DataFrame, n: int, col: str, order: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(col).isNotNull()).orderBy(F.desc(col), *keys(order)).limit(n)


def nsmallest(df: DataFrame, n: int, col: str, order: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(col).isNotNull()).orderBy(F.asc(col), *keys(order)).limit(n)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys(order)).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys([k[1:] if k.startswith("-") else f"-{k}" for k in order])).limit(n)


def slice_rows(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows start to stop - 1 in the order."""
    from lariat.operators.order import numbered

    return numbered(df, order).where((F.col("__pos") >= start) & (F.col("__pos") < stop)).drop("__pos")


def sample(df: DataFrame, share: float, seed: int, by: Sequence[str]) -> DataFrame:
    """About that share of the rows, chosen by a hash of the keys, so the same ones however the rows lie."""
    hashed = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *by)), 1, 8)
    return df.where(hashed < f"{int(share * (1 << 32)):08x}") if share < 1 else df


def index_op(left: DataFrame, right: DataFrame, col: str, kind: str) -> DataFrame:
    """Distinct labels: union, intersection, difference or symmetric_difference."""
    a, b = left.select(col).distinct(), right.select(F.col(right.columns[0] if col not in right.columns else col).alias(col)).distinct()
    if kind == "union":
        return a.union(b).distinct()
    if kind == "intersection":
        return a.intersect(b)
    if kind == "difference":
        return a.subtract(b)
    return a.subtract(b).union(b.subtract(a))
