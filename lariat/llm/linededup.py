"""Lines that repeat, whole or but for one edit, all over a corpus; DataFrame functions only.

Two lines within k edits agree in one of k + 1 segments of the shorter one. An index of such
segments, keyed by the shorter line's length, segment number and text, is probed with the
substrings of the longer line that can be that segment; candidates are verified with a banded
bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import OWN, cut, small_side, text_key, union
from lariat.llm.components import components

#: Edits between two lines of a class.
EDITS = 1
#: Lines shorter than this, blank ones, always stay.
SHORTEST = 1
#: Parts into which what the lines of a crowded bucket may differ in is cut.
PARTS = 8
#: Rows of three numbers that may be broadcast.
SMALL = 400_000


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, no, line) with white space at both ends of a line left out; blank lines have no row."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.select("id", text_key().alias("tk"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    return own.select("id", "tk", "no", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line")).where(F.length("line") >= SHORTEST)


def _hashes() -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")]


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Places (from 0) and sizes of the segments of a line of that length; later ones take the remainder."""
    size, longer = F.floor(length / (edits + 1)).cast("int"), F.pmod(length, F.lit(edits + 1)).cast("int")
    out, at = [], F.lit(0)
    for i in range(edits + 1):
        own = size + F.when(longer >= edits + 1 - i, 1).otherwise(0)
        out.append((at, own))
        at = at + own
    return out


def _keys(edits: int) -> list[tuple[Column, int, int]]:
    """(key, less, segment) for each index entry, first, and each probe of a line.

    less: how many characters shorter the lines are that the key stands for, 0 for the line's own
    entries. A segment of a line that is so much shorter can be found no further off its own place
    than the edits on either side of it allow.
    """
    key = lambda length, i, at, size: F.xxhash64(length, F.lit(i), F.substr(F.col("line"), at + 1, size))
    n = F.length("line")
    made = [(key(n, i, at, size), 0, i) for i, (at, size) in enumerate(_segments(n, edits))]
    for less in range(edits + 1):
        short = n - less
        for i, (at, size) in enumerate(_segments(short, edits)):
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                if less or shift:  # else it is the line's own entry
                    made.append((key(short, i, at + shift, size), less, i))
    return made


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that is used twice would else be evaluated twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _agree(x: Column, y: Column) -> Column:
    """How many characters two strings have in common at their begin, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(24))))
    most = F.least(F.length(x), F.length(y))
    longer = lambda at, s: F.when(at + s > most, at).when(F.substr(x, F.lit(1), at + s) == F.substr(y, F.lit(1), at + s), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), longer)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether b, no shorter than a, becomes a by so many insertions, deletions and substitutions.

    What both have in common at their ends is left off, as it does not count. For the rest,
    Hyyrö's recurrences run over the diagonal band: bits of the vectors are the band's rows, bit
    `edits` + d is the cell of diagonal d, and each step of the fold takes one character of b.
    The distance is followed along the band's last diagonal, where it never falls, and then along
    its last row, where it falls by twice `edits` at most; beyond three times these the steps do nothing.
    """
    one = F.lit(1).cast("bigint")
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("bigint")
    bit = lambda k: F.call_function("shiftleft", one, k)

    def step(v: Column, own: Column, j: Column) -> Column:
        """Column j (from 1); row i = j + r - edits is bit r; rows outside of the pattern match nothing."""
        x, y, m = v["x"], v["y"], v["m"]
        match = F.lit(0).cast("bigint")
        for r in range(width):
            i = j + (r - edits)
            match = match + F.when((i >= 1) & (i <= m) & (F.get(x, i - 1) == F.get(y, j - 1)), F.lit(1 << r).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return _let(match, lambda found: advance(v, own, found, j))

    def advance(v: Column, own: Column, match: Column, j: Column) -> Column:
        vp, vn = own["vp"], own["vn"]
        d0 = (((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn)).bitwiseAND(full)
        return _let(d0, lambda d0: closed(v, own, d0, j))

    def closed(v: Column, own: Column, d0: Column, j: Column) -> Column:
        vp, vn = own["vp"], own["vn"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full)
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        last = F.lit(1 << (width - 1)).cast("bigint")
        row = (v["m"] - j + edits).cast("int")  # bit of the pattern's last row
        slide = F.when(d0.bitwiseAND(last) != 0, 0).otherwise(1)
        flat = F.when(hp.bitwiseAND(bit(row)) != 0, 1).when(hn.bitwiseAND(bit(row)) != 0, -1).otherwise(0)
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (own["d"] + F.when(row >= width - 1, slide).otherwise(flat)).cast("int").alias("d"),
        )

    def distance(v: Column) -> Column:
        start = F.struct(full.bitwiseAND(F.bitwise_not(F.lit((1 << edits) - 1).cast("bigint"))).alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.least(F.lit(edits), v["m"]).alias("d"))
        return F.aggregate(F.sequence(F.lit(1), v["n"]), start, lambda own, j: F.when(own["d"] > 3 * edits, own).otherwise(step(v, own, j)))["d"]

    def rest(x: Column, y: Column, at: Column) -> tuple[Column, Column]:
        return F.reverse(F.substr(x, at + 1)).alias("x"), F.reverse(F.substr(y, at + 1)).alias("y")

    def cores(v: Column) -> Column:
        return _let(F.struct(*rest(v["x"], v["y"], _agree(v["x"], v["y"]))), lambda w: _let(F.struct(*rest(w["x"], w["y"], _agree(w["x"], w["y"]))), told))

    def told(v: Column) -> Column:
        whole = F.struct(F.split(v["x"], "").alias("x"), F.split(v["y"], "").alias("y"), F.length(v["x"]).alias("m"), F.length(v["y"]).alias("n"))
        return F.when(F.length(v["y"]) == 0, F.lit(0)).otherwise(_let(whole, distance))

    return (F.length(b) - F.length(a) <= edits) & (_let(F.struct(a.alias("x"), b.alias("y")), cores) <= edits)


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(h1, h2, line) of the lines with these h1, each once; copies meet after they have become one in each task."""
    own = lines.select("line", *_hashes())
    if ids.limit(SMALL + 1).count() <= SMALL:
        return own.join(F.broadcast(ids), "h1", "left_semi").dropDuplicates(["h1", "h2"])
    return own.dropDuplicates(["h1", "h2"]).join(ids, "h1", "left_semi")


def _live(entries: DataFrame, by: list[str]) -> DataFrame:
    """The keys that some index entry shares with another line's entry: how many do, and the least and greatest h1."""
    found = entries.groupBy(*by).agg(F.count("*").alias("n"), F.max("own").alias("own"), *(f(h).alias(c) for c, f, h in (("a", F.min, "h1"), ("b", F.max, "h1"), ("c", F.min, "h2"), ("d", F.max, "h2"))))
    return found.where("n > 1 and own and (a <> b or c <> d)").select(*by, "n", "a", "b")


def _parts(members: DataFrame) -> DataFrame:
    """Entries of a crowded bucket's lines, each without one of PARTS parts of what the lines may differ in.

    rest is that remainder of a line, m its length in the bucket's shorter lines; the longer ones
    have a character more in it. Lines that one edit tells apart agree in all parts but one.
    """
    m, longer = F.col("m"), F.when(F.col("own"), 0).otherwise(1)
    count = F.least(m, F.lit(PARTS))

    def part(i: Column) -> Column:
        a, b = F.floor(i * m / count).cast("int"), F.floor((i + 1) * m / count).cast("int")
        before, after = F.substr(F.col("rest"), F.lit(1), a), F.substr(F.col("rest"), b + longer + 1)
        return F.struct(F.xxhash64("sub", i, before, after).alias("sub"), F.substr(F.col("rest"), a + 1, b - a + longer).alias("rest"), (b - a).alias("m"))

    own = members.select("key", "own", "h1", "h2", F.explode(F.transform(F.sequence(F.lit(0), count - 1), part)).alias("p"))
    return own.select("key", "own", "h1", "h2", "p.*")


def _stars(entries: DataFrame) -> DataFrame:
    """Candidates (a, b) around one line of each group of entries (key, sub, v, centre, h1).

    The lines of a group are within the edits of any line that may be its centre.
    """
    own = entries.distinct()
    stars = own.groupBy("key", "sub", "v").agg(F.min(F.when(F.col("centre"), F.col("h1"))).alias("c"), F.count("*").alias("n"))
    return own.join(stars.where("n > 1 and c is not null"), ["key", "sub", "v"]).where("h1 <> c").select(F.col("h1").alias("a"), F.col("c").alias("b"))


def _one_place(members: DataFrame) -> DataFrame:
    """Star entries of lines that agree but for one character (m is 1) or for one that the longer line has more.

    Lines of one length are within one edit of each other. A longer line is within one edit of the
    shorter one that it becomes without one of its two characters there.
    """
    rest = F.col("rest")
    entry = lambda v, centre: F.struct(v.alias("v"), F.lit(centre).alias("centre"))
    same, mark = entry(F.lit("any"), True), lambda x: F.concat(F.lit("="), x)
    own = F.when(F.col("m") == 0, F.array(entry(mark(rest), True))).otherwise(F.array(same, entry(mark(rest), True)))
    ends = [entry(mark(F.substr(rest, F.lit(i), F.lit(1))), False) for i in (1, 2)]
    longer = F.when(F.col("m") == 0, F.array(entry(F.lit("="), False))).otherwise(F.array(*ends))
    return members.select("key", "sub", "h1", F.explode(F.when(F.col("own"), own).otherwise(longer)).alias("e")).select("key", "sub", "h1", "e.*")


def _crowded(members: DataFrame) -> DataFrame:
    """Candidates (a, b) of crowded buckets (key, own, segment, h1, h2, line), for one edit, whatever the number of lines.

    What the lines may differ in, the half beside their common segment, is cut into parts again
    and again, until a bucket has two lines or one character that differs.
    """
    short = F.length("line") - F.when(F.col("own"), 0).otherwise(1)
    half, longer = F.floor(short / 2).cast("int"), F.length("line") - short
    first = F.col("segment") == 0
    rest = F.when(first, F.substr(F.col("line"), half + 1)).otherwise(F.substr(F.col("line"), F.lit(1), half + longer))
    rows = members.select("key", "own", "h1", "h2", F.lit(0).cast("bigint").alias("sub"), rest.alias("rest"), F.when(first, short - half).otherwise(half).alias("m"))
    found = []
    while True:
        rows = cut(rows)
        found.append(_stars(_one_place(rows.where("m <= 1"))))
        rest = rows.where("m > 1")
        if rest.isEmpty():
            return union(found)
        fine = cut(_parts(rest))  # read twice; without the cut each entry would be made twice
        live = cut(_live(fine, ["key", "sub"]))
        found.append(live.where("n = 2").select("a", "b"))
        rows = fine.join(small_side(live.where("n > 2").select("key", "sub"), SMALL), ["key", "sub"])


def _choices(n: Column, k: int) -> Column:
    """All ways to choose k of the places 0 to n - 1, as ascending arrays."""
    if not k:
        return F.array(F.array().cast("array<int>"))

    def longer(c: Column) -> Column:
        start = F.coalesce(F.get(c, F.size(c) - 1) + 1, F.lit(0))
        places = F.when(start < n, F.sequence(start, n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(c, F.array(i)))

    return F.flatten(F.transform(_choices(n, k - 1), longer))


def _without(chars: Column, places: Column) -> Column:
    return F.filter(chars, lambda _, i: ~F.array_contains(places, i))


def _ways(gone: int, places: int, less: int, same: int, centre: bool) -> Column:
    """Star entries of a line: what is left of it without `gone` characters, and with so many places of that left out."""
    chars, size = F.split("line", ""), F.length("line")

    def shorter(d: Column) -> Column:
        left = _without(chars, d)

        def entries(s: int) -> Column:
            value = lambda at: F.xxhash64(F.lit(less), F.lit(same), at, F.array_join(_without(left, at), "\x00"))
            return F.transform(_choices(size - gone, s), lambda at: F.struct(value(at).cast("string").alias("v"), F.lit(centre).alias("centre")))

        out = entries(0)
        for s in range(1, places + 1):  # as many places as the line has
            out = F.when(size - gone >= s, entries(s)).otherwise(out)
        return out

    return F.flatten(F.transform(_choices(size, gone), shorter))


def _edited(members: DataFrame, edits: int) -> DataFrame:
    """Candidates (a, b) of crowded buckets (key, own, less, h1, line), for any number of edits.

    A line with p characters deleted, another with q deleted, and s places left out in both: lines
    that agree in that for s + p + q edits are a group, whose centre is of the side with fewer
    deletions. The entries of a line are as many as there are ways to edit it, so beyond one edit
    the cost of a line grows with a power of its length, never with the number of lines.
    """
    found = []
    for less in range(edits + 1):
        for p in range((edits - less) // 2 + 1):
            places = edits - less - 2 * p
            sides = [(F.col("own"), p, True)] + ([(F.col("less") == less, p + less, False)] if less else [])
            for when, gone, centre in sides:
                own = members.where(when).select("key", F.lit(0).cast("bigint").alias("sub"), "h1", F.explode(_ways(gone, places, less, p, centre)).alias("e"))
                found.append(own.select("key", "sub", "h1", "e.*"))
    return _stars(union(found))


def links(distinct: DataFrame, lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Edges (a, b), structs of h1 and h2, that connect every two lines within so many edits.

    distinct: a row for each different line with h1, h2 and keys; lines: all, to take the texts of
    candidates from. A key that two lines share makes them candidates; where more do, candidates
    come from what one edit leaves, so that their number grows with the lines, not with their pairs.
    """
    made = _keys(edits)
    told = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("e") + 1)
    keyed = distinct.select("h1", "h2", F.posexplode("keys").alias("e", "key")).withColumn("own", F.col("e") <= edits)
    some = cut(_live(keyed, ["key"]))
    pairs = some.where("n = 2").select("a", "b")
    members = keyed.join(small_side(some.where("n > 2").select("key"), SMALL), "key")
    members = cut(members.select("key", "own", told([x[1] for x in made]).alias("less"), told([x[2] for x in made]).alias("segment"), "h1", "h2"))
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("h1"))
    text = cut(_texts(lines, ends(pairs).unionByName(members.select("h1")).distinct()))
    if not members.isEmpty():
        own = members.join(text, ["h1", "h2"])
        pairs = pairs.unionByName(_crowded(own) if edits == 1 else _edited(own, edits))
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    node = F.struct("h1", "h2")
    x, y = (text.select(F.col("h1").alias(h), node.alias(n), F.col("line").alias(t)) for h, n, t in (("a", "u", "x"), ("b", "v", "y")))
    met = pairs.join(x, "a").join(y, "b").where("u <> v")
    turned = F.length("x") > F.length("y")
    met = met.select("u", "v", F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y"))
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(spread, "u", "v").where(within(F.col("x"), F.col("y"), edits)).select(F.col("u").alias("a"), F.col("v").alias("b"))


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """(id, tk, gone): for each document with such lines the lines that are not the first of their class.

    A class is what links of so many edits connect, equal lines among it. Its first line is that
    of the smallest id (null last), text hash and number. gone: structs of the line's number, and
    id and number of its class's first line.
    """
    lines = _lines(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tk", "no")
    distinct = lines.select(*_hashes(), order.alias("at"), F.array(*(k for k, _, _ in _keys(edits))).alias("keys")).groupBy("h1", "h2")
    distinct = cut(distinct.agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    near = cut(components(links(distinct, lines, edits), "a", "b").select("node.*", F.struct("root.h1", "root.h2").alias("root")))
    told = distinct.select("h1", "h2", "at", "n").join(small_side(near, SMALL), ["h1", "h2"], "left")
    told = told.where("n > 1 or root is not null").select("h1", "h2", "at", "n", F.coalesce("root", F.struct("h1", "h2")).alias("root"))
    first = told.groupBy("root").agg(F.min("at").alias("first"))
    told = cut(told.join(first, "root").select("h1", "h2", "n", "first"))
    met = _told(lines.select("id", "tk", "no", order.alias("at"), *_hashes()), told)
    met = met.where(F.col("at") != F.col("first")).groupBy("id", "tk")
    return met.agg(F.array_sort(F.collect_set(F.struct("no", F.col("first.id").alias("first_id"), F.col("first.no").alias("first_no")))).alias("gone"))


def _told(lines: DataFrame, told: DataFrame) -> DataFrame:
    """The lines with their row of told (h1, h2, n and more), n being how many copies a line has.

    A large told is joined by a shuffle, but for the lines that have so many copies that there can't
    be more than SMALL of them; these are broadcast, so that no task gets all copies of one.
    """
    size, copies = told.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size <= SMALL:
        return lines.join(F.broadcast(told), ["h1", "h2"])
    often = F.col("n") > max(1000, copies // SMALL)
    rare = lines.join(told.where(often).select("h1", "h2").hint("broadcast"), ["h1", "h2"], "left_anti").join(told.where(~often), ["h1", "h2"])
    return rare.unionByName(lines.join(F.broadcast(told.where(often)), ["h1", "h2"]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, told: str | None = None) -> DataFrame:
    """docs with the lines of dropped() taken out of their texts; all rows and columns stay.

    told names a column to add with what dropped() says, an empty list where nothing went; a
    ValueError if docs has it already. Null texts stay null, empty ones empty; blank lines always
    stay, and so do the lines' own spaces. Rows that agree in id and text are one document and keep
    the same lines. No rows give no rows; a line of any length is one line.
    """
    if told in docs.columns:
        raise ValueError(f"docs has a column {told}")
    gone = dropped(docs.select(id_col, text_col), id_col, text_col, edits).select(F.col("id").alias(f"{OWN}id"), F.col("tk").alias(f"{OWN}tk"), F.col("gone").alias(f"{OWN}gone"))
    match = F.col(id_col).eqNullSafe(F.col(f"{OWN}id")) & (text_key(text_col) == F.col(f"{OWN}tk"))
    numbers = F.transform(F.col(f"{OWN}gone"), lambda x: x["no"])
    kept = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), numbers)
    rest = F.transform(F.array(F.split(F.col(text_col), "\n")), lambda p: F.array_join(F.transform(kept(p), lambda i: F.get(p, i)), "\n"))
    text = F.when(F.col(f"{OWN}gone").isNull(), F.col(text_col)).otherwise(F.get(rest, F.lit(0))).alias(text_col)
    out = [text if c == text_col else F.col(c) for c in docs.columns]
    empty = F.array().cast("array<struct<no: int, first_id: " + docs.schema[id_col].dataType.simpleString() + ", first_no: int>>")
    extra = [F.coalesce(F.col(f"{OWN}gone"), empty).alias(told)] if told else []
    return docs.join(gone, match, "left").select(*out, *extra)
