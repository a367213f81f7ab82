"""String methods as column functions; null in, null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _q(x: str) -> str:
    return re.escape(x)


def title(c: Column) -> Column:
    """Every run of letters with its first letter upper and the rest lower case."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def swapcase(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def _padding(c: Column, width: int, fill: str) -> Column:
    return F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(c), F.lit(0)))


def ljust(c: Column, width: int, fill: str = " ") -> Column:
    return F.concat(c, _padding(c, width, fill))


def rjust(c: Column, width: int, fill: str = " ") -> Column:
    return F.concat(_padding(c, width, fill), c)


def center(c: Column, width: int, fill: str = " ") -> Column:
    """As str.center: of an odd padding the left gets more if the width is odd."""
    need = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    left = F.floor(need / 2).cast("int") + need.bitwiseAND(F.lit(width % 2))
    return F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), need - left))


def zfill(c: Column, width: int) -> Column:
    """Zeros behind a sign, if any; longer texts stay whole."""
    sign = F.regexp_extract(c, "^[+-]", 0)
    return F.concat(sign, _padding(c, width, "0"), F.substr(c, F.length(sign) + 1))


def contains(c: Column, part: str, regex: bool = False, case: bool = True) -> Column:
    return F.regexp_like(c, F.lit(("" if case else "(?i)") + (part if regex else _q(part))))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def find(c: Column, part: str) -> Column:
    """Place of the first occurrence from 0, -1 without."""
    return (F.instr(c, part) - 1).cast("bigint")


def rfind(c: Column, part: str) -> Column:
    at = F.instr(F.reverse(c), part[::-1])
    return F.when(at == 0, F.when(c.isNotNull(), F.lit(-1))).otherwise(F.length(c) - at - len(part) + 1).cast("bigint")


def get(c: Column, i: int) -> Column:
    """A character by place, from the end if negative; null outside."""
    got = F.substr(c, F.lit(i + 1 if i >= 0 else i), F.lit(1))
    return F.when(F.length(c) >= (i + 1 if i >= 0 else -i), got)


def slice_(c: Column, start: int, stop: int) -> Column:
    return F.substr(c, F.lit(start + 1), F.lit(stop - start))


def slice_replace(c: Column, start: int, stop: int, new: str) -> Column:
    return F.concat(F.substr(c, F.lit(1), F.lit(start)), F.lit(new), F.substr(c, F.lit(stop + 1)))


def replace(c: Column, old: str, new: str, regex: bool = False) -> Column:
    return F.regexp_replace(c, old, new) if regex else F.replace(c, F.lit(old), F.lit(new))


def strip(c: Column, chars: str = " \t\n\r\f\v") -> Column:
    return F.btrim(c, F.lit(chars))


def lstrip(c: Column, chars: str = " \t\n\r\f\v") -> Column:
    return F.ltrim(c, F.lit(chars))


def rstrip(c: Column, chars: str = " \t\n\r\f\v") -> Column:
    return F.rtrim(c, F.lit(chars))


def split(c: Column, sep: str, n: int = -1) -> Column:
    """Parts at a literal separator; after n splits the rest stays whole."""
    return F.split(c, _q(sep), n + 1 if n > 0 else -1)


def rsplit(c: Column, sep: str, n: int = -1) -> Column:
    if n <= 0:
        return split(c, sep)
    parts = split(c, sep)
    head = F.greatest(F.size(parts) - n, F.lit(1))
    return F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), head), sep)), F.slice(parts, head + 1, F.lit(n)))


def partition(c: Column, sep: str) -> Column:
    at = F.instr(c, sep)
    return F.when(at == 0, F.array(c, F.lit(""), F.lit(""))).otherwise(F.array(F.substr(c, F.lit(1), at - 1), F.lit(sep), F.substr(c, at + len(sep))))


def rpartition(c: Column, sep: str) -> Column:
    at = rfind(c, sep).cast("int")
    return F.when(at < 0, F.array(F.lit(""), F.lit(""), c)).otherwise(F.array(F.substr(c, F.lit(1), at), F.lit(sep), F.substr(c, at + len(sep) + 1)))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def extractall(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def match(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(f"^(?:{pattern})"))


def fullmatch(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(rf"^(?:{pattern})\z"))


def isalnum(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^[\p{L}\p{N}]+\z"))


def isalpha(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^\p{L}+\z"))


def isdigit(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^\p{Nd}+\z"))


def isspace(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^\s+\z"))


def islower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def isupper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def istitle(c: Column) -> Column:
    return (c == title(c)) & F.regexp_like(c, F.lit(r"\p{Lu}"))


def wrap(c: Column, width: int) -> Column:
    """Lines of at most that many characters, broken at spaces, longer words alone."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(a: Column, w: Column) -> Column:
        fits = F.length(a["line"]) + 1 + F.length(w) <= width
        line = F.when(a["line"] == "", w).when(fits, F.concat(a["line"], F.lit(" "), w)).otherwise(w)
        done = F.when((a["line"] == "") | fits, a["done"]).otherwise(F.concat(a["done"], a["line"], F.lit("\n")))
        return F.struct(done.alias("done"), line.alias("line"))

    return F.aggregate(words, start, add, lambda a: F.concat(a["done"], a["line"]))


def cat(*cols: Column, sep: str = "") -> Column:
    """Texts joined; null if one is."""
    return F.when(~F.greatest(*(c.isNull() for c in cols)), F.concat_ws(sep, *cols)) if len(cols) > 1 else cols[0]


lower, upper, length, repeat = F.lower, F.upper, F.length, F.repeat


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def startswith(c: Column, part: str) -> Column:
    return F.startswith(c, F.lit(part))


def endswith(c: Column, part: str) -> Column:
    return F.endswith(c, F.lit(part))
