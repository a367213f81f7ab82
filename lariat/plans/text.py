"""Queries of string methods and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lariat.functions import strings as s
from lariat.plans.registry import query

#: SQL of each method over p (p_type) and b (p_brand).
_TEXT = {
    "lower": "lower(p)",
    "upper": "upper(p)",
    "len": "length(p)",
    "casefold": "lower(p)",
    "capitalize": "upper(p[1]) || lower(p[2:])",
    "title": "array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')",
    "swapcase": "lower(p)",
    "strip": "trim('  ' || p || ' ')",
    "lstrip": "p || ' '",
    "rstrip": "'  ' || p",
    "ljust": "CASE WHEN length(p) < 25 THEN rpad(p, 25, '*') ELSE p END",
    "rjust": "CASE WHEN length(p) < 25 THEN lpad(p, 25, '*') ELSE p END",
    "center": "repeat('-', (30 - length(p)) // 2) || p || repeat('-', 30 - length(p) - (30 - length(p)) // 2)",
    "pad": "lpad(b, 12, '.')",
    "zfill": "lpad(p_size::VARCHAR, 5, '0')",
    "contains": "contains(p, 'STEEL')",
    "contains_regex": "regexp_matches(p, 'S(TEEL|MALL)')",
    "startswith": "starts_with(p, 'S')",
    "endswith": "ends_with(p, 'L')",
    "count": "length(p) - length(replace(p, 'E', ''))",
    "find": "instr(p, 'E') - 1",
    "rfind": "CASE WHEN instr(p, 'E') = 0 THEN -1 ELSE length(p) - instr(reverse(p), 'E') END",
    "index": "instr(b, '#') - 1",
    "rindex": "length(b) - instr(reverse(b), '#')",
    "get": "p[3]",
    "get_negative": "p[-1]",
    "slice": "p[2:5]",
    "slice_replace": "p[1:2] || '_' || p[6:]",
    "replace": "replace(p, 'E', 'e')",
    "replace_regex": "regexp_replace(p, '[AEIOU]+', '.', 'g')",
    "repeat": "repeat(b, 2)",
    "cat": "p || '-' || b",
    "extract": "regexp_extract(b, '#(\\d)', 1)",
    "match": "regexp_matches(p, '^S')",
    "fullmatch": "regexp_full_match(b, 'Brand#1\\d')",
    "isalnum": "regexp_full_match(p, '[A-Za-z0-9]+')",
    "isalpha": "regexp_full_match(p, '[A-Za-z]+')",
    "isdigit": "regexp_full_match(p_size::VARCHAR, '[0-9]+')",
    "isspace": "false",
    "islower": "p = lower(p) AND p <> upper(p)",
    "isupper": "p = upper(p) AND p <> lower(p)",
    "istitle": "false",
    "split_get": "string_split(p, ' ')[1]",
    "split_n": "'a ' || b",
    "rsplit": "p || ' a'",
    "partition": "'a ' || b",
    "rpartition": "p || ' a'",
    "extractall": "array_to_string(regexp_extract_all(p, '[AEIOU]'), '')",
    "wrap": "replace(p, ' ', chr(10))",
    "encode": "octet_length(encode(p))",
    "decode": "p",
    "get_dummies": "contains(p, 'STEEL')::INT",
}


def _columns() -> dict[str, Column]:
    """The same in column functions."""
    C, B = F.col("p_type"), F.col("p_brand")
    return {
        "lower": s.lower(C),
        "upper": s.upper(C),
        "len": s.length(C),
        "casefold": s.casefold(C),
        "capitalize": s.capitalize(C),
        "title": s.title(C),
        "swapcase": s.swapcase(F.upper(C)),
        "strip": s.strip(F.concat(F.lit("  "), C, F.lit(" "))),
        "lstrip": s.lstrip(F.concat(F.lit("  "), C, F.lit(" "))),
        "rstrip": s.rstrip(F.concat(F.lit("  "), C, F.lit(" "))),
        "ljust": s.ljust(C, 25, "*"),
        "rjust": s.rjust(C, 25, "*"),
        "center": s.center(C, 30, "-"),
        "pad": s.rjust(B, 12, "."),
        "zfill": s.zfill(F.col("p_size").cast("string"), 5),
        "contains": s.contains(C, "STEEL"),
        "contains_regex": s.contains(C, "S(TEEL|MALL)", regex=True),
        "startswith": s.startswith(C, "S"),
        "endswith": s.endswith(C, "L"),
        "count": s.count(C, "E"),
        "find": s.find(C, "E"),
        "rfind": s.rfind(C, "E"),
        "index": s.find(B, "#"),
        "rindex": s.rfind(B, "#"),
        "get": s.get(C, 2),
        "get_negative": s.get(C, -1),
        "slice": s.slice_(C, 1, 5),
        "slice_replace": s.slice_replace(C, 2, 5, "_"),
        "replace": s.replace(C, "E", "e"),
        "replace_regex": s.replace(C, "[AEIOU]+", ".", regex=True),
        "repeat": s.repeat(B, 2),
        "cat": s.cat(C, B, sep="-"),
        "extract": s.extract(B, r"#(\d)"),
        "match": s.match(C, "S"),
        "fullmatch": s.fullmatch(B, r"Brand#1\d"),
        "isalnum": s.isalnum(C),
        "isalpha": s.isalpha(C),
        "isdigit": s.isdigit(F.col("p_size").cast("string")),
        "isspace": s.isspace(C),
        "islower": s.islower(C),
        "isupper": s.isupper(C),
        "istitle": s.istitle(F.concat(C, F.lit(" xY"))),
        "split_get": F.get(s.split(C, " "), F.lit(0)),
        "split_n": F.get(s.split(F.concat(C, F.lit(" a "), B), " ", 1), F.lit(1)),
        "rsplit": F.get(s.rsplit(F.concat(C, F.lit(" a "), B), " ", 1), F.lit(0)),
        "partition": F.get(s.partition(F.concat(C, F.lit(" a "), B), " "), F.lit(2)),
        "rpartition": F.get(s.rpartition(F.concat(C, F.lit(" a "), B), " "), F.lit(0)),
        "extractall": F.array_join(s.extractall(C, "[AEIOU]"), ""),
        "wrap": s.wrap(C, 4),
        "encode": F.octet_length(F.encode(C, "UTF-8")),
        "decode": F.decode(F.encode(C, "UTF-8"), "UTF-8"),
        "get_dummies": s.contains(C, "STEEL").cast("int"),
    }


for _n, _sql in _TEXT.items():
    query(f"str_{_n}", f"SELECT p_partkey, {_sql} AS x FROM (SELECT *, p_type AS p, p_brand AS b FROM part)", lambda t, n=_n: t.part.select("p_partkey", _columns()[n].alias("x")))

_MATH = (("abs", "abs(x)", F.abs), ("floor", "floor(x)", lambda c: F.floor(c).cast("double")), ("ceil", "ceil(x)", lambda c: F.ceil(c).cast("double")), ("sqrt", "round(sqrt(abs(x)), 6)", lambda c: F.round(F.sqrt(F.abs(c)), 6)), ("exp", "round(exp(x / 10000), 6)", lambda c: F.round(F.exp(c / 10000), 6)),
         ("log", "round(ln(abs(x) + 1), 6)", lambda c: F.round(F.log(F.abs(c) + 1), 6)), ("log10", "round(log10(abs(x) + 1), 6)", lambda c: F.round(F.log10(F.abs(c) + 1), 6)), ("log2", "round(log2(abs(x) + 1), 6)", lambda c: F.round(F.log2(F.abs(c) + 1), 6)), ("sin", "round(sin(x), 6)", lambda c: F.round(F.sin(c), 6)),
         ("cos", "round(cos(x), 6)", lambda c: F.round(F.cos(c), 6)), ("negative", "-x", lambda c: -c), ("pow", "round(power(x / 1000, 2), 6)", lambda c: F.round(F.pow(c / 1000, F.lit(2)), 6)), ("floordiv", "floor(x / 7)", lambda c: F.floor(c / 7).cast("double")))
for _n, _sql, _f in _MATH:
    query(f"math_{_n}", f"SELECT c_custkey, {_sql} AS y FROM (SELECT c_custkey, c_acctbal AS x FROM customer)", lambda t, f=_f: t.customer.select("c_custkey", f(F.col("c_acctbal")).alias("y")))


def _tenth(x: pd.Series) -> pd.Series:
    return x * 0.1


def _spread(x: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"event_type": [x["event_type"].iloc[0]], "spread": [round(float(x["value"].max() - x["value"].min()), 4)]})


def _span(x: pd.Series) -> float:
    return float(x.max() - x.min())


class _Words:
    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            yield w, i


query("udf_scalar", "SELECT s_suppkey, round(s_acctbal * 0.1, 4) AS x FROM supplier", lambda t: t.supplier.select("s_suppkey", F.round(F.pandas_udf(_tenth, "double")("s_acctbal"), 4).alias("x")))
query("udf_grouped_map", "SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY 1", lambda t: t.events.select("event_type", "value").groupBy("event_type").applyInPandas(_spread, "event_type string, spread double"))
query("udf_grouped_agg", "SELECT event_type, round(max(value) - min(value), 4) AS span FROM events GROUP BY 1", lambda t: t.events.groupBy("event_type").agg(F.round(F.pandas_udf(_span, "double")("value"), 4).alias("span")))
query("udtf_split", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, generate_subscripts(string_split(p_type, ' '), 1)::INT - 1 AS at FROM part",
      lambda t: t.part.lateralJoin(F.udtf(_Words, returnType="word string, at int")(F.col("p_type").outer())).select("p_partkey", "word", "at"))
