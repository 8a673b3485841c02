"""Metadata parsing and corpus predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# one token of a Python literal: a string (quotes and escapes whole), a bracket,
# a comma, a bare word or number, white space, or any other character
_TOKEN = r'''"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[\[\](){},:]|[A-Za-z0-9_.+-]++|\s++|(?s:.)'''
_WORDS = {"None": "null", "True": "true", "False": "false"}


def _json_token(t: Column) -> Column:
    """A token as JSON: strings in double quotes, bare words and tuples by their JSON twins."""
    inner = F.substr(t, F.lit(2), F.length(t) - 2)
    single = F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
    out = (F.when(t.startswith("'") & (F.length(t) > 1), F.concat(F.lit('"'), single, F.lit('"')))
           .when(t.startswith('"') & (F.length(t) > 1), F.replace(t, F.lit("\\'"), F.lit("'")))
           .when(t == "(", "[").when(t == ")", "]"))
    for word, twin in _WORDS.items():
        out = out.when(t == word, twin)
    return out.otherwise(t)


def parse_meta(meta: Column) -> Column:
    """Python dict literal -> ``map<string,string>``; malformed input ->
    null.  Strings keep what they hold; ``None``, ``True`` and ``False`` are
    read as values only; tuples are arrays; trailing commas are allowed.
    Nested values come back as JSON text."""
    tokens = F.filter(F.regexp_extract_all(meta, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"\A\s+\z"))
    json = F.transform(tokens, _json_token)
    # a comma before a closing bracket goes
    kept = F.transform(F.arrays_zip(json.alias("t"), F.concat(F.slice(json, 2, F.greatest(F.size(json) - 1, F.lit(0))), F.array(F.lit(""))).alias("next")),
                       lambda x: F.when((x["t"] == ",") & x["next"].isin("]", "}"), "").otherwise(x["t"]))
    return F.from_json(F.array_join(kept, ""), "map<string,string>")


def has_key(m: Column, key: str) -> Column:
    """Key present (even with a null value)."""
    return F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))


def key_equals(m: Column, key: str, value: str) -> Column:
    """Key present and equal."""
    return F.coalesce(m[key] == F.lit(value), F.lit(False))


def key_int_at_least(m: Column, key: str, bound: int) -> Column:
    """Integer value >= bound; non-numeric or absent -> false."""
    return F.coalesce(m[key].try_cast("int") >= F.lit(bound), F.lit(False))


def extension(path: Column) -> Column:
    """the last ``.``-separated piece (the whole path when it has none)."""
    return F.element_at(F.split(path, r"[.]", -1), -1)


def language_from_path(path: Column) -> Column:
    """'java' for ``.java`` paths, 'python' otherwise."""
    return F.when(path.endswith(".java"), F.lit("java")).otherwise(F.lit("python"))


def contains_any(text: Column, needles: list[str]) -> Column:
    """P10: case-sensitive substring test for any needle."""
    cond = F.lit(False)
    for n in needles:
        cond = cond | text.contains(n)
    return cond
