"""Completion text functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"


def strip_text(x: Column) -> Column:
    """remove leading and trailing white space (SQL ``trim`` only drops spaces)."""
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def rstrip_text(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+\z", "")


def drop_prefix_chars(x: Column, prefix: Column) -> Column:
    """drop ``length(prefix)`` characters from the front."""
    return F.substr(x, F.length(prefix) + 1)


def stop_at(x: Column, stops: list[str]) -> Column:
    """text before the earliest occurrence of any stop string."""
    if not stops:
        return x
    hits = F.filter(F.array(*[F.instr(x, s) for s in stops]), lambda i: i > 0)
    first = F.array_min(hits)
    return F.when(first.isNull(), x).otherwise(F.substring(x, F.lit(1), first - 1))


def prompt_code(prompt: Column, completion: Column) -> Column:
    """the program text a completion belongs to."""
    return F.concat(prompt, completion)


def keep_until(code: Column, end_line: Column, end_col: Column) -> Column:
    """lines ``0..end_line`` with the last one cut at ``end_col`` (0-based)."""
    lines = F.slice(F.split(code, NL, -1), 1, end_line + 1)
    last = F.substring(F.element_at(lines, -1), F.lit(1), end_col)
    head = F.slice(lines, 1, F.size(lines) - 1)
    return F.array_join(F.concat(head, F.array(last)), NL)
