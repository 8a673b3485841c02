"""Source-code rules as built-in expressions.

Code is cut into lexical tokens by one regular expression (strings, comments,
brackets, line ends, everything else); a fold over the tokens keeps the
bracket depth.  Completions are bounded by the sampling budget, so a fold over
one stays small.  Python and Java, chosen by a language column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibspark.functions.text import NL, drop_prefix_chars, prompt_code, strip_text

HELD = "\u0001"  # stands for a line end inside brackets or a string

_STRINGS = r'''"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?'''
PY_TOKEN = (r'''"""(?s:.*?)(?:"""|\z)|\'\'\'(?s:.*?)(?:\'\'\'|\z)|''' + _STRINGS
            + r'''|#[^\n]*+|\\\n|[()\[\]{}]|\n|[^"'#\\()\[\]{}\n]++|\\''')
JAVA_TOKEN = (r'''"""(?s:.*?)(?:"""|\z)|''' + _STRINGS
              + r'''|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|[{};]|[^"'/{};]++|/''')
PY_DEF = r"^\s*(async\s+)?def\s+\w+"
PY_COMMENT = r"^\s*#"
# a method head: a type (not only modifiers), a name, parameters, optional throws
JAVA_METHOD = (r"(?s)(?:^|[\s;{}>])(?!(?:new|else|return|public|private|protected|throw|case)\s)[\w<>\[\],.?&]+\s+"
               r"(?!(?:if|for|while|switch|catch|synchronized|try)\b)\w+\s*\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)\s*"
               r"(?:throws\s[\w\s,.]+)?$")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^([ \t]*)", 1))


def _is(token: Column, values: str) -> Column:
    return token.isin(*list(values))


def hold_line_ends(code: Column) -> Column:
    """Python code with the line ends inside brackets, strings and after a
    backslash replaced, so that its lines are the logical ones."""
    def step(a, t):
        inside = ((t == NL) & (a["depth"] > 0)) | t.startswith('"""') | t.startswith("'''") | (t == "\\\n")
        depth = a["depth"] + F.when(_is(t, "([{"), 1).when(_is(t, ")]}"), -1).otherwise(0)
        return F.struct(F.concat(a["s"], F.when(inside, F.translate(t, NL, HELD)).otherwise(t)).alias("s"),
                        F.greatest(depth, F.lit(0)).alias("depth"))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("depth"))
    return F.aggregate(F.regexp_extract_all(code, F.lit(PY_TOKEN), F.lit(0)), start, step, lambda a: a["s"])


def _python_end(lines: Column) -> Column:
    """Number of logical lines up to the end of the first function, null
    without one: it ends before the first later line that is not blank, not a
    comment and indented no deeper; comments at its margin don't belong to it."""
    first = F.array_position(F.transform(lines, lambda x: x.rlike(PY_DEF)), F.lit(True))
    info = F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), x.rlike(r"\S").alias("full"),
                                                    x.rlike(PY_COMMENT).alias("note"), _indent(x).alias("in")))

    def of(rows, d):
        margin = F.element_at(rows, F.greatest(d, F.lit(1)).cast("int"))["in"]
        stop = F.array_min(F.transform(F.filter(rows, lambda r: (r["i"] > d) & r["full"] & ~r["note"] & (r["in"] <= margin)),
                                       lambda r: r["i"]))
        own = F.filter(rows, lambda r: r["full"] & (stop.isNull() | (r["i"] < stop)) & ~(r["note"] & (r["in"] <= margin) & (r["i"] > d)))
        return F.when(d > 0, F.array_max(F.transform(own, lambda r: r["i"])))

    return let(info, lambda rows: of(rows, first))


def cut_python(prompt: Column, completion: Column) -> Column:
    """X2, Python: the completion up to the end of the first function of
    ``prompt + completion``; unchanged without one."""
    def cut(lines):
        return let(_python_end(lines), lambda end: F.when(end.isNull(), completion).otherwise(drop_prefix_chars(
            F.regexp_replace(F.translate(F.array_join(F.slice(lines, 1, end), NL), HELD, NL), r"\s+\z", ""), prompt)))
    return let(F.split(hold_line_ends(prompt_code(prompt, completion)), NL, -1), cut)


def _java_end(code: Column) -> Column:
    """Number of characters up to the brace that closes the first method;
    null without a method or without that brace."""
    def step(a, t):
        text = ~(t.startswith('"') | t.startswith("'") | t.startswith("//") | t.startswith("/*"))
        opens = (t == "{") & (a["at"] < 0) & a["head"].rlike(JAVA_METHOD)
        depth = a["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        closes = (t == "}") & (a["at"] >= 0) & (depth == a["at"]) & (a["end"] == 0)
        pos = a["pos"] + F.length(t)
        return F.struct(pos.alias("pos"), depth.alias("depth"),
                        F.when(_is(t, "{};"), "").when(text, F.concat(a["head"], t)).otherwise(F.concat(a["head"], F.lit(" "))).alias("head"),
                        F.when(opens, a["depth"]).otherwise(a["at"]).alias("at"),
                        F.when(closes, pos).otherwise(a["end"]).alias("end"))
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit("").alias("head"), F.lit(-1).alias("at"), F.lit(0).alias("end"))
    return F.aggregate(F.regexp_extract_all(code, F.lit(JAVA_TOKEN), F.lit(0)), start, step,
                       lambda a: F.when(a["end"] > 0, a["end"]))


def cut_java(prompt: Column, completion: Column) -> Column:
    """X2, Java: the completion up to the closing brace of the first method;
    unchanged without one, or where it isn't closed."""
    code = prompt_code(prompt, completion)
    return let(_java_end(code), lambda end: F.when(end.isNull(), completion).otherwise(
        drop_prefix_chars(F.substring(code, F.lit(1), end), prompt)))


def cut_first_function(prompt: Column, completion: Column, language: Column) -> Column:
    """X2 by language (``python`` or ``java``); other languages: unchanged."""
    return (F.when(language == "java", cut_java(prompt, completion))
            .when(language == "python", cut_python(prompt, completion)).otherwise(completion))


def _only_line_ends(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\n]", "")


def strip_comments(code: Column, language: Column) -> Column:
    """Comments, Python docstrings (triple-quoted at the start of a line)
    and Java character literals give way to their line ends; ends trimmed."""
    def python(tokens):
        def one(t, i):
            before, first = F.get(tokens, i - 1), F.get(tokens, i - 2)
            starts = (i == 0) | (before == NL) | (before.rlike(r"\A[ \t]*\z") & ((i == 1) | (first == NL)))
            doc = (t.startswith('"""') | t.startswith("'''")) & starts
            return F.when(t.startswith("#") | doc, _only_line_ends(t)).otherwise(t)
        return F.array_join(F.transform(tokens, one), "")

    def java(tokens):
        gone = lambda t: t.startswith("//") | t.startswith("/*") | t.startswith("'")
        return F.array_join(F.transform(tokens, lambda t: F.when(gone(t), _only_line_ends(t)).otherwise(t)), "")

    of = lambda pattern: F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
    return strip_text(F.when(language == "java", let(of(JAVA_TOKEN), java)).otherwise(let(of(PY_TOKEN), python)))


def split_doc(code: Column, language: Column) -> Column:
    """struct(doc, func): the leading comments with the white space around
    them, and the rest (which then ends with a line end); without a leading
    comment the code is all ``func``."""
    own = F.regexp_replace(code, r"\A\n+", "")
    pattern = F.when(language == "java", F.lit(r"\A(?://[^\n]*+|/\*(?s:.*?)\*/|\s++)++")).otherwise(F.lit(r"\A(?:#[^\n]*+|\s++)++"))
    starts = F.when(language == "java", own.rlike(r"\A(?://|/\*)")).otherwise(own.startswith("#"))
    doc = F.when(starts, F.regexp_substr(own, pattern)).otherwise(F.lit(""))
    rest = F.substr(own, F.length(doc) + 1)
    func = F.when(~starts, code).when(rest.endswith(NL) | (rest == ""), rest).otherwise(F.concat(rest, F.lit(NL)))
    return F.struct(doc.alias("doc"), func.alias("func"))
