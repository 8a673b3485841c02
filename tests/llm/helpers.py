"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """``documents`` of (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append("w%x" % rng.randrange(vocabulary))
        if i % 11 == 10:
            out[-1] += "."
        if i % 37 == 36:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def edge_rows():
    """Nulls, empty and blank texts, no-word texts, repeated rows, ties, odd
    characters, a text without spaces, a very long text."""
    return [(0, None), (1, ""), (2, " \n\t "), (3, "!!! ... ###"), (4, "one"), (4, "one"), (None, "null id here"), (None, None),
            (7, "Ünïcödé ßtraße 日本語 \U0001f600 text"), (8, "x" * 5000), (9, prose(1, 4000)), (10, prose(1, 4000)),
            (11, "tie"), (12, "tie"), (13, "a b c d e"), (14, "a b c d e f")]


def write_tables(folder, **frames):
    """Write DataFrames as <folder>/<name>.parquet and return the folder."""
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
