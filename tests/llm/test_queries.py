"""Registered queries: SQL twins, edge rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from calibspark.llm import registry
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, docs_frame, edge_rows, write_tables
from tools.check_oracle import compare, duck

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_registered_once_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    res = compare(spark, duck(SF_SMALL), name, QUERIES[name], SQL[name], SF_SMALL)
    assert res["ok"], res


def tables(spark, folder, rows, pages, labels, items, vectors=(), clash=False):
    docs = docs_frame(spark, rows)
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    items = spark.createDataFrame(items, "item_id long, text string")
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    if clash:  # columns named as the operators' own
        extra = ["key", "id", "rid", "host", "kept", "doc", "held", "length", "word", "count", "code", "place", "part", "found", "epoch", "block", "spans", "words", "tokens", "p_toxic", "digest", "license"]
        docs = docs.withColumns({c: F.lit("x") for c in extra})
        pages = pages.withColumns({c: F.lit(1) for c in ("rule", "verdict", "features", "digest", "refers_to", "block", "first")})
        labels, items = labels.withColumn("y", F.lit(0)), items.withColumn("doc_id", F.lit(5))
        vectors = vectors.withColumns({c: F.lit(7) for c in ("x", "n", "d", "component", "whitened", "i", "j", "cells")})
    return write_tables(folder, documents=docs, pages=pages, labels=labels, benchmark=items, embeddings=vectors)


PAGES = [(1, "http://a.example.org/es/x", "<p>hi</p>"), (2, None, None), (3, "", ""), (None, "no scheme", "<p>hi</p>"),
         (4, "http://", "x" * 40000), (5, "http://a.example.com/fr/", "x" * 40000), (6, "HTTP://A.COM/de/1?q#f", "é"), (6, "http://a.com", "é")]
LABELS = [(0, 1, 0), (1, 0, 1), (4, 1, 1), (4, 1, 1), (9, None, 0), (None, 1, 1), (99, 1, 0), (13, 0, 0)]
VECTORS = [(0, None, 1), (1, [0.5, 1.0], 0), (2, [0.25, -1.0], None), (2, [0.25, -1.0], None), (None, [3.0, 2.0], 1), (5, [], 0),
           (6, [1.0], 0), (7, [float("nan"), 1.0], 0), (8, [None, 1.0], 0)]
ITEMS = [(1, None), (2, ""), (3, "a b"), (4, "one two three four five six seven eight"), (4, "one two three four five six seven eight"), (None, "a b c d e f")]


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_edge_rows(spark, tmp_path, name):
    rows = edge_rows()
    sf = tables(spark, tmp_path, rows, PAGES, LABELS, ITEMS, VECTORS, clash=True)
    out = E.queries()[name](spark, sf).collect()
    n = name.split("_")[0]
    if n in ("op1", "op6"):
        assert sorted(str(r.page_id) for r in out) == sorted(str(p[0]) for p in PAGES)
    elif n in ("op2", "op3", "op4", "op5", "op9", "op10", "op13"):
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    elif n == "op11":
        assert sorted(str(r.vec_id) for r in out) == sorted(str(i) for i in (1, 2, 2, None) for _ in range(2))
    elif n == "op7":
        assert {str(r.doc_id) for r in out} == {str(r[0]) for r in rows}


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    sf = tables(spark, tmp_path, [], [], [], [])
    assert E.queries()[name](spark, sf).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_schema_is_stable(spark, tmp_path, name):
    sf = tables(spark, tmp_path, [(1, "a")], PAGES[:1], LABELS[:1], ITEMS[3:4], VECTORS[1:2])
    assert QUERIES[name](spark, sf).dtypes == QUERIES[name](spark, SF_SMALL).dtypes
    assert DOCS
