"""What keeps work and memory in bounds as tables grow."""

import random
import re

from shirabe import registry
from shirabe.operators import correlate as K
from shirabe.operators import evaluate as E
from tests.oracle import DIR, same


def test_files_are_boosted_in_more_parts_as_rows_grow(spark, monkeypatch):
    query = registry.QUERIES["cooccurrence_boost"]
    monkeypatch.setattr(K, "ROWS", 500)
    rows = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert query(spark, DIR).rdd.getNumPartitions() == rows // 500 + 1 > 4
    assert same(spark, query, registry.ORACLE["cooccurrence_boost"]) == rows


def _most(ws, fs, ok):
    """The largest matching, by augmenting paths."""
    owner = {}

    def place(i, seen):
        for j, f in enumerate(fs):
            if j not in seen and ok(ws[i], f):
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(ws)))


def test_span_matching_same_as_augmenting_paths(spark):
    """Cases of every size over batches of a few rows, keys of two columns, some null."""
    r = random.Random(3)
    case = lambda i: (i % 7 or None, f"c{i}")
    span = lambda: (lambda a: (a, a + r.choice((0, 1, 2, 3, 5, 9))))(r.randrange(12))
    sides = [{case(i): [span() for _ in range(r.choice((0, 1, 2, 3, 7, 40)))] for i in range(150)} for _ in range(2)]
    tables = [spark.createDataFrame([(*k, *s) for k, x in side.items() for s in x], "a int, b string, start int, end int") for side in sides]
    tests = (lambda w, f: w == f, lambda w, f: f[0] <= w[0] and w[1] <= f[1], lambda w, f: w[0] < f[1] and f[0] < w[1])
    want = {k: (len(w), len(f), *(_most(w, f, t) for t in tests)) for k, w in sides[0].items() for f in [sides[1][k]] if w or f}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for parts in (None, 5):
            got = E.span_matches(*tables, ["a", "b"], parts)
            assert {(x.a, x.b): (x.n_wanted, x.n_found, x.exact, x.containment, x.relaxed) for x in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_case_of_many_spans_is_matched_in_one_shuffle(spark):
    """A chain in which the last span moves all others by one: depth must not grow with it."""
    n = 3000
    ws = spark.createDataFrame([(1, 10 * i, 10 * i + 15) for i in [*range(1, n), 0]], "c int, start int, end int").coalesce(1)
    fs = spark.createDataFrame([(1, 10 * i + 11, 10 * i + 14) for i in range(n)], "c int, start int, end int").coalesce(1)
    got = E.span_matches(ws, fs, ["c"])
    assert tuple(got.first()) == (1, n, n, 0, 0, n)
    assert len(re.findall("Exchange hashpartitioning", got._jdf.queryExecution().toString())) == 1
