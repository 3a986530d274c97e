import itertools
import random

import pytest
from pyspark.sql import functions as F

from shirabe.llm import mixing as X


def cost(flow, capacity, quota):
    total = 0
    for p, out in flow.items():
        used = sum(out.values())
        for e in range(X.EPOCHS):
            total += X.COSTS[e] * max(0, min(capacity[p], used - e * capacity[p]))
    return total + sum(X.SHORT * (q - sum(f.get(s, 0) for f in flow.values())) for s, q in quota.items())


@pytest.mark.parametrize("seed", range(25))
def test_no_cheaper_flow(seed):
    r = random.Random(seed)
    sources = ["a", "b", "c"][: r.choice([2, 3])]
    members = {f"p{i}": r.sample(sources, r.randint(1, len(sources))) for i in range(r.choice([1, 2, 3]))}
    capacity = {p: r.randint(1, 3) for p in members}
    quota = {s: r.randint(0, 5) for s in sources}
    got = X.route(capacity, members, quota)
    for p, f in got.items():
        assert sum(f.values()) <= X.EPOCHS * capacity[p] and set(f) <= set(members[p])
    for s in sources:
        assert sum(f.get(s, 0) for f in got.values()) <= quota[s]
    edges = [(p, s) for p in members for s in members[p]]
    best = None
    for amounts in itertools.product(range(6), repeat=len(edges)):
        flow = {p: {} for p in members}
        for (p, s), x in zip(edges, amounts):
            flow[p][s] = x
        if all(sum(f.values()) <= X.EPOCHS * capacity[p] for p, f in flow.items()) and all(sum(f.get(s, 0) for f in flow.values()) <= quota[s] for s in sources):
            c = cost(flow, capacity, quota)
            best = c if best is None else min(best, c)
        if len(edges) > 6 and best == 0:
            break
    assert cost(got, capacity, quota) == best


def test_quotas_add_up():
    assert X.quotas({"a": 1, "b": 1, "c": 1}, 100) == {"a": 34, "b": 33, "c": 33} and X.quotas({"a": 0}, 9) == {"a": 0}


ROWS = [(i, "w " * (1 + i * 7 % 23), f"s{i % 3 if i % 5 else 0}", ["en", "fr"][i % 4 == 0], i) for i in range(400)]
ODD = [(None, "a b c", "s1", "en", 1), (900, None, "s1", "en", 1), (901, "", "s2", None, 1), (902, "x y", None, None, 1), (903, "x y", None, "fr", 1), (5, ROWS[5][1], "s2", "en", 5), (904, "long " * 40_000, "s2", "en", 1)]


def test_selection_follows_the_flow(spark):
    df = spark.createDataFrame(ROWS + ODD, "doc_id long, text string, source string, lang string, mix_copy int")
    weights = {"source:s0": 0.1, "source:s1": 0.5, "source:s2": 0.1, "lang:fr": 0.2}
    keyed, key, pattern, (slim, _) = X._prepared(df, X.source_and_language(), "doc_id", "text", 7)
    rows = [(r.key, r.pattern, r.tokens, r.id) for r in slim.collect()]
    p = X.plan(slim, weights, budget=20_000)
    assert sum(p.quota.values()) == 20_000
    want = []
    for name in p.flow:
        mine = sorted(x for x in rows if x[1] == name)
        starts, at = {}, 0
        for k, *_ in mine:
            starts.setdefault(k, None)
        total = 0
        for k in starts:
            starts[k] = total
            total += sum(t for kk, _, t, _ in mine if kk == k)
        assert total == p.capacity[name]
        for i in X.intervals({name: p.flow[name]}, p.capacity):
            want += [(d, i.source, i.copy, t) for k, _, t, d in mine if i.low <= starts[k] < i.high]
    got = X.select(slim, p, "key", "pattern")
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.id, r.mix_source, r.mix_copy, r.tokens) for r in got.collect()), key=key) == sorted(want, key=key)
    out = X.mix(df, X.source_and_language(), weights, budget=20_000, seed=7)
    assert out.columns == ["doc_id", "text", "source", "lang", "mix_copy_in", "mix_source", "mix_copy"]
    assert sorted(((r.doc_id, r.mix_source, r.mix_copy) for r in out.collect()), key=key) == sorted((w[:3] for w in want), key=key)
    again = X.mix_decisions(df, X.source_and_language(), weights, budget=20_000, seed=7).drop("tokens")
    assert sorted(map(tuple, again.collect()), key=key) == sorted((w[:3] for w in want), key=key)
    assert 902 not in {w[0] for w in want}


def test_default_weights_and_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string, mix_copy int")
    out = X.mix_decisions(df, X.source_and_language()).groupBy("mix_source").agg(F.sum("tokens").alias("n")).collect()
    _, _, _, (slim, _) = X._prepared(df, X.source_and_language(), "doc_id", "text", X.SEED)
    p = X.plan(slim, X.by_family)
    for r in out:
        assert abs(r.n - p.quota[r.mix_source]) <= 23 * 10
    assert X.mix(df.limit(0), X.source_and_language()).count() == 0
