import random

import numpy as np
import pyarrow as pa
import pytest

from shirabe.llm import simhash as S


def brute(sig):
    return {(i, j) for i in range(len(sig)) for j in range(i + 1, len(sig)) if np.bitwise_count(sig[i] ^ sig[j]).sum() <= S.MOST}


def some_signatures(n, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, (n, 2), dtype=np.uint64)
    out = [base]
    for k in (1, 7, 15, 20, 21, 22, 23, 30):  # on both sides of the limit
        copy = base[: n // 2].copy()
        for row in copy:
            for b in r.choice(128, k, replace=False):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        out.append(copy)
    return np.unique(np.concatenate(out), axis=0)


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def bucketed(sig, limit):
    """Components and rows of the buckets that :func:`S.near_edges` would make."""
    cells = pa.array(S._cells(sig), pa.binary())
    v, hot = S.segments(sig), np.zeros(0, np.int64)
    for depth in range(1, S.DEEPEST):
        keys, n = np.unique(np.concatenate([S.base_keys(v, i, hot) for i in range(S.M)]), return_counts=True)
        more = keys[(n > limit) & (keys >= 65**depth)]
        if not len(more):
            break
        hot = np.unique(np.append(hot, more))
    rows = pa.Table.from_batches([S._rows(sig, cells, hot)])
    got, place, keys = [], {c: i for i, c in enumerate(cells.to_pylist())}, {}
    for n, k in enumerate(rows["key"].to_pylist()):
        keys.setdefault(k, []).append(n)
    for k, at in keys.items():
        if len(at) > 1:
            out = S._bucket((pa.scalar(k),), rows.take(pa.array(at)))
            got += [(place[a], place[b]) for a, b in zip(out["u"].to_pylist(), out["v"].to_pylist())]
    return components(len(sig), got), hot


@pytest.mark.parametrize("limit", [10**6, 12, 4])
def test_no_link_is_lost(limit):
    for seed in (1, 2):
        sig = some_signatures(40, seed)
        got, hot = bucketed(sig, limit)
        assert got == components(len(sig), brute(sig)) and (len(hot) > 0) == (limit < 100)


def test_dense_buckets_lose_no_link():
    """Thousands of near copies at all distances from their centre, and a chain that leads away from them."""
    r = np.random.default_rng(8)
    flip = lambda row, bits: row ^ np.array([sum(1 << int(b) for b in bits if b < 64), sum(1 << int(b) - 64 for b in bits if b >= 64)], np.uint64)
    for spread in (6, 12, 18):
        centre = r.integers(0, 2**64, 2, dtype=np.uint64)
        rows = [flip(centre, r.choice(128, r.integers(0, spread), replace=False)) for _ in range(250)]
        far = centre
        for _ in range(8):
            far = flip(far, r.choice(128, 14, replace=False))
            rows.append(far)
        sig = np.unique(np.concatenate([np.array(rows), r.integers(0, 2**64, (50, 2), dtype=np.uint64)]), axis=0)
        v, all_rows = S.segments(sig), np.arange(len(sig))
        got = [p for i in range(S.M) for key in np.unique(v[:, i]) for a, b in S.links(sig, v, all_rows[v[:, i] == key], [], i, 1, dense=8) for p in zip(a.tolist(), b.tolist())]
        assert all(np.bitwise_count(sig[a] ^ sig[b]).sum() <= S.MOST for a, b in got)
        assert components(len(sig), got) == components(len(sig), brute(sig))
        assert bucketed(sig, 20)[0] == components(len(sig), brute(sig))


def test_chain_pairs_are_exactly_the_near_ones():
    sig = some_signatures(30, 5)
    v = S.segments(sig)
    got = set()
    for i in range(S.M):
        for a, b in S.chain_pairs(v, v, i, 0, 0, True):
            got |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    assert got == brute(sig)


def document(r, n):
    return " ".join("".join(r.choices("abcdefghijkl", k=r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    rows, truth = [], []
    for i in range(40):
        n = r.choice([40, 120, 400])
        t = document(r, n)
        rows.append((i, t))
        if i < 20:
            w = t.split()
            for k in r.sample(range(n), max(1, n // 40)):
                w[k] = document(r, 1)
            rows.append((100 + i, " ".join(w)))
            truth.append((i, 100 + i))
    rows += [(200, rows[39][1]), (201, None), (202, None), (203, ""), (204, "  "), (205, "one two"), (206, "One, two!"), (207, "one two three"), (None, rows[39][1]), (3, rows[6][1])]
    return rows, truth


def test_groups_and_rows_that_stay(spark, corpus):
    rows, truth = corpus
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __k1 string")
    got = S.near_duplicates(df).collect()
    group = {}
    for r in got:
        group.setdefault(r.group_id, []).append(r.doc_id)
    by = {d: g for g, ds in group.items() for d in ds if d is not None}
    assert sum(by.get(a, -1) == by.get(b, -2) for a, b in truth) >= 0.9 * len(truth)
    assert by[203] == by[204] and by[205] == by[206] and 207 not in by and 201 not in by
    assert not {d for d in range(20, 39)} & set(by)
    assert all(r.group_size == len(group[r.group_id]) for r in got)
    two = {tuple(r) for r in S.near_duplicates(df, limit=3).collect()}
    assert two == {tuple(r) for r in got}
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({r.doc_id for r in df.collect() if r.doc_id is not None and by.get(r.doc_id, r.doc_id) == r.doc_id})
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.drop_near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, t), (1, t), (2, t + " more")], "doc_id long, text string")
    assert [r.doc_id for r in S.drop_near_duplicates(df).collect()] == [1]


def test_a_very_long_text_and_short_ones(spark):
    r = random.Random(5)
    w = document(r, 120_000).split()
    other = w.copy()
    for k in r.sample(range(len(w)), 500):
        other[k] = document(r, 1)
    few = [(10, "alpha beta"), (11, "Alpha, beta."), (12, "alpha gamma"), (13, "ok"), (14, "no"), (15, "ok ok"), (16, "a b c d e f g"), (17, "h i j k l m n")]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other)), (3, document(r, 120_000)), *few], "doc_id long, text string")
    got = {(x.group_id, x.doc_id) for x in S.near_duplicates(df).collect()}
    sig = S.signatures(pa.array([t for _, t in few]))
    apart = np.bitwise_count(S._matrix(sig)[:, None] ^ S._matrix(sig)[None]).sum(2)
    assert {(1, 1), (1, 2)} <= got and not any(3 in x for x in got)
    assert apart[0, 1] == 0 and apart[6, 7] > S.MOST and {(10, 10), (10, 11)} <= got and (16, 17) not in got
