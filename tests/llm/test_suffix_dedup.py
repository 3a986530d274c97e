import random
from collections import defaultdict

import numpy as np
import pytest

from shirabe.llm import suffix_dedup as S


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_and_prefixes(seed):
    r = random.Random(seed)
    s = np.array([r.randrange(r.choice([1, 2, 5, 50])) for _ in range(r.choice([0, 1, 2, 30, 400]))], np.int64)
    order, rank = S.suffix_array(s)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert order.tolist() == want and rank[order].tolist() == list(range(len(s)))
    for most in (5, 10**6):
        lcp = S.common_prefixes(s, order, rank, most, lanes=7)
        for k in range(1, len(s)):
            a, b = s[want[k - 1] :], s[want[k] :]
            n = min(len(a), len(b))
            same = int(np.append(a[:n] == b[:n], False).argmin())
            assert lcp[k] == min(most, same)


def test_merging_runs():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 8):
        runs = [np.sort(r.integers(0, 30, r.integers(0, 20))) for _ in range(n)]
        flat = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        order = S.merge_runs(runs)
        assert sorted(order.tolist()) == list(range(len(flat))) and (np.diff(flat[order]) >= 0).all()


def brute(rows):
    docs = {(i, t) for i, t in rows if t}
    where = defaultdict(set)
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - S.LEAST + 1):
            where[tuple(w[k : k + S.LEAST])].add((i, t))
    out = []
    for i, t in docs:
        w = t.split()
        last = None
        for k in range(len(w) - S.LEAST + 1):
            who = where[tuple(w[k : k + S.LEAST])]
            first = min((d for d, _ in who if d is not None), default=None) if len(who) > 1 else "none"
            if first != "none":
                if last and last[2] == k + S.LEAST - 1 and last[4] == first:
                    last[2] += 1
                    last[3] += 1
                else:
                    last = [i, k, k + S.LEAST, S.LEAST, first]
                    out.append(last)
    return sorted(map(tuple, out), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcde", k=r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 80, 400)]
    rows = []
    for i in range(60):
        w = text(r.randint(0, 200))
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = p
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[4][1] + " tail"), (102, None), (103, ""), (104, "x " * 3000), (105, "y " * 300), (105, "y " * 299), (None, rows[5][1]), (None, "z " * 120), (106, "z " * 60), (3, rows[3][1]), (107, "one\n two"), (108, "q" * 100_000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rid string")
    got = S.repeated_passages(df, merge_rows=5000 if seed == 1 else 10**6).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert S.repeated_passages(df.limit(0)).count() == 0


def test_small_shards_change_nothing():
    r = np.random.default_rng(1)
    for n in (0, 10, 300):
        word = r.integers(0, 3, n).astype(np.uint64)
        word[n // 2 :] = word[: n - n // 2]
        piece = np.array([0, n // 2, n])
        cls = S.shard_classes(word, piece)
        for p in range(2):
            for i in range(piece[p], piece[p + 1]):
                assert (cls[i] >= 0) == (i + S.LEAST <= piece[p + 1])
        for i in np.flatnonzero(cls >= 0):
            for j in np.flatnonzero(cls >= 0):
                assert (cls[i] == cls[j]) == (word[i : i + S.LEAST] == word[j : j + S.LEAST]).all()


def test_ids_of_any_type(spark):
    p = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("b", "x " + p), ("a", p + " y"), ("c", "z " * 70), (None, p)], "doc_id string, text string")
    got = sorted(map(tuple, S.repeated_passages(df).collect()), key=repr)
    assert got == sorted([("b", 1, 61, 60, "a"), ("a", 0, 60, 60, "a"), (None, 0, 60, 60, "a")], key=repr)


def test_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_WORDS", 2000)
    p = " ".join(f"w{i}" for i in range(55))
    df = spark.createDataFrame([(i, f"{i} {p} {i}{i}") for i in range(400)], "doc_id long, text string")
    assert sorted(map(tuple, S.repeated_passages(df.repartition(7)).collect())) == [(i, 1, 56, 55, 0) for i in range(400)]


def test_one_half_of_a_hash_is_not_enough():
    """Classes that agree in h alone stay apart."""
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int64()), ("cls", pa.int32()), ("first", pa.int64())])
    rows = pa.record_batch({"shard": [1, 2, 3, 4, 2], "cls": pa.array([0, 0, 0, 0, 1], pa.int32()), "h": [5, 5, 5, 5, 6], "g": [1, 2, 1, 3, 1], "two": [False, False, False, True, False], "least": pa.array([9, 8, 7, 6, 5], pa.int64())})
    got = pa.Table.from_batches(S._merged(schema)([rows])).to_pylist()
    assert sorted((r["shard"], r["cls"], r["first"]) for r in got) == [(1, 0, 7), (3, 0, 7), (4, 0, 6)]
