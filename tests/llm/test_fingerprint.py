import random

import numpy as np
import pyarrow as pa
import pytest

from shirabe.llm import fingerprint as L
from shirabe.llm.common import utf8_parts

MASK = 2**64 - 1


def mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


def toss(s):
    out = []
    for i, x in enumerate(s):
        p = 0 if not i else ((x ^ s[i - 1]) & -(x ^ s[i - 1])).bit_length() - 1
        out.append(2 * p + (x >> p & 1))
    return out


def brute_level(s, at_bytes):
    runs = []
    for x in s:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    c = [x for x, _ in runs]
    for _ in range(3 if at_bytes else 4):
        c = toss(c)
    assert all(a != b for a, b in zip(c, c[1:])) and max(c) < 6
    for high in (5, 4, 3):
        c = [min({0, 1, 2} - set(c[max(0, i - 1) : i] + c[i + 1 : i + 2])) if x == high else x for i, x in enumerate(c)]
    assert all(a != b for a, b in zip(c, c[1:])) and max(c) < 3
    cut = [0] + [i for i in range(2, len(c) - 1) if c[i] > c[i - 1] and c[i] > c[i + 1]] + [len(c)]
    names = []
    for a, b in zip(cut, cut[1:]):
        h = sum(((mix(x + 1) if at_bytes else x) + (n * 0xD6E8FEB86659FD93 if n > 1 else 0)) * pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k, (x, n) in enumerate(runs[a:b]))
        names.append(mix((h + b - a) & MASK))
    return names


def brute(raw, level):
    s, depth, at = list(raw), 0, None
    if not s:
        return 0, 0, []
    while True:
        s = brute_level(s, depth == 0)
        depth += 1
        if depth == level:
            at = s
        if len(s) == 1:
            return s[0], depth, at or s


@pytest.mark.parametrize("seed", range(25))
def test_same_as_symbol_by_symbol(seed):
    r = random.Random(seed)
    texts = ["".join(r.choices(r.choice(["ab", "abcé", "aaaaab", "abcdefghij klm"]), k=r.choice([0, 1, 2, 3, 4, 5, 9, 50, 400]))) for _ in range(12)]
    level = r.choice([1, 2, 3, 4])
    data, off, _ = utf8_parts(pa.array(texts))
    root, levels, names, at = L.parse(data, off, level)
    for i, t in enumerate(texts):
        assert (int(root[i]), int(levels[i]), names[at[i] : at[i + 1]].tolist()) == brute(t.encode(), level)


def test_equal_substrings_share_names_at_any_offset():
    r = random.Random(2)
    text = lambda n: "".join(r.choices("abcdefghijklmnop     ", k=n))
    shared = text(3000)
    a, b = text(r.randint(1, 500)) + shared + text(77), text(r.randint(1, 500)) + shared + text(301)
    data, off, _ = utf8_parts(pa.array([a, b, shared, text(3000)]))
    for level, least in ((1, 0.98), (2, 0.95), (3, 0.9), (4, 0.8)):
        _, _, names, at = L.parse(data, off, level)
        s = [set(names[at[i] : at[i + 1]].tolist()) for i in range(4)]
        assert len(s[0] & s[2]) >= least * len(s[2]) and len(s[0] & s[1] & s[2]) >= least * len(s[2])
        assert level < 3 or len(s[3] & s[2]) <= 0.01 * len(s[2])


def test_spark(spark):
    rows = [(1, "a" * 200_000, 5), (2, "", 5), (3, None, 5), (None, "x", 5), (4, "hello world " * 50, None), (4, "hello world " * 50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = L.fingerprints(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].levels == 1 and by[2].root == 0 and by[2].phrases == [] and by[3].root is None and by[3].phrases is None
    assert by[1].root_in == 5 and len({(r.root, tuple(r.phrases)) for r in got if r.doc_id == 4}) == 1
    assert L.fingerprints(df.limit(0)).count() == 0


def test_hierarchy_same_as_symbol_by_symbol(spark):
    texts = ["", "a", "aaaa b", "é" * 9, "one two three " * 40, "abc de " * 3 + "x" * 50 + " fgh" * 30, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.fingerprints(df).collect():
        t = texts[r.doc_id]
        if t is None:
            assert r.hierarchy is None
            continue
        want = [[x - 2**64 if x >= 2**63 else x for x in brute(t.encode(), level)[2]] for level in range(L.FINEST, r.levels + 1)]
        assert r.hierarchy == want and (not t or r.hierarchy[-1] == [r.root])
        assert r.phrases == (want[min(L.LEVEL, r.levels) - L.FINEST] if t else [])


def test_short_passages_share_names_as_registered(spark):
    """50 words in differing surroundings, and benchmark texts, have a name in common in what op9 returns."""
    folder, r = "/root/testdata/sf0.01", random.Random(3)
    words = [x.text.split() for x in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect() if len(x.text.split()) >= 120]
    passages = [" ".join(w[i : i + 50]) for w in r.choices(words, k=400) for i in [r.randrange(len(w) - 49)]]
    passages += ["= " * 50, "no no no yes " * 12 + "no no", *(x.text for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect())]

    def around(p):
        w = r.choice(words)
        return " ".join(w[: r.randint(1, 40)]) + " " + p + " " + " ".join(w[-r.randint(1, 40) :])

    df = spark.createDataFrame([(i, side, around(p)) for i, p in enumerate(passages) for side in (0, 1)], "doc_id long, side int, text string")
    names = {(x.doc_id, x.side): x for x in L.fingerprints(df).collect()}
    assert all(any(set(a) & set(b) for a, b in zip(names[i, 0].hierarchy, names[i, 1].hierarchy)) for i in range(len(passages)))
    assert not all(set(names[i, 0].phrases) & set(names[i, 1].phrases) for i in range(len(passages)))
