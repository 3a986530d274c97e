import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shirabe.llm import toxicity as X


def invented(r, n, toxic):
    w = ["".join(r.choices("aeioulmnrst", k=r.randint(2, 7))) for _ in range(n)]
    if toxic:
        for i in r.sample(range(n), max(2, n // 40)):
            w[i] = r.choice(["zwarg", "zwargol", "zwargish"]) + r.choice(["", "e", "s", "!"])
    return " ".join(w)


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(1)
    return [(i, invented(r, r.choice([12, 90, 300, 900]), i % 4 == 0), int(i % 4 == 0)) for i in range(400)]


@pytest.fixture(scope="module")
def net(labelled):
    return X.train([t for _, t, _ in labelled[:300]], [y for *_, y in labelled[:300]])


def test_held_out_accuracy(labelled, net):
    got = np.asarray(X.score_arrow(pa.array([t for _, t, _ in labelled[300:]]), net)[0])
    want = np.array([bool(y) for *_, y in labelled[300:]])
    assert (got & want).sum() >= 0.9 * want.sum() and (got & ~want).sum() <= 0.05 * (~want).sum()


def test_gradients():
    r = np.random.default_rng(0)
    n = X.Network.new({}, np.zeros(0, np.float32))
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    gates = r.standard_normal((2, 9, 3 * X.HIDDEN))
    idx = r.integers(0, 9, (4, 6))
    live = np.arange(6) < np.array([6, 3, 1, 6])[:, None]
    dy = r.standard_normal(4)
    y, kept = n.forward(gates, idx, live, keep=True)
    grad, dx = n.backward(kept, dy, idx, live)
    dg = np.zeros_like(gates)
    for d in (0, 1):
        np.add.at(dg[d], idx.ravel(), dx[d].reshape(-1, 3 * X.HIDDEN))
    for values, slope in [(n.p[k], grad[k]) for k in ("u", "a", "v", "o", "c")] + [(gates, dg)]:
        values, slope = values.reshape(-1), slope.reshape(-1)
        for j in r.integers(0, values.size, 8):
            old, at = values[j], []
            for step in (1e-5, -1e-5):
                values[j] = old + step
                at.append(n.forward(gates, idx, live) @ dy)
            values[j] = old
            assert abs((at[0] - at[1]) / 2e-5 - slope[j]) < 1e-5


def scalar_logit(net, words):
    """One window's logit, number by number."""
    p, H = {k: v.astype(np.float64).tolist() for k, v in net.p.items()}, X.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    inputs = []
    for w in words:
        marked = b"\x02" + w + b"\x03"
        buckets = []
        for n in X.GRAMS:
            for k in range(len(marked) - n + 1):
                code = int.from_bytes(marked[k : k + n], "big")
                buckets.append((code * 0x9E3779B97F4A7C15) % 2**64 >> (64 - 14))
        char = [sum(p["char"][b][j] for b in buckets) / math.sqrt(max(1, len(buckets))) for j in range(X.CHAR_DIM)]
        seq = [sum(math.tanh(p["seq"][0][marked[k - 1]][j] + p["seq"][1][marked[k]][j] + p["seq"][2][marked[k + 1]][j]) for k in range(1, len(marked) - 1)) / max(1, len(w)) for j in range(X.SEQ_DIM)]
        inputs.append(p["word"][net.vocabulary.get(w, 0)] + char + seq)
    states = [[None, None] for _ in words]
    for d in (0, 1):
        h = [0.0] * H
        for s in range(len(words)) if d == 0 else reversed(range(len(words))):
            x = [sum(v * p["x"][d][i][j] for i, v in enumerate(inputs[s])) + p["b"][d][0][j] for j in range(3 * H)]
            m = [sum(v * p["u"][d][i][j] for i, v in enumerate(h)) for j in range(3 * H)]
            z, q = ([sig(x[o + j] + m[o + j]) for j in range(H)] for o in (0, H))
            c = [math.tanh(x[2 * H + j] + q[j] * m[2 * H + j]) for j in range(H)]
            h = [c[j] + z[j] * (h[j] - c[j]) for j in range(H)]
            states[s][d] = h
    both = [a + b for a, b in states]
    e = [sum(math.tanh(sum(v * p["a"][i][j] for i, v in enumerate(row))) * p["v"][j] for j in range(X.ATTENTION)) for row in both]
    w = [math.exp(v - max(e)) for v in e]
    pooled = [sum(a * row[i] for a, row in zip(w, both)) / sum(w) for i in range(2 * H)]
    return sum(a * b for a, b in zip(pooled, p["o"])) + p["c"][0]


def test_every_window_same_as_number_by_number(labelled, net):
    """Brute force of the whole score: words, windows, network, the worst window's place."""
    for t in [labelled[0][1], labelled[3][1][:300], "zwarg!", "!! ?", "日本語 and zwargol"]:
        words = [w for w in re.sub(r"([\u3000-\udfff])", r" \1 ", t).split()]
        plain = [w.lower().strip(X.EDGES_PUNCT).encode() for w in words]
        starts = sorted({max(0, min(f, len(words) - X.WINDOW)) for f in range(0, max(1, len(words) - X.WINDOW + X.STRIDE), X.STRIDE)})
        logits = [scalar_logit(net, plain[f : f + X.WINDOW]) for f in starts]
        toxic, score, n, *_ = (x[0].as_py() for x in X.score_arrow(pa.array([t]), net))
        assert n == len(starts) and abs(score - 1 / (1 + math.exp(net.threshold - max(logits)))) < 1e-3 and toxic == (max(logits) >= net.threshold)


def test_words_of_writing_without_blanks():
    b = X.read(pa.array(["私は日本語" * 24, "ab日c", "é" * 40 + "x", "x" * 130]))
    assert np.diff(b.offsets).tolist() == [120, 3, 4, 6]
    pieces = [bytes(b.data[s:e]).decode() for s, e in zip(b.start, b.end)]
    assert "".join(pieces) == "私は日本語" * 24 + "ab日c" + "é" * 40 + "x" + "x" * 130 and max(len(p.encode()) for p in pieces) <= 25


def test_the_sample_is_bounded_by_bytes(spark, labelled):
    df = spark.createDataFrame([(i, t) for i, t, _ in labelled[:80]] + [(900, "zwarg " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled[:80]] + [(900, 1)], "doc_id long, toxic int")
    assert X.fitted(df, labels, per_class_bytes=40_000).trained and not X.fitted(df, labels, per_class_bytes=10).trained


def test_convolution_gradient():
    r = np.random.default_rng(3)
    n = X.Network.new({}, np.zeros(0, np.float32))
    ids, grams, chars = n.features([b"ab", b"", b"abc"])
    _, z = n.embed(ids, grams, chars, keep=True)
    dy = r.standard_normal((3, X.SEQ_DIM)).astype(np.float32)
    grad = n.seq_grad(z, chars, dy)
    for k, byte in ((0, 2), (0, 97), (1, 98), (2, 3), (2, 99)):
        at = []
        for step in (1e-2, -1e-2):
            n.p["seq"][k, byte, 1] += step
            at.append(float((n.embed(ids, grams, chars)[:, -X.SEQ_DIM :] * dy).sum()))
            n.p["seq"][k, byte, 1] -= step
        assert abs((at[0] - at[1]) / 2e-2 - grad[k, byte, 1]) < 1e-2


def test_windows_cover_every_word():
    for n in (*range(0, 300), 1000):
        text, first = X.windows(np.array([5, n]))
        mine = first[text == 1]
        seen = set()
        for f in mine:
            seen |= set(range(f, min(n, f + X.WINDOW)))
        assert seen == set(range(n))
        assert all(b - a <= X.STRIDE for a, b in zip(mine, mine[1:]))


def test_windows_scored_together_or_alone(labelled, net):
    texts = [t for _, t, _ in labelled[:30]] + ["", None, "one"]
    together = X.score_arrow(pa.array(texts), net)[1].to_pylist()
    alone = [X.score_arrow(pa.array([t], pa.string()), net)[1][0].as_py() for t in texts]
    assert all(a == b or abs(a - b) < 1e-4 for a, b in zip(together, alone))


def test_spark(spark, labelled, net):
    rows = [(i, t, 1) for i, t, _ in labelled[:60]] + [(None, "a b", 1), (70, None, 1), (71, "", 1), (72, "zwargol zwarge " * 3 + "é " * 9000, 1), (72, "zwargol zwarge " * 3 + "é " * 9000, 1), (73, "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled[:60]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    fit = X.fitted(df.drop("toxic"), labels)
    assert fit.trained
    got = {r.doc_id: r for r in X.score(df, net, keep_text=True).collect()}
    assert got[70].toxicity is None and got[70].toxic is False and got[71].toxicity == 0 and got[72].toxic and got[72].toxic_in == 1
    assert "zwarg" in got[72].text[got[72].worst_start : got[72].worst_end]
    kept = X.drop_toxic(df, net)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    none = X.fitted(df, labels.where("toxic = 0"))
    assert not none.trained and X.drop_toxic(df, none).count() == len(rows)
    assert X.score(df.limit(0), net).count() == 0
