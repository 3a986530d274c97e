"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word vector beside two readings of its characters, so unknown and misspelt words still say
something: a convolution over its bytes in order (three wide, squashed, averaged) and the scaled sum of vectors of
its 3- and 5-byte sequences. Gated recurrent units run over a window of words in both directions, attention
pools their states, and a logistic unit scores the window. A text is scored over all its overlapping windows
(``WINDOW`` words, a new one every ``STRIDE``) and counts as toxic if its worst window reaches the threshold.

Words are parted by ASCII white space; each character from U+3000 to U+DFFF (kana, Han, Hangul), which are written
without blanks, is a word. Words of over 48 bytes are read in pieces of 24, cut between characters, none left out.

Training is weakly supervised: labels are of whole texts. A bound holds for the classifier's training sample only:
``per_class`` labelled rows of either class and ``per_class_bytes`` of their text, whole texts in the order of a
hash of their id. Of a toxic text the worst window so far is learnt as toxic; of clean ones the worst window of
each text, the ``HARD`` worst of all and ``RANDOM`` others as clean, in rounds. Words of at least three texts of the
sample, the ``VOCABULARY`` commonest, have vectors. A fifth of the sample is held out to set the threshold.

Defined results: a null text has a null score and isn't toxic; a text without words scores 0; rows are scored
one by one, so repeated rows repeat; if labels of either class are missing nothing is toxic and every score is
0; a doc_id that is labelled both ways counts as toxic. Other columns are carried (``<name>_in`` where they
bear an output's name). Texts of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_text, ragged, sorted_unique, spans_encoded, utf8_parts, with_nulls, words
from .simhash import EDGES_PUNCT

WINDOW, STRIDE = 64, 32
#: Labelled rows of either class from which the classifier is fitted, at most.
PER_CLASS = 1500
#: Bytes of these rows' texts of either class, at most.
PER_CLASS_BYTES = 32 << 20
#: Clean windows of a training round besides the worst of each text.
HARD, RANDOM = 1000, 3000
#: Windows of a step of the training.
MINIBATCH = 512
VOCABULARY, BUCKETS, WORD_DIM, CHAR_DIM, SEQ_DIM, HIDDEN, ATTENTION = 8192, 1 << 14, 8, 8, 4, 8, 8
#: Lengths of the byte sequences of a word, its two ends included, that have vectors.
GRAMS = (3, 5)


# --- reading ---------------------------------------------------------------------------------------------
@dataclass
class Batch:
    """Texts as codes of distinct words."""

    valid: np.ndarray
    offsets: np.ndarray  # of the texts, in words
    codes: np.ndarray
    plain: list[bytes]  # the distinct words, in lower case and without punctuation at the ends
    start: np.ndarray
    end: np.ndarray  # bytes of the words
    data: np.ndarray
    text_off: np.ndarray


def _cut(start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with cuts at the places ``at`` that lie inside one."""
    if not len(at) or not len(start):
        return start, end
    k = np.maximum(np.searchsorted(start, at, "right") - 1, 0)
    inside = sorted_unique(at[(at > start[k]) & (at < end[k])])
    return np.sort(np.append(start, inside)), np.sort(np.append(end, inside))


def read(text: pa.Array) -> Batch:
    data, off, valid = utf8_parts(text)
    start, end, at = words(data, off)
    wide = np.flatnonzero((data >= 0xE3) & (data <= 0xED))
    start, end = _cut(start, end, np.append(wide, wide + 3))
    long = np.flatnonzero(end - start > 48)
    if len(long):
        n = (end - start)[long] // 24
        cut = np.repeat(start[long], n) + 24 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        cut = np.minimum(cut, np.repeat(end[long], n))
        for _ in range(3):  # back to where a character begins
            cut = np.where((cut < len(data)) & (data[np.minimum(cut, len(data) - 1)] & 0xC0 == 0x80), cut - 1, cut)
        start, end = _cut(start, end, cut)
    at = np.searchsorted(start, off)
    codes, distinct = spans_encoded(data, start, end)
    try:
        wide = pa.types.is_large_binary(distinct.type)
        plain = pc.utf8_trim(pc.utf8_lower(distinct.cast(pa.large_string() if wide else pa.string())), characters=EDGES_PUNCT).cast(pa.binary()).to_pylist()
    except pa.ArrowInvalid:
        plain = [b.decode("utf-8", "replace").lower().strip(EDGES_PUNCT).encode() for b in distinct.to_pylist()]
    return Batch(valid, at, codes, plain, start, end, data, off)


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word within it) of every window; the last one of a text ends with it."""
    count = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n_words)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, np.minimum(first, np.maximum(0, n_words[text] - WINDOW))


# --- the network -------------------------------------------------------------------------------------------
def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    threshold: float = 0.0
    trained: bool = False
    held_out: dict = field(default_factory=dict)

    @staticmethod
    def new(vocabulary: dict[bytes, int], odds: np.ndarray, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM + SEQ_DIM, HIDDEN
        g = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        p = {"word": g(len(vocabulary) + 1, WORD_DIM, k=0.1), "char": g(BUCKETS, CHAR_DIM, k=0.05), "seq": g(3, 256, SEQ_DIM, k=0.1), "x": g(2, d, 3 * h), "u": g(2, h, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "a": g(2 * h, ATTENTION), "v": g(ATTENTION), "o": g(2 * h), "c": np.full(1, -1, np.float32)}
        p["word"][1:, 0] = odds
        return Network(vocabulary, p)

    def features(self, plain: list[bytes]):
        """(word id of each; for each of GRAMS, the buckets of the words one after another and how many; the words'
        bytes between two marks, and how many)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in plain), np.int64, len(plain))
        byte = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in plain), np.uint8)
        raw = byte.astype(np.uint64)
        size = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
        first = np.cumsum(size) - size
        grams = []
        for n in GRAMS:
            code = np.zeros(max(0, len(raw) - n + 1), np.uint64)
            for k in range(n):
                code = code << np.uint64(8) | raw[k : k + len(code)]
            bucket = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)).astype(np.int32)
            count = np.maximum(0, size - n + 1)
            grams.append((bucket[ragged(first, count)], count))
        return ids, grams, (byte, size)

    def embed(self, ids, grams, chars, keep=False):
        """Vectors of words. keep: also the squashed convolution, which the gradient needs."""
        char = np.zeros((len(ids), CHAR_DIM), np.float32)
        for bucket, count in grams:
            some = np.flatnonzero(count)
            if len(some):
                char[some] += np.add.reduceat(self.p["char"][bucket], (np.cumsum(count) - count)[some], axis=0)
        byte, size = chars
        t = self.p["seq"]
        z = t[1][byte]
        if len(byte) > 1:  # the marks at the ends have the next word's for a neighbour, which is a mark as well
            z[1:] += t[0][byte[:-1]]
            z[:-1] += t[2][byte[1:]]
        np.tanh(z, out=z)
        first = np.cumsum(size) - size
        z[first] = z[first + size - 1] = 0
        seq = np.add.reduceat(z, first, axis=0) / np.maximum(size - 2, 1)[:, None].astype(np.float32) if len(ids) else np.zeros((0, SEQ_DIM), np.float32)
        e = np.concatenate([self.p["word"][ids], char * self.scale(grams), seq], 1)
        return (e, z) if keep else e

    @staticmethod
    def seq_grad(z, chars, share):
        """Gradient of the convolution's tables; share: that of each word's average."""
        byte, size = chars
        dz = np.repeat(share / np.maximum(size - 2, 1)[:, None].astype(np.float32), size, axis=0) * (1 - z * z)
        first = np.cumsum(size) - size
        dz[first] = dz[first + size - 1] = 0
        out = np.zeros((3, 256, SEQ_DIM), np.float32)
        for k, d in enumerate(dz.T):
            for j, (b, w) in enumerate(((byte[:-1], d[1:]), (byte, d), (byte[1:], d[:-1]))):
                out[j, :, k] = np.bincount(b, weights=w, minlength=256)
        return out

    @staticmethod
    def scale(grams):
        return (1 / np.sqrt(np.maximum(1, sum(c for _, c in grams)))).astype(np.float32)[:, None]

    def forward(self, gates, idx, live=None, keep=False):
        """Logits of windows. gates: (2, words, 3 H) inputs of both directions; idx: (windows, T) words;
        live: which of them are there (None: all). keep: also what :meth:`backward` needs."""
        n, t = idx.shape
        u = self.p["u"]
        h = np.zeros((2, n, HIDDEN), u.dtype)
        states = np.empty((t, 2, n, HIDDEN), u.dtype)
        trace = []
        for s in range(t):
            x = np.stack([gates[0][idx[:, s]], gates[1][idx[:, t - 1 - s]]])
            m = h @ u
            zr = _sigmoid(x[..., : 2 * HIDDEN] + m[..., : 2 * HIDDEN])
            z, q = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN :] + q * m[..., 2 * HIDDEN :])
            new = c + z * (h - c)
            on = None
            if live is not None:
                on = np.stack([live[:, s], live[:, t - 1 - s]])[..., None]
                new = np.where(on, new, h)
            if keep:
                trace.append((h, z, q, c, m[..., 2 * HIDDEN :], on))
            h = new
            states[s, 0], states[t - 1 - s, 1] = h[0], h[1]
        both = np.concatenate([states[:, 0], states[:, 1]], -1)  # (t, n, 2 H)
        k = np.tanh(both @ self.p["a"])
        e = k @ self.p["v"]
        if live is not None:
            e = np.where(live.T, e, u.dtype.type(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * both).sum(0)
        y = pooled @ self.p["o"] + self.p["c"]
        return (y, (both, k, w, pooled, trace)) if keep else y

    def backward(self, kept, dy, idx, live):
        """Gradients of the parameters, and of the gates' inputs (2, n, T, 3 H)."""
        both, k, w, pooled, trace = kept
        t, n, _ = both.shape
        grad = {"o": pooled.T @ dy, "c": dy.sum(keepdims=True)}
        dp = dy[:, None] * self.p["o"]
        dboth = w[..., None] * dp
        de = w * ((both * dp).sum(-1) - (pooled * dp).sum(-1))
        grad["v"] = np.einsum("tna,tn->a", k, de)
        dk = de[..., None] * self.p["v"] * (1 - k * k)
        grad["a"] = np.einsum("tnh,tna->ha", both, dk)
        dboth += dk @ self.p["a"].T
        dstate = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]], 1)  # by step
        du = np.zeros_like(self.p["u"])
        dh = np.zeros((2, n, HIDDEN), du.dtype)
        dx = np.zeros((2, n, t, 3 * HIDDEN), du.dtype)
        for s in range(t - 1, -1, -1):
            h, z, q, c, mc, on = trace[s]
            g = dh + dstate[s]
            gl = g if on is None else np.where(on, g, 0)
            dc = gl * (1 - z) * (1 - c * c)
            dz = gl * (h - c) * z * (1 - z)
            dq = dc * mc * q * (1 - q)
            dm = np.concatenate([dz, dq, dc * q], -1)
            dx_s = np.concatenate([dz, dq, dc], -1)
            dx[0][:, s], dx[1][:, t - 1 - s] = dx_s[0], dx_s[1]
            du += h.transpose(0, 2, 1) @ dm
            dh = gl * z + dm @ self.p["u"].transpose(0, 2, 1)
            if on is not None:
                dh += np.where(on, 0, g)
        grad["u"] = du
        return grad, dx

    def gates(self, e):
        return (e @ np.concatenate(list(self.p["x"]), 1)).reshape(len(e), 2, -1).transpose(1, 0, 2) + self.p["b"]

    def score_windows(self, b: Batch, block: int = 1024, feats=None):
        """(text, first word, logit) of every window of the batch."""
        n = np.diff(b.offsets)
        text, first = windows(n)
        gates = self.gates(self.embed(*(feats or self.features(b.plain)))) if b.plain else np.zeros((2, 0, 3 * HIDDEN), np.float32)
        at = b.offsets[text] + first
        out = np.empty(len(text), np.float32)
        whole = n[text] >= WINDOW
        for rows, t in ((np.flatnonzero(whole), WINDOW), (np.flatnonzero(~whole), 0)):
            for k in range(0, len(rows), block):
                r = rows[k : k + block]
                if t:
                    out[r] = self.forward(gates, b.codes[at[r, None] + np.arange(WINDOW)])
                else:
                    size = n[text[r]]
                    live = np.arange(size.max()) < size[:, None]
                    idx = np.where(live, at[r, None] + np.arange(size.max()), at[r, None])
                    out[r] = self.forward(gates, b.codes[idx], live)
        return text, first, out


def _reference_window(b: Batch, text, first):
    """(codes (n, WINDOW), live) of windows; short ones are padded."""
    size = np.minimum(np.diff(b.offsets)[text], WINDOW)
    live = np.arange(WINDOW) < size[:, None]
    at = (b.offsets[text] + first)[:, None]
    return b.codes[np.where(live, at + np.arange(WINDOW), at)], live


class _Adam:
    def __init__(self, p, rate=0.015):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grad):
        self.t += 1
        for k, g in grad.items():
            m, s = self.m[k], self.s[k]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            self.p[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-6)


def _sums_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by index, below n."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        ordered = index[order]
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        out[ordered[head]] = np.add.reduceat(rows[order], head, axis=0)
    return out


def _fit(net: Network, feats, idx, live, y, epochs, adam, r):
    starts = [np.cumsum(c) - c for _, c in (*feats[1], feats[2])]
    pick = lambda part, start, used: (part[0][ragged(start[used], part[1][used])], part[1][used])
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), MINIBATCH):
            rows = order[at : at + MINIBATCH]
            used, local = np.unique(idx[rows], return_inverse=True)
            local = local.reshape(len(rows), -1)
            grams, chars = [pick(g, s, used) for g, s in zip(feats[1], starts)], pick(feats[2], starts[-1], used)
            e, z = net.embed(feats[0][used], grams, chars, keep=True)
            logit, kept = net.forward(net.gates(e), local, live[rows], keep=True)
            dy = ((_sigmoid(logit) - y[rows]) / len(rows)).astype(np.float32)
            grad, dx = net.backward(kept, dy, local, live[rows])
            dg = _sums_by(local.ravel(), dx.transpose(1, 2, 0, 3).reshape(local.size, -1), len(used)).reshape(len(used), 2, -1).transpose(1, 0, 2)
            grad["x"] = e.T[None] @ dg
            grad["b"] = dg.sum(1, keepdims=True)
            de = (dg @ net.p["x"].transpose(0, 2, 1)).sum(0)
            grad["word"] = _sums_by(feats[0][used], de[:, :WORD_DIM], len(net.p["word"]))
            share = de[:, WORD_DIM : WORD_DIM + CHAR_DIM] * net.scale(grams)
            grad["char"] = sum(_sums_by(bucket, np.repeat(share, count, axis=0), BUCKETS) for bucket, count in grams)
            grad["seq"] = net.seq_grad(z, chars, de[:, WORD_DIM + CHAR_DIM :])
            for k in ("char", "word"):
                grad[k] += np.float32(2e-5) * net.p[k]
            adam.step(grad)


def train(texts: list[str], toxic: list[int], clean_weight: float = 1.0, seed: int = 7, rounds: int = 3, epochs: int = 3) -> Network:
    """Fit a network on labelled texts; see the module's text. clean_weight: how many clean labels one of the
    sample stands for, against a toxic one, when the threshold is set."""
    r = np.random.default_rng(seed)
    y = np.asarray(toxic, bool)
    if y.all() or not y.any():
        return Network.new({}, np.zeros(0, np.float32))
    b = read(pa.array(texts, pa.large_string()))
    n = np.diff(b.offsets)
    held = r.random(len(y)) < 0.2
    if y[~held].all() or not y[~held].any() or not y[held].any() or y[held].all():
        held[:] = False
    # in how many texts of either class each word stands
    plain, same = np.unique(np.array(b.plain, object), return_inverse=True)
    doc = np.repeat(np.arange(len(y)), n)
    pair = sorted_unique(doc.astype(np.int64) * len(plain) + same[b.codes])
    doc, word = pair // max(1, len(plain)), pair % max(1, len(plain))
    use = ~held[doc]
    hit = [np.bincount(word[use & (y[doc] == c)], minlength=len(plain)) for c in (False, True)]
    total = [max(1, int((y[~held] == c).sum())) for c in (False, True)]
    odds = np.clip(np.log((hit[1] + 0.5) / (total[1] + 1)) - np.log((hit[0] + 0.5) / (total[0] + 1)), -3, 3)
    often = np.flatnonzero(hit[0] + hit[1] >= 3)
    often = often[np.argsort(-(hit[0] + hit[1])[often], kind="stable")][:VOCABULARY]
    net = Network.new({plain[i]: k + 1 for k, i in enumerate(often)}, odds[often].astype(np.float32))
    net.trained = True
    known = np.zeros(len(plain))
    known[often] = odds[often]
    value = np.append(0, np.cumsum(np.maximum(known[same], 0)[b.codes]))
    text, first = windows(n)
    at = b.offsets[text] + first
    score = value[at + np.minimum(n[text], WINDOW)] - value[at]
    adam, feats = _Adam(net.p), net.features(b.plain)
    for turn in range(rounds):
        worst = np.lexsort((-score, text))
        head = worst[np.flatnonzero(np.diff(text[worst], prepend=-1))]  # the worst window of each text
        fit_text = ~held[text]
        pos = head[y[text[head]] & fit_text[head]]
        neg_head = head[~y[text[head]] & fit_text[head]]
        clean = np.flatnonzero(~y[text] & fit_text)
        hard = clean[np.argsort(-score[clean], kind="stable")][:HARD]
        neg = np.unique(np.concatenate([neg_head, hard, r.choice(clean, min(len(clean), RANDOM), replace=False)]))
        rows = np.concatenate([pos, neg])
        idx, live = _reference_window(b, text[rows], first[rows])
        _fit(net, feats, idx, live, np.append(np.ones(len(pos)), np.zeros(len(neg))).astype(np.float32), epochs, adam, r)
        score = net.score_windows(b, feats=feats)[2]
        adam.rate *= 0.6
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, text, score)
    sample = np.flatnonzero((held if held.any() else ~held) & (n > 0))
    net.threshold, net.held_out = _threshold(best[sample], y[sample], clean_weight)
    return net


def _threshold(score, y, clean_weight):
    """A logit of best F1, in the widest gap that has it: the nearer to the toxic texts, the more clean ones
    there are outside the sample."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (hit + clean_weight * np.cumsum(~y[order]) + y.sum())
    low = np.append(s[1:], s[-1] - 2)
    gap = np.where(f1 >= f1.max() - 1e-12, s - low, -1)
    k = int(np.argmax(gap))
    return float(low[k] + (s[k] - low[k]) * clean_weight / (1 + clean_weight)), {"f1": float(f1[k]), "texts": len(s)}


# --- Spark ---------------------------------------------------------------------------------------------------
def fitted(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, per_class_bytes: int = PER_CLASS_BYTES) -> Network:
    """A network fitted on at most ``per_class`` labelled texts of either class and ``per_class_bytes`` of these,
    chosen by a hash of their id."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    total = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    chosen = [one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    few = chosen[0].unionByName(chosen[1])  # 2 * per_class rows at most, so it can be broadcast
    sized = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id").where(F.octet_length("text") <= per_class_bytes)
    texts = sized.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # of the sample
    rows = texts.withColumn("so_far", so_far).where(F.col("so_far") <= per_class_bytes).drop("so_far").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    used = [sum(r.toxic == c for r in rows) for c in (0, 1)]
    weight = (total.get(0, 0) / max(1, used[0])) / (total.get(1, 0) / max(1, used[1])) if all(used) else 1.0
    return train([r.text for r in rows], [r.toxic for r in rows], weight)


def score_arrow(text: pa.Array, net: Network):
    b = read(text)
    count = len(b.valid)
    n = np.diff(b.offsets)
    score, a, z, n_win = np.zeros(count), np.zeros(count, np.int32), np.zeros(count, np.int32), np.zeros(count, np.int32)
    toxic = np.zeros(count, bool)
    if len(b.codes):
        at, first, logit = net.score_windows(b)
        n_win = np.bincount(at, minlength=count).astype(np.int32)
        order = np.lexsort((first, -logit, at))
        head = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        doc = at[head]
        if net.trained:
            score[doc] = _sigmoid(logit[head].astype(np.float64) - net.threshold)
            toxic[doc] = logit[head] >= net.threshold
        char = np.append(0, np.cumsum((b.data & 0xC0) != 0x80))
        w = b.offsets[doc] + first[head]
        a[doc] = char[b.start[w]] - char[b.text_off[doc]]
        z[doc] = char[b.end[w + np.minimum(n[doc], WINDOW) - 1]] - char[b.text_off[doc]]
    return [pa.array(toxic), *(with_nulls(pa.array(x), b.valid) for x in (score, n_win, a, z))]


OUTPUTS = [("toxic", T.BooleanType()), ("toxicity", T.DoubleType()), ("n_windows", T.IntegerType()), ("worst_start", T.IntegerType()), ("worst_end", T.IntegerType())]


def score(df: DataFrame, net: Network, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``toxic``, ``toxicity`` (0.5 at the threshold), ``n_windows`` and the worst window's characters
    [worst_start, worst_end)."""
    return map_text(df, text_col, OUTPUTS, lambda: lambda text: score_arrow(text, net), drop=() if keep_text else (text_col,))


def drop_toxic(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't toxic, with their columns as they are."""
    flag = fresh(df.columns, "__toxic")
    marked = map_text(df, text_col, [(flag, T.BooleanType())], lambda: lambda text: score_arrow(text, net)[:1])
    return marked.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in df.columns])
