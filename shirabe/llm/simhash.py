"""Near duplicates by SimHash and pigeonring filtering.

A text's signature has 128 bits: the signs of summed feature hashes over its set of words (weight 4) and
its set of neighbouring word pairs (weight 2), in lower case and without punctuation at the ends; the smallest
word hash counts once more, so that no sum is 0. Two texts are near duplicates if their signatures differ in at
most ``T`` = 21 bits; groups are the connected components of that relation.

Candidates come from the pigeonring principle. The bits are cut into m = T + 1 segments on a ring. If two
signatures differ in at most T bits, then from some segment on, every chain of the next j segments differs
in at most floor(j * T / m) bits, for j = 1 to m. The first segment of such a chain is equal, so rows meet
by (segment, value). A bucket of more than ``LIMIT`` signatures is parted by the segment after, and so on, at any
size of the table and each bucket by itself; there, a row also looks into the buckets that the budgets allow. Inside
a bucket the next segments are looked up with every difference that the budgets allow, as many of them as make
a lookup return about one row, and the rest of the chain prunes what is left; a chain over the whole ring is the
full Hamming check. This loses no link.

Equal signatures are joined once, and a bucket returns a spanning forest instead of its pairs. Where a bucket is
dense (thousands of near copies), all rows within T bits of one are linked to it and set aside; of the others, only
those within 2 T bits of it are looked up among these, in blocks, and each until one link is found. So neither
copies nor near copies square.

Defined results: a null text is in no group; texts without any word form one group; texts of a few words are
compared like all others; of a group the row with the smallest doc_id stays (null last; ties by content), and of
rows that are equal in id and text one stays; :func:`drop_near_duplicates` carries all columns, :func:`near_duplicates`
none but the id. Empty tables give empty results. A text of any length is a set of words and pairs, read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, fresh, keep_table, map_text, mix64, ragged, row_key, scratch, sorted_unique, spans_encoded, utf8_parts, words, write_table

BITS, MOST = 128, 21
M = MOST + 1
SIZES = [6] * (BITS - 5 * M) + [5] * (6 * M - BITS)
STARTS = np.cumsum([0, *SIZES[:-1]])
#: Signatures of a bucket from which on it is parted by one more segment: what one worker handles at once.
LIMIT = 1 << 20
#: Segments of a bucket's key at most.
DEEPEST = 8
EDGES_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿、。「」（）！？"


# --- signatures --------------------------------------------------------------------------------------
def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of words in lower case without punctuation at the ends (of the word itself, if it has
    nothing else)."""
    try:
        text = distinct.cast(pa.large_string() if pa.types.is_large_binary(distinct.type) else pa.string())
        plain = pc.utf8_trim(pc.utf8_lower(text), characters=EDGES_PUNCT).to_pylist()
    except pa.ArrowInvalid:
        plain = [b.decode("utf-8", "replace").lower().strip(EDGES_PUNCT) for b in distinct.to_pylist()]
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(p) if p else h(r) for p, r in zip(plain, distinct.to_pylist())), np.uint64, len(plain))


_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def _signs(key: np.ndarray, n: int, acc: list[np.ndarray], weight: int) -> None:
    """Add the features (document index above, 48 bits of hash below, sorted) to the sums of 2 x 64 bits.

    The 8 bits of a byte are spread over the lanes of a word; runs of 255 at most are summed without a carry."""
    if not len(key):
        return
    doc, h = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(head, len(doc)))
    runs = -(-size // 255)
    start = ragged(np.zeros(len(head), np.int64), runs) * 255 + np.repeat(head, runs)
    first = np.cumsum(runs) - runs
    for half, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        b = mix64(h + np.uint64(salt)).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lanes = np.add.reduceat(_SPREAD[b[:, j]], start).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
            acc[half][doc[head], 8 * j : 8 * j + 8] += weight * (2 * ones - size[:, None])


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def signatures(text: pa.Array) -> pa.Array:
    """The 16-byte signature of each text; null for null."""
    data, off, valid = utf8_parts(text)
    n = len(valid)
    start, end, at = words(data, off)
    codes, distinct = spans_encoded(data, start, end)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << np.uint64(48)
    low = np.uint64((1 << 48) - 1)
    acc = [np.zeros((n, 64), np.int64), np.zeros((n, 64), np.int64)]
    single = sorted_unique(doc | (mix64(h) & low))
    _signs(single, n, acc, 4)
    _signs(single[_heads(single >> np.uint64(48))], n, acc, 1)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    _signs(sorted_unique(doc[pair] | (mix64(mix64(h[pair]) + h[pair + 1]) & low)), n, acc, 2)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    sig = np.stack([((a > 0) * weight).sum(1, dtype=np.uint64) for a in acc], 1) if n else np.zeros((0, 2), np.uint64)
    return pa.array([x if v else None for x, v in zip(_cells(sig), valid)], pa.binary())


def _cells(sig: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(sig, "<u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _matrix(cells: pa.Array) -> np.ndarray:
    return utf8_parts(cells)[0].view("<u8").reshape(-1, 2)


def segments(sig: np.ndarray) -> np.ndarray:
    """The m segment values of each signature, as bytes."""
    out = np.empty((len(sig), M), np.uint8)
    for i, (s, w) in enumerate(zip(STARTS, SIZES)):
        k, s = divmod(int(s), 64)
        v = sig[:, k] >> np.uint64(s)
        if s + w > 64:
            v = v | (sig[:, k + 1] << np.uint64(64 - s))
        out[:, i] = (v & np.uint64((1 << w) - 1)).astype(np.uint8)
    return out


# --- buckets -------------------------------------------------------------------------------------------
def budget(j: int) -> int:
    return j * MOST // M


@lru_cache(maxsize=None)
def allowed(first: int, n: int, taken: int, used: int) -> tuple[tuple[int, int], ...]:
    """(difference, its bits) over the n segments from ``first`` on that keep within the budgets, after
    ``taken`` segments of the chain with ``used`` bits; the first of these segments is lowest."""
    out, shift = [(0, used)], 0
    for k in range(n):
        w = SIZES[(first + k) % M]
        most = budget(taken + k + 1)
        out = [(d | (v << shift), u + v.bit_count()) for d, u in out for v in range(1 << w) if u + v.bit_count() <= most]
        shift += w
    return tuple(out)


def chain_pairs(va: np.ndarray, vb: np.ndarray, i: int, taken: int, used: int, same: bool):
    """Index pairs (of va, of vb) whose chain from segment i on, of which ``taken`` segments with ``used``
    bits are known, keeps all budgets round the ring. same: va is vb, and pairs come once."""
    if not len(va) or not len(vb):
        return
    n, bits = 0, 0
    while taken + n < M and len(vb) > (4 << bits):
        bits += SIZES[(i + taken + n) % M]
        n += 1
    key = [np.zeros(len(v), np.int64) for v in (va, vb)]
    shift = 0
    for k in range(n):
        c = (i + taken + k) % M
        for kk, v in zip(key, (va, vb)):
            kk |= v[:, c].astype(np.int64) << shift
        shift += SIZES[c]
    order = np.argsort(key[1], kind="stable")
    begin = np.append(0, np.cumsum(np.bincount(key[1], minlength=1 << bits)))  # of each key in that order
    for diff, bits_used in allowed((i + taken) % M, n, taken, used):
        want = key[0] ^ diff
        lo = begin[want]
        hits = begin[want + 1] - lo
        if same and diff:  # either of two rows would find the other: let that without the lowest bit
            hits = np.where(key[0] & (diff & -diff), 0, hits)
        rows = np.flatnonzero(hits)
        for block in np.array_split(rows, max(1, int(hits.sum()) >> 20)):  # about a million candidates at once
            c = hits[block]
            total = int(c.sum())
            if not total:
                continue
            a = np.repeat(block, c)
            b = order[np.repeat(lo[block] - (np.cumsum(c) - c), c) + np.arange(total)]
            if same and not diff:
                ok = a < b
                a, b = a[ok], b[ok]
            u = np.full(len(a), bits_used, np.int16)
            for j in range(taken + n + 1, M + 1):
                c = (i + j - 1) % M
                u += np.bitwise_count(va[a, c] ^ vb[b, c])
                ok = u <= budget(j)
                a, b, u = a[ok], b[ok], u[ok]
                if not len(a):
                    break
            if len(a):
                yield a, b


def forest(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for nodes that aren't the smallest themselves."""
    parent = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(n))
    return child, parent[child]


def links(sig: np.ndarray, v: np.ndarray, base: np.ndarray, probes: list[tuple[int, np.ndarray]], i: int, taken: int, dense: int = 2048):
    """Index pairs within T bits that connect, as all such pairs of a bucket would: of base rows, which share the
    chain's first ``taken`` segments, and of probes (bits used so far, rows) with them."""
    apart = lambda rows, p: np.bitwise_count(sig[rows] ^ sig[p]).sum(1, dtype=np.int16)
    r, rest, misses = np.random.default_rng(0), base, 0
    while len(rest) >= dense and misses < 6:
        p = rest[r.integers(len(rest))]
        d = apart(rest, p)
        ball = rest[d <= MOST]
        if len(ball) * 64 < len(rest):
            misses += 1
            continue
        misses = 0
        yield ball, np.full(len(ball), p)
        round_it = [(0, rest[(d > MOST) & (d <= 2 * MOST)])]
        for used, rows in probes:
            d_probe = apart(rows, p)
            near = rows[d_probe <= MOST]
            yield near, np.full(len(near), p)
            round_it.append((used, rows[(d_probe > MOST) & (d_probe <= 2 * MOST)]))
        rest = rest[d > MOST]
        for used, rows in round_it:  # farther ones have no link to the ball
            for at in range(0, len(ball), 512):
                block, found = ball[at : at + 512], np.zeros(len(rows), bool)
                for a, b in chain_pairs(v[rows], v[block], i, taken, used, False):
                    yield rows[a], block[b]
                    found[a] = True
                rows = rows[~found]
                if not len(rows):
                    break
    for a, b in chain_pairs(v[rest], v[rest], i, taken, 0, True):
        yield rest[a], rest[b]
    for used, rows in probes:
        for a, b in chain_pairs(v[rows], v[rest], i, taken, used, False):
            yield rows[a], rest[b]


# A bucket's key: in base 65, the chain's first segment and the values of the segments known, each plus 1.
def _place(key: int) -> tuple[int, int]:
    """(first segment of the chain, segments known)."""
    digits = []
    while key:
        key, x = divmod(key, 65)
        digits.append(x)
    return digits[-1] - 1, len(digits) - 1


def _bucket(key, table):
    i, taken = _place(key[0].as_py())
    role = table.column("role").to_numpy()
    sig = _matrix(table.column("sig"))
    probes = [(int(u), np.flatnonzero(role == u)) for u in np.unique(role) if u]
    child, root = forest(len(sig), links(sig, segments(sig), np.flatnonzero(role == 0), probes, i, taken))
    cells = table.column("sig").combine_chunks() if isinstance(table.column("sig"), pa.ChunkedArray) else table.column("sig")
    return pa.table({"u": cells.take(pa.array(child)), "v": cells.take(pa.array(root))}, schema=pa.schema([("u", pa.binary()), ("v", pa.binary())]))


def _known(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return hot[at] == keys


def base_keys(v: np.ndarray, i: int, hot: np.ndarray) -> np.ndarray:
    """The bucket of each row for chains from segment i. hot: the keys, sorted, of buckets that are parted."""
    key = (i + 1) * 65 + v[:, i].astype(np.int64) + 1
    rows, d = np.flatnonzero(_known(key, hot)), 1
    while len(rows):
        key[rows] = key[rows] * 65 + v[rows, (i + d) % M] + 1
        rows, d = rows[_known(key[rows], hot)], d + 1
    return key


def probe_keys(v: np.ndarray, i: int, hot: np.ndarray):
    """(rows, their keys, bits used) of other buckets to look into. Of two rows that part at a segment, the one
    without the lowest bit in which they differ there looks up the other."""
    key = (i + 1) * 65 + v[:, i].astype(np.int64) + 1
    rows, d = np.flatnonzero(_known(key, hot)), 1
    front = (rows, key[rows], np.zeros(len(rows), np.int32))
    out = []
    while len(front[0]):
        c, nxt = (i + d) % M, []
        for diff in range(1 << SIZES[c]):
            rows, key, used = front
            ok = used + diff.bit_count() <= budget(d + 1)
            if diff:
                ok &= (used > 0) | (v[rows, c] & (diff & -diff) == 0)
            rows, key, used = rows[ok], key[ok], used[ok]
            nxt.append((rows, key * 65 + (v[rows, c] ^ diff) + 1, used + diff.bit_count()))
        rows, key, used = (np.concatenate(x) for x in zip(*nxt))
        deeper = _known(key, hot)
        ends = ~deeper & (used > 0)
        out.append((rows[ends], key[ends], used[ends]))
        front, d = (rows[deeper], key[deeper], used[deeper]), d + 1
    return (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))


def _rows(sig: np.ndarray, cells: pa.Array, hot: np.ndarray) -> pa.RecordBatch:
    v, n = segments(sig), len(sig)
    key, src, role = [], [], []
    for i in range(M):
        rows, keys, used = probe_keys(v, i, hot)
        key += [base_keys(v, i, hot), keys]
        src += [np.arange(n), rows]
        role += [np.zeros(n, np.int32), used.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(role)), cells.take(pa.array(np.concatenate(src)))], names=["key", "role", "sig"])


def _matrices(batches, most: int):
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            cells = batch.column(0).slice(at, most)
            yield _matrix(cells), cells


def parted(sigs: DataFrame, limit: int = LIMIT) -> np.ndarray:
    """The keys, sorted, of buckets with more than ``limit`` signatures. What is counted and collected is one row
    a bucket of the depth: 22 x 64 at first, then 64 for each that is parted, of which there are at most 22 n / limit."""
    hot = np.zeros(0, np.int64)
    for depth in range(1, DEEPEST):
        known = hot

        def run(batches, depth=depth, known=known):
            for sig, _ in _matrices(batches, 1 << 16):
                v = segments(sig)
                keys = np.concatenate([base_keys(v, i, known) for i in range(M)])
                keys, n = np.unique(keys[keys >= 65**depth], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        found = sigs.select("sig").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("key").collect()
        if not found:
            break
        hot = np.unique(np.concatenate([hot, np.array([r.key for r in found], np.int64)]))
    return hot


def near_edges(sigs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct signatures ``sig`` within T bits of each other."""
    hot = parted(sigs, limit)

    def run(batches):
        for sig, cells in _matrices(batches, 2000):
            yield _rows(sig, cells, hot)

    rows = sigs.select("sig").mapInArrow(run, "key long, role int, sig binary")
    return rows.groupBy("key").applyInArrow(_bucket, "u binary, v binary")


# --- groups ----------------------------------------------------------------------------------------------
def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root): the smallest node of each component, for all nodes that aren't it, by alternating
    large-star and small-star steps; each round's edges are a table in the shared folder."""
    spark = edges.sparkSession
    now, path = write_table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.withColumn("m", F.min("v").over(w))
        small = m.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(m.select("u", F.col("m").alias("v"))).distinct()
        nxt, new_path = write_table(small, "edges")
        drop_table(spark, path)
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now, path = nxt, new_path
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path
        state = seen


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every row of a group of at least two: (k1, k2: its content key, ``id_col``, group_id, group_size, kept).

    group_id is the id of the row that stays."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    k1, k2 = row_key("id", "t")
    slim = slim.withColumn("k1", k1).withColumn("k2", k2)
    signed = map_text(slim, "t", [("sig", T.BinaryType())], lambda: lambda text: [signatures(text)], drop=("t",))
    with scratch(df.sparkSession):
        table, _ = write_table(signed.where("sig is not null"), "signatures")
        first = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
        uniq, _ = write_table(table.groupBy("sig").agg(F.count("*").alias("n"), F.min(first).alias("first")), "distinct")
        linked, made = components(near_edges(uniq, limit))
        rooted = uniq.join(linked, uniq["sig"] == linked["node"], "left").select("sig", "n", "first", F.coalesce("root", "sig").alias("root"))
        whole = rooted.groupBy("root").agg(F.sum("n").alias("group_size"), F.min("first").alias("stays")).where("group_size > 1")
        named = rooted.select("sig", "root").join(whole, "root").select("sig", "group_size", "stays")
        kept = (F.col("k1") == F.col("stays.k1")) & (F.col("k2") == F.col("stays.k2"))
        out, path = write_table(table.join(named, "sig").select("k1", "k2", F.col("id").alias(id_col), F.col("stays.id").alias("group_id"), "group_size", kept.alias("kept")), "groups")
        drop_table(df.sparkSession, made)
        keep_table(path)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, group_id, group_size, kept) of every row in a group of two or more."""
    return groups(df, id_col, text_col, **how).select(F.col(id_col).alias("doc_id"), "group_id", "group_size", "kept")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with one of each group; columns as they are."""
    a, b, r, kept = (fresh(df.columns, x) for x in ("__k1", "__k2", "__rank", "__kept"))
    with scratch(df.sparkSession):
        decided = groups(df, id_col, text_col, **how).groupBy("k1", "k2").agg(F.max("kept").alias(kept))
        in_group, path = write_table(decided.select(F.col("k1").alias(a), F.col("k2").alias(b), kept), "decisions")
        keep_table(path)
    k1, k2 = row_key(id_col, F.col(text_col).cast("string"))
    joined = df.withColumn(a, k1).withColumn(b, k2).join(in_group, [a, b], "left")
    ranked = joined.withColumn(r, F.row_number().over(Window.partitionBy(a, b).orderBy(a)))
    return ranked.where(F.col(kept).isNull() | (F.col(kept) & (F.col(r) == 1))).select(*[F.col(f"`{c}`") for c in df.columns])
