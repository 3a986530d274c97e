"""Passages that repeat across documents, by suffix arrays.

A passage is a run of at least ``LEAST`` = 50 words (runs of characters that aren't ASCII white space, compared
as they are). Reported are, for every document, the maximal runs of words each of whose 50-word windows stands
in another document as well, split where the document that has the window first (smallest doc_id) changes.

1. A first pass names each 50-word window by the smallest of its 26 hashes of 25 words. Equal windows have
   equal names, so only windows whose name occurs in two documents can repeat; documents without such a name
   are done. Names are counted with partial aggregates, whatever share of the documents has one.
2. The rest are cut to the words of such windows and gathered into shards of bounded size. Each shard gets a
   suffix array of its words by Larsson-Sadakane refinement (prefix doubling that sorts unfinished groups only)
   and the common prefixes of neighbours by Kasai's algorithm, run in lanes side by side; suffixes that share 50
   words fall into one class. A shard's members stay together, packed in one row.
3. Shards are merged: each hands on one row a class, keyed by a 128-bit hash of its 50 words, however many members
   it has; rows are exchanged by key, and the sorted runs of the shards are merged by binary search. What that
   found goes back to the shards, which join neighbouring windows to passages.

Nothing is sampled or capped. A document is known by 128 bits of its id and text. Defined results: null and short
texts have no passages; a passage that repeats inside one document only isn't reported; rows equal in id and text
are one document, and rows of one id with different texts are different ones; ids may be of any type with an
order, and a null id is never smaller than another. A text of any length is read whole. An empty table gives an
empty result; other columns aren't carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_table, map_text, mix64, ragged, row_key, scratch, slices, sorted_unique, spans_encoded, utf8_parts, words, write_table

LEAST, GRAM = 50, 25
#: Words of a shard; a document with more is a shard of its own.
SHARD_WORDS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


# --- windows -------------------------------------------------------------------------------------------------
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashed:
    """Words as 64-bit hashes, with hashes of any run of them. ``wide``: of these, 128 bits."""

    def __init__(self, text, wide: bool = False):
        data, off, _ = utf8_parts(text)
        start, end, self.at = words(data, off)
        codes, distinct = spans_encoded(data, start, end)
        parts = distinct.to_pylist()
        hashed = lambda h: np.fromiter(map(h, parts), np.uint64, len(parts))[codes] if len(codes) else np.zeros(0, np.uint64)
        self.word = hashed(xxhash.xxh3_64_intdigest)
        self.back = _powers(_BACK, len(self.word))
        self.sums = self._sums(self.word)
        self.more = self._sums(hashed(lambda b: xxhash.xxh3_64_intdigest(b, 1))) if wide else None

    @staticmethod
    def _sums(word: np.ndarray) -> np.ndarray:
        return np.append(np.zeros(1, np.uint64), np.cumsum(word * _powers(_BASE, len(word)), dtype=np.uint64))

    def runs(self, start: np.ndarray, size: int, second: bool = False) -> np.ndarray:
        sums = self.more if second else self.sums
        return mix64((sums[start + size] - sums[start]) * self.back[start])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, name) of every window of LEAST words."""
        count = np.maximum(0, np.diff(self.at) - LEAST + 1)
        text = np.repeat(np.arange(len(count)), count)
        first = ragged(self.at[:-1], count)
        if not len(first):
            return text, first, np.zeros(0, np.uint64)
        low = self.runs(np.arange(len(self.word) - GRAM + 1), GRAM)
        need, width = LEAST - GRAM + 1, 1
        while 2 * width <= need:  # minima of twice as many neighbours each time
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        return text, first, np.minimum(low[first], low[first + need - width])


# --- suffix arrays ---------------------------------------------------------------------------------------------
def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of integers from 0 by Larsson and Sadakane's doubling: a suffix's rank is where
    its group begins, and each round sorts the groups that aren't single by the rank twice as far on."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.append(True, s[order][1:] != s[order][:-1]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    single = new & np.append(new[1:], True)
    left, h = np.flatnonzero(~single), 1  # places in the array that aren't final
    while len(left):
        i = order[left]
        beyond = i + h
        key = rank[i] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        i, key = i[by], key[by]
        order[left] = i
        new = np.append(True, key[1:] != key[:-1])
        rank[i] = left[np.flatnonzero(new)][np.cumsum(new) - 1]
        single = new & np.append(new[1:], True)
        left = left[~single]
        h *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Kasai's common prefix, up to ``most``, of each suffix in the array with the one before it. The text is
    cut into lanes that advance side by side, each carrying its prefix length from position to position."""
    n = len(s)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    lanes = max(1, min(lanes, n // 64))
    stop = np.linspace(0, n, lanes + 1).astype(np.int64)
    i, stop = stop[:-1].copy(), stop[1:]
    h = np.zeros(lanes, np.int64)
    wide = np.append(s, -1)
    while len(i):
        r = rank[i]
        j = order[r - 1]  # for the first suffix any; its result stays 0
        end = np.minimum(i, n) + h, np.minimum(j, n) + h
        go = (h < most) & (end[0] < n) & (end[1] < n) & (r > 0)
        go &= wide[np.minimum(end[0], n)] == wide[np.minimum(end[1], n)]
        h += go
        done = ~go
        out[r[done]] = np.where(r[done] > 0, h[done], 0)
        i += done
        h = np.where(done, np.maximum(h - 1, 0), h)
        if done.any():
            live = i < stop
            if not live.all():
                i, stop, h = i[live], stop[live], h[live]
    return out


def shard_classes(word: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Class of each position of pieces (offsets ``piece``) of words: those with LEAST words left in their
    piece that share these have one class, the position of one of them; others have -1."""
    n, pieces = len(word), len(piece) - 1
    if not n:
        return np.zeros(0, np.int64)
    ids = np.searchsorted(sorted_unique(word), word) + pieces
    at = np.arange(n) + np.repeat(np.arange(pieces), np.diff(piece))  # a mark of its own ends each piece
    s = np.empty(n + pieces, np.int64)
    s[at] = ids
    s[piece[1:] + np.arange(pieces)] = np.arange(pieces)
    order, rank = suffix_array(s)
    lcp = common_prefixes(s, order, rank, LEAST)
    head = np.flatnonzero(lcp < LEAST)
    group = np.cumsum(lcp < LEAST) - 1
    cls = np.empty(len(s), np.int64)
    cls[order] = order[head][group]
    place = np.full(len(s), -1, np.int64)
    place[at] = np.arange(n)
    left = np.repeat(piece[1:], np.diff(piece)) - np.arange(n)
    return np.where(left >= LEAST, place[cls[at]], -1)


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """The order (of the runs' concatenation) that merges sorted runs, two by two by binary search."""
    base = np.cumsum([0, *map(len, runs)])
    now = [(r, np.arange(len(r)) + b) for r, b in zip(runs, base)]
    while len(now) > 1:
        nxt = []
        for k in range(0, len(now) - 1, 2):
            (a, ia), (b, ib) = now[k], now[k + 1]
            key, index = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), np.int64)
            pa_, pb = np.arange(len(a)) + np.searchsorted(b, a, "left"), np.arange(len(b)) + np.searchsorted(a, b, "right")
            key[pa_], key[pb], index[pa_], index[pb] = a, b, ia, ib
            nxt.append((key, index))
        now = nxt + now[len(now) - len(now) % 2 :]
    return now[0][1] if now else np.zeros(0, np.int64)


# --- Spark ---------------------------------------------------------------------------------------------------------
def shard_type(id_type: T.DataType) -> T.StructType:
    """A row for each class of a shard: its number, its hash (h, g), whether two of the shard's documents have it,
    and their smallest id; and one for each shard: its members, packed, and the ids of its documents."""
    long, yes = T.LongType(), T.BooleanType()
    return T.StructType([T.StructField(n, t) for n, t in (("shard", long), ("cls", T.IntegerType()), ("h", long), ("g", long), ("two", yes), ("least", id_type), ("members", T.BinaryType()), ("ids", T.ArrayType(id_type)))])


def _packed(text) -> list[pa.Array]:
    """Texts compressed: what a join moves and keeps on disk is a third of what it were."""
    z = zstandard.ZstdCompressor(level=1)
    return [pa.array([z.compress(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary())]


def _unpacked(packed) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(b) for b in packed.to_pylist()], pa.binary())


def _names(text) -> list[pa.Array]:
    """The distinct window names of each text."""
    w = Hashed(text)
    doc, _, name = w.windows()
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])) if len(doc) else np.zeros(0, bool)
    count = np.bincount(doc[new], minlength=len(w.at) - 1)
    return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(name[new].view(np.int64)))]


def _least(values: pa.Array, order: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The smallest value of each run of ``values`` taken in ``order``; null if a run has nulls only."""
    rank = pc.rank(values, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    low = np.minimum.reduceat(rank[order], begin) if len(begin) else np.zeros(0, np.int64)
    one = np.zeros(int(rank.max()) + 1 if len(rank) else 1, np.int64)
    one[rank] = np.arange(len(rank))
    return values.take(pa.array(one[low]))


class _Shard:
    """Gathers the words of windows that may repeat, and returns their classes and the classes' members."""

    def __init__(self, number: int):
        self.number, self.words, self.parts, self.ids = number, 0, [], []

    def add(self, batch: pa.RecordBatch) -> None:
        ids, packed, hot = batch.columns
        w = Hashed(_unpacked(packed), wide=True)
        doc, first, name = w.windows()
        off = hot.offsets.to_numpy()
        listed = hot.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64)
        owner = np.repeat(np.arange(len(hot)), np.diff(off))
        # (text, name) is asked for in the list of (text, hot name): ranks of names make both one integer
        all_names = sorted_unique(listed)
        at = np.searchsorted(all_names, name)
        known = at < len(all_names)
        known[known] &= all_names[at[known]] == name[known]
        want = np.isin(doc * (len(all_names) + 1) + at, owner * (len(all_names) + 1) + np.searchsorted(all_names, listed)) & known
        first, doc = first[want], doc[want]
        if not len(first):
            return
        cut = np.flatnonzero(np.append(True, (np.diff(first) > LEAST) | (np.diff(doc) > 0)))  # gaps between pieces
        a, b = first[cut], first[np.append(cut[1:], len(first)) - 1] + LEAST
        size = b - a
        flat = ragged(a, size)
        owner = np.repeat(doc[cut], size)
        full = np.repeat(np.cumsum(size), size) - np.arange(len(flat)) >= LEAST
        hashes = np.zeros((2, len(flat)), np.uint64)
        hashes[:, full] = [w.runs(flat[full], LEAST, second) for second in (False, True)]
        place = np.arange(len(w.word)) - np.repeat(w.at[:-1], np.diff(w.at))
        wanted = np.zeros(len(w.word), bool)
        wanted[first] = True
        self.parts.append((w.word[flat], size, hashes[0], hashes[1], owner + sum(map(len, self.ids)), place[flat], wanted[flat]))
        self.ids.append(ids)
        self.words += len(flat)

    def rows(self, schema: pa.Schema) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        word, size, h, g, doc, pos, wanted = (np.concatenate(x) for x in zip(*self.parts))
        ids = pa.concat_arrays(self.ids)
        cls = shard_classes(word, np.append(0, np.cumsum(size)))
        take = np.flatnonzero((cls >= 0) & wanted)
        one, cls = np.unique(cls[take], return_inverse=True)  # a position of each class stands for it
        doc, pos = doc[take], pos[take]
        order = np.argsort(cls, kind="stable")
        begin = np.flatnonzero(np.diff(cls[order], prepend=-1))
        two = np.minimum.reduceat(doc[order], begin) != np.maximum.reduceat(doc[order], begin) if len(begin) else np.zeros(0, bool)
        n = len(one)
        members = zstandard.ZstdCompressor(level=1).compress(np.stack([doc, np.diff(pos, prepend=0), cls]).astype("<i4").tobytes())
        number = pa.array(np.full(n + 1, self.number, np.int64))
        cells = [pa.array(np.arange(n, dtype=np.int32)), pa.array(h[one].view(np.int64)), pa.array(g[one].view(np.int64)), pa.array(two), _least(ids.take(pa.array(doc)), order, begin), pa.nulls(n, pa.binary()), pa.nulls(n, schema.field("ids").type)]
        tail = [None, None, None, None, None, members, ids.to_pylist()]
        both = [pa.concat_arrays([c.cast(f.type), pa.array([x], f.type)]) for c, x, f in zip(cells, tail, list(schema)[1:])]
        return pa.RecordBatch.from_arrays([number, *both], schema=schema)


def _shards(schema: pa.Schema):
    def run(batches):
        base = TaskContext.get().partitionId() << 24
        shard, n = _Shard(base), 0
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                shard.add(part)
                if shard.words >= SHARD_WORDS:
                    yield shard.rows(schema)
                    n += 1
                    shard = _Shard(base + n)
        last = shard.rows(schema)
        if last is not None:
            yield last

    return run


def _merged(schema: pa.Schema):
    """(shard, cls, first) of the classes that stand in two documents: in two of one shard, or in two shards, since
    a document is in one shard only."""

    def run(batches):
        batches = list(batches)
        rows = pa.Table.from_batches(batches) if batches else None
        if rows is None or not rows.num_rows:
            return
        whole = lambda c: rows.column(c).combine_chunks()
        h, g, shard, two = (whole(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "shard", "two"))
        by_shard = np.lexsort((g, h, shard))
        cut = np.flatnonzero(np.diff(shard[by_shard])) + 1
        order = by_shard[merge_runs(np.split(h[by_shard], cut))]
        h, g = h[order], g[order]
        if (uneven := np.flatnonzero((h[1:] == h[:-1]) & (g[1:] < g[:-1]))).size:  # one h, several g: all but never
            mixed = np.isin(h, h[uneven])
            at = np.flatnonzero(mixed)
            order[at] = order[at][np.lexsort((g[at], h[at]))]
            h, g = whole("h").to_numpy()[order], whole("g").to_numpy()[order]
        head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        size = np.diff(np.append(head, len(h)))
        twice = (size > 1) | np.logical_or.reduceat(two[order], head)
        first = _least(whole("least"), order, head)
        live = np.repeat(twice, size)
        at = order[live]
        made = [whole("shard").take(pa.array(at)), whole("cls").take(pa.array(at)), first.take(pa.array(np.repeat(np.arange(len(head)), size)[live]))]
        yield pa.RecordBatch.from_arrays(made, schema=schema)

    return run


def _passages(schema: pa.Schema):
    """A shard's runs of neighbouring windows with one first document."""

    def run(key, shard, found):
        if not shard.num_rows or not found.num_rows:
            return schema.empty_table()
        doc, pos, cls = np.frombuffer(zstandard.ZstdDecompressor().decompress(shard.column("members")[0].as_py()), "<i4").reshape(3, -1)
        pos = np.cumsum(pos)
        ids = shard.column("ids").combine_chunks().flatten()
        coded = found.column("first").combine_chunks().dictionary_encode()
        code = np.full(int(cls.max()) + 1, -2, np.int64)
        code[found.column("cls").to_numpy()] = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        live = np.flatnonzero(code[cls] > -2)
        doc, pos, code = doc[live], pos[live], code[cls][live]
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(pos) != 1) | (np.diff(code) != 0))[: len(doc)]
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(doc)) - 1
        n = pos[z] + LEAST - pos[a]
        first = coded.dictionary.take(pa.array(code[a], mask=code[a] < 0))
        return pa.table([ids.take(pa.array(doc[a])), *(pa.array(x.astype(np.int32)) for x in (pos[a], pos[z] + LEAST, n)), first], schema=schema)

    return run


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", merge_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc): words [start_word, end_word) repeat across documents,
    and first_doc is the smallest id that has them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    id_type = slim.schema["id"].dataType
    k1, k2 = row_key("id", "t")
    slim = slim.withColumn("k1", k1).withColumn("k2", k2)
    shape, int_type = shard_type(id_type), T.IntegerType()
    out = T.StructType([T.StructField(n, t) for n, t in (("doc_id", id_type), ("start_word", int_type), ("end_word", int_type), ("n_words", int_type), ("first_doc", id_type))])
    back = T.StructType([T.StructField("shard", T.LongType()), T.StructField("cls", int_type), T.StructField("first", id_type)])
    with scratch(df.sparkSession):
        named, _ = write_table(map_text(slim, "t", [("names", T.ArrayType(T.LongType()))], lambda: _names, drop=("t", "id")), "names")
        pairs = named.select("k1", "k2", F.explode("names").alias("name"))
        # k1 tells two documents of one name apart but for one in 2^64 such pairs
        shared = pairs.groupBy("name").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a != b").select("name")
        hot, _ = write_table(pairs.join(shared, "name").groupBy("k1", "k2").agg(F.collect_set("name").alias("hot")), "windows")
        packed = map_text(slim, "t", [("packed", T.BinaryType())], lambda: _packed, drop=("t",))
        once = packed.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("packed").alias("packed"))
        both = once.join(hot, ["k1", "k2"]).select("id", "packed", "hot")
        shards, _ = write_table(both.mapInArrow(_shards(to_arrow_schema(shape)), shape), "shards")
        classes = shards.where("members is null").select("shard", "cls", "h", "g", "two", "least")
        parts = max(1, -(-classes.count() // merge_rows))
        twice = classes.repartition(parts, "h").mapInArrow(_merged(to_arrow_schema(back)), back)
        whole = shards.where("members is not null").select("shard", "members", "ids")
        found = whole.groupBy("shard").cogroup(twice.groupBy("shard")).applyInArrow(_passages(to_arrow_schema(out)), out)
        result, path = write_table(found, "passages")
        keep_table(path)
    return result


#: DuckDB SQL for :func:`repeated_passages` over ``documents``.
SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(ws[i:i + {LEAST - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {LEAST - 2})) AS i FROM w WHERE len(ws) >= {LEAST})),
r AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, pos, first_doc, pos - row_number() OVER (PARTITION BY doc_id, first_doc ORDER BY pos) AS run FROM g JOIN r USING (h))
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + {LEAST} AS INTEGER) AS end_word, CAST(max(pos) + {LEAST} - min(pos) AS INTEGER) AS n_words, first_doc FROM m GROUP BY doc_id, first_doc, run"""
