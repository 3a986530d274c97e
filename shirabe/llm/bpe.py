"""Byte-level BPE: encoding with character offsets, and decoding.

The tokenizers library encodes Arrow batches. A text is first cut where no token can span, so that equal pieces
of a batch are encoded once (and those a worker still knows not at all); ids are then laid out by numpy. Token byte
lengths give byte offsets, and the text's own bytes map these to characters. No id is ever looked up in Python row
by row.

Cuts are safe for tokenizer files whose pre-tokenizer parts words, numbers, signs and white space as the byte-level
one does: before white space that follows something else; and inside longer pieces between ASCII letters, digits
and signs, and between two bytes that stand side by side in no token, since then no merge can cross. A run in
which any two neighbours may merge (one letter a million times) has no safe cut and goes alone.

Defined results: a null text gives nulls; an empty text gives empty lists and 0 tokens; strings of special
tokens are ordinary text; repeated rows stay repeated; an empty table stays empty; other columns are
carried, and those that bear an output's name become ``<name>_in``. Texts of any length that a column can hold
(2 GiB) are encoded whole: a text has no more ids than bytes, which 32-bit offsets can count.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, int_lists, make_room, map_text, ragged, utf8_parts, with_nulls

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text in one call of the tokenizers library, and of pieces that it gets as one text.
CALL_BYTES, JOINED_BYTES = 1 << 18, 1 << 12
#: Pieces of more bytes are cut further.
LONG = 256
#: Pieces that a worker remembers, and their bytes, at most (and those of one step).
HELD, HELD_BYTES = 1 << 18, 16 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LAST, _SECOND = np.zeros(256, bool), np.zeros(256, bool)
_LAST[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F, 0x8E]] = True  # how Unicode white space ends
_SECOND[[0xC2, 0x80, 0x81, 0x9A, 0xA0]] = True
_QUOTE = ord("'")
#: 1 ASCII letters, 2 digits, 3 signs, 0 all else.
_CLASS = np.array([1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)] + [0] * 128, np.uint8)
_CLASS[_SPACE] = 0


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A tokenizer file with its byte table; one for each worker and path."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        back, vocab = byte_characters(), self.tok.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        table: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            table[i] = added[i].encode() if i in added else bytes(back[c] for c in s)
        self.length = np.array([len(b) for b in table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        #: Which bytes (first * 256 + second) stand side by side in some token.
        self.meet = np.zeros(1 << 16, bool)
        inner = np.ones(len(self.bytes), bool)
        inner[self.start[self.length > 0]] = False
        at = np.flatnonzero(inner)
        self.meet[self.bytes[at - 1].astype(np.int64) << 8 | self.bytes[at]] = True
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.first, self.count, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def slots(self, pieces: pa.Array) -> np.ndarray:
        """Of each distinct piece, the place of its ids: ``ids[first[slot] : first[slot] + count[slot]]``."""
        if len(self.slot) > HELD or self.held > HELD_BYTES:
            self._forget()
        texts, get = pieces.to_pylist(), self.slot.get
        at = np.fromiter((get(t, -1) for t in texts), np.int64, len(texts))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh_ones = pieces.take(pa.array(new))
            ids, counts = self.encode_each(fresh_ones)
            at[new] = len(self.count) + np.arange(len(new))
            self.slot.update(zip((texts[i] for i in new.tolist()), at[new].tolist()))
            self.first = np.append(self.first, len(self.ids) + np.cumsum(counts) - counts)
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, counts)
            self.held += int(utf8_parts(fresh_ones)[1][-1])
        return at

    def encode_each(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, one after another; number of ids of each piece), in calls balanced by bytes. Pieces between
        which a cut is safe go to the library as one text; where tokens end tells them apart."""
        data, off, _ = utf8_parts(pieces)
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        begin, last = data[off[:-1]], data[off[1:] - 1]
        alone = np.append(True, ~(_SPACE[begin[1:]] & ~_SPACE[last[:-1]] & ~_LAST[last[:-1]]))
        head = np.flatnonzero(alone | np.append(True, np.diff(off[:-1] // JOINED_BYTES) > 0))
        joined = _strings(data, np.append(off[head], off[-1]))
        got = [e.ids for part in balanced(joined) for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), np.int32)
        end = np.cumsum(self.length[ids])
        if len(end) and end[-1] == len(data):
            return ids, np.bincount(np.searchsorted(off, end - self.length[ids], "right") - 1, minlength=len(pieces))
        got = [e.ids for part in balanced(pieces) for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes for which the ids stand; ids outside the table stand for none."""
        ids = ids[(ids >= 0) & (ids < len(self.length))]
        return self.bytes[ragged(self.start[ids], self.length[ids])]

    def texts(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The texts of lists of ids. A list's bytes are joined before they are read as UTF-8, so characters split
        over tokens come out whole; bytes that form no character become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.length))
        size = np.where(known, self.length[np.where(known, ids, 0)], 0)
        edges = np.append(0, np.cumsum(size))[off]
        raw = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.decode_bytes(ids)))])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.large_string())


def _strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    wide = len(data) > 2**31 - 2
    return pa.Array.from_buffers(pa.large_string() if wide else pa.string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def balanced(pieces: pa.Array):
    """Lists of texts of about CALL_BYTES each; a longer piece, which has no safe boundary, goes alone."""
    _, off, _ = utf8_parts(pieces)
    at = 0
    while at < len(pieces):
        end = max(at + 1, int(np.searchsorted(off, off[at] + CALL_BYTES, "right")) - 1)
        yield pieces.slice(at, end - at).to_pylist()
        at = end


def _inner_cuts(data: np.ndarray, at: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """Which places inside pieces are safe, too. None is next to a quote, before which and in which a word may be
    cut by the pre-tokenizer in another way, nor behind what could be white space."""
    left, right = data[at - 1], data[at]
    quote = (left == _QUOTE) | (right == _QUOTE) | (data[np.maximum(at - 2, 0)] == _QUOTE)
    between = (right & 0xC0 != 0x80) & ~_SPACE[left] & ~(_LAST[left] & _SECOND[data[np.maximum(at - 2, 0)]]) & ~quote
    kinds = (_CLASS[left] > 0) & (_CLASS[right] > 0) & (_CLASS[left] != _CLASS[right])
    return at[between & (kinds | ~meet[left.astype(np.int64) << 8 | right])]


def safe_pieces(data: np.ndarray, off: np.ndarray, meet: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Cut texts at safe boundaries: (piece codes in order, distinct pieces, piece offsets of the texts).

    White space only starts a token or stands in a token of white space alone, so a boundary before it is
    safe if what precedes isn't white space. After bytes that could end a Unicode space none is assumed.
    ``meet``: which bytes stand side by side in a token.
    """
    if not len(data):
        return np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros(len(off), np.int64)
    head = _SPACE[data]
    solid = ~head & ~_LAST[data]
    odd = np.flatnonzero(_LAST[data])
    solid[odd] = ~_SECOND[data[odd - 1]] & (odd > 0)
    head[1:] &= solid[:-1]
    head[0] = True
    head[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(data)))
    long = np.flatnonzero(size > LONG)
    if len(long):
        head[_inner_cuts(data, ragged(start[long] + 1, size[long] - 1), meet)] = True
        start = np.flatnonzero(head)
    coded = _strings(data, np.append(start, len(data))).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(start, off)


def encode_arrow(text: pa.Array, path: str, check: bool = True):
    """(valid, n_tokens, id offsets, ids, char starts, char ends, does it decode to the text)."""
    c = codec(path)
    data, off, valid = utf8_parts(text)
    codes, pieces, piece_off = safe_pieces(data, off, c.meet)
    slot = c.slots(pieces)[codes]
    each = c.count[slot]
    ids = c.ids[ragged(c.first[slot], each)]
    tok_off = np.append(0, np.cumsum(each))[piece_off]
    end = np.cumsum(c.length[ids])
    begin = end - c.length[ids]
    char = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)  # characters begun up to each byte
    base = np.repeat(np.append(0, char)[off[:-1]], np.diff(tok_off)).astype(np.int32)
    same = np.ones(len(text), bool)
    if check:
        same = pc.equal(c.texts(ids, tok_off), text.cast(pa.large_string()).fill_null("")).to_numpy(zero_copy_only=False)
    return valid, np.diff(tok_off), tok_off, ids, char[begin] - 1 - base if len(ids) else ids, char[end - 1] - base if len(ids) else ids, same


def encode(df: DataFrame, text_col: str = "text", path: str = DEFAULT_TOKENIZER, keep_text: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``token_ids``, ``char_starts``, ``char_ends`` and ``round_trip``.

    Token i covers characters [char_starts[i], char_ends[i]); tokens that share a split character all
    cover it. ``round_trip`` tells that decoding gave the text's bytes again.
    """
    ints = T.ArrayType(T.IntegerType())

    def start():
        def f(text):
            valid, n, tok_off, ids, a, b, same = encode_arrow(text, path)
            return [with_nulls(pa.array(n.astype(np.int32)), valid), *(int_lists(x.astype(np.int32, copy=False), tok_off, valid) for x in (ids, a, b)), with_nulls(pa.array(same), valid)]

        return f

    out = [("n_tokens", T.IntegerType()), ("token_ids", ints), ("char_starts", ints), ("char_ends", ints), ("round_trip", T.BooleanType())]
    return map_text(df, text_col, out, start, drop=() if keep_text else (text_col,))


def decode_arrow(ids: pa.Array, path: str) -> pa.Array:
    """Texts of lists of ids; ids outside the table stand for nothing."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    off = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.slice(off[0], off[-1] - off[0]).fill_null(-1).to_numpy(zero_copy_only=False)
    return with_nulls(codec(path).texts(flat, off - off[0]).cast(pa.string()), np.asarray(ids.is_valid()))


def decode(df: DataFrame, ids_col: str = "token_ids", path: str = DEFAULT_TOKENIZER, out_col: str = "decoded") -> DataFrame:
    """Add the text for which the ids stand; null for null, empty for an empty list."""
    src = fresh([*df.columns, out_col], "__ids")
    df = make_room(df.withColumn(src, F.col(ids_col).cast("array<int>")), [out_col])
    carry = [c for c in df.columns if c != src]
    df = df.select(*carry, src)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], decode_arrow(part.column(len(carry)), path)], names=[*carry, out_col])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in carry), T.StructField(out_col, T.StringType())]))
