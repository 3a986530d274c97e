"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, these into longer phrases, and so on up to one. On each level runs of
equal symbols count as one; deterministic coin tossing (the lowest bit in which a symbol differs from its left
neighbour, repeated) brings the symbols down to six labels and then to three colours that differ from their
neighbours; a phrase begins at each local maximum of the colours. A phrase's name hashes its symbols and run
lengths. Where a phrase begins depends on a few symbols to either side only, so equal substrings, wherever they
stand, get equal names but for some phrases at their edges.

Defined results: null text, nulls; empty text, root 0, no phrases, 0 levels, no lists; a text with fewer levels than
asked for has its root as its only phrase. Equal texts have equal fingerprints; rows are handled one by one; other
columns are carried (``<name>_in`` where they bear an output's name).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import int_lists, map_text, mix64, ragged, utf8_parts, with_nulls

#: The level whose phrases are returned as ``phrases``: they have about 80 bytes each. Some 150 to 250 bytes at the
#: edges of a shared passage have no common name there, so a short passage may have none.
LEVEL = 5
#: The finest level of ``hierarchy``: of periodic passages, only this one may keep a name that doesn't reach into
#: what stands around them.
FINEST = 1
#: Names take some six times a text's bytes, so steps are shorter than those of other operators.
STEP_BYTES = 1 << 19
_LOW = np.zeros(256, np.uint8)
for _i in range(1, 256):
    _LOW[_i] = (_i & -_i).bit_length() - 1
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(64)], np.uint64)
_RUN = np.uint64(0xD6E8FEB86659FD93)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest differing bit's place, plus the bit. The first symbol of
    a text is taken to differ in bit 0."""
    out = np.empty(len(x), np.uint8)
    if x.dtype == np.uint8:
        place = np.empty(len(x), np.uint8)
        place[1:] = _LOW[x[1:] ^ x[:-1]]
        place[first] = 0
        np.right_shift(x, place, out=out)
    else:
        d = np.empty(len(x), np.uint64)
        np.bitwise_xor(x[1:], x[:-1], out=d[1:])
        d[first] = 1
        d &= ~d + np.uint64(1)
        wide = (d.astype(np.float64).view(np.int64) >> 52) - 1023  # exact for powers of two
        place = wide.astype(np.uint8)
        out[:] = x >> wide.astype(np.uint64) & np.uint64(1)
    out &= 1
    place <<= 1
    out |= place
    return out


def _colours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three colours; neighbours within a text differ."""
    c = _toss(x, first)
    for _ in range(2 if x.dtype == np.uint8 else 3):
        c = _toss(c, first)
    last = np.append(first[1:], len(x)) - 1
    for high in (5, 4, 3):
        at = np.flatnonzero(c == high)
        if not len(at):
            continue
        left, right = c[at - 1], c[np.minimum(at + 1, len(c) - 1)]
        edge = np.isin(at, first) if len(first) > 1 else at == 0
        left = np.where(edge, 255, left)
        edge = np.isin(at, last) if len(last) > 1 else at == len(c) - 1
        right = np.where(edge, 255, right)
        free = np.zeros(len(at), np.uint8)
        for _ in range(2):
            free += (free == left) | (free == right)
        c[at] = free
    return c


def _level(x: np.ndarray, first: np.ndarray):
    """(names of the phrases, where each text's begin) of texts that have a symbol at least."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    runs = len(at) < len(x)
    if runs:
        size = np.diff(np.append(at, len(x)))
        first = np.searchsorted(at, first)
        x = x[at]
    c = _colours(x, first)
    begin = np.zeros(len(x), bool)
    begin[1:-1] = (c[1:-1] > c[:-2]) & (c[1:-1] > c[2:])
    begin[np.append(first[1:], len(x)) - 1] = False  # neither the last symbol
    begin[np.minimum(first + 1, len(x) - 1)] = False  # nor the second one begins a phrase
    begin[first] = True
    start = np.flatnonzero(begin)
    value = _BYTE[x] if x.dtype == np.uint8 else x.copy()
    if runs:
        long = np.flatnonzero(size > 1)
        value[long] += size[long].astype(np.uint64) * _RUN
    count = np.diff(np.append(start, len(x)))
    place = np.arange(len(x)) - np.repeat(start, count)
    value *= _ODD[place]
    return mix64(np.add.reduceat(value, start) + count.astype(np.uint64)), np.searchsorted(start, first)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def hierarchy(data: np.ndarray, off: np.ndarray, finest: int = FINEST):
    """(root of each text, number of its levels, phrase names, offsets of the lists of them, list offsets of the
    texts): for each text a list for each level from ``finest`` to its root's, or of its root alone."""
    n = len(off) - 1
    root, levels = np.zeros(n, np.uint64), np.zeros(n, np.int32)
    owner, size_of, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    docs = np.flatnonzero(np.diff(off))
    x, first = data, off[:-1][docs]
    depth = 0
    while len(docs):
        x, first = _level(x, first)
        depth += 1
        size = np.diff(np.append(first, len(x)))
        done = size == 1
        root[docs[done]], levels[docs[done]] = x[first[done]], depth
        if depth >= finest:
            owner.append(docs), size_of.append(size), kept.append(x)
        elif done.any():
            owner.append(docs[done]), size_of.append(size[done]), kept.append(x[first[done]])
        if done.any():
            live = np.repeat(~done, size)
            x, docs = x[live], docs[~done]
            first = np.cumsum(size[~done]) - size[~done]
    whose, size = np.concatenate(owner), np.concatenate(size_of)
    order = np.argsort(whose, kind="stable")
    names = np.concatenate(kept)[ragged((np.cumsum(size) - size)[order], size[order])]
    return root, levels, names, np.append(0, np.cumsum(size[order])), np.append(0, np.cumsum(np.bincount(whose, minlength=n)))


def _at(level: int, finest: int, levels: np.ndarray, names: np.ndarray, edges: np.ndarray, lists: np.ndarray):
    """(phrase names at ``level``, their offsets) of a hierarchy from ``finest``."""
    which = np.where(levels > 0, lists[:-1] + np.clip(np.minimum(level, levels) - finest, 0, None), 0)
    count = np.where(levels > 0, np.diff(edges)[which], 0) if len(edges) > 1 else np.zeros(len(levels), np.int64)
    return names[ragged(edges[which], count)], np.append(0, np.cumsum(count))


def parse(data: np.ndarray, off: np.ndarray, level: int = LEVEL):
    """(root of each text, number of its levels, phrase names at ``level``, their offsets)."""
    root, levels, *rest = hierarchy(data, off, level)
    return root, levels, *_at(level, level, levels, *rest)


OUTPUTS = [("root", T.LongType()), ("levels", T.IntegerType()), ("n_phrases", T.IntegerType()), ("phrases", T.ArrayType(T.LongType())), ("hierarchy", T.ArrayType(T.ArrayType(T.LongType())))]


def fingerprints(df: DataFrame, text_col: str = "text", level: int = LEVEL, keep_text: bool = False) -> DataFrame:
    """Add ``root`` (the name of the whole text), ``levels``, ``phrases``: the names at ``level`` in order,
    ``n_phrases`` of them, and ``hierarchy``: a list of names for each level from FINEST to the root's."""

    def start():
        def f(text):
            data, off, valid = utf8_parts(text)
            root, levels, *rest = hierarchy(data, off, FINEST)
            names, at = _at(level, FINEST, levels, *rest)
            flat, edges, lists = rest
            inner = int_lists(flat.view(np.int64), edges, np.ones(len(edges) - 1, bool))
            nested = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32), mask=np.append(~valid, False) if not valid.all() else None), inner)
            return [with_nulls(pa.array(root.view(np.int64)), valid), with_nulls(pa.array(levels), valid), with_nulls(pa.array(np.diff(at).astype(np.int32)), valid), int_lists(names.view(np.int64), at, valid), nested]

        return f

    return map_text(df, text_col, OUTPUTS, start, drop=() if keep_text else (text_col,), step_bytes=STEP_BYTES)
