"""Telephony audio in media columns: mu-law, A-law and ADPCM payloads to resampled PCM.

mu-law and A-law bytes are expanded by tables of 256. IMA ADPCM (mono blocks: predictor int16, step index,
a spare byte, then two samples a byte, low half first) is decoded with numpy over all blocks of a batch at
once, sample by sample of the block. Resampling is polyphase windowed-sinc filtering; PCM is stored as 16-bit
little-endian bytes.

Defined results: a null payload or codec gives null PCM and no error; an empty payload gives empty PCM; an
unknown codec gives null PCM and an error; a last ADPCM block that is short is decoded as far as it goes, and
one without a whole header is left out with an error; a step index over 88 counts as 88; a payload whose PCM no
cell can hold (2 GiB) gives null PCM and an error. Rows are handled one by one; other columns are carried (``<name>_in`` where they bear an output's name).
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, make_room, ragged, slices, utf8_parts, with_nulls

CODECS = ("mulaw", "alaw", "ima_adpcm")
IN_RATE, OUT_RATE, BLOCK = 8000, 16000, 256
#: Zeros of the filter on either side; in input samples, more of them the lower the cut-off (see :func:`reach`).
ZEROS = 16
#: Bytes that a cell can hold.
CELL = 2**31 - 64


def _mulaw() -> np.ndarray:
    b = ~np.arange(256, dtype=np.uint8)
    size = (((b & 15).astype(np.int32) << 3) + 132 << ((b >> 4) & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    b = np.arange(256, dtype=np.uint8) ^ 0x55
    low, seg = (b & 15).astype(np.int32) << 4, ((b >> 4) & 7).astype(np.int32)
    size = np.where(seg == 0, low + 8, (low + 264) << np.maximum(seg - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}
# fmt: off
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
# fmt: on
_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_c = np.arange(16)
#: By step index and code: the change of the predictor, and the next step index.
CHANGE = ((STEPS[:, None] >> 3) + (_c & 1) * (STEPS[:, None] >> 2) + (_c >> 1 & 1) * (STEPS[:, None] >> 1) + (_c >> 2 & 1) * STEPS[:, None]) * np.where(_c & 8, -1, 1)
NEXT = np.clip(np.arange(89)[:, None] + _SHIFT, 0, 88)


def decode_adpcm(data: np.ndarray, off: np.ndarray, block: int = BLOCK):
    """(samples, sample offsets, was a broken block left out) of payloads of ADPCM blocks."""
    if block < 5:
        raise ValueError("an ADPCM block has a header of 4 bytes and some samples")
    size = np.diff(off)
    whole = -(-size // block)
    doc = np.repeat(np.arange(len(size)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    begin = off[:-1][doc] + nth * block
    length = np.minimum(block, off[1:][doc] - begin)
    broken = np.zeros(len(size), bool)
    broken[doc[length < 4]] = True
    good = length >= 4
    doc, begin, length = doc[good], begin[good], length[good]
    count = 1 + 2 * (length - 4)
    out = np.zeros((len(doc), 1 + 2 * (block - 4)), np.int16)
    if len(doc):
        padded = np.append(data, np.zeros(block, np.uint8))
        cells = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, block)[begin].T)
        pred = (cells[0].astype(np.uint16) | cells[1].astype(np.uint16) << 8).view(np.int16).astype(np.int32)
        index = np.minimum(cells[2], 88).astype(np.int32)
        change, following = CHANGE.astype(np.int32).ravel(), NEXT.astype(np.int32).ravel()
        samples = np.empty((out.shape[1], len(doc)), np.int16)
        samples[0] = pred
        for k in range(4, block):
            for half in (0, 1):
                at = (index << 4) | (cells[k] >> 4 if half else cells[k] & 15)
                pred = np.clip(pred + change[at], -32768, 32767)
                index = following[at]
                samples[2 * k - 7 + half] = pred
        out = samples.T
    flat = out[np.arange(out.shape[1]) < count[:, None]] if len(doc) else np.zeros(0, np.int16)
    per = np.bincount(doc, weights=count, minlength=len(size)).astype(np.int64)
    return flat, np.append(0, np.cumsum(per)), broken


def reach(up: int, down: int) -> int:
    """Input samples on either side that an output sample depends on."""
    return -(-ZEROS * max(up, down) // (2 * up)) if down > up else ZEROS // 2


@lru_cache(maxsize=16)
def kernel(up: int, down: int) -> np.ndarray:
    """(up, 2 reach + 1) weights of the input samples around each output phase; each row sums to 1. Going down, the
    cut-off lies below half the new rate by the filter's own slope, so that what is above doesn't fold back."""
    cut, wide = min(1.0, up / down), reach(up, down)
    if down > up:
        wide, cut = 2 * wide, cut * (1 - 2 / ZEROS)
    t = np.arange(-wide, wide + 1)[None, :] - (np.arange(up) / up)[:, None]
    w = np.sinc(t * cut) * np.where(np.abs(t) <= wide, 0.5 + 0.5 * np.cos(np.pi * t / (wide + 1)), 0)
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, off: np.ndarray, rate: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit signals at another rate: ceil(n * to / rate) samples; silence is assumed around a signal."""
    if rate == to or not len(x):
        return x, off
    g = gcd(rate, to)
    up, down = to // g, rate // g
    n = np.diff(off)
    h = kernel(up, down)
    side = h.shape[1] // 2
    room = n + 2 * side
    base = np.cumsum(room) - room + side
    wide = np.zeros(int(room.sum()), np.float32)
    spot = ragged(base, n)
    wide[spot] = x
    n_out = -(-n * up // down)
    out_off = np.append(0, np.cumsum(n_out))
    if down == 1:  # every input sample yields ``up`` output samples
        out = np.empty((len(x), up), np.int16)
        for p in range(up):
            if p == 0 and abs(h[0, side] - 1) < 1e-6:
                out[:, 0] = x
                continue
            y = np.zeros(len(wide), np.float32)
            for k in range(-side, side + 1):
                if h[p, k + side]:
                    a, b = max(0, -k), len(wide) - max(0, k)
                    y[a:b] += h[p, k + side] * wide[a + k : b + k]
            out[:, p] = np.clip(np.rint(y[spot]), -32768, 32767)
        return out.ravel(), out_off
    t = (np.arange(out_off[-1]) - np.repeat(out_off[:-1], n_out)) * down
    at = np.repeat(base, n_out) + t // up
    phase = t % up
    y = np.zeros(len(t), np.float32)
    for k in range(-side, side + 1):
        y += h[phase, k + side] * wide[at + k]
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16), out_off


def decode_batch(payload: pa.Array, codec: list, rate: int, to: int, block: int):
    """[pcm, n_samples, sample_rate, error] of payloads."""
    data, off, valid = utf8_parts(payload)
    n = len(valid)
    pcm: list[bytes | None] = [None] * n
    error: list[str | None] = [None] * n
    for name in {c for c in codec if c is not None}:
        rows = np.array([i for i in range(n) if codec[i] == name and valid[i]], np.int64)
        if name not in CODECS:
            for i in rows:
                error[i] = f"unknown codec {name}"
            continue
        size = np.diff(off)[rows]
        own, own_off = data[ragged(off[:-1][rows], size)], np.append(0, np.cumsum(size))
        if name == "ima_adpcm":
            x, at, broken = decode_adpcm(own, own_off, block)
            for i in rows[broken]:
                error[i] = "a last block without a whole header was left out"
        else:
            x, at = TABLES[name][own], own_off
        y, at = resample(x, at, rate, to)
        for i in rows[2 * np.diff(at) > CELL]:
            error[i] = "the samples would not fit a cell"
        raw = memoryview(np.ascontiguousarray(y, "<i2")).cast("B")
        for k, i in enumerate(rows.tolist()):
            if 2 * (at[k + 1] - at[k]) <= CELL:
                pcm[i] = raw[2 * at[k] : 2 * at[k + 1]].tobytes()
    has = np.array([p is not None for p in pcm], bool)
    count = pa.array(np.array([len(p) // 2 if p is not None else 0 for p in pcm], np.int32))
    return [pa.array(pcm, pa.binary()), with_nulls(count, has), with_nulls(pa.array(np.full(n, to, np.int32)), has), pa.array(error, pa.string())]


def decode_audio(df: DataFrame, payload_col: str = "payload", codec_col: str = "codec", rate: int = IN_RATE, to: int = OUT_RATE, block: int = BLOCK, step_bytes: int = 1 << 20) -> DataFrame:
    """Replace the payload by ``pcm``, ``n_samples``, ``sample_rate`` and ``error``; one pass, no shuffle."""
    names = ["pcm", "n_samples", "sample_rate", "error"]
    src, how = (fresh([*df.columns, *names], x) for x in ("__payload", "__codec"))
    df = make_room(df.withColumn(src, F.col(payload_col).cast("binary")).withColumn(how, F.col(codec_col).cast("string")).drop(payload_col), names)
    carry = [c for c in df.columns if c not in (src, how)]
    df = df.select(*carry, src, how)
    kinds = [T.BinaryType(), T.IntegerType(), T.IntegerType(), T.StringType()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(carry), step_bytes):
                made = decode_batch(part.column(len(carry)), part.column(len(carry) + 1).to_pylist(), rate, to, block)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *made], names=[*carry, *names])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in carry), *(T.StructField(a, k) for a, k in zip(names, kinds))]))
