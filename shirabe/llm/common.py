"""What the operators of this subpackage share: shared-folder tables, column names, byte-bounded
Arrow batches and vectorised word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
STEP_BYTES = 4 << 20
_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


# --- tables in the shared folder --------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; only where that is unset and all runs
    in one process (tests) a temporary one, removed at exit."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shirabe-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Tables written inside of each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: lineage ends there, so that a lost
    executor costs its running tasks only. The table goes when the :func:`scratch` around it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shirabe/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end. Operators put it round their intermediate tables;
    put it round an operator and the writing of its result to delete what that result reads as well."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_table(spark, path)


def keep_table(path: str) -> None:
    """Let a table outlive the innermost scope: it goes with the scope around that, if there is one."""
    if _SCOPES and path in _SCOPES[-1]:
        _SCOPES[-1].remove(path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`write_table` made and no plan needs any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


# --- names -------------------------------------------------------------------------------------
def fresh(taken, base: str) -> str:
    """``base``, or with underscores after it until no column of ``taken`` is called so."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def make_room(df: DataFrame, outputs) -> DataFrame:
    """Columns of ``df`` that bear the name of an output are renamed ``<name>_in`` (underscores are
    added while that is taken as well), so that neither is lost."""
    out = {o.lower() for o in outputs}
    for c in df.columns:
        if c.lower() in out:
            df = df.withColumnRenamed(c, fresh([*df.columns, *outputs], f"{c}_in"))
    return df


def row_key(*cols) -> list:
    """Two 64-bit hashes of the columns: a null-safe 128-bit key of a row's content."""
    each = [x for c in (F.col(c) if isinstance(c, str) else c for c in cols) for x in (c, c.isNull())]
    return [F.xxhash64(*each), F.xxhash64(F.lit(0x5EED), *reversed(each))]


# --- Arrow batches -------------------------------------------------------------------------------
def utf8_parts(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 from 0, validity) of an Arrow string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    valid = np.ones(len(arr), bool) if not arr.null_count else np.asarray(arr.is_valid())
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0], valid


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``most`` bytes in ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    _, off, _ = utf8_parts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def map_text(df: DataFrame, text_col: str, outputs: list[tuple[str, T.DataType]], start: Callable[[], Callable], drop=(), step_bytes: int = STEP_BYTES) -> DataFrame:
    """Add columns computed from the text column, batch by batch, in one pass without a shuffle.

    ``start()`` is called once for each task and returns ``f(text array) -> [array of each output]``.
    All columns of ``df`` are carried but those in ``drop``; see :func:`make_room` for clashing names.
    """
    names = [n for n, _ in outputs]
    src = fresh([*df.columns, *names], "__text")
    df = df.withColumn(src, F.col(text_col).cast("string")).drop(*drop)
    df = make_room(df, names)
    carry = [c for c in df.columns if c != src]
    df = df.select(*carry, src)
    schema = T.StructType([*(df.schema[c] for c in carry), *(T.StructField(n, t) for n, t in outputs)])

    def run(batches):
        f = start()
        for batch in batches:
            for part in slices(batch, len(carry), step_bytes):
                made = f(part.column(len(carry)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *made], names=[*carry, *names])

    return df.mapInArrow(run, schema)


def with_nulls(arr: pa.Array, valid: np.ndarray) -> pa.Array:
    """``arr`` with null wherever ``valid`` is false."""
    if valid.all():
        return arr
    return pa.compute.if_else(pa.array(valid), arr, pa.scalar(None, arr.type))


def int_lists(values: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A list array from flat values; lists that aren't valid are null and must be empty."""
    off = pa.array(offsets.astype(np.int32), mask=np.append(~valid, False) if not valid.all() else None)
    return pa.ListArray.from_arrays(off, pa.array(values))


# --- words -----------------------------------------------------------------------------------------
def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets of the texts): maximal runs of bytes that aren't ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_ASCII_SPACE[data]
    head, tail = ink.copy(), ink.copy()
    head[1:] &= ~ink[:-1]
    tail[:-1] &= ~ink[1:]
    inner = off[1:-1]
    at = inner[(inner < len(data))]
    head[at] = ink[at]
    back = inner[inner > 0] - 1
    tail[back] = ink[back]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(start, off)


def spans_encoded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each span, the distinct spans as binary)."""
    if not len(start):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    wide = len(data) > 2**31 - 2
    edges = np.empty(2 * len(start) + 1, np.int64 if wide else np.int32)
    edges[0:-1:2], edges[1::2] = start, end
    edges[-1] = end[-1]  # an empty last gap
    arr = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), 2 * len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = arr.dictionary_encode()
    codes = coded.indices.to_numpy()[0::2]
    seen, codes = _compact(codes, len(coded.dictionary))
    return codes, coded.dictionary.take(pa.array(seen))


def _compact(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop the codes that don't occur (the gaps between spans)."""
    here = np.zeros(n, bool)
    here[codes] = True
    new = np.cumsum(here, dtype=np.int32) - 1
    return np.flatnonzero(here), new[codes]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; by sorting, which numpy does much faster than hashing them."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the concatenation of the ranges [start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total, dtype=np.int64)
