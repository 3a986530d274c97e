"""Scans: documents, lines and patches in, findings out.

A document is the unit of work, since evidence crosses lines; documents are independent, so a scan is one pass
without a shuffle. Catalyst drops documents without any character that a rule needs before Python sees them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..detect import rules as R
from ..detect.engine import Config, Detector, Finding, offsets

_I, _S, _B = T.IntegerType(), T.StringType(), T.BooleanType()
REASON = T.StructType([T.StructField(n, t) for n, t in (("base_confidence", _S), ("final_confidence", _S), ("context_keywords", T.ArrayType(_S)), ("context_promoted", _B), ("require_context", _B), ("context_window", _I), ("validated", _B), ("cooccurrence_boosted", _B), ("path_demoted", _B), ("kind", _S), ("external", _B))])
FINDING = T.StructType([T.StructField(n, t) for n, t in (("rule_id", _S), ("description", _S), ("line", _I), ("column", _I), ("match", _S), ("confidence", _I), ("score", _I), ("start", _I), ("end", _I), ("offset", _I), ("end_offset", _I), ("fail_only", _B), ("reason", REASON))])
DROP = T.StructType([T.StructField(n, t) for n, t in (("rule_id", _S), ("line", _I), ("column", _I), ("reason", _S), ("base_confidence", _S))])


def as_row(f: Finding, place: tuple[int, int] | None = None) -> dict:
    reason = {"base_confidence": R.LEVELS[f.base], "final_confidence": R.LEVELS[f.confidence], "context_keywords": f.keywords, "context_promoted": f.promoted, "require_context": f.required, "context_window": f.window, "validated": f.validated, "cooccurrence_boosted": f.boosted, "path_demoted": f.demoted, "kind": f.kind, "external": f.external}
    at = place or (None, None)
    return {"rule_id": f.rule_id, "description": f.about, "line": f.line, "column": f.start + 1, "match": f.match, "confidence": f.confidence, "score": f.score, "start": f.start, "end": f.end, "offset": at[0], "end_offset": at[1], "fail_only": f.fail_only, "reason": reason}


#: Rows whose values are Python's at a time.
_STEP = 256


def _values(c: pa.Array) -> list:
    """A column's values; lists are cut out of one list of all their values, which is several times as fast."""
    if not pa.types.is_list(c.type):
        return c.to_pylist()
    flat, at, out = c.flatten().to_pylist(), 0, []
    for n in c.value_lengths().to_pylist():
        out.append(None if n is None else flat[at : at + n])
        at += n or 0
    return out


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An array of values; structs field by field."""
    if pa.types.is_struct(kind):
        fields = list(kind)
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in fields], fields=fields)
    return pa.array(values, kind)


def spread(df: DataFrame, key: str = "k") -> DataFrame:
    """Few, costly texts, by their keys in several parts for each core: no row is sorted for it, and a slow task holds up
    little."""
    return df.repartition(_PARTS * df.sparkSession.sparkContext.defaultParallelism, key)


_PARTS = 3


def _rows_of(df: DataFrame, inputs: list[str], schema: T.StructType, make: Callable[[], Callable[..., list[dict]]]) -> DataFrame:
    """Each row's values of ``inputs`` to any number of rows, beside the other columns."""
    keys = [c for c in df.columns if c not in inputs]
    clash = {f.name for f in schema}
    low = {c.lower() for c in clash}
    for c in [k for k in keys if k.lower() in low]:
        new = f"{c}_in"
        while new.lower() in low | {x.lower() for x in df.columns}:
            new += "_"
        df, keys = df.withColumnRenamed(c, new), [new if k == c else k for k in keys]
    df = df.select(*keys, *inputs)
    out = T.StructType([*(df.schema[k] for k in keys), *schema.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for batch in batches:
            took, rows = [], []
            for begin in range(0, batch.num_rows, _STEP):
                step = batch.slice(begin, _STEP)
                for i, cells in enumerate(zip(*(_values(step.column(len(keys) + k)) for k in range(len(inputs)))), begin):
                    got = f(*cells)
                    if got:
                        took += [i] * len(got)
                        rows += got
            if rows:
                kept = [batch.column(k).take(pa.array(took)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*kept, *(_column([r[c.name] for r in rows], c.type) for c in arrow)], names=[*keys, *schema.names])

    return df.mapInArrow(run, out)


def scan_documents(df: DataFrame, text_col: str = "text", path_col: str | None = None, config: Config | None = None) -> DataFrame:
    """Findings of every text, beside the other columns. The path tells a file's kind; null texts have none."""
    config = config or Config()
    df, file = _with_file(df.where(Detector(config).gate(F.col(text_col))), path_col)

    def make():
        d = Detector(config)

        def f(text, file):
            found = d.scan(text, file or "") if text else []
            return [as_row(x, at) for x, at in zip(found, offsets(text, found))] if found else []

        return f

    return _rows_of(df, [text_col, file], FINDING, make)


def _with_file(df: DataFrame, path_col: str | None) -> tuple[DataFrame, str]:
    """``df`` with the path in a column of a new name, and the name."""
    name, taken = "__file", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return df.withColumn(name, F.col(path_col).cast("string") if path_col else F.lit("")), name


def scan_lines(df: DataFrame, line_col: str = "line_text", config: Config | None = None) -> DataFrame:
    """Findings of single lines, without what neighbours or structure could say."""
    config = config or Config()

    def make():
        d = Detector(config)
        return lambda text: [as_row(x) for x in d.scan_line(text)] if text else []

    return _rows_of(df, [line_col], FINDING, make)


#: Drops of a text that a report lists, at most.
LISTED = 1000


def dropped(df: DataFrame, text_col: str = "text", path_col: str | None = None, config: Config | None = None, most: int | None = LISTED) -> DataFrame:
    """Candidates that were dropped, and why: at most ``most`` for each text (None: all), with ``truncated`` if there
    were more (the log is a report; counts are of :func:`dropped_counts`)."""
    config = config or Config()
    df, file = _with_file(df.where(Detector(config).gate(F.col(text_col))), path_col)
    schema = T.StructType([*DROP.fields, T.StructField("truncated", _B)])

    def make():
        from dataclasses import replace

        d = Detector(replace(config, log_drops=True))

        def f(text, file):
            d.drops = []
            if text:
                d.scan(text, file or "")
            return [{"rule_id": x.rule_id, "line": x.line, "column": x.column, "reason": x.reason, "base_confidence": R.LEVELS[x.confidence], "truncated": most is not None and len(d.drops) > most} for x in d.drops[:most]]

        return f

    return _rows_of(df, [text_col, file], schema, make)


def dropped_counts(df: DataFrame, text_col: str = "text", path_col: str | None = None, config: Config | None = None) -> DataFrame:
    """(rule_id, reason, n) over every dropped candidate of all texts."""
    return dropped(df, text_col, path_col, config, most=None).groupBy("rule_id", "reason").agg(F.count("*").alias("n"))


def scan_hunks(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Findings on added lines. Columns: file, first_line, texts, added; optional csv_header and post_image."""
    config = config or Config()
    for c in ("csv_header", "post_image"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    df, name = _with_file(df, "file")

    def make():
        d = Detector(config)
        return lambda file, first, texts, added, header, post: [as_row(x) for x in d.scan_hunk(file or "", first, texts, added, header or "", post or "")]

    return _rows_of(df, [name, "first_line", "texts", "added", "csv_header", "post_image"], FINDING, make)


class _TooLong(Exception):
    pass


def _bounded(recognize: Callable, seconds: float | None) -> Callable:
    """``recognize`` whose call ends after ``seconds`` (by a timer's signal, in the worker's main thread), and whose
    failure gives no candidates."""
    import signal
    import threading

    def stop(*_):
        raise _TooLong

    def f(path, text):
        timed = seconds is not None and threading.current_thread() is threading.main_thread() and hasattr(signal, "setitimer")
        try:
            if timed:
                before = signal.signal(signal.SIGALRM, stop)
                signal.setitimer(signal.ITIMER_REAL, seconds)
            return list(recognize(path, text))
        except Exception:  # whatever a recognizer of the user's own raises; its text has our findings only
            return []
        finally:
            if timed:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, before)

    return f


def external_candidates(df: DataFrame, recognize: Callable[[str, str], list[dict]], text_col: str = "text", path_col: str | None = None, most: int = 1000, config: Config | None = None, seconds: float | None = 30.0) -> DataFrame:
    """Findings of a recognizer of the user's own, beside ours and resolved with them.

    ``recognize(path, text)`` returns dicts of rule_id, line, column, length and confidence. A rule id must
    begin with ``x-``; if any candidate of a text is out of range, or there are more than ``most``, all of that
    text's are discarded, and so they are if the recognizer raises or takes more than ``seconds`` over it."""
    config = config or Config()
    df, name = _with_file(df, path_col)
    levels = {v: k for k, v in R.LEVELS.items()}

    def make():
        from ..detect.engine import settle

        d, ask = Detector(config), _bounded(recognize, seconds)

        def theirs(text, file):
            lines, out = [x.removesuffix("\r") for x in text.split("\n")], []
            got = ask(file, text)
            if len(got) > most:
                return []
            for c in got:
                n, a = c.get("line", 0), c.get("column", 0) - 1
                z = a + c.get("length", 0)
                if not str(c.get("rule_id", "")).startswith("x-") or not 1 <= n <= len(lines) or not 0 <= a < z <= len(lines[n - 1]) or c.get("confidence") not in levels:
                    return []
                value, level = lines[n - 1][a:z], levels[c["confidence"]]
                if level >= d.floor and not d.allowed(value) and not d.ignored(lines[n - 1]):
                    out.append(Finding(c["rule_id"], n, a, z, value, level, level, external=True, fail_only=level < config.min_confidence).rate())
            return out

        def f(text, file):
            found = settle(d.scan(text, file or "") + theirs(text, file or "")) if text else []
            return [as_row(x, at) for x, at in zip(found, offsets(text, found))] if found else []

        return f

    return _rows_of(df, [text_col, name], FINDING, make)


def rules_listing(spark, config: Config | None = None) -> DataFrame:
    """The rules, whether they are in force, and whether they need high recall."""
    config = config or Config()
    on = {r.id for r in R.selected(config.high_recall, config.disabled, config.custom)}
    rows = list(dict.fromkeys((r.id, r.about, r.id in on, r.extended) for r in (*R.builtin(), *config.custom)))
    return spark.createDataFrame(rows, "rule_id string, description string, enabled boolean, high_recall boolean")
