"""Unified diffs: hunks with the new file's line numbers, from git or from a column of patches."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _name(s: str) -> str | None:
    s = s.split("\t")[0].strip()
    if len(s) > 1 and s[0] == s[-1] == '"':
        s = s[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
    return None if s == "/dev/null" else s.removeprefix("b/")


def parse(patch: str) -> Iterator[tuple[str, int, int, list[str], list[bool]]]:
    """(file, hunk from 1 within it, first new line, texts, which of them are added). The counts in a hunk's
    head, not what lines look like, tell where it ends; deleted lines and deleted files are left out."""
    file, nth, rows = None, 0, patch.split("\n")
    i = 0
    while i < len(rows):
        row = rows[i]
        i += 1
        if row.startswith("+++ "):
            file, nth = _name(row[4:]), 0
        m = _HEAD.match(row)
        if not m:
            continue
        old, new = (1 if g is None else int(g) for g in (m[1], m[3]))
        nth += 1
        texts, added = [], []
        while (old > 0 or new > 0) and i < len(rows):
            mark, text = rows[i][:1], rows[i][1:]
            if mark == "+":
                new -= 1
                texts.append(text)
                added.append(True)
            elif mark == "-":
                old -= 1
            elif mark in (" ", ""):
                old, new = old - 1, new - 1
                texts.append(text)
                added.append(False)
            elif mark != "\\":
                break
            i += 1
        if file is not None and texts:
            yield file, nth, int(m[2]), texts, added


def hunks(df: DataFrame, patch_col: str = "patch") -> DataFrame:
    """Each patch's hunks: file, hunk, first_line, texts, added, beside the other columns."""
    keys = [c for c in df.columns if c != patch_col]
    df = df.select(*keys, F.col(patch_col).cast("string"))
    names = ["file", "hunk", "first_line", "texts", "added"]
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "file string, hunk int, first_line int, texts array<string>, added array<boolean>"])
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.bool_())]

    def run(batches):
        for b in batches:
            took, cols = [], [[] for _ in names]
            for i, p in enumerate(b.column(len(keys)).to_pylist()):
                for row in parse(p or ""):
                    took.append(i)
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(took, pa.int64())) for k in range(len(keys))), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*keys, *names])

    return df.mapInArrow(run, schema)


def added_lines(hunked: DataFrame) -> DataFrame:
    """file, line and text of each added line."""
    keep = [c for c in hunked.columns if c not in ("texts", "added", "hunk", "first_line")]
    flat = hunked.select(*keep, "first_line", F.posexplode(F.arrays_zip("texts", "added")).alias("p", "x"))
    return flat.where("x.added").select(*keep, (F.col("first_line") + F.col("p")).alias("line"), F.col("x.texts").alias("text"))


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def git_patch(spark: SparkSession, repo: str, revisions: str | None = None) -> DataFrame:
    """The patch of what is staged, or between revisions, as a table of one row (git runs on the driver)."""
    what = [revisions] if revisions else ["--staged"]
    return spark.createDataFrame([(_git(repo, "diff", "--no-ext-diff", "--no-color", "--diff-filter=ACMRT", "-U3", *what, "--"),)], "patch string")


def post_revision(revisions: str | None) -> str | None:
    """The revision after a range, ``""`` for the index; None for a single one (the working tree)."""
    if revisions is None:
        return ""
    for dots in ("...", ".."):
        if dots in revisions:
            return revisions.partition(dots)[2] or "HEAD"
    return None


def post_images(spark: SparkSession, repo: str, files: list[str], revisions: str | None = None, most: int = 5 << 20) -> DataFrame:
    """(file, csv_header, post_image) of the new files: a CSV's first line, a JSON's or YAML's whole text;
    empty for what is missing, binary or larger than ``most``."""
    from ..detect.structure import kind_of, scope_of

    rev = post_revision(revisions)
    rows = []
    for f in dict.fromkeys(files):
        text = ""
        if (kind_of(f) == "csv" or scope_of(f)) and rev is not None:
            got = subprocess.run(["git", "-C", repo, "show", f"{rev}:{f}"], capture_output=True).stdout
            text = "" if len(got) > most or b"\0" in got[:8192] else got.decode("utf-8", "replace")
        rows.append((f, text.split("\n")[0].removesuffix("\r") if kind_of(f) == "csv" else "", text if scope_of(f) else ""))
    return spark.createDataFrame(rows, "file string, csv_header string, post_image string")
