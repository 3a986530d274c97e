"""Correlation of lines and findings in Catalyst: adjacency, co-occurrence, resolution, ordering, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

RANK = ("confidence", "fail_only", "score", "length", "rule_id")


def explode_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each line: line_no from 1, line and its normalised form."""
    out = df.select(*[c for c in df.columns if c != text_col], F.posexplode(X.lines(F.col(text_col))).alias("p", "line"))
    return out.withColumn("line_no", F.col("p") + 1).withColumn("norm", X.normalize(F.col("line"))).drop("p")


def line_starts(df: DataFrame, file: list[str], line_no: str = "line_no", raw: str = "raw") -> DataFrame:
    """Add ``line_start``: the characters of the text before each line (raw lines, as they were split)."""
    w = Window.partitionBy(*file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("line_start", F.coalesce(F.sum(F.length(raw) + 1).over(w), F.lit(0)))


def next_line(df: DataFrame, file: list[str], line_no: str = "line_no", text: str = "line", gap: int = 3) -> DataFrame:
    """Lines that aren't blank, each with the next of these within ``gap``: next_no and next_text."""
    w = Window.partitionBy(*file).orderBy(line_no)
    ahead = F.lead(F.struct(F.col(line_no).alias("n"), F.col(text).alias("t"))).over(w)
    out = df.where(F.trim(F.regexp_replace(text, "\\s+", " ")) != "").withColumn("__a", ahead)
    return out.where(F.col("__a.n") - F.col(line_no) <= gap).select("*", F.col("__a.n").alias("next_no"), F.col("__a.t").alias("next_text")).drop("__a")


#: Rows that a task sorts, about.
ROWS = 500_000


def parts_for(*tables: DataFrame) -> int:
    """Parts into which to shuffle the rows of tables so that no task sorts much more than :data:`ROWS`, however many
    rows there are (they are counted: for tables that are read, not for costly ones)."""
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, sum(t.count() for t in tables) // ROWS + 1)


def boost(df: DataFrame, file: list[str], anchor: Column, target: Column, line_no: str = "line", record: str | None = None, reach: int = 5, parts: int | None = None) -> DataFrame:
    """Add ``boosted``: whether a target has an anchor in its record, or (one of no record, if it has a record
    itself) within ``reach`` lines. Files are shuffled into ``parts`` (None: as many as Spark's own), of which each
    is sorted by one task; see :func:`parts_for`."""
    if parts:
        df = df.repartition(parts, *file)
    near = Window.partitionBy(*file).orderBy(line_no).rangeBetween(-reach, reach)
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    if record is None:
        return df.withColumn("boosted", target & (flag(anchor).over(near) == 1))
    own = Window.partitionBy(*file, record)
    in_record = (F.col(record) != 0) & (flag(anchor).over(own) == 1)
    loose = flag(anchor & (F.col(record) == 0)).over(near) == 1
    return df.withColumn("boosted", target & (in_record | F.when(F.col(record) != 0, loose).otherwise(flag(anchor).over(near) == 1)))


def _key(x: Column) -> Column:
    """Sorts better findings first."""
    return F.struct(-x["confidence"], x["fail_only"], -x["score"], -(x["end"] - x["start"]), x["rule_id"])


def resolve_overlaps(df: DataFrame, line: list[str], order: str) -> DataFrame:
    """The fold over a line's candidates in ``order``: one that overlaps a kept one that is no worse goes, else
    it evicts what it overlaps. Lines are folded by a higher-order function, without Python."""
    rest = [c for c in df.columns if c not in line]
    listed = df.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *rest))).alias("f"))
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def step(kept, x):
        lost = F.exists(kept, lambda k: touch(k, x) & ~(_key(x) < _key(k)))
        return F.when(lost, kept).otherwise(F.concat(F.filter(kept, lambda k: ~touch(k, x)), F.array(x)))

    kept = F.aggregate("f", F.slice("f", 1, 0), step)
    return listed.select(*line, F.explode(kept).alias("__kept")).select(*line, *(f"__kept.{c}" for c in rest))


def dedup(df: DataFrame, key: list[str]) -> DataFrame:
    """The best finding of each key, by confidence, score and length."""
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), "fail_only", F.desc("score"), F.desc(F.col("end") - F.col("start")), "rule_id")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def in_order(df: DataFrame, *ties: str) -> DataFrame:
    """Findings in the order of output; ``ties``: columns that settle what is equal in all of that."""
    return df.orderBy("file", "line", "column", "end", "rule_id", *ties)


def demote_tests(df: DataFrame, path: str = "file") -> DataFrame:
    """Medium findings that needed context are low on paths of tests."""
    hit = F.col("require_context") & (F.col("confidence") == 2) & X.path_is_test(F.col(path))
    return df.withColumn("path_demoted", hit).withColumn("confidence", F.when(hit, 1).otherwise(F.col("confidence")))


def score(confidence: Column, rule_id: Column, validated: Column, has_keywords: Column, structured: Column, cross_line: Column, distance: Column, required: Column, pair: Column, bound: Column, boosted: Column, same_record: Column) -> Column:
    """The score of a finding's evidence, inside the band of its confidence."""
    n = lambda c, x: F.when(c, x).otherwise(0)
    near = F.when(structured, 8).when(cross_line, 2).when(distance <= 8, 6).when(distance <= 40, 4).otherwise(1)
    s = F.when(confidence == 3, 80).when(confidence == 2, 50).otherwise(20) - n(rule_id.endswith("-high-recall"), 20) + n(validated, 5) + n(has_keywords, near) + n(required, 2) + n(pair, 8) + n(bound, 8) + n(boosted, F.when(same_record, 7).otherwise(2))
    low = F.when(confidence == 3, 75).when(confidence == 2, 40).otherwise(0)
    high = F.when(confidence == 3, 100).when(confidence == 2, 74).otherwise(39)
    return F.greatest(low, F.least(high, s))


def keyword_distance(norm: Column, start: Column, end: Column, words: list[str]) -> Column:
    """Characters from a span to the nearest of the keywords, or null."""
    best = None
    for w in words:
        at = F.transform(F.split(F.lower(norm), w.lower(), -1), lambda x: F.length(x))
        ends = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.aggregate(F.slice(at, 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(w))
        d = F.transform(F.when(F.size(at) > 1, ends).otherwise(F.array().cast("array<int>")), lambda a: F.when(a + len(w) <= start, start - a - len(w)).when(end <= a, a - end).otherwise(0))
        near = F.array_min(d)
        best = near if best is None else F.least(best, near)
    return best if best is not None else F.lit(None).cast("int")


def exit_status(df: DataFrame, fail_on: int | None = None, partial: bool = False) -> DataFrame:
    """One row: 0 nothing, 1 findings (at ``fail_on`` or above, if set), 2 the scan was partial."""
    hit = F.coalesce(F.max(F.col("confidence")), F.lit(0)) >= (fail_on or 1)
    return df.agg(F.lit(2).alias("status") if partial else F.when(hit, 1).otherwise(0).alias("status"))
