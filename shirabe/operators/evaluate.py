"""Evaluation: what was expected against what was found, by rule, kind and tag, with calibration."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp and fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def outcomes(wanted: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """A row for each key that is wanted or found, with tp, fp and fn."""
    w, f = wanted.select(*key).distinct().withColumn("__w", F.lit(1)), found.select(*key).distinct().withColumn("__f", F.lit(1))
    both = w.join(f, key, "full_outer")
    has_w, has_f = F.col("__w").isNotNull(), F.col("__f").isNotNull()
    one = lambda c, n: F.when(c, 1).otherwise(0).alias(n)
    return both.select(*key, one(has_w & has_f, "tp"), one(~has_w & has_f, "fp"), one(has_w & ~has_f, "fn"))


def totals(rows: DataFrame, *by: str) -> DataFrame:
    return with_scores(rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def strata(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals of each value of each column, and over all, in one pass of grouping sets."""
    sets = ", ".join(f"({c})" for c in by)
    view = rows.select(*by, "tp", "fp", "fn")
    out = view.sparkSession.sql(f"SELECT {', '.join(by)}, grouping_id({', '.join(by)}) AS level, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM {{rows}} GROUP BY GROUPING SETS ({sets}, ())", rows=view)
    return with_scores(out)


def averages(by_rule: DataFrame) -> DataFrame:
    """Micro scores of all counts, and macro means over the rules that have any."""
    some = by_rule.where("tp + fp + fn > 0")
    micro = with_scores(some.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    macro = some.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return micro.crossJoin(macro)


def wilson_low(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """The lower end of the 95 % Wilson interval."""
    p = hits / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)).otherwise(F.lit(0.0))


ACCEPTED = {"high": 0.975, "medium": 0.92}


def calibration(findings: DataFrame) -> DataFrame:
    """By confidence (column ``band``): tp, fp, precision, its Wilson bound, and whether it is accepted.
    ``correct`` tells whether a finding was wanted."""
    out = findings.groupBy("band").agg(F.sum(F.when(F.col("correct"), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("correct"), 0).otherwise(1)).alias("fp"))
    n = F.col("tp") + F.col("fp")
    out = out.withColumn("precision", ratio(F.col("tp"), n)).withColumn("wilson_low", wilson_low(F.col("tp"), n))
    need = F.when(F.col("band") == "high", ACCEPTED["high"]).when(F.col("band") == "medium", ACCEPTED["medium"])
    return out.withColumn("accepted", F.coalesce(F.col("precision") >= need, F.lit(True)))


def _exact(ws: list, fs: list) -> int:
    """Equal spans of two sorted lists, one to one."""
    i = j = n = 0
    while i < len(ws) and j < len(fs):
        w, f = ws[i], fs[j]
        n, i, j = n + (w == f), i + (w <= f), j + (f <= w)
    return n


def _contained(ws: list, fs: list) -> int:
    """The most wanted spans that lie inside found ones, one to one, of two sorted lists. Wanted ones by their starts
    each take the found one that ends first, of those that hold it: what is left holds any later one as well."""
    active: list = []
    i = n = 0
    for a, z in ws:
        while i < len(fs) and fs[i][0] <= a:
            bisect.insort(active, fs[i][1])
            i += 1
        k = bisect.bisect_left(active, z)
        if k < len(active):
            del active[k]
            n += 1
    return n


def _overlapping(ws: list, fs: list) -> int:
    """The same of spans that overlap: wanted ones by their ends."""
    active: list = []
    i = n = 0
    for a, z in sorted(ws, key=lambda w: w[1]):
        while i < len(fs) and fs[i][0] < z:
            bisect.insort(active, fs[i][1])
            i += 1
        k = bisect.bisect_right(active, a)
        if k < len(active):
            del active[k]
            n += 1
    return n


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where rows differ from those before them; the first does."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, n - 1))
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differs.to_numpy(zero_copy_only=False)
    return out


def span_matches(wanted: DataFrame, found: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """By key: how many wanted and found spans (start, end) can be matched one to one, exactly, with the
    wanted one inside the found one, or overlapping. Matchings are largest possible (by sweeps, in n log n). Both sides
    are shuffled once, into ``parts`` (None: as many as Spark's own), and read in the order of their keys."""
    n_keys = len(key)

    def cases(t: pa.Table) -> pa.RecordBatch:
        columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in t.columns]
        first = np.flatnonzero(_changes(columns[:n_keys]))
        gid = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
        a, z, side = columns[n_keys:]
        is_found = side.to_numpy(zero_copy_only=False)
        n_found = np.bincount(gid, weights=is_found, minlength=len(first)).astype(np.int32)
        n_wanted = (np.bincount(gid, minlength=len(first)) - n_found).astype(np.int32)
        known = pc.and_(a.is_valid(), z.is_valid()).to_numpy(zero_copy_only=False)  # spans without a place match none
        both = known & ((n_found > 0) & (n_wanted > 0))[gid]
        rows = np.flatnonzero(both)
        a, z, gid, is_found = a.take(pa.array(rows)).to_numpy(zero_copy_only=False), z.take(pa.array(rows)).to_numpy(zero_copy_only=False), gid[rows], is_found[rows]
        order = np.lexsort((z, a, is_found, gid))
        spans = list(zip(a[order].tolist(), z[order].tolist()))
        cut = np.searchsorted(2 * gid[order] + is_found[order], np.arange(2 * len(first) + 1)).tolist()
        got = np.zeros((3, len(first)), dtype=np.int32)
        for g in np.unique(gid).tolist():
            ws, fs = spans[cut[2 * g] : cut[2 * g + 1]], spans[cut[2 * g + 1] : cut[2 * g + 2]]
            got[:, g] = _exact(ws, fs), _contained(ws, fs), _overlapping(ws, fs)
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in columns[:n_keys]), pa.array(n_wanted), pa.array(n_found), *map(pa.array, got)], names=[*key, "n_wanted", "n_found", "exact", "containment", "relaxed"])

    def run(batches):
        open_: list[pa.RecordBatch] = []  # of the last case, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            before = open_[-1].slice(open_[-1].num_rows - 1) if open_ else b.slice(0, 1)
            starts = np.flatnonzero(_changes([pa.concat_arrays([before.column(k), b.column(k)]) for k in range(n_keys)])[1:])
            if len(starts):
                last = int(starts[-1])
                yield cases(pa.Table.from_batches([*open_, b.slice(0, last)]))
                open_ = []
                b = b.slice(last)
            open_.append(b)
        if open_:
            yield cases(pa.Table.from_batches(open_))

    # New attributes, as both may come from one table.
    of = lambda df, is_found: df.select(*(F.col(c).alias(c) for c in (*key, "start", "end")), F.lit(is_found).alias("__found"))
    spans = of(wanted, False).unionByName(of(found, True))
    spread = spans.repartition(parts, *key) if parts else spans.repartition(*key)
    counts = [T.StructField(c, T.IntegerType()) for c in ("n_wanted", "n_found", "exact", "containment", "relaxed")]
    return spread.sortWithinPartitions(*key).mapInArrow(run, T.StructType([*(spans.schema[k] for k in key), *counts]))


def golden_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Metrics (key, metric, value) that differ between two documents, or stand in one only."""
    k = [*key, "metric"]
    a, b = old.select(*k, F.col("value").alias("was")), new.select(*k, F.col("value").alias("now"))
    return a.join(b, k, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def trend(old: DataFrame, new: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Change in percent of each rule's rate; a rule that had none before warns if it has any."""
    both = old.select("rule_id", F.col("rate").alias("was")).join(new.select("rule_id", F.col("rate").alias("now")), "rule_id", "full_outer")
    both = both.select("rule_id", F.coalesce("was", F.lit(0.0)).alias("was"), F.coalesce("now", F.lit(0.0)).alias("now"))
    change = F.when(F.col("was") > 0, (F.col("now") - F.col("was")) / F.col("was") * 100)
    return both.withColumn("change", change).withColumn("warns", F.when(F.col("was") > 0, change > threshold).otherwise(F.col("now") > 0))


CASE = "id string, line string, content string, diff array<struct<text:string,added:boolean>>, file string, want array<string>, spans array<struct<rule_id:string,line:int,start:int,end:int>>, tags array<string>"


def scan_cases(cases: DataFrame, config=None) -> DataFrame:
    """Findings of labelled cases (schema CASE): a line by itself, a content as a file, a diff as a hunk.
    Returns id, rule_id, line, start, end and confidence."""
    from ..detect.engine import Config, Detector
    from .scan import FINDING, _rows_of, as_row

    config = config or Config()
    slim = cases.select("id", "line", "content", F.coalesce("file", F.lit("dataset")).alias("file_name"), F.col("diff.text").alias("texts"), F.col("diff.added").alias("added"))

    def make():
        d = Detector(config)

        def f(line, content, file, texts, added):
            if line is not None:
                found = d.scan_line(line)
            elif content is not None:
                found = d.scan(content, file)
            else:
                found = d.scan_hunk(file, 1, texts or [], added or [])
            return [as_row(x) for x in found]

        return f

    return _rows_of(slim, ["line", "content", "file_name", "texts", "added"], FINDING, make).select("id", "line", "start", "end", "rule_id", "confidence")


def case_kind(cases: DataFrame) -> DataFrame:
    """Add ``kind``: line, content or diff."""
    return cases.withColumn("kind", F.when(F.col("line").isNotNull(), "line").when(F.col("content").isNotNull(), "content").otherwise("diff"))


def evaluate_cases(cases: DataFrame, config=None) -> dict[str, DataFrame]:
    """Scores of labelled cases: ``rules`` and ``strata`` (by kind and tag) of (case, rule) pairs, ``spans`` by
    rule of matched spans, ``averages`` over the rules."""
    found = scan_cases(cases, config)
    kinds = case_kind(cases).select("id", "kind", F.explode_outer("tags").alias("tag"))
    wanted = cases.select("id", F.explode("want").alias("rule_id"))
    rows = outcomes(wanted, found, ["id", "rule_id"])
    rules = totals(rows, "rule_id")
    tagged = rows.join(kinds, "id")
    by_kind = totals(rows.join(kinds.select("id", "kind").distinct(), "id"), "kind").withColumnRenamed("kind", "stratum")
    by_tag = totals(tagged.where("tag is not null"), "tag").withColumnRenamed("tag", "stratum")
    spans = cases.select("id", F.explode("spans").alias("s")).select("id", "s.rule_id", "s.start", "s.end")
    matched = span_matches(spans, found, ["id", "rule_id"]).groupBy("rule_id").agg(*(F.sum(c).alias(c) for c in ("n_wanted", "n_found", "exact", "containment", "relaxed")))
    return {"rules": rules, "strata": by_kind.unionByName(by_tag), "spans": matched, "averages": averages(rules)}


def dataset_quality(cases: DataFrame, known_rules: list[str]) -> DataFrame:
    """One row: rule ids that no rule has, cases that repeat another but for their id, and expected (case, rule)
    pairs without a span."""
    spark = cases.sparkSession
    rules = spark.createDataFrame([(r,) for r in known_rules], "rule_id string")
    named = cases.select(F.explode(F.array_union("want", F.coalesce(F.transform("spans", lambda s: s["rule_id"]), F.array().cast("array<string>")))).alias("rule_id"))
    unknown = named.join(rules, "rule_id", "left_anti").select(F.countDistinct("rule_id").alias("unknown_rules"))
    body = F.sha2(F.to_json(F.struct(*[c for c in cases.columns if c != "id"])), 256)
    repeats = cases.groupBy(body.alias("h")).count().select(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_cases"))
    pairs = cases.select("id", F.explode("want").alias("rule_id"), "spans").where(~F.exists(F.coalesce("spans", F.array().cast("array<struct<rule_id:string,line:int,start:int,end:int>>")), lambda s: s["rule_id"] == F.col("rule_id")))
    return unknown.crossJoin(repeats).crossJoin(pairs.agg(F.count("*").alias("pairs_without_span")))


def dataset_counts(cases: DataFrame, by: list[str]) -> DataFrame:
    """How many cases each value of each column has, and all: one pass of grouping sets."""
    sets = ", ".join(f"(`{c}`)" for c in by)
    return cases.sparkSession.sql(f"SELECT {', '.join(f'`{c}`' for c in by)}, count(*) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets}, ())", rows=cases.select(*by))


def confidence_misses(wanted: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """By rule: findings that no case wants (``finding_fp``), and wanted ones that were found with another confidence
    than the case asks for (``confidence_miss``; null asks for none). Both have ``key``, rule_id and confidence."""
    w = wanted.select(*key, "rule_id", F.col("confidence").alias("__asked"), F.lit(True).alias("__w"))
    both = found.join(w, [*key, "rule_id"], "left")
    miss = F.col("__w") & F.col("__asked").isNotNull() & (F.col("__asked") != F.col("confidence"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.groupBy("rule_id").agg(n(F.col("__w").isNull()).alias("finding_fp"), n(F.coalesce(miss, F.lit(False))).alias("confidence_miss"))
