"""Queries of context, correlation, resolution, baselines, evaluation and whole scans."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import functions as F

from ..detect import vocabulary as W
from ..detect.engine import Config
from ..functions import checks as C
from ..functions import text as X
from ..operators import baseline as B
from ..operators import correlate as K
from ..operators import evaluate as E
from ..operators import reports as P
from ..operators import scan as S
from .. import sinks
from .checks import _MY, sql_mask, sql_sum, table
from .grids import Grid, listed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _pad(x, n):
    return F.lpad(x.cast("string"), n, "0")


# --- context around a value ----------------------------------------------------------------------------------------
_WORDS = ("免許", "driver license", "licence", "値", "LICENSE NO", "xlicence", "licences", "免")
_window = Grid("orders", "o_orderkey").digits("d", 12, 10**6).pick("word", _WORDS).pick("side", ("left", "right")).add("gap", "k * 7 % 61").add("dots", "repeat('・', CAST(gap AS INTEGER))").add("lead", "CASE side WHEN 'left' THEN word || dots ELSE '番 ' END").add("line", "CASE side WHEN 'left' THEN lead || ' ' || d ELSE lead || d || ' ' || dots || word END")
_START = "CASE side WHEN 'left' THEN length(lead) + 1 ELSE length(lead) END"
_NEAR_SQL = f"substr(line, CAST(greatest(({_START}) - 40, 0) + 1 AS BIGINT), CAST(({_START}) + 52 - greatest(({_START}) - 40, 0) AS BIGINT))"
_HIT = "contains({0}, '免許') OR regexp_matches(lower({0}), '(^|[^0-9a-z])(driver license|licence|license no)([^0-9a-z]|$)')"


@query("require_context_window", f"SELECT k, gap, ({_HIT.format('near')}) AS in_window, ({_HIT.format('line')}) AS in_line FROM (SELECT *, {_NEAR_SQL} AS near FROM ({_window.sql}))")
def require_context_window(spark, sf_dir):
    """A word on either side and, so many characters off, a number: is a keyword wholly within 40 characters?"""
    t = _window.rows(spark, sf_dir)
    start = F.when(F.col("side") == "left", F.length("lead") + 1).otherwise(F.length("lead"))
    near = X.window(F.col("line"), start, start + 12, 40)
    any_word = lambda c: functools.reduce(lambda a, w: a | X.word_contained(F.lower(c), w), W.LICENCE, F.lit(False))
    return t.select("k", "gap", any_word(near).alias("in_window"), any_word(F.col("line")).alias("in_line"))


_words = Grid("orders", "o_orderkey").pick("before", ("", "(", "ho", "電", "_", "x ", "9")).pick("word", ("tel", "fax", "電話", "TEL", "te", "x", "Fax")).pick("after", (": 090", "ephone", "番号", "-1", "_no", "1"))
_words = _words.add("line", "before || word || after")


@query("keyword_matches", f"SELECT k, regexp_matches(lower(line), '(^|[^0-9a-z])(tel|fax)([^0-9a-z]|$)') OR contains(line, '電話') AS hit FROM ({_words.sql})")
def keyword_matches(spark, sf_dir):
    """ASCII keywords need edges, others don't."""
    hit = functools.reduce(lambda a, w: a | X.word_contained(F.lower("line"), w), ("tel", "fax", "電話"), F.lit(False))
    return _words.rows(spark, sf_dir).select("k", hit.alias("hit"))


def _near(rows, kind: str, positive: tuple[str, ...] = (), mode: str = "all"):
    """The matcher's own test of the words beside ``value`` in ``line``, over Arrow batches."""
    from ..detect import context

    def run(batches):
        for b in batches:
            line, value = b.column(1).to_pylist(), b.column(2).to_pylist()
            at = [x.index(v) for x, v in zip(line, value)]
            hit = [context.negative_near(x, a, a + len(v), kind, positive, mode) for x, v, a in zip(line, value, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.bool_())], names=["k", "line", "negative"])

    return rows.select("k", "line", "value").mapInArrow(run, "k long, line string, negative boolean")


_units = Grid("orders", "o_orderkey").pick("left_side", ("値 ", "¥", "$ ", "¥\t", "円", "US$は")).pick("space", ("", " ", "  \t")).pick("right_side", ("", "円", "件", "件名", "名簿", "個。", "%", "万円", "cm", "人 ", "人々")).digits("value", 7, 10**6).add("line", "left_side || value || space || right_side")
_UNITS = "left_side IN ('¥', '$ ', '¥\t') OR substr(right_side, 1, 1) IN ('円', '%', '万') OR (substr(right_side, 1, 1) IN ('件', '名', '個', '人') AND NOT regexp_matches(substr(right_side, 2, 1), '[㐀-鿿]'))"


@query("negative_units", f"SELECT k, line, ({_UNITS}) AS negative FROM ({_units.sql})")
def negative_units(spark, sf_dir):
    """Currency before, currency and counters after a number; a counter that begins another word isn't one."""
    return _near(_units.rows(spark, sf_dir), "unit")


_numbering = Grid("orders", "o_orderkey").pick("label", ("伝票番号", "SKU", "品番", "電話", "顧客コード", "userId", "userid", "account no", "製造キー", "ab", "会員番号", "追跡番号について", "注文 番号")).pick("glue", (": ", "=", "は", " の : ", "::", ":::", "         ")).digits("value", 9, 10**6).add("line", "label || glue || value")
_LISTED = "label IN ('伝票番号', 'SKU', '品番')"
_NAMED = "label IN ('顧客コード', 'userId', '製造キー', '会員番号', 'account no')"


@query("numbering_labels", f"SELECT k, line, ({_LISTED} OR ({_NAMED} AND label <> '会員番号' AND label <> 'account no')) AND glue NOT IN (':::', '         ') AS negative FROM ({_numbering.sql})")
def numbering_labels(spark, sf_dir):
    """Labels of other numbers right before a value, with up to two joining characters and eight in all between:
    known ones, and words that end like a number's name, unless they are the rule's own."""
    return _near(_numbering.rows(spark, sf_dir), "unit", ("会員", "account no"))


_modes = Grid("orders", "o_orderkey").pick("lead", ("伝票番号: ", "値 ", "¥")).pick("tail", ("", "円", " 注文")).pick("kind", ("", "unit", "full")).pick("mode", ("all", "label", "none")).digits("value", 9, 10**6).add("line", "lead || value || tail")
_BY_MODE = "CASE WHEN kind = '' OR mode = 'none' THEN FALSE WHEN mode = 'label' THEN lead = '伝票番号: ' ELSE lead <> '値 ' OR tail = '円' OR (kind = 'full' AND tail = ' 注文') END"


@query("negative_modes", f"SELECT k, line, kind, mode, {_BY_MODE} AS negative FROM ({_modes.sql})")
def negative_modes(spark, sf_dir):
    """Which evidence counts against a value, by kind of rule and mode of pattern."""
    rows, out = _modes.rows(spark, sf_dir), None
    for kind in ("", "unit", "full"):
        for mode in ("all", "label", "none"):
            part = _near(rows.where((F.col("kind") == kind) & (F.col("mode") == mode)), kind, (), mode).select("k", "line", F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), "negative")
            out = part if out is None else out.unionByName(part)
    return out


_far = Grid("orders", "o_orderkey").pick("word", ("TEL", "電話", "tel", "x", "telTel")).pick("other", ("電話", "", "Tel", "電話電話")).add("gap", "k * 3 % 13").add("back", "k * 5 % 11").digits("value", 7, 10**6)
_far = _far.add("line", "word || repeat('.', CAST(gap AS INTEGER)) || value || repeat('-', CAST(back AS INTEGER)) || other")
_LEFT, _RIGHT = "CASE WHEN word <> 'x' THEN gap END", "CASE WHEN other <> '' THEN back END"


@query("keyword_distance", f"SELECT k, least(coalesce({_LEFT}, {_RIGHT}), coalesce({_RIGHT}, {_LEFT})) AS distance FROM ({_far.sql})")
def keyword_distance(spark, sf_dir):
    """Characters from a value to the nearest keyword on either side, if there is any."""
    start = F.length("word") + F.col("gap").cast("int")
    return _far.rows(spark, sf_dir).select("k", K.keyword_distance(F.col("line"), start, start + 7, ["tel", "電話"]).cast("long").alias("distance"))


# --- lines together ----------------------------------------------------------------------------------------------------
def _lines(spark, sf_dir):
    """A file for each order: a line for each item, some of them blank."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    line = F.when((k + n) % 3 == 0, F.lit("  ")).when(n % 2 == 1, F.lit("口座番号:")).otherwise(_pad(F.col("l_partkey") * 7919 % 10_000_000, 7))
    rows = table(spark, sf_dir, "lineitem").select(k.alias("file"), (n * (1 + k % 3)).alias("line_no"), line.alias("line"))
    return rows.groupBy("file", "line_no").agg(F.max("line").alias("line"))


_LINES_SQL = "SELECT file, line_no, max(line) AS line FROM (SELECT l_orderkey AS file, l_linenumber * (1 + l_orderkey % 3) AS line_no, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN '  ' WHEN l_linenumber % 2 = 1 THEN '口座番号:' ELSE lpad(CAST(l_partkey * 7919 % 10000000 AS VARCHAR), 7, '0') END AS line FROM lineitem) GROUP BY file, line_no"


@query("adjacent_lines", f"SELECT file, line_no, line, next_no, next_text FROM (SELECT *, lead(line_no) OVER w AS next_no, lead(line) OVER w AS next_text FROM ({_LINES_SQL}) WHERE trim(line) <> '' WINDOW w AS (PARTITION BY file ORDER BY line_no)) WHERE next_no - line_no <= 3")
def adjacent_lines(spark, sf_dir):
    return K.next_line(_lines(spark, sf_dir), ["file"])


@query("label_then_value", f"SELECT file, next_no AS line_no, next_text AS value FROM (SELECT *, lead(line_no) OVER w AS next_no, lead(line) OVER w AS next_text FROM ({_LINES_SQL}) WHERE trim(line) <> '' WINDOW w AS (PARTITION BY file ORDER BY line_no)) WHERE next_no - line_no <= 3 AND line LIKE '口座%' AND regexp_matches(next_text, '^[0-9]{{7}}$') AND next_text <> repeat(substr(next_text, 1, 1), 7)")
def label_then_value(spark, sf_dir):
    pairs = K.next_line(_lines(spark, sf_dir), ["file"])
    value = F.col("next_text")
    return pairs.where(X.word_contained(F.col("line"), "口座") & value.rlike("\\A[0-9]{7}\\z") & ~C.all_same(value)).select("file", F.col("next_no").alias("line_no"), value.alias("value"))


def _marks(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(k.alias("file"), (n * 4).alias("line"), (F.col("l_suppkey") % 7 == 0).alias("anchor"), (F.col("l_partkey") % 3 == 0).alias("target"), F.when(k % 2 == 0, (n % 3)).otherwise(0).alias("record"))


_MARKS_SQL = "SELECT l_orderkey AS file, l_linenumber * 4 AS line, l_suppkey % 7 = 0 AS anchor, l_partkey % 3 = 0 AS target, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber % 3 ELSE 0 END AS record FROM lineitem"
_NEAR = "bool_or({c}) OVER (PARTITION BY file ORDER BY line RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


@query("cooccurrence_boost", f"SELECT file, line, target, record, target AND CASE WHEN record <> 0 THEN bool_or(anchor) OVER (PARTITION BY file, record) OR {_NEAR.format(c='anchor AND record = 0')} ELSE {_NEAR.format(c='anchor')} END AS boosted FROM ({_MARKS_SQL})")
def cooccurrence_boost(spark, sf_dir):
    marks = _marks(spark, sf_dir)
    return K.boost(marks, ["file"], F.col("anchor"), F.col("target"), record="record", parts=K.parts_for(marks)).drop("anchor")


# --- findings ----------------------------------------------------------------------------------------------------------
def _findings(spark, sf_dir):
    """A finding for each line item; places and confidences follow the keys."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    i = lambda c: c.cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (k % 50).cast("string"), F.lit(".txt")).alias("file"), i(k % 400).alias("line"), i(n).alias("ordinal"), F.element_at(F.array(*map(F.lit, "credit-card jp-bank-account jp-phone-number".split())), i(p % 3 + 1)).alias("rule_id"),
        i(p % 20).alias("start"), i(p % 20 + 4 + p % 5).alias("end"), i(1 + p % 3).alias("confidence"), i(40 + p % 40).alias("score"), (p % 11 == 0).alias("fail_only"), F.col("l_suppkey").cast("string").alias("match"), k.alias("k"),
    )


_FINDINGS_SQL = (
    "SELECT 'f' || CAST(l_orderkey % 50 AS VARCHAR) || '.txt' AS file, CAST(l_orderkey % 400 AS INTEGER) AS line, CAST(l_linenumber AS INTEGER) AS ordinal, CASE l_partkey % 3 WHEN 0 THEN 'credit-card' WHEN 1 THEN 'jp-bank-account' ELSE 'jp-phone-number' END AS rule_id, "
    "CAST(l_partkey % 20 AS INTEGER) AS start, CAST(l_partkey % 20 + 4 + l_partkey % 5 AS INTEGER) AS \"end\", CAST(1 + l_partkey % 3 AS INTEGER) AS confidence, CAST(40 + l_partkey % 40 AS INTEGER) AS score, l_partkey % 11 = 0 AS fail_only, CAST(l_suppkey AS VARCHAR) AS match, l_orderkey AS k FROM lineitem"
)


@query("dedup_findings", f"SELECT file, line, rule_id, start, confidence, score, fail_only FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id, start ORDER BY confidence DESC, fail_only, score DESC, \"end\" - start DESC, rule_id) AS rn FROM ({_FINDINGS_SQL})) WHERE rn = 1")
def dedup_findings(spark, sf_dir):
    return K.dedup(_findings(spark, sf_dir), ["file", "line", "rule_id", "start"]).select("file", "line", "rule_id", "start", "confidence", "score", "fail_only")


_RANKED = f"SELECT *, (-confidence, fail_only, -score, -(\"end\" - start), rule_id) AS rank FROM ({_FINDINGS_SQL})"
_SPAN = "{'o': ordinal, 's': start, 'e': \"end\", 'r': rank}"


@query(
    "resolve_overlaps",
    f"WITH RECURSIVE c AS (SELECT k, list({_SPAN} ORDER BY ordinal, start, \"end\", rule_id, confidence, fail_only, score) AS f FROM ({_RANKED}) GROUP BY k), "
    "w AS (SELECT k, f, 1 AS i, f[1:0] AS kept FROM c UNION ALL SELECT k, f, i + 1, CASE WHEN len(list_filter(kept, lambda y: y.s < f[i].e AND f[i].s < y.e AND NOT f[i].r < y.r)) > 0 THEN kept ELSE list_append(list_filter(kept, lambda y: NOT (y.s < f[i].e AND f[i].s < y.e)), f[i]) END FROM w WHERE i <= len(f)) "
    "SELECT k, x.o AS ordinal, x.s AS start, x.e AS \"end\", x.r[5] AS rule_id FROM (SELECT k, unnest(kept) AS x FROM w WHERE i = len(f) + 1)",
)
def resolve_overlaps(spark, sf_dir):
    """All candidates of every line, resolved by the fold: a winner may evict several, and a loser none."""
    every = _findings(spark, sf_dir).select("k", "ordinal", "start", "end", "rule_id", "confidence", "fail_only", "score")
    return K.resolve_overlaps(every, ["k"], "ordinal").select("k", "ordinal", "start", "end", "rule_id")


_SALT = "00112233445566778899aabbccddeeff"
_KEY = bytes.fromhex(_SALT).ljust(64, b"\0")
_HMAC_SQL = f"sha256(unhex('{bytes(b ^ 0x5C for b in _KEY).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _KEY).hex()}') || encode(rule_id) || unhex('00') || encode(file) || unhex('00') || encode(match))))"


def _printed(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.withColumn("fingerprint", B.fingerprint(_SALT, F.col("rule_id"), F.col("file"), F.col("match")))


@query("fingerprints", f"SELECT k, ordinal, {_HMAC_SQL} AS fingerprint FROM ({_FINDINGS_SQL})")
def fingerprints(spark, sf_dir):
    return _printed(spark, sf_dir).select("k", "ordinal", "fingerprint")


_BASE_SQL = f"WITH f AS (SELECT *, {_HMAC_SQL} AS fingerprint FROM ({_FINDINGS_SQL})) SELECT k, ordinal, fingerprint FROM f WHERE fingerprint {{}} (SELECT fingerprint FROM f WHERE ordinal = 1)"


@query("baseline_new", _BASE_SQL.format("NOT IN"))
def baseline_new(spark, sf_dir):
    f = _printed(spark, sf_dir)
    return B.split(f, f.where("ordinal = 1").select("fingerprint").distinct())[0].select("k", "ordinal", "fingerprint")


@query("baseline_known", _BASE_SQL.format("IN"))
def baseline_known(spark, sf_dir):
    f = _printed(spark, sf_dir)
    return B.split(f, f.where("ordinal = 1").select("fingerprint").distinct())[1].select("k", "ordinal", "fingerprint")


@query("baseline_merge", f"WITH f AS (SELECT *, {_HMAC_SQL} AS fingerprint FROM ({_FINDINGS_SQL})) SELECT DISTINCT fingerprint FROM f WHERE ordinal <= 2")
def baseline_merge(spark, sf_dir):
    f = _printed(spark, sf_dir)
    return B.merge(f.where("ordinal = 1").select("fingerprint").distinct(), f.where("ordinal = 2"))


def _reported(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("column", F.col("start") + 1).withColumn("description", F.lit("number"))
    return f.withColumn("line", (F.col("k") * 10 + F.col("ordinal")).cast("int"))


_REPORTED_SQL = f"SELECT * REPLACE (CAST(k * 10 + ordinal AS INTEGER) AS line), start + 1 AS \"column\" FROM ({_FINDINGS_SQL})"


@query("sarif_rows", f"SELECT *, substr(sha256(encode(rule_id) || unhex('00') || encode(file) || unhex('00') || encode(CAST(ordinal AS VARCHAR))), 1, 16) AS line_hash FROM (SELECT k, rule_id, file, line, CAST(row_number() OVER (PARTITION BY rule_id, file ORDER BY line, \"column\", \"end\", match) - 1 AS INTEGER) AS ordinal, CAST(\"column\" + length(match) AS INTEGER) AS end_column FROM ({_REPORTED_SQL}))")
def sarif_rows(spark, sf_dir):
    return sinks.sarif_results(_reported(spark, sf_dir)).select("k", "rule_id", "file", "line", "ordinal", "end_column", "line_hash")


@query("annotations", f"SELECT '::' || CASE confidence WHEN 3 THEN 'error' WHEN 1 THEN 'notice' ELSE 'warning' END || ' file=' || file || ',line=' || CAST(line AS VARCHAR) || ',col=' || CAST(\"column\" AS VARCHAR) || ',title=' || rule_id || '::number ' || {sql_mask('match')} AS value FROM ({_REPORTED_SQL})")
def annotations(spark, sf_dir):
    return sinks.annotations(_reported(spark, sf_dir))


@query("text_report", f"SELECT file || ':' || CAST(line AS VARCHAR) || ':' || CAST(\"column\" AS VARCHAR) || ' [' || CASE confidence WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END || '] ' || rule_id || ' number ' || {sql_mask('match')} AS value FROM ({_REPORTED_SQL})")
def text_report(spark, sf_dir):
    return sinks.text_report(_reported(spark, sf_dir))


@query("summary", f"SELECT count(*) AS findings, count(*) FILTER (WHERE confidence = 3) AS high, count(*) FILTER (WHERE confidence = 2) AS medium, count(*) FILTER (WHERE confidence = 1) AS low FROM ({_FINDINGS_SQL})")
def summary(spark, sf_dir):
    return sinks.summary(_findings(spark, sf_dir))


@query("exit_status", f"SELECT CASE WHEN max(confidence) >= 3 THEN 1 ELSE 0 END AS status FROM ({_FINDINGS_SQL})")
def exit_status(spark, sf_dir):
    return K.exit_status(_findings(spark, sf_dir), fail_on=3)


@query("path_demotion", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 IN (0, 1, 2) AND o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS confidence, o_orderkey % 5 IN (0, 1, 2) AND o_orderkey % 2 = 0 AS path_demoted FROM orders")
def path_demotion(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.when(k % 5 == 0, "src/testdata/a.txt").when(k % 5 == 1, "pkg/a_test.go").when(k % 5 == 2, "web/a.spec.ts").when(k % 5 == 3, "src/testdata.txt").otherwise("specs/a.go")
    f = table(spark, sf_dir, "orders").select(k.alias("k"), path.alias("file"), F.lit(2).alias("confidence"), (k % 2 == 0).alias("require_context"))
    return K.demote_tests(f).select("k", "confidence", "path_demoted")


@query("confidence_scores", "SELECT k, greatest(lo, least(hi, base + CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0 WHEN k % 5 = 0 THEN 8 WHEN k % 11 <= 8 THEN 6 ELSE 4 END + CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 8 ELSE 0 END)) AS score FROM (SELECT o_orderkey AS k, CASE o_orderkey % 3 + 1 WHEN 3 THEN 80 WHEN 2 THEN 50 ELSE 20 END AS base, CASE o_orderkey % 3 + 1 WHEN 3 THEN 75 WHEN 2 THEN 40 ELSE 0 END AS lo, CASE o_orderkey % 3 + 1 WHEN 3 THEN 100 WHEN 2 THEN 74 ELSE 39 END AS hi FROM orders)")
def confidence_scores(spark, sf_dir):
    k, no = F.col("o_orderkey"), F.lit(False)
    s = K.score(k % 3 + 1, F.lit("credit-card"), k % 2 == 0, k % 3 != 0, k % 5 == 0, no, k % 11, k % 7 == 0, no, k % 13 == 0, no, no)
    return table(spark, sf_dir, "orders").select(k.alias("k"), s.alias("score"))


@query("retained_candidates", f"SELECT file, count(*) AS n, max(line) AS last_line FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, ordinal, k) AS rn FROM ({_FINDINGS_SQL})) WHERE rn <= 150 GROUP BY file")
def retained_candidates(spark, sf_dir):
    """The feature's own budget by file (here 150): candidates kept for a boost."""
    kept = P.retained(_findings(spark, sf_dir), ["file"], ["line", "ordinal", "k"], most=150)
    return kept.groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


@query("split_by_threshold", f"SELECT visible, rule_id, count(*) AS n FROM (SELECT *, confidence >= 2 AND NOT fail_only AS visible FROM ({_FINDINGS_SQL})) GROUP BY visible, rule_id")
def split_by_threshold(spark, sf_dir):
    shown, rest = P.split_by_threshold(_findings(spark, sf_dir), 2)
    return shown.withColumn("visible", F.lit(True)).unionByName(rest.withColumn("visible", F.lit(False))).groupBy("visible", "rule_id").agg(F.count("*").alias("n"))


@query("json_findings", f"SELECT rule_id, file, line, \"column\", CASE confidence WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, {sql_mask('match')} AS match FROM ({_REPORTED_SQL})")
def json_findings(spark, sf_dir):
    """The rows of the JSON report, read back from what is written."""
    read = F.from_json("value", "rule_id string, file string, line int, `column` int, confidence string, match string")
    return sinks.json_lines(_reported(spark, sf_dir)).select(read.alias("r")).select("r.*")


@query("entity_spans", f"SELECT k, CASE rule_id WHEN 'credit-card' THEN 'CREDIT_CARD' WHEN 'jp-phone-number' THEN 'PHONE_NUMBER' ELSE 'JP_BANK_ACCOUNT' END AS entity_type, start, \"end\", CASE confidence WHEN 3 THEN 0.85 WHEN 2 THEN 0.6 ELSE 0.4 END::DOUBLE AS score FROM ({_FINDINGS_SQL})")
def entity_spans(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("offset", F.col("start")).withColumn("end_offset", F.col("end")).withColumnRenamed("k", "doc_id").drop("start", "end")
    return sinks.entities(f).withColumnRenamed("doc_id", "k").drop("file").withColumn("score", F.col("score").cast("double"))


# --- evaluation ---------------------------------------------------------------------------------------------------------
def _cases(spark, sf_dir):
    """Labels as wanted findings, and others as found ones."""
    d = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").withColumn("rule_id", F.element_at(F.array(*map(F.lit, "abc")), (d % 3 + 1).cast("int"))).withColumn("kind", F.when(d % 2 == 0, "line").otherwise("content"))
    wanted = labels.where("quality = 1").select("doc_id", "rule_id", "kind")
    return wanted, labels.where((d % 5 != 0) | (F.col("toxic") == 1)).select("doc_id", "rule_id", "kind")


_CASES_SQL = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS rule_id, CASE WHEN doc_id % 2 = 0 THEN 'line' ELSE 'content' END AS kind, quality = 1 AS w, (doc_id % 5 <> 0 OR toxic = 1) AS f FROM labels"
_COUNTS = "CAST(sum(CASE WHEN w AND f THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT w AND f THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN w AND NOT f THEN 1 ELSE 0 END) AS BIGINT) AS fn"
_SCORES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE AS f1"


def _outcomes(spark, sf_dir):
    return E.outcomes(*_cases(spark, sf_dir), ["doc_id", "rule_id", "kind"])


@query("eval_by_rule", f"SELECT *, {_SCORES} FROM (SELECT rule_id, {_COUNTS} FROM ({_CASES_SQL}) WHERE w OR f GROUP BY rule_id)")
def eval_by_rule(spark, sf_dir):
    return E.totals(_outcomes(spark, sf_dir), "rule_id")


@query("eval_strata", f"SELECT *, {_SCORES} FROM (SELECT rule_id, kind, CAST(grouping(rule_id) * 2 + grouping(kind) AS BIGINT) AS level, {_COUNTS} FROM ({_CASES_SQL}) WHERE w OR f GROUP BY GROUPING SETS ((rule_id), (kind), ()))")
def eval_strata(spark, sf_dir):
    return E.strata(_outcomes(spark, sf_dir), ["rule_id", "kind"])


@query("eval_averages", f"WITH r AS (SELECT *, {_SCORES} FROM (SELECT rule_id, {_COUNTS} FROM ({_CASES_SQL}) WHERE w OR f GROUP BY rule_id)), m AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r) SELECT m.*, {_SCORES}, (SELECT avg(precision) FROM r) AS macro_precision, (SELECT avg(recall) FROM r) AS macro_recall, (SELECT avg(f1) FROM r) AS macro_f1 FROM m")
def eval_averages(spark, sf_dir):
    return E.averages(E.totals(_outcomes(spark, sf_dir), "rule_id"))


@query("calibration", "WITH c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS band, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS BIGINT) AS fp FROM labels GROUP BY 1), p AS (SELECT *, tp / (tp + fp) AS precision, (tp + fp)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM c) SELECT band, tp, fp, precision, (precision + z * z / (2 * n) - z * sqrt((precision * (1 - precision) + z * z / (4 * n)) / n)) / (1 + z * z / n) AS wilson_low, CASE band WHEN 'high' THEN precision >= 0.975 WHEN 'medium' THEN precision >= 0.92 ELSE TRUE END AS accepted FROM p")
def calibration(spark, sf_dir):
    band = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return E.calibration(table(spark, sf_dir, "labels").select(band.alias("band"), (F.col("quality") == 1).alias("correct")))


@query("golden_diff", "WITH o AS (SELECT p_brand AS rule_id, 'n' AS metric, count(*)::DOUBLE AS value FROM part WHERE p_size < 40 GROUP BY 1), n AS (SELECT p_brand AS rule_id, 'n' AS metric, count(*)::DOUBLE AS value FROM part WHERE p_partkey % 10 <> 3 GROUP BY 1) SELECT rule_id, metric, o.value AS was, n.value AS now FROM o FULL JOIN n USING (rule_id, metric) WHERE o.value IS DISTINCT FROM n.value")
def golden_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    doc = lambda df: df.groupBy(F.col("p_brand").alias("rule_id")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("n"))
    return E.golden_diff(doc(part.where("p_size < 40")), doc(part.where("p_partkey % 10 <> 3")), ["rule_id"])


@query("false_positive_trend", "WITH o AS (SELECT p_brand AS rule_id, count(*)::DOUBLE AS was FROM part WHERE p_size < 25 GROUP BY 1), n AS (SELECT p_brand AS rule_id, count(*)::DOUBLE AS now FROM part WHERE p_size > 20 GROUP BY 1) SELECT rule_id, coalesce(was, 0) AS was, coalesce(now, 0) AS now, CASE WHEN coalesce(was, 0) > 0 THEN (coalesce(now, 0) - was) / was * 100 END AS change, CASE WHEN coalesce(was, 0) > 0 THEN (coalesce(now, 0) - was) / was * 100 > 20 ELSE coalesce(now, 0) > 0 END AS warns FROM o FULL JOIN n USING (rule_id)")
def false_positive_trend(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rate = lambda df: df.groupBy(F.col("p_brand").alias("rule_id")).agg(F.count("*").cast("double").alias("rate"))
    return E.trend(rate(part.where("p_size < 25")), rate(part.where("p_size > 20")))


@query("findings_per_million_lines", "WITH l AS (SELECT sum(len(string_split(text, chr(10)))) AS n FROM documents) SELECT lang, count(*) AS findings, count(*) * 1e6 / (SELECT n FROM l) AS rate FROM ({}) GROUP BY lang")
def findings_per_million_lines(spark, sf_dir):
    from .checks import cards

    return P.per_million_lines(cards(spark, sf_dir), table(spark, sf_dir, "documents"), "lang")


def _finish() -> None:
    from .checks import _cards_sql

    ORACLE["findings_per_million_lines"] = ORACLE["findings_per_million_lines"].format(_cards_sql())


_finish()


@query("dataset_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def dataset_counts(spark, sf_dir):
    return E.dataset_counts(table(spark, sf_dir, "documents"), ["lang", "source"])


_CASE = (
    "SELECT CAST(doc_id AS VARCHAR) AS id, text AS line, CASE doc_id % 3 WHEN 0 THEN ['jp-my-number'] WHEN 1 THEN ['jp-phone-number', 'no-such-rule'] ELSE [] END AS want, CASE WHEN doc_id % 4 = 0 THEN ['jp-my-number'] WHEN doc_id % 4 = 1 THEN ['jp-phone-number', 'old-rule'] ELSE [] END AS spans FROM documents"
)


@query(
    "dataset_quality",
    f"WITH c AS ({_CASE}), n AS (SELECT unnest(want) AS r FROM c UNION SELECT unnest(spans) FROM c) SELECT (SELECT count(DISTINCT r) FROM n WHERE r NOT IN ('jp-my-number', 'jp-phone-number')) AS unknown_rules, (SELECT CAST(sum(m - 1) AS BIGINT) FROM (SELECT count(*) AS m FROM c GROUP BY line, want, spans)) AS repeated_cases, "
    "(SELECT count(*) FROM (SELECT unnest(want) AS r, spans FROM c) WHERE NOT list_contains(spans, r)) AS pairs_without_span",
)
def dataset_quality(spark, sf_dir):
    """Cases made of the documents: unknown rules, cases that repeat another but for their id, pairs without a span."""
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    ids = lambda *x: F.array(*map(F.lit, x))
    want = F.when(d % 3 == 0, ids("jp-my-number")).when(d % 3 == 1, ids("jp-phone-number", "no-such-rule")).otherwise(none)
    spans = F.when(d % 4 == 0, ids("jp-my-number")).when(d % 4 == 1, ids("jp-phone-number", "old-rule")).otherwise(none)
    made = F.transform(spans, lambda r: F.struct(r.alias("rule_id"), F.lit(1).alias("line"), F.lit(0).alias("start"), F.lit(5).alias("end")))
    cases = table(spark, sf_dir, "documents").select(d.cast("string").alias("id"), F.col("text").alias("line"), want.alias("want"), made.alias("spans"))
    return E.dataset_quality(cases, ["jp-my-number", "jp-phone-number"])


# --- structure and sources -------------------------------------------------------------------------------------------------
_csv = Grid("orders", "o_orderkey").pick("a", ("x", "\"x,y\"", "\"he said \"\"hi\"\"\"", "", "x y")).pick("b", ("1", "\"2,3\"", "", "\"\"")).digits("n", 4, 10**6).pick("c", ("z", "\"090,-\"")).add("line", "a || ',' || b || ',' || n || ',' || c")


@query("csv_fields", f"SELECT k, i AS field, CASE i WHEN 1 THEN trim(a, '\"') WHEN 2 THEN trim(b, '\"') WHEN 3 THEN n ELSE trim(c, '\"') END AS value FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM ({_csv.sql}))".replace("trim(a, '\"')", "regexp_replace(a, '^\"(.*)\"$', '\\1')"))
def csv_fields(spark, sf_dir):
    """Fields of records with quoted commas and doubled quotes, where they stand in the line."""
    from ..detect import structure

    def run(batches):
        for b in batches:
            k, field, value = [], [], []
            for key, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (x, z) in enumerate(structure.csv_fields(line, ",")):
                    k.append(key), field.append(i + 1), value.append(line[x:z])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(field, pa.int32()), pa.array(value, pa.string())], names=["k", "field", "value"])

    return _csv.rows(spark, sf_dir).select("k", "line").mapInArrow(run, "k long, field int, value string")


@query("diff_added_lines", "SELECT o_orderkey AS k, 'f' || CAST(o_orderkey % 10 AS VARCHAR) || '.txt' AS file, CAST(o_orderkey % 100 + 2 AS INTEGER) AS line, 'new ' || CAST(o_orderkey AS VARCHAR) AS text FROM orders")
def diff_added_lines(spark, sf_dir):
    from ..sources.diff import added_lines, hunks

    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    f, n = F.concat(F.lit("f"), (k % 10).cast("string"), F.lit(".txt")), (k % 100 + 1).cast("string")
    patch = F.concat(F.lit("--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n@@ -"), n, F.lit(",2 +"), n, F.lit(",3 @@\n same\n+new "), s, F.lit("\n-old\n+++ kept\n\\ No newline\n"))
    patch = F.replace(patch, F.lit("\n+++ kept"), F.lit("\n tail"))
    return added_lines(hunks(table(spark, sf_dir, "orders").select(k.alias("k"), F.replace(patch, F.lit(",2 +"), F.lit(",3 +")).alias("patch"))))


@query("unescaped_pages", "SELECT page_id, md5(html) AS digest FROM (SELECT page_id, replace(html || ' &#23665;' || chr(92) || 'u5c71 %E5%B1%B1', '&#23665;' || chr(92) || 'u5c71 %E5%B1%B1', '山山 山') AS html FROM pages)")
def unescaped_pages(spark, sf_dir):
    """Whole pages with three kinds of escapes behind them, which alone are read: pages have none of their own."""
    from ..sources.files import unescaped

    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit(" &#23665;\\u5c71 %E5%B1%B1")).alias("html"))
    return unescaped(pages, "html").select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"))


_MAIL = "[%+._0-9A-Za-z-]+@[.0-9A-Za-z-]+\\.[A-Za-z]{2,}"
_MAIL_TEXTS = "SELECT doc_id, text || chr(10) || 'mail u' || CAST(doc_id AS VARCHAR) || '@' || CASE doc_id % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN '-x.jp' WHEN 2 THEN 'mail.nosuchtld' WHEN 3 THEN 'sample.org' ELSE 'a-b.co.jp' END AS text FROM documents"


def _mail_sql() -> str:
    from ..detect.dictionaries import words

    labels = "string_split(lower(split_part(value, '@', 2)), '.')"
    bad = f"len(list_filter({labels}, lambda x: x = '' OR x LIKE '-%' OR x LIKE '%-' OR x = 'example')) > 0"
    local = "split_part(value, '@', 1)"
    dummy = "regexp_matches(lower({}), 'hoge|fuga|dummy|sample|foo|bar')"
    return (
        f"SELECT doc_id, value, NOT {bad} AND NOT regexp_matches({local}, '^\\.|\\.$|\\.\\.') AND regexp_matches({local}, '[0-9A-Za-z]') AND NOT {dummy.format(local)} AND NOT {dummy.format(labels + '[1]')} AND {labels}[-1] IN {listed(words('tlds'))} AND {labels}[-1] NOT IN {listed(W.RESERVED_HOSTS)} AS valid "
        f"FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS value FROM ({_MAIL_TEXTS}))"
    )


@query("email_candidates", _mail_sql())
def email_candidates(spark, sf_dir):
    """Mail addresses of the documents, and one more behind each, judged by the engine's rule."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    host = F.when(d % 5 == 0, "gmail.com").when(d % 5 == 1, "-x.jp").when(d % 5 == 2, "mail.nosuchtld").when(d % 5 == 3, "sample.org").otherwise("a-b.co.jp")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nmail u"), s, F.lit("@"), host).alias("text"))
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), 0)).alias("value"))
    return found.withColumn("valid", C.email_valid(F.col("value")))


_headlines = Grid("orders", "o_orderkey").pick("a", ("山田太郎", "森林浴場", "鈴木花子", "会議", "田中")).pick("glue", ("、", "と", "", " ")).pick("b", ("佐藤健一", "報告書", "山田花子", "花子")).add("text", "'見出し ' || a || glue || b")


def _homographs_sql() -> str:
    from ..detect.dictionaries import words

    names, given = listed(words("surnames")), listed(words("given_names"))
    splits = " OR ".join(f"(length(v) - {i} BETWEEN 1 AND 4 AND NOT ({i} = 1 AND length(v) = 2) AND substr(v, 1, {i}) IN {names} AND substr(v, {i + 1}) IN {given})" for i in (1, 2, 3, 4))
    grams = "list_transform(range(1, length(run) + 1), lambda i: list_transform(range(2, least(8, length(run) - i + 1) + 1), lambda n: substr(run, i, n)))"
    return f"SELECT v AS value, count(*) AS n FROM (SELECT unnest(flatten({grams})) AS v FROM (SELECT unnest(regexp_extract_all(text, '[一-鿿]{{2,}}')) AS run FROM ({_headlines.sql}))) WHERE {splits} GROUP BY v"


@query("name_homographs", _homographs_sql())
def name_homographs(spark, sf_dir):
    """Runs of Han characters in texts without names that could pass for a surname and a given name."""
    from ..sources import dictionaries

    return dictionaries.homographs(_headlines.rows(spark, sf_dir))


# --- whole scans -------------------------------------------------------------------------------------------------------------
@query("scan_documents")
def scan_documents(spark, sf_dir):
    """Every finding of the default rules in the documents, masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = S.scan_documents(docs)
    return sinks.masked(found).select("doc_id", "source", "rule_id", "line", "column", "match", "confidence", "score", "offset", "end_offset")


def _japanese(spark, sf_dir):
    """A text of several lines for each customer, with numbers whose check digits hold for four in five."""
    k = F.col("c_custkey")
    b = _pad(k * 104729 % 100_000_000_000, 11)
    t = table(spark, sf_dir, "customer").select(k.alias("k"), b.alias("b"))
    rest = C._weighted(F.col("b"), _MY) % 11
    check = F.when(F.col("k") % 5 == 0, (F.when(rest <= 1, 0).otherwise(11 - rest) + 1) % 10).otherwise(F.when(rest <= 1, 0).otherwise(11 - rest))
    text = F.concat(F.lit("氏名: 山田太郎\n個人番号："), F.col("b"), check.cast("string"), F.lit("\n\n携帯\n０９０-"), _pad(F.col("k") % 10000, 4), F.lit("-"), _pad(F.col("k") * 7 % 10000, 4), F.lit("\n合計 "), _pad(F.col("k"), 7), F.lit("円"))
    return t.withColumn("check", check).select("k", text.alias("text"))


_B = "lpad(CAST(c_custkey * 104729 % 100000000000 AS VARCHAR), 11, '0')"
_CK = f"(CASE WHEN {sql_sum('b', _MY)} % 11 <= 1 THEN 0 ELSE 11 - {sql_sum('b', _MY)} % 11 END)"


@query(
    "scan_derived_texts",
    f"WITH t AS (SELECT c_custkey AS k, {_B} AS b FROM customer), c AS (SELECT k, b || CAST({_CK} AS VARCHAR) AS n FROM t WHERE k % 5 <> 0) SELECT k, 'jp-my-number' AS rule_id, 2 AS line, 6 AS \"column\", {sql_mask('n')} AS match, 3 AS confidence FROM c WHERE n <> repeat(substr(n, 1, 1), 12) "
    "UNION ALL SELECT c_custkey, 'jp-phone-number', 5, 1, '０９' || repeat('*', 9) || right('090-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0'), 2), 3 FROM customer UNION ALL SELECT c_custkey, 'person-name', 1, 5, '****', 3 FROM customer",
)
def scan_derived_texts(spark, sf_dir):
    """The matcher over derived texts: check digits, a label on the line before, a price, a name near anchors."""
    # The derived texts are one small file's worth of rows that cost much each: spread over the cores.
    found = sinks.masked(S.scan_documents(S.spread(_japanese(spark, sf_dir))))
    return found.select("k", "rule_id", "line", "column", "match", "confidence")


@query("dropped_reasons")
def dropped_reasons(spark, sf_dir):
    """Every dropped candidate of the documents, counted by rule and reason."""
    return S.dropped_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("external_candidates", "SELECT 'x-license' AS rule_id, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line LIKE 'Licensed%'")
def external_candidates(spark, sf_dir):
    """A recognizer of the user's own beside the rules."""

    def recognize(path, text):
        return [{"rule_id": "x-license", "line": i + 1, "column": 1, "length": 8, "confidence": "low"} for i, line in enumerate(text.split("\n")) if line.startswith("Licensed")]

    found = S.external_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), recognize)
    return found.where("rule_id like 'x-%'").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("rules_listing")
def rules_listing(spark, sf_dir):
    return S.rules_listing(spark, Config())
