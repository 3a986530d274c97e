"""Queries of structured files, pairs of lines, decoding and span matching, over texts derived from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..detect.engine import Config
from ..functions import checks as C
from ..operators import correlate as K
from ..operators import evaluate as E
from ..operators import scan as S
from ..sources import files
from . import families
from .checks import _Y, sql_mask, sql_same, table
from .grids import Grid

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


_ACCOUNT = "lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0')"


def _accounts(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.lpad((k * 7919 % 10_000_000).cast("string"), 7, "0").alias("n"))


def _scanned(df, text, path: str, config: Config = Config(high_recall=True)):
    """Scanned texts of few, costly rows: spread over the cores first."""
    files_ = S.spread(df.select("k", text.alias("text"), F.lit(path).alias("file")))
    return sinks.masked(S.scan_documents(files_, path_col="file", config=config)).select("k", "rule_id", "line", "column", "match", "confidence")


def _account_sql(line: int, column: int, names: str = "") -> str:
    one = f"SELECT c_custkey AS k, 'jp-bank-account' AS rule_id, {line} AS line, {column} AS \"column\", {sql_mask('n')} AS match, 2 AS confidence FROM (SELECT c_custkey, {_ACCOUNT} AS n FROM customer) WHERE NOT {sql_same('n')}"
    return one + names


def _name_sql(line: int, column: int) -> str:
    return f" UNION ALL SELECT c_custkey, 'person-name-structured', {line}, {column}, '****', 2 FROM customer"


@query("scan_csv_columns", _account_sql(2, 6, _name_sql(2, 1)))
def scan_csv_columns(spark, sf_dir):
    """Cells judged by their header: a name, an account, and an order number that isn't one."""
    n = F.col("n")
    return _scanned(_accounts(spark, sf_dir), F.concat(F.lit("氏名,口座番号,注文番号\n山田太郎,"), n, F.lit(","), n, F.lit("\n")), "a.csv")


_INSERT = "INSERT INTO t (full_name, account_no, order_id) VALUES ('山田太郎', '"


@query("scan_sql_columns", _account_sql(1, len(_INSERT) + 1, _name_sql(1, _INSERT.index("山") + 1)))
def scan_sql_columns(spark, sf_dir):
    """Values of an INSERT judged by their column."""
    n = F.col("n")
    return _scanned(_accounts(spark, sf_dir), F.concat(F.lit(_INSERT), n, F.lit("', "), n, F.lit(");")), "a.sql")


@query("scan_json_scope", _account_sql(2, 8))
def scan_json_scope(spark, sf_dir):
    """Values judged by their key and the key above it."""
    n = F.col("n")
    return _scanned(_accounts(spark, sf_dir), F.concat(F.lit('{"bankAccount": {\n"no": "'), n, F.lit('",\n\n\n\n\n"orderId": "'), n, F.lit('"\n}}')), "a.json")


@query("scan_yaml_scope", _account_sql(2, 7))
def scan_yaml_scope(spark, sf_dir):
    n = F.col("n")
    return _scanned(_accounts(spark, sf_dir), F.concat(F.lit("bankAccount:\n  no: "), n, F.lit("\n\n\n\n\norders:\n  id: "), n), "a.yaml")


@query("scan_code_statements", _account_sql(1, 17))
def scan_code_statements(spark, sf_dir):
    """Assignments judged by their left sides."""
    n = F.col("n")
    return _scanned(_accounts(spark, sf_dir), F.concat(F.lit('bankAccount := "'), n, F.lit('"; orderId := "'), n, F.lit('"')), "a.go")


_PAIR_SQL = f"SELECT *, lpad(n, 8, '0') AS n8 FROM (SELECT c_custkey AS k, '1' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '00' AS s, CAST(100000 + c_custkey * 31 % 900000 AS VARCHAR) || '1' AS n FROM customer)"
_SYMBOL = f"(substr(s, 1, 3) || CAST(({_Y}) % 10 AS VARCHAR) || '0')"


@query(
    "yucho_line_pairs",
    f"WITH p AS (SELECT k, {_SYMBOL} AS s, n FROM ({_PAIR_SQL})) SELECT k, 'jp-yucho-account' AS rule_id, 1 AS line, 4 AS \"column\", {sql_mask('s')} AS match, 3 AS confidence FROM p WHERE NOT {sql_same('s')} AND NOT {sql_same('n')} UNION ALL SELECT k, 'jp-yucho-account', 2, 4, {sql_mask('n')}, 3 FROM p WHERE NOT {sql_same('s')} AND NOT {sql_same('n')}",
)
def yucho_line_pairs(spark, sf_dir):
    """A symbol and, on the next line, a number that its check digit fits."""
    k = F.col("c_custkey")
    n = F.concat((100_000 + k * 31 % 900_000).cast("string"), F.lit("1"))
    blank = F.concat(F.lit("1"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("00"))
    t = table(spark, sf_dir, "customer").select(k.alias("k"), n.alias("n"), blank.alias("b"))
    s = F.concat(F.substring("b", 1, 3), C.yucho_check(F.col("b"), F.col("n")).cast("string"), F.lit("0"))
    return _scanned(t.withColumn("s", s), F.concat(F.lit("記号 "), "s", F.lit("\n番号 "), "n"), "a.txt")


@query("name_line_pairs", "SELECT c_custkey AS k, 'person-name-structured' AS rule_id, 2 AS line, 1 AS \"column\", '****' AS match, 2 AS confidence FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'person-name', 1, 4, '**', 2 FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 'person-name', 2, 4, '**', 2 FROM customer WHERE c_custkey % 3 = 1")
def name_line_pairs(spark, sf_dir):
    """A label and the name below it; surname and given name on lines of their own."""
    k = F.col("k")
    text = F.when(k % 3 == 0, "氏名:\n山田太郎").when(k % 3 == 1, "姓: 山田\n名: 太郎").otherwise("件名:\n山田太郎")
    return _scanned(_accounts(spark, sf_dir), text, "a.txt")


_LABEL, _END = "口座番号: ", " テストabcdefghijkl"


@query("decoded_files", f"SELECT c_custkey AS k, CASE WHEN c_custkey % 9 IN (4, 8) THEN NULL ELSE '{_LABEL}' || CAST(c_custkey AS VARCHAR) || '{_END}' END AS text FROM customer")
def decoded_files(spark, sf_dir):
    """Bytes in UTF-8, UTF-16 with a mark or without, Shift_JIS, EUC-JP, ISO-2022-JP, and none of these."""
    k = F.col("c_custkey")
    text = F.concat(F.lit(_LABEL), k.cast("string"), F.lit(_END))
    le, be, number = F.encode(text, "UTF-16LE"), F.encode(text, "UTF-16BE"), F.encode(k.cast("string"), "UTF-8")
    old = lambda name: F.concat(F.unhex(F.lit(_LABEL.encode(name).hex())), number, F.unhex(F.lit(_END.encode(name).hex())))
    raw = F.when(k % 9 == 0, F.encode(text, "UTF-8")).when(k % 9 == 1, F.concat(F.unhex(F.lit("FFFE")), le)).when(k % 9 == 2, F.concat(F.unhex(F.lit("FEFF")), be)).when(k % 9 == 3, le).when(k % 9 == 4, F.unhex(F.lit("00FF" + "07" * 20)))
    raw = raw.when(k % 9 == 5, old("cp932")).when(k % 9 == 6, old("euc_jp")).when(k % 9 == 7, old("iso2022_jp")).otherwise(F.unhex(F.lit("FEFFD800")))
    return files.decoded(table(spark, sf_dir, "customer").select(k.alias("k"), raw.alias("content")))


@query("escapes_read", "SELECT c_custkey AS k, 'a' || chr(CAST(23665 + c_custkey % 100 AS INTEGER)) || 'b' || chr(CAST(23665 + c_custkey % 100 AS INTEGER)) || ' 山 %41 &amp; \\\\u5c71' AS text FROM customer")
def escapes_read(spark, sf_dir):
    """Numeric references, JSON escapes and runs of percent signs; single ones and escaped backslashes stay."""
    k = F.col("c_custkey")
    code = 23665 + k % 100
    raw = F.concat(F.lit("a&#"), code.cast("string"), F.lit(";b\\u"), F.lower(F.hex(code)), F.lit(" %E5%B1%B1 %41 &amp; \\\\u5c71"))
    return files.unescaped(table(spark, sf_dir, "customer").select(k.alias("k"), raw.alias("text")))


_WANTED = "SELECT l_orderkey AS k, CAST(l_partkey % 9 AS INTEGER) AS start, CAST(l_partkey % 9 + 5 AS INTEGER) AS z FROM lineitem"
_FOUND = "SELECT l_orderkey AS k, CAST(l_suppkey % 9 AS INTEGER) AS start, CAST(l_suppkey % 9 + 4 + l_linenumber % 3 AS INTEGER) AS z FROM lineitem WHERE l_linenumber < 6"


@query(
    "span_matching",
    f"WITH w AS (SELECT k, start, z, count(*) AS n FROM ({_WANTED}) GROUP BY ALL), f AS (SELECT k, start, z, count(*) AS n FROM ({_FOUND}) GROUP BY ALL), e AS (SELECT k, CAST(sum(least(w.n, f.n)) AS INTEGER) AS exact FROM w JOIN f USING (k, start, z) GROUP BY k), "
    f"a AS (SELECT k, CAST(count(*) AS INTEGER) AS n_wanted FROM ({_WANTED}) GROUP BY k), b AS (SELECT k, CAST(count(*) AS INTEGER) AS n_found FROM ({_FOUND}) GROUP BY k) SELECT k, n_wanted, coalesce(n_found, 0) AS n_found, coalesce(exact, 0) AS exact FROM a LEFT JOIN b USING (k) LEFT JOIN e USING (k)",
)
def span_matching(spark, sf_dir):
    """All wanted and found spans of each order, matched one to one; SQL can state the exact matches, of which the
    largest number is a count (containment and overlap are held against brute force in the tests)."""
    n = F.col("l_linenumber")
    t = table(spark, sf_dir, "lineitem")
    a, f = (F.col("l_partkey") % 9).cast("int"), (F.col("l_suppkey") % 9).cast("int")
    wanted = t.select(F.col("l_orderkey").alias("k"), a.alias("start"), (a + 5).alias("end"))
    found = t.where("l_linenumber < 6").select(F.col("l_orderkey").alias("k"), f.alias("start"), (f + 4 + n % 3).cast("int").alias("end"))
    return E.span_matches(wanted, found, ["k"], parts=K.parts_for(wanted, found)).select("k", "n_wanted", "n_found", "exact")


_record = Grid().pick("quote", ("\"山\n田\"", "山田", "\"山,\n\n田\"")).pick("head", ("口座番号", "注文番号", "account_no")).digits("d", 7, 10**6).add("text", "'会員名,' || head || chr(10) || quote || ',' || d || chr(10) || 'x,' || d || chr(10)")
_BREAKS = "(length(quote) - length(replace(quote, chr(10), '')))"


@query(
    "csv_quoted_records",
    f"SELECT k, 'jp-bank-account' AS rule_id, CAST({_BREAKS} + 2 + i AS INTEGER) AS line, CAST(CASE WHEN i = 1 THEN 3 ELSE length(string_split(quote, chr(10))[-1]) + 2 END AS INTEGER) AS \"column\", d AS match, 2 AS confidence FROM (SELECT *, unnest([0, 1]) AS i FROM ({_record.sql})) WHERE head <> '注文番号' AND NOT (i = 0 AND {_BREAKS} > 0) AND NOT {sql_same('d')}",
)
def csv_quoted_records(spark, sf_dir):
    """Records with line breaks in quoted fields are passed over; the records after them still belong to their columns."""
    rows = S.spread(_record.rows(spark, sf_dir).select("k", "text", F.lit("a.csv").alias("file")))
    return S.scan_documents(rows, path_col="file", config=families.only("jp-bank-account")).select("k", "rule_id", "line", "column", "match", "confidence")


_hunk = Grid("orders", "o_orderkey").digits("d", 7, 10**6).pick("label", ("口座番号:", "普通預金", "値", "注文番号:")).pick("label_added", ("yes", "no")).pick("value_added", ("yes", "no", "yes")).pick("after", ("円", "備考", "")).pick("after_added", ("yes", "no")).add("first_line", "CAST(k % 100 + 1 AS INT)")


@query("scan_hunks", f"SELECT k, 'jp-bank-account' AS rule_id, first_line + 1 AS line, 1 AS \"column\", d AS match FROM ({_hunk.sql}) WHERE value_added = 'yes' AND label IN ('口座番号:', '普通預金') AND NOT (after = '円' AND after_added = 'yes') AND NOT {sql_same('d')}")
def scan_hunks(spark, sf_dir):
    """Only values on added lines are findings; unchanged lines give context, but never against."""
    t = _hunk.rows(spark, sf_dir)
    yes = lambda c: F.col(c) == "yes"
    t = t.select("k", F.lit("a.txt").alias("file"), "first_line", F.array("label", "d", "after").alias("texts"), F.array(yes("label_added"), yes("value_added"), yes("after_added")).alias("added"))
    return S.scan_hunks(S.spread(t), config=families.only("jp-bank-account")).select("k", "rule_id", "line", "column", "match")


_single = Grid("orders", "o_orderkey").pick("label", ("口座番号", "値")).pick("glue", (": ", "\n")).digits("d", 7, 10**6).add("line", "label || glue || d")


@query("scan_single_lines", f"SELECT k, 'jp-bank-account' AS rule_id, CAST(length(label || glue) + 1 AS INTEGER) AS \"column\" FROM ({_single.sql}) WHERE label = '口座番号' AND NOT {sql_same('d')}")
def scan_single_lines(spark, sf_dir):
    """Lines by themselves: what a text is broken into, no line knows."""
    return S.scan_lines(_single.rows(spark, sf_dir).select("k", "line"), "line", families.only("jp-bank-account")).select("k", "rule_id", "column")


@query("confidence_misses", "SELECT rule_id, count(*) FILTER (WHERE NOT wanted) AS finding_fp, count(*) FILTER (WHERE wanted AND asked IS NOT NULL AND asked <> confidence) AS confidence_miss FROM (SELECT 'r' || CAST(doc_id % 3 AS VARCHAR) AS rule_id, quality = 1 AS wanted, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 2 + 2 END AS asked, doc_id % 3 + 1 AS confidence FROM labels WHERE toxic = 1 OR doc_id % 5 <> 0) GROUP BY rule_id")
def confidence_misses(spark, sf_dir):
    """Findings that no case wants, and wanted ones found with another confidence than the case asks for."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").withColumn("rule_id", F.concat(F.lit("r"), (d % 3).cast("string")))
    wanted = rows.where("quality = 1").select("doc_id", "rule_id", F.when(d % 4 == 0, None).otherwise(d % 2 + 2).alias("confidence"))
    return E.confidence_misses(wanted, rows.where("toxic = 1 OR doc_id % 5 <> 0").select("doc_id", "rule_id", (d % 3 + 1).alias("confidence")), ["doc_id"])
