"""Queries of lists, kinds, paths, bytes and single-value validators over values derived from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import text as X
from ..sources import dictionaries as D
from ..sources import files
from .checks import matched, table
from .grids import Grid

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


_numbers = Grid("orders", "o_orderkey").pick("head", ("090-", "03-", "0120-", "050-", "+81-90-", "080-")).digits("d", 8, 10**6).add("value", "CASE head WHEN '0120-' THEN head || substr(d, 1, 3) || '-' || substr(d, 4, 3) ELSE head || substr(d, 1, 4) || '-' || substr(d, 5, 4) END").add("text", "'tel ' || value")
_FOUND = f"SELECT k, value AS match FROM ({_numbers.sql})"
_STOPPED = "'0120-003-456', '080-1111-2222'"


def _phones_found(spark, sf_dir, **config):
    from .families import only, scanned

    return scanned(_numbers.rows(spark, sf_dir), only("jp-phone-number", **config)).select("k", "match")


@query("allow_listed_values", f"{_FOUND} WHERE value NOT IN ({_STOPPED}) AND NOT regexp_matches(value, '^090-[0-4]') AND NOT regexp_matches(value, '7$')")
def allow_listed_values(spark, sf_dir):
    """What the matcher finds besides values that a stop word or an allowed pattern exempts."""
    return _phones_found(spark, sf_dir, stopwords=("0120-003-456", "080-1111-2222"), allow=("^090-[0-4]", "7$"))


@query("excluded_kinds", f"{_FOUND} WHERE head NOT IN ('0120-', '050-') AND NOT regexp_matches(value, '^080-?0')")
def excluded_kinds(spark, sf_dir):
    """What the matcher finds besides numbers of services and of IP telephony."""
    return _phones_found(spark, sf_dir, exclude_kinds=("service", "ip"))


_paths = Grid("orders", "o_orderkey").pick("root", ("/r/", "/data/x/", "file:/h/")).pick("folder", ("src", "node_modules", ".git", "dist", "distx", "docs/b", "docs", "vendor/y", "my.venv", "build")).pick("name", ("/a.txt", "/a.md", "/build", "/c/d.md", ".md")).add("length", "k * 7919 % 10485760").add("path", "root || folder || name")


@query("pruned_paths", f"SELECT k, path FROM ({_paths.sql}) WHERE length <= 5242880 AND NOT regexp_matches(path, '/(node_modules|vendor|venv|\\.venv|\\.git|build|dist|target|\\.next|__pycache__)/') AND NOT regexp_matches(path, '(^|/)docs/(.*/)?[^/]*\\.md$')")
def pruned_paths(spark, sf_dir):
    """Files of a listing that are read: of a fair size, in no skipped folder and under no allowed glob."""
    return files.pruned(_paths.rows(spark, sf_dir), allow_paths=("docs/**/*.md",)).select("k", "path")


_bytes = Grid("orders", "o_orderkey").add("n", "k * 7919 % 9000").pick("zero", ("yes", "no", "yes"))


@query("binary_contents", f"SELECT k, zero = 'yes' AND n < 8192 AS is_binary FROM ({_bytes.sql})")
def binary_contents(spark, sf_dir):
    """A zero byte somewhere in the first 8 KiB; one after them doesn't count."""
    rows = _bytes.rows(spark, sf_dir)
    head = F.encode(F.repeat(F.lit("x"), F.col("n").cast("int")), "UTF-8")
    raw = F.when(F.col("zero") == "yes", F.concat(head, F.unhex(F.lit("0079")))).otherwise(F.concat(head, F.unhex(F.lit("79"))))
    return rows.select("k", files.binary(raw).alias("is_binary"))


_kana = Grid("orders", "o_orderkey").pick("a", tuple("かがハぱウあアんゝヽー山")).pick("mark", ("\u3099", "\u309a", "", "\u3099\u3099")).pick("b", tuple("タほワx")).pick("mark2", ("\u3099", "\u309a", "")).add("text", "a || mark || b || mark2")


@query("composed_kana", f"SELECT k, nfc_normalize(text) AS value FROM ({_kana.sql})")
def composed_kana(spark, sf_dir):
    """Kana and a combining voice mark in one character, where there is one for both."""
    return _kana.rows(spark, sf_dir).select("k", X.compose_kana(F.col("text")).alias("value"))


@query("address_tails", "SELECT o_orderkey AS k, NOT (o_orderkey % 3 = 0 AND try_cast(CAST(1990 + o_orderkey % 30 AS VARCHAR) || '-' || CAST(1 + o_orderkey % 14 AS VARCHAR) || '-' || CAST(1 + o_orderkey % 33 AS VARCHAR) AS DATE) IS NOT NULL) AS valid FROM orders")
def address_tails(spark, sf_dir):
    """Numbers behind an address that are a date, and others."""
    k, s = F.col("o_orderkey"), lambda x: x.cast("string")
    date = F.concat(s(1990 + k % 30), F.lit("-"), s(1 + k % 14), F.lit("-"), s(1 + k % 33))
    tail = F.when(k % 3 == 0, date).when(k % 3 == 1, F.concat(s(k % 9999), F.lit("-"), s(k % 99))).otherwise(F.concat(date, F.lit("-1")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), C.address_tail_is_no_date(F.concat(F.lit("渋谷区神南"), tail)).alias("valid"))


def _mail_grid():
    from .families import _MAIL_OK, _mail

    return _mail, _MAIL_OK


@query("email_valid", f"SELECT k, value, ({_mail_grid()[1]}) AS valid, ({_mail_grid()[1]}) AS by_matcher FROM ({_mail_grid()[0].sql})")
def email_valid(spark, sf_dir):
    """The validity of mail addresses: as an expression, and in the matcher."""
    from ..detect import validators

    rows = matched(_mail_grid()[0].rows(spark, sf_dir), ["value"], lambda: lambda v: (v, validators.email_valid(v)), "value string, by_matcher boolean")
    return rows.select("k", "value", C.email_valid(F.col("value")).alias("valid"), "by_matcher")


@query("drivers_license_valid", "SELECT o_orderkey AS k, lpad(CAST(o_orderkey * 7919 % 1000000000000 AS VARCHAR), 12, CAST(o_orderkey % 3 AS VARCHAR)) AS value, substr(lpad(CAST(o_orderkey * 7919 % 1000000000000 AS VARCHAR), 12, CAST(o_orderkey % 3 AS VARCHAR)), 1, 1) <> '0' AS valid FROM orders")
def drivers_license_valid(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.lpad((k * 7919 % 1_000_000_000_000).cast("string"), F.lit(12), (k % 3).cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), value.alias("value")).withColumn("valid", C.drivers_license_valid(F.col("value")))


_groups = Grid("orders", "o_orderkey").pick("a", ("", "1234 ", "12 ", "x 1234 ", "9999-", "12345 ", "x1234 ")).digits("d", 12, 10**6).add("value", "substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' ' || substr(d, 9, 4)").pick("z", ("", " 5678", " 56", " x", " 56789", "-1234", " 5678 1")).add("line", "a || value || z")


@query("neighbouring_groups", f"SELECT k, NOT (regexp_matches(a, '(^|[^0-9])[0-9]{{4}} $') OR regexp_matches(z, '^ [0-9]{{4}}($|[^0-9])')) AS valid FROM ({_groups.sql})")
def neighbouring_groups(spark, sf_dir):
    """Groups of four digits beside a number of three such groups say that it is part of a longer one."""
    from ..detect import validators

    def make():
        check = validators.no_digit_group(" ", 4)
        return lambda a, value, line: (check(line, len(a), len(a) + len(value)),)

    return matched(_groups.rows(spark, sf_dir), ["a", "value", "line"], make, "valid boolean")


@query("sampled_words", "SELECT word FROM (SELECT DISTINCT p_name AS word FROM part) ORDER BY md5('7:' || word), word LIMIT 50")
def sampled_words(spark, sf_dir):
    """Fifty words of a list, the same at every run: a sampling operator."""
    return D.sampled(table(spark, sf_dir, "part").select(F.col("p_name").alias("word")), 50)


@query("latin_name_variants", "SELECT DISTINCT unnest([w, replace(replace(replace(w, 'ou', 'o'), 'oo', 'o'), 'uu', 'u'), replace(replace(w, 'ou', 'oh'), 'oo', 'oh'), replace(replace(replace(w, 'ou', 'oh'), 'oo', 'oh'), 'uu', 'u')]) AS word FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'satou' WHEN 1 THEN 'oono' WHEN 2 THEN 'yuuki' ELSE 'x' || CAST(c_custkey AS VARCHAR) END AS w FROM customer)")
def latin_name_variants(spark, sf_dir):
    k = F.col("c_custkey")
    return D.romaji_variants(table(spark, sf_dir, "customer").select(F.when(k % 4 == 0, "satou").when(k % 4 == 1, "oono").when(k % 4 == 2, "yuuki").otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("word")))
