"""Jobs that make dictionary files out of published tables; run only where these are supplied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def words(spark: SparkSession, path: str) -> DataFrame:
    """A word list: a word a line, comments after ``#``."""
    lines = spark.read.text(path).select(F.explode(F.split(F.trim(F.regexp_replace("value", "#.*", "")), "\\s+")).alias("word"))
    return lines.where("word <> ''").distinct()


def postal_codes(spark: SparkSession, path: str, column: int = 2) -> DataFrame:
    """The 7-digit codes of a postal table in CSV (by default its third column)."""
    df = spark.read.option("encoding", "MS932").csv(path)
    return df.select(F.col(df.columns[column]).alias("word")).where(F.col("word").rlike("^[0-9]{7}$")).distinct()


def municipalities(spark: SparkSession, path: str, column: int = 7) -> DataFrame:
    """Municipality names of the same table; wards of a city also by themselves, counties left out."""
    df = spark.read.option("encoding", "MS932").csv(path)
    name = F.regexp_replace(df.columns[column], "^.+郡(?=.+[町村]$)", "")
    parts = F.array(name, F.regexp_extract(name, "^(.+市).+区$", 1), F.regexp_extract(name, "^.+市(.+区)$", 1))
    return df.select(F.explode(parts).alias("word")).where("word <> ''").distinct()


def towns(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Town names without their numbered blocks."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.regexp_replace(column, "[〇一二三四五六七八九十0-9０-９]+丁目$", "").alias("word")).where("word <> ''").distinct()


def area_codes(spark: SparkSession, path: str, column: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.select(F.regexp_extract(column, "^(0[0-9]{1,4})", 1).alias("word")).where("word <> ''").distinct()


def names(spark: SparkSession, path: str, column: str, least: int = 1, count: str | None = None) -> DataFrame:
    """Names of a CSV that stand in it often enough."""
    df = spark.read.option("header", True).csv(path)
    n = F.sum(F.col(count).cast("long")) if count else F.count("*")
    return df.groupBy(F.trim(column).alias("word")).agg(n.alias("n")).where((F.col("n") >= least) & (F.col("word") != "")).select("word")


def romaji_variants(df: DataFrame) -> DataFrame:
    """Latin names, with their long vowels shortened and o as oh."""
    w = F.col("word")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "ou", "o"), "oo", "o"), "uu", "u")
    oh = F.regexp_replace(F.regexp_replace(w, "ou", "oh"), "oo", "oh")
    return df.select(F.explode(F.array(w, short, oh, F.regexp_replace(oh, "uu", "u"))).alias("word")).distinct()


def homographs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, n): parts of runs of Han characters in texts without names that could pass for a known surname and
    given name (up to 4 characters each, not one and one)."""
    from ..detect.dictionaries import words as known

    runs = df.select(F.explode(F.regexp_extract_all(text_col, F.lit("[\\x{4E00}-\\x{9FFF}]{2,}"), 0)).alias("run"))
    part = lambda a: F.transform(F.sequence(F.lit(2), F.least(F.length("run") - a + 1, F.lit(8))), lambda n: F.substring(F.col("run"), a, n))
    grams = runs.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("run") - 1), part))).alias("value"))
    names, given = sorted(known("surnames")), sorted(known("given_names"))
    n = F.length("value")
    fits = lambda i: (n - i).between(1, 4) & ~((i == 1) & (n == 2)) & F.substring(F.col("value"), F.lit(1), i).isin(*names) & F.substring(F.col("value"), i + 1, F.lit(9)).isin(*given)
    return grams.where(F.exists(F.sequence(F.lit(1), F.least(n - 1, F.lit(4))), fits)).groupBy("value").agg(F.count("*").alias("n"))


def sampled(words: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` words in the order of a seeded hash, the same ones at every run: examples for generated cases."""
    return words.select("word").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "word").cast("binary")), "word").limit(most)
