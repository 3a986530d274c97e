"""What reports need besides findings: budgets by file, thresholds, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..detect.engine import RETAINED


def retained(found: DataFrame, file: list[str], order: list[str], most: int = RETAINED) -> DataFrame:
    """The first ``most`` candidates of each file, which are kept for a boost; ``most`` is the feature's budget."""
    w = Window.partitionBy(*file).orderBy(*order)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def split_by_threshold(found: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(findings to report, those that only count for the exit status)."""
    shown = (F.col("confidence") >= least) & ~F.col("fail_only")
    return found.where(shown), found.where(~shown)


def per_million_lines(found: DataFrame, texts: DataFrame, *by: str, text_col: str = "text") -> DataFrame:
    """Findings of each group, and their rate a million lines of all texts."""
    n = texts.agg(F.sum(F.size(F.split(text_col, "\n", -1))).alias("n"))
    return found.groupBy(*by).agg(F.count("*").alias("findings")).crossJoin(F.broadcast(n)).select(*by, "findings", (F.col("findings") * 1e6 / F.col("n")).alias("rate"))
