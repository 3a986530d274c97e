"""Scans of streams: the matcher keeps no state between documents, so it runs on them as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detect.engine import Config
from ..operators.scan import scan_documents


def scan_stream(stream: DataFrame, text_col: str = "text", path_col: str | None = None, config: Config | None = None) -> DataFrame:
    """Findings of a streaming DataFrame's texts."""
    return scan_documents(stream, text_col, path_col, config)


def findings_by_window(stream: DataFrame, time_col: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Findings a rule and window of event time, for data that is up to ``late`` late."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, size), "rule_id").count()


def write_findings(findings: DataFrame, out: str, checkpoint: str):
    """Append masked findings as Parquet, exactly once, and stop when the input is read."""
    from ..sinks import masked

    return masked(findings).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
