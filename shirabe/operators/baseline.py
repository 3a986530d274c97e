"""Baselines: salted fingerprints of known findings, and the findings that aren't among them."""

from __future__ import annotations

import json
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def fingerprint(salt_hex: str, rule_id: Column, file: Column, match: Column) -> Column:
    """HMAC-SHA256 of rule, file and value (parted by zero bytes), in hex, by built-in functions alone."""
    key = bytes.fromhex(salt_hex)
    key = (key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    zero = F.unhex(F.lit("00"))
    message = F.concat(F.encode(rule_id, "utf-8"), zero, F.encode(file, "utf-8"), zero, F.encode(match, "utf-8"))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def new_salt() -> str:
    return secrets.token_hex(16)


def split(findings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that are new, findings whose fingerprint is known)."""
    return findings.join(known, "fingerprint", "left_anti"), findings.join(known, "fingerprint", "left_semi")


def merge(known: DataFrame, findings: DataFrame) -> DataFrame:
    """The known fingerprints, and those of new findings after them."""
    return known.select("fingerprint").unionByName(findings.select("fingerprint").distinct().join(known, "fingerprint", "left_anti"))


def write(entries: DataFrame, salt: str, path: str) -> None:
    """The baseline document: one JSON line for its head, one for each entry."""
    head = json.dumps({"version": VERSION, "salt": salt})
    spark = entries.sparkSession
    body = entries.select(F.to_json(F.struct("fingerprint")).alias("value"))
    spark.createDataFrame([(head,)], "value string").unionByName(body).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    rows = spark.read.schema("version int, salt string, fingerprint string").json(path)
    head = rows.where("version is not null").first()
    if head is None or head.version != VERSION:
        raise ValueError(f"no baseline of version {VERSION} at {path}")
    return head.salt, rows.where("fingerprint is not null").select("fingerprint")
