"""Results as tables, reports, JSON, SARIF and annotations. Values are masked unless asked for otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import mask

LEVEL = {3: "high", 2: "medium", 1: "low"}


def level(c: Column) -> Column:
    return F.when(c == 3, "high").when(c == 2, "medium").otherwise("low")


def masked(df: DataFrame, unmask: bool = False) -> DataFrame:
    """``match`` masked; every sink begins with this."""
    return df if unmask else df.withColumn("match", mask(F.col("match")))


def text_report(df: DataFrame, unmask: bool = False, reasons: bool = False) -> DataFrame:
    """A line for each finding: place, confidence, rule, description, value."""
    line = F.format_string("%s:%d:%d [%s] %s %s %s", "file", "line", "column", level(F.col("confidence")), "rule_id", "description", "match")
    if reasons:
        line = F.concat(line, F.lit("\n    "), F.to_json("reason"))
    return masked(df, unmask).orderBy("file", "line", "column", "end", "rule_id").select(line.alias("value"))


def json_lines(df: DataFrame, unmask: bool = False) -> DataFrame:
    """A JSON object for each finding; the form for results of any size."""
    keep = [c for c in ("rule_id", "description", "file", "line", "column", "offset", "end_offset", "match", "reason", "fingerprint") if c in df.columns]
    return masked(df, unmask).select(F.to_json(F.struct(*keep, level(F.col("confidence")).alias("confidence"))).alias("value"))


def json_report(df: DataFrame, drops: DataFrame | None = None, unmask: bool = False) -> DataFrame:
    """One JSON document of all findings and, if given, drops (one row: for reports, not for archives)."""
    one = json_lines(df, unmask).agg(F.array_sort(F.collect_list("value")).alias("f"))
    body = F.concat(F.lit('{"findings":['), F.array_join("f", ","), F.lit('],"count":'), F.size("f").cast("string"))
    if drops is None:
        return one.select(F.concat(body, F.lit("}")).alias("value"))
    d = drops.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in drops.columns if c != "truncated"])))).alias("d"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("t"))
    return one.crossJoin(d).select(F.concat(body, F.lit(',"dropped":['), F.array_join("d", ","), F.lit('],"dropped_truncated":'), F.col("t").cast("string"), F.lit("}")).alias("value"))


def _escaped(c: Column, name: bool) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *((":", "%3A"), (",", "%2C"))[: 2 * name]):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def annotations(df: DataFrame, unmask: bool = False) -> DataFrame:
    """Workflow commands: error, warning or notice by confidence."""
    kind = F.when(F.col("confidence") == 3, "error").when(F.col("confidence") == 1, "notice").otherwise("warning")
    said = F.concat_ws(" ", "description", "match")
    place = {"file": _escaped(F.col("file"), True), "line": F.col("line").cast("string"), "col": F.col("column").cast("string"), "title": _escaped(F.col("rule_id"), True)}
    line = F.concat(F.lit("::"), kind, F.lit(" "), F.concat_ws(",", *(F.concat(F.lit(f"{k}="), v) for k, v in place.items())), F.lit("::"), _escaped(said, False))
    return masked(df, unmask).select(line.alias("value"))


def sarif_results(df: DataFrame) -> DataFrame:
    """SARIF results by row: region, ordinal of the finding within its rule and file, and the hash of these."""
    w = Window.partitionBy("rule_id", "file").orderBy("line", "column", "end", "match")
    out = df.withColumn("ordinal", F.row_number().over(w) - 1)
    zero = F.unhex(F.lit("00"))
    ident = F.concat(F.encode("rule_id", "utf-8"), zero, F.encode("file", "utf-8"), zero, F.encode(F.col("ordinal").cast("string"), "utf-8"))
    return out.withColumn("end_column", F.col("column") + F.length("match")).withColumn("line_hash", F.substring(F.sha2(ident, 256), 1, 16))


def sarif(df: DataFrame, unmask: bool = False) -> DataFrame:
    """One SARIF 2.1.0 document, in one row: for reports. Findings of any size are rows of :func:`sarif_results`."""
    r = masked(sarif_results(df), unmask)
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    severity = F.when(F.col("confidence") == 3, "error").when(F.col("confidence") == 1, "note").otherwise("warning")
    result = F.struct(F.col("rule_id").alias("ruleId"), severity.alias("level"), F.struct(F.concat_ws(": ", "description", "match").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("line_hash").alias("primaryLocationLineHash")).alias("partialFingerprints"))
    rules = F.array_sort(F.collect_set(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"))))
    run = r.select(result.alias("r"), "rule_id", "description", "file", "line", "column").agg(F.array_sort(F.collect_list(F.struct("file", "line", "column", "r"))).alias("x"), rules.alias("rules"))
    driver = F.struct(F.struct(F.lit("shirabe").alias("name"), F.col("rules")).alias("driver")).alias("tool")
    return run.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver, F.transform("x", lambda v: v["r"]).alias("results"))).alias("runs"))).alias("value"))


#: Entity types and the rules that give them; other rules give their own name.
ENTITIES = {
    rule: kind
    for kind, rules in (("PERSON", "person-name person-name-romaji person-name-structured person-name-high-recall"), ("LOCATION", "jp-address jp-address-high-recall"), ("EMAIL_ADDRESS", "email-address email-address-confusable email-address-eai"), ("PHONE_NUMBER", "jp-phone-number"), ("DATE_TIME", "jp-birthdate"))
    for rule in rules.split()
}


def entities(df: DataFrame) -> DataFrame:
    """Spans for entity recognizers: entity type, start, end and a probability for each confidence."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ENTITIES.items() for x in p]), F.col("rule_id")), F.upper(F.replace("rule_id", F.lit("-"), F.lit("_"))))
    chance = F.when(F.col("confidence") == 3, 0.85).when(F.col("confidence") == 2, 0.6).otherwise(0.4)
    return df.select(*[c for c in ("doc_id", "file") if c in df.columns], kind.alias("entity_type"), F.col("offset").alias("start"), F.col("end_offset").alias("end"), chance.alias("score"))


def summary(df: DataFrame) -> DataFrame:
    """Counts of findings by confidence, in one row."""
    n = lambda k: F.sum(F.when(F.col("confidence") == k, 1).otherwise(0))
    return df.agg(F.count("*").alias("findings"), *(F.coalesce(n(k), F.lit(0)).alias(v) for k, v in LEVEL.items()))
