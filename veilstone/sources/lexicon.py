"""Rule lists: one rule per line, with ``=`` (case-sensitive) and ``*`` (prefix, contains) notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of a rule file; line numbers start at 1."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "raw")).select((F.col("n") + 1).alias("line_no"), "raw")


def _parsed(lines: DataFrame) -> DataFrame:
    """Every rule line with its root and what its marks say. Order of the marks: trim, one ``=``, one
    leading ``*``, one trailing ``*``, trim."""
    rules = lines.withColumn("raw", F.trim("raw")).filter((F.col("raw") != "") & ~F.startswith("raw", F.lit("#")))
    body = F.when(F.startswith("raw", F.lit("=")), F.expr("substring(raw, 2)")).otherwise(F.col("raw"))
    rules = rules.withColumn("case_sensitive", F.startswith("raw", F.lit("="))).withColumn("__b", body)
    rules = rules.withColumn("__lead", F.startswith("__b", F.lit("*")))
    rules = rules.withColumn("__b", F.when(F.col("__lead"), F.expr("substring(__b, 2)")).otherwise(F.col("__b")))
    rules = rules.withColumn("__trail", F.endswith("__b", F.lit("*")))
    rules = rules.withColumn("__b", F.trim(F.when(F.col("__trail"), F.expr("substring(__b, 1, length(__b) - 1)")).otherwise(F.col("__b"))))
    return rules.withColumn("tokens", F.filter(F.split("__b", r"(?U)\s+"), lambda t: t != ""))


def _reason() -> Column:
    many = F.size("tokens") > 1
    return (
        F.when(F.col("__b") == "", F.lit("empty"))
        .when(many & (F.col("__lead") | F.col("__trail")), F.lit("phrase_star"))
        .when(F.col("__lead") & ~F.col("__trail"), F.lit("leading_star"))
    )


def lexicon_load(lines: DataFrame) -> DataFrame:
    """Usable rules of (line_no, raw): line_no, raw, tokens, match_type, case_sensitive. Phrases with
    stars are kept as exact phrases."""
    kind = (
        F.when(F.size("tokens") > 1, F.lit("exact"))
        .when(F.col("__lead") & F.col("__trail"), F.lit("contains"))
        .when(F.col("__trail"), F.lit("startswith"))
        .otherwise(F.lit("exact"))
    )
    kept = _parsed(lines).withColumn("__r", _reason()).filter(F.col("__r").isNull() | (F.col("__r") == "phrase_star"))
    return kept.select(F.col("line_no").cast("int").alias("line_no"), "raw", "tokens", kind.alias("match_type"), "case_sensitive")


def lexicon_rejects(lines: DataFrame) -> DataFrame:
    """Lines dropped or downgraded, with the reason."""
    return _parsed(lines).withColumn("reason", _reason()).filter("reason is not null").select(F.col("line_no").cast("int").alias("line_no"), "raw", "reason")


def lexicon_fallback(configured: DataFrame, default: DataFrame, present: Column) -> DataFrame:
    """The configured lines where their source is ``present`` (a flag per source: a present source
    without lines doesn't fall back), the default lines elsewhere. Both frames hold source, line_no, raw;
    ``default`` also holds the flag."""
    sources = default.select("source", present.alias("__present")).distinct()
    chosen = configured.join(sources.filter("__present"), "source", "left_semi").withColumn("origin", F.lit("configured"))
    rest = default.select(*configured.columns).join(sources.filter("__present"), "source", "left_anti").withColumn("origin", F.lit("default"))
    return chosen.unionByName(rest)
