"""Verdicts on content findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passerelle.functions.text import last_integer, severity_from_color
from passerelle.operators.health import resolve_attempts

MODES = {"errors": ("error",), "warnings": ("warning",), "all": ("error", "warning")}


def exclude_patterns(compositions: DataFrame) -> DataFrame:
    return compositions.where(~F.coalesce("pattern", F.lit(False)))


def in_mode(severity: Column, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"unsupported mode {mode}: one of {', '.join(MODES)}")
    return severity.isin(*MODES[mode])


def filter_by_mode(findings: DataFrame, mode: str) -> DataFrame:
    """The findings whose severity the mode reports."""
    return findings.where(in_mode(severity_from_color("color"), mode))


def validate_content(findings: DataFrame, mode: str = "all") -> DataFrame:
    """findings with severity, verdict (pass or fail) and message.

    Without a colour there is no indicator, so it passes; an unexpected colour fails in any mode; out of mode passes
    before anything is counted; in mode, no number or one above zero fails.
    """
    severity = severity_from_color("color")
    n = last_integer("html")
    fails = F.when(severity.isNull(), False).when(severity == "unexpected", True).when(~in_mode(severity, mode), False).when(n.isNull(), True).otherwise(n > 0)
    message = F.when(severity == "unexpected", F.concat(F.lit("Unexpected color "), F.col("color"))).when(n.isNull(), F.lit("no number found")).otherwise(F.concat(F.lit("There are "), n.cast("string"), F.lit(" errors on "), F.col("name")))
    return findings.withColumns({"severity": severity, "verdict": F.when(fails, "fail").otherwise("pass"), "message": F.when(fails, message)})


def final_verdict(log: DataFrame, retries: int = 2, key: str = "url") -> DataFrame:
    """The last attempt that was run of each case: failed ones run again, `retries` times at most."""
    return resolve_attempts(log, F.col("failed"), retries + 1, key)


def validation_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("kind", F.coalesce("severity", F.lit("none")).alias("severity"), "verdict").agg(F.count("*").alias("n"))
