"""Sinks: inventories, differences, JUnit suites and the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passerelle.sources.shared import written


def write_inventory(df: DataFrame, path: str, format: str = "json") -> None:
    """Sorted by url; the files' order is the rows' order."""
    df.orderBy("url").write.mode("overwrite").format(format).save(path)


def write_diff(df: DataFrame, path: str) -> None:
    """Always written, so that no older difference is left when there is none now."""
    df.write.mode("overwrite").json(path)


def write_junit(cases: DataFrame, path: str, per_file: int = 100_000) -> None:
    """XML of the suites: a folder for each, whose files are testsuite documents with the suite's name, tests and failures.

    cases: suite, name, classname, properties (array of name, value), failure (message, text; or null), system_out.
    Cases stay rows: a suite is dealt to files of about per_file cases, each under the totals of the whole suite.
    """
    prop = F.transform("properties", lambda p: F.struct(p["name"].alias("@name"), p["value"].alias("@value")))
    case = F.struct(
        F.col("name").alias("@name"),
        F.col("classname").alias("@classname"),
        F.struct(prop.alias("property")).alias("properties"),
        F.when(F.col("failure").isNotNull(), F.struct(F.col("failure.message").alias("@message"), F.col("failure.text").alias("#"))).alias("failure"),
        F.col("system_out").alias("system-out"),
    )
    xml = F.to_xml(case, {"rowTag": "testcase", "attributePrefix": "@", "valueTag": "#"})
    rows = written(cases.select("suite", xml.alias("value"), F.col("failure").isNotNull().alias("failed")), "cases")
    totals = rows.groupBy("suite").agg(F.count("*").alias("tests"), F.count_if("failed").alias("failures")).withColumn("files", F.ceil(F.col("tests") / per_file).cast("int"))
    attribute = F.col("suite")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        attribute = F.replace(attribute, F.lit(plain), F.lit(escaped))
    head = F.concat(F.lit('<testsuite name="'), attribute, F.lit('" tests="'), F.col("tests").cast("string"), F.lit('" failures="'), F.col("failures").cast("string"), F.lit('">'))
    # a file's rows are its head, its cases and its end, in this order
    numbered = totals.select("suite", head.alias("head"), F.explode(F.sequence(F.lit(0), F.col("files") - 1)).alias("file"))
    ends = numbered.select("suite", "file", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.col("head").alias("value")), F.struct(F.lit(2).alias("ord"), F.lit("</testsuite>").alias("value")))).alias("e")).select("suite", "file", "e.*")
    own = rows.join(F.broadcast(totals.select("suite", "files")), "suite").select("suite", F.pmod(F.xxhash64("value"), F.col("files")).cast("int").alias("file"), F.lit(1).alias("ord"), "value")
    out = own.unionByName(ends).repartition("suite", "file").sortWithinPartitions("suite", "file", "ord")
    out.select("suite", "file", "value").write.mode("overwrite").partitionBy("suite", "file").text(path)


def quality_gate(violations: DataFrame) -> DataFrame:
    """violations, passed: passed if there are none."""
    return violations.agg(F.count("*").alias("violations")).withColumn("passed", F.col("violations") == 0)
