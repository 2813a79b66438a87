"""Test cases and suites of a comparison run, as rows: suite, name, classname, properties, failure, system_out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passerelle.functions.text import component_role, detail_line, to_fixed2
from passerelle.operators.compare import is_failing, worst_tag

#: fixed values: the suites of a run
SUITES = ("Visual Regression (without header/footer)", "Visual Regression — Headers", "Visual Regression — Footers", "Redirect URL Mismatches", "Blocked Media URLs")
BODY, HEADER, FOOTER, REDIRECTS, MEDIA = SUITES
IMAGES = ("prod_img", "stage_img", "diff_img")


def _properties(**values: Column | str) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(v) if isinstance(v, str) else v).alias("value")) for k, v in values.items()])


def _failure(when: Column, message: Column, text: Column) -> Column:
    return F.when(when, F.struct(message.alias("message"), text.alias("text")))


def _images(comps: DataFrame) -> Column:
    """The images that a component has, as attachment lines."""
    have = [F.col(c) for c in IMAGES if c in comps.columns]
    names = F.array_compact(F.array(*have)) if have else F.array().cast("array<string>")
    return F.transform(names, lambda x: F.concat(F.lit("[[ATTACHMENT|"), x, F.lit("]]")))


def body_cases(components: DataFrame) -> DataFrame:
    """A failing case for each page with a difference outside headers and footers; it lists all body components in order."""
    role = component_role("component")
    body = components.where(~role["header"] & ~role["footer"])
    line = detail_line("component", "mismatch", "tag")
    rows = body.withColumns({"_line": line, "_fails": is_failing(), "_images": _images(body)})
    cases = rows.groupBy("url").agg(worst_tag().alias("classname"), F.bool_or("_fails").alias("_any"), F.sort_array(F.collect_list(F.struct("ord", "_line", "_images"))).alias("_rows")).where("_any")
    text = F.concat(F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n"), F.lit("\n\n"), F.array_join(F.flatten(F.transform("_rows", lambda r: r["_images"])), "\n"))
    message = F.concat(F.lit("Visual mismatch (excluding header/footer) for "), F.col("url"))
    return cases.select(
        F.lit(BODY).alias("suite"),
        F.col("url").alias("name"),
        "classname",
        _properties(mismatchTag=F.col("classname"), mismatchPercentage="N/A").alias("properties"),
        _failure(F.lit(True), message, F.lit("Body components have differences. See details below.")).alias("failure"),
        text.alias("system_out"),
    )


def role_cases(components: DataFrame, role: str) -> DataFrame:
    """A case for each header or footer component, failing or not. page_tag, if there is one, stands in for a missing tag."""
    if role not in ("header", "footer"):
        raise ValueError(f"unknown role {role}")
    own = components.where(component_role("component")[role])
    page_tag = F.col("page_tag") if "page_tag" in own.columns else F.lit(None).cast("string")
    pct = to_fixed2("mismatch")
    of = F.concat(F.col("component"), F.lit(" for "), F.col("url"))
    return own.select(
        F.lit(HEADER if role == "header" else FOOTER).alias("suite"),
        F.concat(F.col("url"), F.lit(" :: "), F.col("component")).alias("name"),
        F.coalesce("tag", page_tag, F.lit("unclassified")).alias("classname"),
        _properties(url=F.col("url"), component=F.col("component"), mismatchPercentage=pct).alias("properties"),
        _failure(is_failing(), F.concat(F.lit("Visual mismatch in "), of), F.concat(F.lit("Component mismatch: "), pct, F.lit("%."))).alias("failure"),
        F.concat(detail_line("component", "mismatch", "tag"), F.lit("\n\n"), F.array_join(_images(own), "\n")).alias("system_out"),
    )


def redirect_cases(mismatched: DataFrame) -> DataFrame:
    """A failing case for each page whose redirects part: url, prod_final, stage_final."""
    p, m = F.coalesce("prod_final", F.lit("")), F.coalesce("stage_final", F.lit(""))
    return mismatched.select(
        F.lit(REDIRECTS).alias("suite"),
        F.col("url").alias("name"),
        F.lit("redirect-url-mismatch").alias("classname"),
        _properties(url=F.col("url"), prodFinalUrl=p, migratedFinalUrl=m, mismatchPercentage="100").alias("properties"),
        _failure(F.lit(True), F.concat(F.lit("Redirect targets differ for "), F.col("url")), F.concat(F.lit("PROD → "), p, F.lit("\nMIGRATED → "), m)).alias("failure"),
        F.concat(F.lit("URL: "), F.col("url"), F.lit("\n\n")).alias("system_out"),
    )


def media_cases(media: DataFrame) -> DataFrame:
    """A case for each page of media_set_diff(), failing if its sets differ."""
    pct = to_fixed2("mismatch")
    name = "__blocked_media_urls__"  # a fixed value
    return media.where("url is not null").select(
        F.lit(MEDIA).alias("suite"),
        F.concat(F.col("url"), F.lit(f" :: {name}")).alias("name"),
        F.col("tag").alias("classname"),
        _properties(url=F.col("url"), component=name, mismatchPercentage=pct).alias("properties"),
        _failure(is_failing(), F.concat(F.lit("Blocked media filenames mismatch for "), F.col("url")), F.concat(F.lit("Mismatch: "), pct, F.lit("%"))).alias("failure"),
        F.concat(F.lit(f"• {name}: "), pct, F.lit("% ["), F.col("tag"), F.lit("]\n\n"), F.col("log")).alias("system_out"),
    )


def suite_totals(cases: DataFrame) -> DataFrame:
    """suite, tests, failures of all five suites, empty ones too."""
    suites = cases.sparkSession.createDataFrame([(s,) for s in SUITES], "suite string")
    counts = cases.groupBy("suite").agg(F.count("*").alias("tests"), F.count_if(F.col("failure").isNotNull()).alias("failures"))
    return suites.join(counts, "suite", "left").na.fill(0)
