"""The same audit steps on streams of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passerelle.operators.health import check_pages


def stream_first_seen(stream: DataFrame, key: str = "url", ts: str | None = None, within: str | None = None) -> DataFrame:
    """Each key once, across restarts. State grows with the keys; `within` of the event time `ts` bounds it, and then a key may come again later."""
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def stream_link_health(stream: DataFrame) -> DataFrame:
    """Check results of arriving captures (url, html, status): stateless, the batch step itself."""
    return check_pages(stream)


def stream_progress(stream: DataFrame, total: int) -> DataFrame:
    """done, failed and the percentage of `total` to a decimal, in complete mode; needs ok."""
    done = F.count("*")
    return stream.agg(done.alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.round(100.0 * done / F.lit(max(total, 1)), 1).alias("percent"))
