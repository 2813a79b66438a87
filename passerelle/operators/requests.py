"""What a capture does with each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passerelle.functions.urls import extract_candidate_url, is_allowed_media, is_gif, is_video, let, media_filename


def request_decision(requests: DataFrame, url: str = "url") -> DataFrame:
    """requests with candidate and decision (continue or abort): gifs and videos go, unless allowed."""
    df = requests.withColumn("candidate", F.lower(extract_candidate_url(url)))
    media = is_gif("candidate") | is_video("candidate")
    return df.withColumn("decision", F.when(~is_allowed_media("candidate") & media, "abort").otherwise("continue"))


def blocked_names(blocked: DataFrame, asset_host: str) -> DataFrame:
    """side, url, names: the sorted distinct media names that were blocked."""
    name = let(media_filename("media_url", asset_host), lambda n: F.when(n != "", n))
    return blocked.groupBy("side", "url").agg(F.sort_array(F.collect_set(name)).alias("names"))


#: The bit of each side in `sides`.
SIDES = {"prod": 1, "migrated": 2}


def blocked_sides(blocked: DataFrame, asset_host: str) -> DataFrame:
    """url, name, sides: each media name of a page with the bits of the sides that blocked it.

    A row with a null name has the bits of sides that blocked only what has no name, or whose list was empty (a null media_url).
    """
    name = let(media_filename("media_url", asset_host), lambda n: F.when(n != "", n))
    bit = F.lit(0)
    for side, value in SIDES.items():
        bit = F.when(F.col("side") == side, value).otherwise(bit)
    return blocked.groupBy("url", name.alias("name")).agg(F.bit_or(bit).alias("sides"))
