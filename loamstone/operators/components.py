"""Connected components of an edge list, without collecting links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.session import materialise


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of an edge the smallest node it is connected to.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every node links its larger
    neighbours, then its smaller ones, to the least of its neighbourhood, until nothing changes; that
    takes about log(n) rounds and no round has more edges than the one before. Neighbourhoods are only
    reduced to their minimum (partial aggregation), never collected, so a hub does no harm. Each round
    is a written table: a lost executor costs one round. Nulls and self-links make no edge.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    links = materialise(links)
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        links = materialise(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
