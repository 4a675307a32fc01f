"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014).

Every round is two aggregations and joins over the links; a node with very many links is summed before the shuffle and
split by adaptive skew joins. The driver sees only a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Links that one task takes.
TASK_ROWS = 200_000


def _star(links: DataFrame, large: bool, parts: int) -> DataFrame:
    """links (u, v): each u's smallest neighbour m, itself included, becomes the hub of its other neighbours."""
    if large:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hubs = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(hubs, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(hubs.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct().coalesce(parts)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): of every linked node the smallest node it reaches. Links (a, b) may repeat; a loop is no link."""
    found, state = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()), None
    while True:
        now = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        parts = -(-now[0] // TASK_ROWS) or 1
        if state == now or not now[0]:
            # all links lead to a hub, the smallest node of its component
            return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state, found = now, found.coalesce(parts)
        found = stored(_star(_star(found, True, parts), False, parts))
