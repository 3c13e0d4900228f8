"""Connected components of a links table by alternating large and small stars, in Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: u, v (long). Returns id, root: the smallest id that each linked id reaches. Ids without a link to
    another are left out.

    Each round hangs every neighbourhood on its smallest member, first over larger and then over smaller
    neighbours; the links of a round number no more than those before it. Every round is a written table, so
    lineage doesn't grow and lost executors cost one round. Stops when a round changes nothing."""
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = written(links, "links")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        then, next_path = written(small.distinct(), "links")
        discard(now.sparkSession, path)
        now, path = then, next_path
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _mark(links: DataFrame) -> tuple[int, int]:
    """Count and an order-free digest."""
    r = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])
