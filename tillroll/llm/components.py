"""Connected components of a link table: alternating large-star and
small-star steps, each a group-by and a join on the link's end, written to
the shared folder. The number of rounds grows with the logarithm of the
longest chain. Hot ends are pre-aggregated and their joins split by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    """Count and sum of hashes of the links, and whether nearly as many links
    as upper ends are left, as of stars."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.approx_count_distinct("u").alias("ends")).first()
    return r["n"], r["h"], r["n"] <= 1.1 * r["ends"]


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one link, to an id that is no upper end:
    a further round would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))).alias("e"))
    ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.low").alias("low"))
    return ends.agg(F.count_if((F.col("up") + F.col("low")) > 1)).first()[0] == 0


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): for every id in a link, the smallest id it reaches."""
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    edges, mark = written(edges, "links"), None
    while (now := _mark(edges)) != mark and not (now[2] and _stars(edges)):
        mark = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # links that come out twice go with the next grouping
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")),
                                                                F.struct("u", F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        edges = written(small, "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
