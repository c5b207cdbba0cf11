"""Connected components of a link table by alternating large-star and small-star steps.

The published map-reduce scheme (Kiveris et al., "Connected Components in MapReduce and
Beyond"): a large star hangs every larger neighbour of a node on the smallest node it sees, a
small star does the same for the smaller neighbours.  Both are an aggregate with map-side
combine and an equi-join, so a hub's neighbours are never gathered into one group, and no step
writes more rows than it reads.  Links stay on the executors; the driver sees one checksum a
round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.filter("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(hash(u, v))")).first()
    return tuple(r)


def connected_components(links: DataFrame) -> DataFrame:
    """Components of the undirected links ``(u, v)``: rows ``(node, root)`` with the smallest
    node of each component as ``root``.

    Nodes without a link to another node do not appear; self links and repeated links are
    ignored, null ends are dropped; no links give no rows.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = written(e.filter("u > v").distinct(), "links")
    mark = _mark(e)
    while mark[0]:
        e = written(_small_star(_large_star(e)), "stars")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
