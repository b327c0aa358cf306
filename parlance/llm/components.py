"""Connected components of a link table by repeated contraction, all in joins and partial aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (a, b); component is the smallest node reachable.

    Each round moves every node to the neighbour, or itself, that comes first: by value in the first round, which settles
    stars at once, then by a hash that changes with the round, which shortens chains by a constant factor. Links whose ends
    meet leave, until none is left. Null ends are ignored, self links and repeats do no harm; without links there are no rows.
    """
    e = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a < b").distinct()
    e = stored(e, "links")
    where = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("at"))
    for r in itertools.count():
        if e.isEmpty():
            break
        order = (lambda c: F.col(c)) if r == 0 else (lambda c, r=r: F.xxhash64(F.lit(r), F.col(c)))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(order("b").alias("key"), F.col("b").alias("b"))).alias("first"))
        own = F.struct(order("a").alias("key"), F.col("a").alias("b"))
        moved = stored(near.select(F.col("a").alias("from"), F.least(own, F.col("first"))["b"].alias("to")), "moved")
        where = stored(where.join(moved, F.col("at") == F.col("from"), "left").select("node", F.coalesce("to", "at").alias("at")), "where")
        left = e.join(moved, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        e = left.join(moved, F.col("b") == F.col("from")).select("a", F.col("to").alias("b")).where("a <> b")
        e = stored(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    least = where.groupBy("at").agg(F.min("node").alias("component"))
    return where.join(least, "at").select("node", "component")
