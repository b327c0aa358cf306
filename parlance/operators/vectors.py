"""Preference directions: weighted sums of unit vectors, their cosines, wins and drift. Sums run per dimension, not per vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cosine, dot, unit


def direction(vectors: DataFrame, by: list[str], weight: Column, vector: str = "embedding", out: str = "direction") -> DataFrame:
    """by, n, direction: unit vector of the weighted sum."""
    rows = vectors.withColumn("_w", weight).where("_w IS NOT NULL")
    dims = rows.select(*by, "_w", F.posexplode(vector).alias("dim", "v")).groupBy(*by, "dim").agg(F.sum(F.col("_w") * F.col("v").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    g = dims.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("z"))
    return g.select(*by, "n", unit(F.transform("z", lambda x: x["s"])).alias(out))


def cosines(directions: DataFrame, key: str) -> DataFrame:
    """a < b, cosine of every two directions; there is one per setting."""
    a = directions.select(F.col(key).alias("a"), F.col("direction").alias("x"))
    b = directions.select(F.col(key).alias("b"), F.col("direction").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", cosine("x", "y").alias("cosine"))


def projections(vectors: DataFrame, directions: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """vectors with the length of their projection on their own group's direction."""
    return vectors.join(directions.select(*by, "direction"), by).withColumn("projection", dot(vector, "direction")).drop("direction")


def drift(directions: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, order, cosine to the direction before."""
    before = F.lag("direction").over(Window.partitionBy(*by).orderBy(order))
    return directions.withColumn("_p", before).where("_p IS NOT NULL").select(*by, order, cosine("direction", "_p").alias("cosine"))


def on_each(vectors: DataFrame, directions: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors without the vector, times directions: the projection on each. There is a direction per setting, so their list is short."""
    return vectors.crossJoin(F.broadcast(directions)).withColumn("projection", dot(vector, "direction")).drop("direction", vector)
