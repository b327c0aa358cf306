"""A ledger of quotable numbers: key, value as JSON text, source and note; new entries replace old ones of the same key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, value string, source string, note string"


def json_scalar(value: Column, digits: int | None = None) -> Column:
    """A number as JSON text of at most six digits after the point: NaN and null are null, whole numbers have no point; optionally rounded."""
    v = F.when(F.isnan(value.cast("double")), None).otherwise(value.cast("double"))
    v = F.round(v, digits) if digits is not None else v
    return F.coalesce(F.regexp_replace(v.cast("decimal(28,6)").cast("string"), r"\.?0+$", ""), F.lit("null"))


def entries(df: DataFrame, keys: list[str], values: list[str], source: str, note: str = "", digits: int | None = 3) -> DataFrame:
    """An entry per row and value of a result: the key joins the row's keys and the value's name by dots."""
    name = F.concat_ws(".", *(F.col(k).cast("string") for k in keys))
    one = lambda v: F.struct(F.concat_ws(".", name, F.lit(v)).alias("key"), json_scalar(F.col(v), digits).alias("value"), F.lit(source).alias("source"), F.lit(note).alias("note"))
    return df.select(F.inline(F.array(*(one(v) for v in values))))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).json(path)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both; of one key the new one."""
    both = old.select(F.col("key"), F.struct("value", "source", "note").alias("o")).join(new.select(F.col("key"), F.struct("value", "source", "note").alias("n")), "key", "full_outer")
    return both.select("key", F.coalesce("n", "o").alias("x")).select("key", "x.value", "x.source", "x.note")


def save_numbers(path: str, *new: DataFrame, old: str | None = None) -> None:
    """Write the ledger at `path`: what is at `old`, replaced by key; old and new folders differ, so a failed write loses nothing."""
    spark = new[0].sparkSession
    every = reduce(DataFrame.unionByName, new)
    out = merged(read_ledger(spark, old), every) if old else every
    out.coalesce(1).sortWithinPartitions("key").write.mode("overwrite").option("ignoreNullFields", False).json(path)
