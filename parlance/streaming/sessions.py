"""Append-only session logs as a stream: each run takes the files that have come since the last one, and work goes on where it stopped.

Runs are Structured Streaming with a checkpoint. State is keyed: the ids of records, so that a record written twice counts once, and the
totals of each unit. What a run changes is written under the number of its batch, so a batch that is repeated after a failure replaces
itself. Reading takes the last state of each unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A record: which unit of work, in which phase and iteration, how long it took, and whether the unit is finished with it.
RECORD = "record_id string, unit string, iteration int, phase string, seconds double, finished boolean"
UNIT = ["unit", "iteration"]


def session_totals(records: DataFrame) -> DataFrame:
    """unit, iteration, n_records, seconds, finished of a stream or table of records; repeated record ids count once, null ones each."""
    named = records.where("record_id IS NOT NULL").dropDuplicates(["record_id"])
    every = named.unionByName(records.where("record_id IS NULL"))
    return every.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.max(F.coalesce("finished", F.lit(False))).alias("finished"))


def run_once(spark: SparkSession, folder: str, checkpoint: str, out: str, files: int = 1000) -> None:
    """Fold what has come since the last run, `files` files a batch at most, and stop; lines that do not parse give records without a unit, which are left out."""
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files).json(folder)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    totals = session_totals(stream.where("unit IS NOT NULL"))
    query = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """unit, iteration, n_records, seconds, finished: the last state of every unit."""
    rows = spark.read.schema("unit string, iteration int, n_records long, seconds double, finished boolean, batch long").parquet(out)
    newest = Window.partitionBy(*UNIT).orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "batch")


def unfinished(plan: DataFrame, totals: DataFrame) -> DataFrame:
    """Planned units (unit, iteration and what else the plan has) that are not finished yet."""
    return plan.join(totals.where("finished").select(*UNIT), UNIT, "left_anti")
