"""The score lake: one CSV per conversation under judge=/rep=/metric=/model=, its fold to one Parquet part per (judge, rep, metric).

Partition columns come from the paths by Spark's own discovery. A partition's signature is a digest of its files' names, sizes and
times; the fold keeps the signatures it was made from, and serves a partition only while they still agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import experiment_parts
from ..operators.training import BRANCH

KEYS = ["judge", "rep", "metric"]
#: Columns of a score file; further ones are left out, missing ones null.
SCORES = "mean double, total double, n_items int"
_FILE = r"/([0-9]+)\.csv$"
_PART = r"/judge=([^/]+)/rep=([^/]+)/metric=([^/]+)/"


def _name() -> Column:
    return F.col("_metadata.file_path")


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    """judge, rep, metric, model, file_index, mean, total, n_items: the first row of every file whose name is a number.

    Rows that do not parse are dropped, files without rows give none.
    """
    raw = spark.read.option("basePath", root).option("header", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", False).schema(SCORES + ", judge string, rep int, metric string, model string").csv(root)
    index = F.regexp_extract(_name(), _FILE, 1)
    rows = raw.withColumns({"file_index": index, "at": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()}).where("file_index <> ''")
    first = rows.groupBy("judge", "rep", "metric", "model", F.col("file_index").cast("int").alias("file_index")).agg(F.min_by(F.struct("mean", "total", "n_items"), F.struct("at", "line")).alias("x"))
    return first.select("judge", "rep", "metric", "model", "file_index", "x.*")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def _signature(name: Column) -> Column:
    """An aggregate over files that does not depend on their order: two sums of hashes of name, size and time, and the count."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), name, F.col("length"), F.unix_micros("modificationTime")).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws("|", part(1), part(2), F.count(F.lit(1)).cast("string")), 256)


def signatures(spark: SparkSession, root: str) -> DataFrame:
    """judge, rep, metric, n_files, bytes, signature of each partition."""
    part = lambda i: F.regexp_extract("path", _PART, i)
    f = _files(spark, root).where(F.col("path").rlike(_PART)).select(part(1).alias("judge"), part(2).cast("int").alias("rep"), part(3).alias("metric"), "path", "length", "modificationTime")
    return f.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), _signature(F.regexp_extract("path", _PART + "(.*)$", 4)).alias("signature"))


def fold(spark: SparkSession, root: str, out: str) -> None:
    """Write the lake as Parquet by (judge, rep, metric), then the manifest of signatures, last, so a half-made fold serves nothing."""
    seen = signatures(spark, root)
    rows = read_scores(spark, root)
    manifest = seen.collect()  # a row per partition, a few dozen
    rows.repartition(*KEYS).write.mode("overwrite").partitionBy(*KEYS).parquet(f"{out}/scores")
    spark.createDataFrame(manifest, seen.schema).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")


def _current(spark: SparkSession, root: str, out: str) -> DataFrame:
    """judge, rep, metric, is_current for each partition of the lake."""
    kept = spark.read.parquet(f"{out}/manifest").select(*KEYS, F.col("signature").alias("kept"))
    return signatures(spark, root).join(kept, KEYS, "left").select(*KEYS, F.coalesce(F.col("signature") == F.col("kept"), F.lit(False)).alias("is_current"))


def served(spark: SparkSession, root: str, out: str) -> DataFrame:
    """The lake's rows, from the fold where its signature still holds and from the files elsewhere."""
    state = _current(spark, root, out)
    names = ["judge", "rep", "metric", "model", "file_index", "mean", "total", "n_items"]
    folded = spark.read.schema(f"model string, file_index int, {SCORES}, judge string, rep int, metric string").parquet(f"{out}/scores")
    fresh = folded.join(state.where("is_current"), KEYS, "left_semi")
    stale = read_scores(spark, root).join(state.where("NOT is_current"), KEYS, "left_semi")
    return fresh.select(*names).unionByName(stale.select(*names))


def fold_status(spark: SparkSession, root: str, out: str) -> DataFrame:
    """n_current, n_stale partitions."""
    return _current(spark, root, out).agg(F.count_if("is_current").alias("n_current"), F.count_if(~F.col("is_current")).alias("n_stale"))


def verify_fold(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Rows that only one of lake and fold has; none if they agree."""
    names = ["judge", "rep", "metric", "model", "file_index", "mean", "total", "n_items"]
    lake = read_scores(spark, root).select(*names)
    kept = spark.read.schema(f"model string, file_index int, {SCORES}, judge string, rep int, metric string").parquet(f"{out}/scores").select(*names)
    return lake.exceptAll(kept).withColumn("side", F.lit("lake")).unionByName(kept.exceptAll(lake).withColumn("side", F.lit("fold")))


def fold_report(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Files and bytes of lake and fold, and how many times fewer."""
    total = lambda path, n: _files(spark, path).agg(F.count(F.lit(1)).alias(f"{n}_files"), F.sum("length").alias(f"{n}_bytes"))
    both = total(root, "lake").join(total(f"{out}/scores", "fold"))
    return both.withColumn("times_fewer", F.col("lake_files") / F.nullif("fold_files", F.lit(0)))


def judges(scores: DataFrame) -> DataFrame:
    """judge, reps: the graders of a lake and their repeats."""
    return scores.groupBy("judge").agg(F.sort_array(F.collect_set("rep")).alias("reps"))


def read_generations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(branch records, lines that do not parse) of JSON lines with nested candidates, read with an explicit schema."""
    rows = spark.read.schema(f"{BRANCH}, bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    parsed = spark.read.text(path).select("value", F.from_json("value", BRANCH, {"mode": "PERMISSIVE"}).alias("r"))
    return rows.where("bad IS NULL").drop("bad"), parsed.where("r IS NULL OR r.candidates IS NULL").select("value")


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    """iteration, conversation_id, chosen_score, rejected_score, margin of the pair files under iteration_<n>/."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "pairs.csv").schema("conversation_id int, chosen_score double, rejected_score double").csv(root)
    return raw.select(F.regexp_extract(_name(), r"iteration_(\d+)/", 1).cast("int").alias("iteration"), "*").withColumn("margin", F.col("chosen_score") - F.col("rejected_score"))


def discover_arms(spark: SparkSession, root: str) -> DataFrame:
    """experiment, iteration, n_files and the parts of the experiment's name, for each folder <experiment>/iteration_<n>/ with files.

    Names that do not fit have null parts; `steps` comes from run_metadata.json beside the iterations, null without one.
    """
    f = _files(spark, root)
    conv = f.withColumns({"experiment": F.regexp_extract("path", r"/([^/]+)/iteration_(\d+)/[^/]+\.csv$", 1), "iteration": F.regexp_extract("path", r"/([^/]+)/iteration_(\d+)/[^/]+\.csv$", 2)}).where("experiment <> ''")
    arms = conv.groupBy("experiment", F.col("iteration").cast("int").alias("iteration")).agg(F.count(F.lit(1)).alias("n_files"))
    meta = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "run_metadata.json").schema("steps long").json(root).select(F.regexp_extract(_name(), r"/([^/]+)/run_metadata\.json$", 1).alias("experiment"), "steps")
    return arms.join(meta, "experiment", "left").select("*", experiment_parts("experiment").alias("p")).select("experiment", "iteration", "n_files", "steps", "p.*")


def filter_arms(arms: DataFrame, **wanted: list | None) -> DataFrame:
    """arms whose columns have one of the wanted values; None leaves a column alone."""
    for name, values in wanted.items():
        if values is not None:
            arms = arms.where(F.col(name).isin(list(values)))
    return arms


def reset_cache(spark: SparkSession, store: str) -> int:
    """Delete every frame that cached() has kept in a store; how many there were. Frames held in memory leave, too."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = [x.getPath() for x in files.listStatus(where) if re.search(r"-[0-9a-f]{24}$", x.getPath().getName())] if files.exists(where) else []
    for path in kept:
        files.delete(path, True)
    spark.catalog.clearCache()
    return len(kept)


def judge_scores(scores: DataFrame, judge: str, rep: int | None = None) -> DataFrame:
    """The rows of one grader, of one repeat or, without one, the mean over its repeats of each conversation."""
    own = scores.where(F.col("judge") == judge)
    if rep is not None:
        return own.where(F.col("rep") == rep)
    return own.groupBy("judge", "metric", "model", "file_index").agg(F.avg("mean").alias("mean"), F.avg("total").alias("total"), F.count(F.lit(1)).alias("n_reps"))


def cached(spark: SparkSession, store: str, name: str, inputs: list[str], params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, kept as Parquet under a key of name, parameters and the signature of the input files.

    The signature is computed by Spark from names, sizes and times. A finished write is marked by Spark's own marker, so a broken one is
    made again.
    """
    sign = hashlib.sha256(repr((name, sorted(params.items()))).encode())
    for root in inputs:
        sign.update(_files(spark, root).agg(_signature(F.col("path"))).first()[0].encode())
    path = f"{store}/{name}-{sign.hexdigest()[:24]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
