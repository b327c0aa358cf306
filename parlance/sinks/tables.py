"""Results as files. Markdown and LaTeX are for short result tables: their lines are made by Spark and written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What an empty result leaves behind instead of nothing.
EMPTY = "(no rows)"


def _cells(df: DataFrame, digits: int) -> list:
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        c = F.round(c, digits) if f.dataType.typeName() in ("double", "float") else c
        out.append(F.coalesce(c.cast("string"), F.lit("—")))
    return out


def lines(df: DataFrame, form: str, digits: int = 3, order: list[str] | None = None) -> DataFrame:
    """The lines of a Markdown or LaTeX table, in order; an empty result has one line that says so."""
    left, between, right = ("| ", " | ", " |") if form == "md" else ("", " & ", r" \\")
    head = left + between.join(df.columns) + right
    body = df.select(F.concat(F.lit(left), F.concat_ws(between, *_cells(df, digits)), F.lit(right)).alias("line"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order or [])))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*(f"o{i}" for i in range(len(order or []))), "line")) + 1
    spark = df.sparkSession
    top = [(0, head)] + ([(1, "|" + "---|" * len(df.columns))] if form == "md" else [])
    rows = body.select(place.alias("at"), "line")
    if df.isEmpty():
        top = [(0, EMPTY)]
    return spark.createDataFrame(top, "at int, line string").unionByName(rows).orderBy("at").select("line")


def save_table(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv", "parquet", "md"), digits: int = 3, order: list[str] | None = None, caption: str = "") -> None:
    """Write df under path/<format>; text formats as one file, with a caption file beside them."""
    spark = df.sparkSession
    for form in formats:
        if form == "parquet":
            df.write.mode("overwrite").parquet(f"{path}/parquet")
        elif form == "csv":
            df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
        else:
            lines(df, form, digits, order).coalesce(1).write.mode("overwrite").text(f"{path}/{form}")
    if caption:
        spark.createDataFrame([(caption,)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/caption")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A pipe table back to columns: numbers where every cell of a column is one or missing, else text."""
    rows = spark.read.text(path).where(F.col("value").startswith("|")).select(F.transform(F.split(F.trim("value"), r"\|"), lambda x: F.trim(x)).alias("c"), F.monotonically_increasing_id().alias("i"))
    rows = rows.where(~F.forall(F.slice("c", 2, F.size("c") - 2), lambda x: x.rlike("^:?-+:?$")))
    head = rows.orderBy("i").first()
    if head is None:
        return spark.createDataFrame([], "line string")
    names = head["c"][1:-1]
    cell = lambda k: F.nullif(F.col("c")[k + 1], F.lit("—"))
    body = rows.where(F.col("i") > head["i"]).select(*(cell(k).alias(n) for k, n in enumerate(names)))
    typed = body.agg(*(F.bool_and(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast("double").isNotNull()).alias(n) for n in names)).first()
    return body.select(*(F.col(f"`{n}`").try_cast("double").alias(n) if typed[n] else F.col(f"`{n}`") for n in names))


def save_conversations(turns: DataFrame, path: str, key: str = "conv_id") -> None:
    """role and text of every conversation as CSV, a folder per conversation."""
    turns.repartition(key).sortWithinPartitions(key, "turn").select(key, "role", "text").write.mode("overwrite").partitionBy(key).option("header", True).option("escape", '"').csv(path)


def save_records(records: DataFrame, path: str) -> None:
    """Nested records as JSON lines; Spark's marker tells a whole write from a broken one."""
    records.write.mode("overwrite").json(path)


def save_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def log_session(spark: SparkSession, path: str, iteration: int, **seconds: float) -> None:
    """Add a session's phase seconds to a log of JSON lines."""
    spark.createDataFrame([(iteration, k, float(v)) for k, v in seconds.items()], "iteration int, phase string, seconds double").coalesce(1).write.mode("append").json(path)


def cumulative_seconds(spark: SparkSession, path: str) -> DataFrame:
    """iteration, phase, seconds over all sessions."""
    return spark.read.schema("iteration int, phase string, seconds double").json(path).groupBy("iteration", "phase").agg(F.sum("seconds").alias("seconds"))


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """name, form, n_files, bytes of what save_table() left under a folder."""
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/(csv|parquet|md|tex|caption)/part-[^/]*$", i)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return f.select(part(1).alias("name"), part(2).alias("form"), "length").where("name <> ''").groupBy("name", "form").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def orphan_captions(spark: SparkSession, root: str) -> DataFrame:
    """Names with a caption and nothing else."""
    a = artifacts(spark, root)
    return a.where("form = 'caption'").select("name").join(a.where("form <> 'caption'").select("name").distinct(), "name", "left_anti")
