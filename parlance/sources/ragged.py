"""CSV files whose headers differ: each is read as text once, with its own header, and columns are aligned by name.

Files are small, one a conversation. A row that has more or fewer fields than its header, or a value that is not of the wanted type, is
kept apart with the reason. Fields may be quoted and hold commas and doubled quotes, but no line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import not_nan

_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)'
#: Cells that stand for a missing value.
MISSING = ("", "nan", "NaN", "null", "NULL", "None")


def _cells(line: Column) -> Column:
    """Fields of a line, without their quotes."""
    plain = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(x))
    return F.transform(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), plain)


def read_ragged(spark: SparkSession, root: str, names: str = "*.csv") -> DataFrame:
    """path, line, fields (column name to text), bad: every row of the files under a folder; a file without rows gives none."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(root, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n").alias("lines"))
    rows = lines.select("path", _cells(F.col("lines")[0]).alias("head"), F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("at", "text")).where("trim(text) <> ''")
    rows = rows.withColumn("cells", _cells(F.col("text")))
    bad = F.when(F.size("cells") != F.size("head"), F.format_string("%d fields under %d names", F.size("cells"), F.size("head"))).when(F.size(F.array_distinct("head")) < F.size("head"), "a name stands twice")
    known = F.when(bad.isNull(), F.map_from_arrays("head", "cells"))
    return rows.select("path", (F.col("at") + 2).alias("line"), known.alias("fields"), bad.alias("bad"), "text")


def aligned(rows: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ("path", "line")) -> tuple[DataFrame, DataFrame]:
    """(rows with the wanted columns, rejected rows with the reason): a column a file lacks is null, as are cells that stand for nothing."""
    text = {n: F.when(~F.col("fields")[n].isin(*MISSING), F.col("fields")[n]) for n in columns}
    cast = {n: (text[n] if t == "string" else not_nan(text[n].try_cast(t)) if t in ("double", "float") else text[n].try_cast(t)) for n, t in columns.items()}
    wrong = F.concat_ws("; ", *(F.when(text[n].isNotNull() & text[n].try_cast(t).isNull(), F.concat(F.lit(f"{n} is not {t}: "), text[n])) for n, t in columns.items() if t != "string"))
    checked = rows.withColumn("why", F.coalesce("bad", F.nullif(wrong, F.lit(""))))
    good = checked.where("why IS NULL").select(*keep, *(c.alias(n) for n, c in cast.items()))
    return good, checked.where("why IS NOT NULL").select("path", "line", F.col("why").alias("bad"), "text")


def load_evaluations(spark: SparkSession, root: str, columns: dict[str, str], models: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(model, patient_id and the columns, rejected rows) of <root>/<model>/<patient>.csv; names that are no number give patient -1."""
    good, bad = aligned(read_ragged(spark, root), columns)
    named = good.withColumns({"model": F.regexp_extract("path", r"/([^/]+)/[^/]+\.csv$", 1), "patient_id": F.coalesce(F.expr("try_cast(regexp_extract(path, '/([^/]+)[.]csv$', 1) AS INT)"), F.lit(-1))})
    if models is not None:
        named = named.where(F.col("model").isin(models))
    return named.select("model", "patient_id", *columns), bad


def load_crossgen(spark: SparkSession, root: str, manifest: DataFrame, judge: str, rep: int = 0, oracle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(model, arm, iteration, conv_index, q1, q2, final, rejected rows) of judge=/rep=/metric=/oracle=/<model>/<i>.csv under a folder.

    The manifest has model, arm and iteration. Only conversations with both means are kept; final is the mean of the two.
    """
    raw = read_ragged(spark, root)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    raw = raw.where((part("judge") == judge) & (part("rep") == str(rep)) & part("metric").isin("Q1", "Q2") & (F.lit(True) if oracle is None else part("oracle") == oracle))
    good, bad = aligned(raw, {"Q1_Mean": "double", "Q2_Mean": "double"})
    index = F.expr("try_cast(regexp_extract(path, '/([0-9]+)[.]csv$', 1) AS INT)")
    mean = F.when(part("metric") == "Q1", F.col("Q1_Mean")).otherwise(F.col("Q2_Mean"))
    first = good.withColumns({"model": F.regexp_extract("path", r"/([^/]+)/[^/]+\.csv$", 1), "conv_index": index, "metric": part("metric"), "mean": mean}).where("conv_index IS NOT NULL")
    side = lambda m: F.min_by(F.when(F.col("metric") == m, F.col("mean")), F.when(F.col("metric") == m, F.col("line")))
    both = first.groupBy("model", "conv_index").agg(side("Q1").alias("q1"), side("Q2").alias("q2")).where("q1 IS NOT NULL AND q2 IS NOT NULL")
    out = both.join(manifest.select("model", "arm", "iteration"), "model")
    return out.select("model", "arm", "iteration", "conv_index", "q1", "q2", ((F.col("q1") + F.col("q2")) / 2).alias("final")), bad


def load_beside(spark: SparkSession, root: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(as load_crossgen, rejected rows) of scores_<i>.csv beside the conversations; the manifest also has folder, the last part of their path."""
    good, bad = aligned(read_ragged(spark, root, "scores_*.csv"), {"scores1_avg": "double", "scores2_avg": "double", "scores_avg": "double"})
    named = good.withColumns({"folder": F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), "conv_index": F.expr("try_cast(regexp_extract(path, '/scores_([0-9]+)[.]csv$', 1) AS INT)")}).where("conv_index IS NOT NULL")
    first = named.groupBy("folder", "conv_index").agg(F.min_by(F.struct("scores1_avg", "scores2_avg", "scores_avg"), "line").alias("x"))
    out = first.join(manifest.select("model", "arm", "iteration", "folder"), "folder")
    return out.select("model", "arm", "iteration", "conv_index", F.col("x.scores1_avg").alias("q1"), F.col("x.scores2_avg").alias("q2"), F.col("x.scores_avg").alias("final")), bad


def state_means(scores: DataFrame) -> DataFrame:
    """arm, iteration, n, q1, q2, final: means over the conversations of a state."""
    return scores.groupBy("arm", "iteration").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("q1", "q2", "final")))
