"""The order in which a run meets its personas, and checks of that order against what was recorded."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ways in which a text states an age: "61 years old", "61-year-old", "am 61", "I'm 61", "61 years of age".
AGE = r"(\d{1,3})\s*(?:-|\s)?years?[\s-]*old|\bam\s+(\d{1,3})\b|\bI'?m\s+(\d{1,3})\b|\b(\d{1,3})\s+years\s+of\s+age"


@F.udtf(returnType="file_index: bigint, persona_id: int")
class ShuffledPersonas:
    """(file_index, persona_id) of one iteration: Python's generator, seeded, shuffles the numbers of the personas."""

    def eval(self, seed: int, n: int):
        order = list(range(n))
        random.Random(seed).shuffle(order)
        yield from enumerate(order)


def persona_order(spark: SparkSession, seed: int, iterations: int, n: int = 96, offset: int = 1) -> DataFrame:
    """(iteration, file_index, persona_id): iteration k is shuffled with seed + k + offset, each on an executor."""
    its = spark.range(iterations).select(F.col("id").cast("int").alias("iteration"), (F.col("id") + seed + offset).alias("seed"))
    return its.lateralJoin(ShuffledPersonas(F.col("seed").outer(), F.lit(n))).select("iteration", "file_index", "persona_id")


def misplaced(recorded: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of a record (iteration, file_index, persona_id) that the derived order does not have."""
    return recorded.join(order, ["iteration", "file_index", "persona_id"], "left_anti")


def stated_age(text: Column | str) -> Column:
    """The first age that a text states, null without one."""
    hit = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*(F.nullif(F.regexp_extract(hit, AGE, i), F.lit("")) for i in range(1, 5))).cast("int")


def seed_scores(opening: DataFrame, ages: DataFrame, seed: int, iterations: int, n: int = 96, offsets: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """offset, iteration, correct, wrong, unresolved: how far ages stated in opening texts are those of the personas that an offset predicts.

    opening: iteration, file_index, text; ages: persona_id, age. A text without an age, or a persona without one, is unresolved; places
    outside of the order do not count.
    """
    spark = opening.sparkSession
    said = opening.select("iteration", "file_index", stated_age("text").alias("said"))
    orders = None
    for o in offsets:
        one = persona_order(spark, seed, iterations, n, o).withColumn("offset", F.lit(o))
        orders = one if orders is None else orders.unionByName(one)
    met = said.join(orders, ["iteration", "file_index"]).join(ages, "persona_id", "left")
    same = F.col("said") == F.col("age")
    return met.groupBy("offset", "iteration").agg(F.count_if(same).alias("correct"), F.count_if(~same).alias("wrong"), F.count_if(same.isNull()).alias("unresolved"))


def verify_seeds(scores: DataFrame, offset: int = 1) -> DataFrame:
    """verdict, correct, wrong: confirmed if nothing under the offset is wrong, something is right and every other offset fails.

    Where another offset passes as well the test tells nothing: inconclusive.
    """
    g = scores.groupBy("offset").agg(F.sum("correct").alias("correct"), F.sum("wrong").alias("wrong"))
    own = F.col("offset") == offset
    s = g.agg(F.sum(F.when(own, F.col("correct"))).alias("correct"), F.sum(F.when(own, F.col("wrong"))).alias("wrong"), F.coalesce(F.min(F.when(~own, F.col("wrong") > 0)), F.lit(False)).alias("others_fail"))
    passed = (F.col("wrong") == 0) & (F.col("correct") > 0)
    verdict = F.when(passed & F.col("others_fail"), "confirmed").when(passed, "inconclusive").otherwise("rejected")
    return s.select(verdict.alias("verdict"), F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("wrong", F.lit(0)).alias("wrong"))
