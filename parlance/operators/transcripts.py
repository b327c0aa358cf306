"""Transcripts: turn metrics, prompts, budgets, markers, vocabulary and labelled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio


def turn_metrics(turns: DataFrame, role: str, mark: str, key: str = "conv_id") -> DataFrame:
    """key, n_turns, mean_chars, max_repeat, loop, marks_per_turn over the turns of one role; conversations without any give zeros.

    max_repeat counts equal trimmed turns; loop is max_repeat >= 2.
    """
    own = turns.where((F.col("role") == role) & F.col("text").isNotNull())
    marks = F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
    said = own.groupBy(key, F.trim("text").alias("said")).agg(F.count(F.lit(1)).alias("times"), F.sum(F.length("text")).alias("chars"), F.sum(marks).alias("marks"))
    g = said.groupBy(key).agg(F.sum("times").alias("n_turns"), F.sum("chars").alias("chars"), F.max("times").alias("max_repeat"), F.sum("marks").alias("marks"))
    every = turns.select(key).distinct().join(g, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(key, F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns"), zero(ratio("chars", "n_turns")).alias("mean_chars"), F.coalesce("max_repeat", F.lit(0)).cast("long").alias("max_repeat"), (F.coalesce("max_repeat", F.lit(0)) >= 2).alias("loop"), zero(ratio("marks", "n_turns")).alias("marks_per_turn"))


def transcript(turns: DataFrame, labels: dict[str, str], key: str = "conv_id") -> DataFrame:
    """key, transcript: labelled turns in order, a blank line between them; other roles and blank turns are skipped."""
    label = F.coalesce(*(F.when(F.col("role") == r, F.lit(f"[{x}] ")) for r, x in labels.items()))
    rows = turns.where(label.isNotNull() & (F.trim("text") != "")).select(key, F.struct("turn", F.concat(label, "text").alias("line")).alias("x"))
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select(key, F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("transcript"))


def prompts(turns: DataFrame, role: str, least: int, key: str = "conv_id") -> DataFrame:
    """key, turn, n_turns, n_chars: a sample for each turn of `role` from position `least` on, holding all turns up to it."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = turns.withColumns({"n_turns": F.count(F.lit(1)).over(w), "n_chars": F.sum(F.coalesce(F.length("text"), F.lit(0))).over(w)})
    return grown.where((F.col("role") == role) & (F.col("n_turns") >= least)).select(key, "turn", "n_turns", "n_chars")


def last_within(turns: DataFrame, budget: int, cost: Column, key: str = "conv_id") -> DataFrame:
    """The longest run of last turns whose costs stay within the budget."""
    w = Window.partitionBy(key).orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def vocabulary(texts: DataFrame, text: str, n: int, pattern: str = "[a-z]{3,}") -> DataFrame:
    """The n most frequent words, ties in order of spelling; n is the feature, counts cover all texts."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(n)


def alternation(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n, n_switches: turns whose role differs from the one before."""
    w = Window.partitionBy(key).orderBy("turn")
    rows = turns.withColumn("_p", F.lag("role").over(w))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_p") != F.col("role")).alias("n_switches"))


def messages_of(transcripts: DataFrame, text: str, labels: dict[str, str], key: str) -> DataFrame:
    """key, pos, role, content of a labelled transcript: a labelled segment opens a turn, unlabelled ones continue it."""
    parts = transcripts.select(key, F.posexplode(F.split(F.col(text), "\n\n")).alias("i", "part"))
    label = F.regexp_extract("part", r"^\[(" + "|".join(labels) + r")\]\s*", 1)
    opened = parts.withColumn("_label", label).withColumn("pos", F.sum((F.col("_label") != "").cast("int")).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    body = F.regexp_replace("part", r"^\[[A-Z]+\]\s*", "")
    said = F.when(F.col("_label") != "", body).otherwise(F.col("part"))
    g = opened.where("pos > 0").groupBy(key, "pos").agg(F.max("_label").alias("_l"), F.sort_array(F.collect_list(F.struct("i", said.alias("s")))).alias("x"))
    role = F.coalesce(*(F.when(F.col("_l") == k, F.lit(v)) for k, v in labels.items()))
    return g.select(key, "pos", role.alias("role"), F.array_join(F.transform("x", lambda x: x["s"]), "\n\n").alias("content"))


def message_lists(turns: DataFrame, system: str, key: str = "conv_id") -> DataFrame:
    """key, messages, mirrored: the turns as (role, content) after a system message, and the same from the other side.

    Other roles and null texts are left out.
    """
    rows = turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull()).select(key, F.struct("turn", "role", "text").alias("x"))
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    other = lambda r: F.when(r == "user", "assistant").otherwise("user")
    first = lambda: F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    as_is = F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    turned = F.transform("x", lambda t: F.struct(other(t["role"]).alias("role"), t["text"].alias("content")))
    return g.select(key, F.concat(first(), as_is).alias("messages"), F.concat(first(), turned).alias("mirrored"))


def with_parity_roles(turns: DataFrame, order: str = "turn", role: str = "role") -> DataFrame:
    """turns whose missing role follows from their place: the therapist speaks first."""
    return turns.withColumn(role, F.coalesce(role, F.when(F.col(order) % 2 == 0, "assistant").otherwise("user")))


def token_tail(text: Column | str, n: int, word: str = r"\S+") -> Column:
    """The last n tokens of a text, joined by single blanks; all of it if it has fewer."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(word), F.lit(0))
    return F.array_join(F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), n), " ")


def prefix_seeds(turns: DataFrame, n: int, role: str, key: str = "conv_id") -> DataFrame:
    """key, seed: the first n turns of conversations that are longer and whose n-th turn has this role."""
    rows = turns.select(key, F.struct("turn", "role", "text").alias("x"))
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.where((F.size("x") > n) & (F.get("x", F.lit(n - 1))["role"] == role)).select(key, F.slice("x", 1, n).alias("seed"))


def prefixes(turns: DataFrame, role: str, least: int, key: str = "conv_id") -> DataFrame:
    """key, turn, prefix: labelled text of all turns up to and with each turn of `role` from place `least` on."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.coalesce("text", F.lit("")))
    grown = turns.withColumns({"n": F.count(F.lit(1)).over(w), "prefix": F.array_join(F.collect_list(line).over(w), "\n\n")})
    return grown.where((F.col("role") == role) & (F.col("n") >= least)).select(key, "turn", "prefix")
