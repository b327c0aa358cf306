"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every six neighbouring five-word grams the smallest hash is kept, so any ten words that a document shares with a
benchmark item leave a common fingerprint. Fingerprint hits are then extended: the ten-word windows around each hit are cut
out of the document and compared, word by word, with the benchmark's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, ascii_lower, let, scratch, stored, unused

GRAM, WINDOW = 5, 10
#: PLAIN_WORD with A-Z added: counts the same words without lower-casing first.
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def winnowed(words: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array of (at, gram): grams that are smallest in one of the runs of window - gram + 1 grams; ties are all kept."""
    run = window - gram + 1
    upto = lambda n: F.sequence(F.lit(0), n)

    def pick(g):
        mins = F.transform(upto(F.size(g) - run), lambda j: F.least(*(F.get(g, j + d) for d in range(run))))
        top = lambda m, i: F.greatest(*(F.get(m, i - d) for d in range(run)))
        marked = let(mins, lambda m: F.transform(g, lambda x, i: F.struct(i.alias("at"), x.alias("gram"), (x == top(m, i)).alias("low"))))
        return F.transform(F.filter(marked, lambda x: x["low"]), lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram")))

    def grams(h):
        return let(F.transform(upto(F.size(h) - gram), lambda i: F.xxhash64(*(F.get(h, i + d) for d in range(gram)))), pick)

    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= window, grams(h)))
    return F.coalesce(some, F.array().cast("array<struct<at:int,gram:bigint>>"))


def _cut(words: Column, start: Column, length) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


_GRAMS = "array<struct<at:int,gram:bigint,len:int>>"


def _all_grams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("at"), F.xxhash64(_cut(words, i, n)).alias("gram"), F.lit(n).alias("len")))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items, their length, and the ids of the items that have them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    cut = words.select("item", size.alias("len"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: _cut(F.col("w"), i, size))).alias("words"))
    return cut.groupBy("words", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, n_hit, items) of the documents in which a window of an item occurs.

    text_key is xxhash64 of the text: rows that repeat a document share a row here, rows with the same id and another text
    have their own; null ids are matched as equal. Items of fewer words than a window are one window, their gram is the whole
    item and none is winnowed out. Items whose id is null count in n_hit but cannot be listed. Null or empty texts have no
    words, an empty benchmark gives no rows; further columns of either table are ignored.
    """
    with scratch(docs.sparkSession):
        return stored(_find_contamination(docs, benchmark, window, gram), "contaminated", result=True)


def _find_contamination(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    windows = stored(item_windows(benchmark, window), "item-windows")
    short = sorted(r["len"] for r in windows.where(F.col("len") < window).select("len").distinct().collect())  # below ten values
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), plain_words(F.col("text")).alias("w"))
    marks = benchmark.select(F.explode(winnowed(plain_words(F.col("text")), gram, window)).alias("m")).select(F.col("m.gram").alias("gram")).distinct()
    marks = stored(marks, "item-marks")
    found = keyed.select("doc_id", "text_key", F.explode(winnowed(F.col("w"), gram, window)).alias("m")).select("doc_id", "text_key", "m.at", "m.gram")
    hits = found.join(marks, "gram").select("doc_id", "text_key", "at", F.lit(window).alias("len"))
    if short:  # every gram of each of these lengths, in one pass over the texts
        tiny = stored(windows.where(F.col("len") < window).select("len", F.xxhash64("words").alias("gram")).distinct(), "short-items")
        every = F.concat(*(F.when(F.size("w") >= n, _all_grams(F.col("w"), n)).otherwise(F.array().cast(_GRAMS)) for n in short))
        cut = keyed.select("doc_id", "text_key", F.explode(every).alias("m")).select("doc_id", "text_key", "m.at", "m.gram", "m.len")
        hits = hits.union(cut.join(tiny, ["gram", "len"]).select("doc_id", "text_key", "at", "len"))
    at = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "len")).alias("at"))
    at = stored(at, "hits")
    same = [F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")), F.col("d.text_key") == F.col("h.text_key")]
    around = lambda h: F.when(h["len"] < window, F.array(h["at"])).otherwise(F.sequence(h["at"] - (window - gram), h["at"]))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda h: F.transform(around(h), lambda s: F.struct(s.alias("s"), h["len"].alias("len"))))))
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = narrow.alias("d").join(at.alias("h"), same).select("d.doc_id", "d.text_key", plain_words(F.col("d.text")).alias("w"), starts.alias("starts"))
    inside = F.filter("starts", lambda x: (x["s"] >= 0) & (x["s"] + x["len"] <= F.size("w")))
    cut = texts.select("doc_id", "text_key", F.explode(let(F.col("w"), lambda w: F.transform(inside, lambda x: F.struct(x["s"].alias("s"), x["len"].alias("len"), _cut(w, x["s"], x["len"]).alias("words"))))).alias("x"))
    cut = cut.select("doc_id", "text_key", "x.s", "x.len", "x.words")
    met = cut.join(windows, ["words", "len"]).select("doc_id", "text_key", "s", "len", "items")
    spans = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("s", "len"))).alias("spans"), F.collect_set("items").alias("items"))

    def cover(acc, x):
        end = F.greatest(acc["end"], x["s"] + x["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["s"])).alias("n"))

    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda a: a["n"].cast("long"))
    return spans.select("doc_id", "text_key", n_hit.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which a window of a benchmark item occurs; all columns and all other rows stay."""
    found = find_contamination(docs, benchmark)
    ident, key = unused(docs, "hit_id", "hit_key")
    hit = found.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col(ident)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: every row of docs with its counts."""
    found = find_contamination(docs, benchmark)
    every = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_ANY_CASE_WORD)).cast("long").alias("n_words"))
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key"))
    joined = every.alias("d").join(found.alias("h"), same, "left")
    items = F.coalesce(F.array_join("h.items", ","), F.lit(""))
    n_hit = F.coalesce("h.n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("h.items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
