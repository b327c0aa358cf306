"""Removal of repeated byte strings by distributed prefix doubling over anchored suffixes.

A full suffix array holds every byte position; here the suffixes that start within one run of positions share an anchor: the
37-byte gram that is smallest by hash among the 64 of a 100-byte string. Equal strings have equal anchors at equal
distances, so Spark sorts anchors instead of bytes. First, segments of about sixteen anchors are compared as a whole, and those
that start earlier leave at once. Then each round regroups (rank, next bytes) pairs; the length that a rank stands for grows
37, 85, 97, 100 as the run of starts behind an anchor is cut in four. Ranks that are unique leave, runs that repeat an
earlier run as a whole are removed, the rest goes on until the threshold is reached. Ranks are names of pairs: only their
equality is asked for, and (rank, name) pairs are compared, 128 bits in all.

Python cuts anchors and the kept bytes; all regrouping is DataFrame work.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .common import new_folder, scratch, stored

LENGTH = 100
#: Size of the filter that keeps grams seen once from being shuffled a second time: 2**26 bits, whatever the corpus. A larger
#: corpus fills it up and lets more through, which costs time and changes nothing in the result.
SLOT_BITS = 26
#: An anchor in so many ends a segment; runs of starts are cut in so many each round.
SEGMENT, WAYS = 16, 4
_CHUNK = 1 << 18
_LAST_ID = (1 << 63) - 1
_GRAM = "gram long"
_ANCHOR = "rank long, name long, doc long, spot long, var long, repeat boolean"
_SEGMENT = "rank long, name long, doc long, spot long, var long, last long"
#: spot holds the anchor's place and its farthest and nearest start: at << 20 | hi << 10 | lo.
_AT, _HI, _LO = (lambda x: F.shiftright(x, 20)), (lambda x: F.shiftright(x, 10).bitwiseAND(F.lit(1023)).cast("int")), (lambda x: x.bitwiseAND(F.lit(1023)).cast("int"))


def spread_of(length: int) -> int:
    """Number of starts that share an anchor: the largest power of WAYS up to two thirds of the length."""
    spread = WAYS
    while spread * WAYS * 3 <= length * 2:
        spread *= WAYS
    return spread


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(sums, gram, row, at, first, last) of a run of texts: the starts first..last have the anchor at `at`."""
    spread = spread_of(length)
    gram = length - spread + 1
    n = len(data) - gram + 1
    if n < spread:
        return None
    sums = bk.prefix(data)
    h = bk.gram_hashes(data, gram)
    bits = np.uint64(n.bit_length())
    low = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < spread:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    inside = np.ones(len(low), bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    anchor[~inside] = -1
    turn = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.append(0, turn)
    last = np.append(turn, len(anchor)) - 1
    there = anchor[first] >= 0
    first, last = first[there], last[there]
    at = anchor[first]
    return sums, h[at], np.searchsorted(offsets, first, "right") - 1, at, first, last


def _cut(batches, length: int, each):
    """Runs each(data, offsets, anchors, top) over the texts of column 2; yields (rows, columns) as (doc, spot or start, var) joined."""
    for batch in batches:
        for top, end, data, offsets in bk.chunks(batch.column(2), _CHUNK):
            found = _anchors(data, offsets, length)
            if found is not None and len(found[1]):
                yield from each(batch, top, end, data, offsets, *found)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """Segments of consecutive anchors with two names of all their bytes, cut after every SEGMENT-th anchor on average."""

    def each(batch, top, end, data, offsets, sums, gram, row, at, first, last):
        ends = np.append((row[1:] != row[:-1]) | (gram[:-1] % np.uint64(SEGMENT) == 0), True)
        b = np.flatnonzero(ends)
        a = np.append(0, b[:-1] + 1)
        start, stop = first[a], last[b]
        other = bk.prefix(data, 1)
        row, base = row[a], offsets[row[a]]
        names = [bk.range_hash(s, start, stop + length, w).view(np.int64) for w, s in enumerate((sums, other))]
        doc, var = (np.asarray(batch.column(i))[top + row] for i in (0, 1))
        yield _batch(_SEGMENT, *names, doc, (start - base) << 20, var, stop - base)

    return docs.mapInArrow(lambda batches: _cut(batches, length, each), _SEGMENT)


def _anchor_rows(docs: DataFrame, length: int, seen: np.ndarray | None = None) -> DataFrame:
    """Anchors of (doc, var, text, skip) outside the skipped starts: their grams, or, with a filter, all columns of those it lets through.

    repeat marks anchors whose strings all start earlier in the same text; they are left out of the grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(seen) if seen is not None else None

    def each(batch, top, end, data, offsets, sums, gram, row, at, first, last):
        doc, var = (np.asarray(batch.column(i)) for i in (0, 1))
        skip = batch.column(3).slice(top, end - top)
        parts = skip.flatten()
        if len(parts):
            owner = np.repeat(np.arange(end - top), np.asarray(skip.value_lengths().fill_null(0)))
            v, a, b = (np.asarray(parts.field(n)) for n in ("var", "start", "last"))
            mine = v == var[top + owner]
            a, b = (a + offsets[owner])[mine], (b + offsets[owner])[mine]
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            i = np.searchsorted(a, first, "right") - 1
            stay = np.flatnonzero((i < 0) | (first > b[i])) if len(a) else np.arange(len(first))
            gram, row, at, first, last = (x[stay] for x in (gram, row, at, first, last))
        if not len(gram):
            return
        hi, lo = at - first, at - last
        name = bk.mixed(bk.range_hash(sums, first, last + length) + (hi * 4096 + lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        whole = bk.mixed(gram + name * np.uint64(0xC2B2AE3D27D4EB4F) + row.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        repeat = np.ones(len(at), bool)
        repeat[np.unique(whole, return_index=True)[1]] = False
        if shared is None:
            yield _batch(_GRAM, gram[~repeat].view(np.int64))
            return
        slot = (gram & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        keep = repeat | ((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
        spot = (at - offsets[row]) << 20 | hi << 10 | lo
        where = top + row[keep]
        yield _batch(_ANCHOR, gram[keep].view(np.int64), name[keep].view(np.int64), doc[where], spot[keep], var[where], repeat[keep])

    return docs.mapInArrow(lambda batches: _cut(batches, length, each), _GRAM if seen is None else _ANCHOR)


def _filter_of(grams: DataFrame) -> np.ndarray:
    """Bits of the grams' slots: at most 2**SLOT_BITS / 32768 rows of 4 kB reach the driver."""
    slot = F.col("gram").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) + 1
    rows = grams.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for r in rows.collect():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _spans(rows: DataFrame, length: int) -> DataFrame:
    at = _AT(F.col("spot"))
    return rows.select("doc", "var", (at - _HI(F.col("spot"))).alias("start"), (at - _LO(F.col("spot")) + length).alias("end"))


def _classes(rows: DataFrame, tag: str) -> DataFrame:
    """rank, name, size and first row (doc, spot, var) of each class; a class of any size is combined before the shuffle."""
    g = rows.groupBy("rank", "name").agg(F.min(F.struct("doc", "spot", "var")).alias("x"), F.count("*").alias("n"))
    return stored(g.select("rank", "name", "n", "x.*"), f"classes-{tag}")


def _later(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows that are not the first of their class; rows of equal place are all first."""
    many = classes.where("n > 1").select("rank", "name", F.col("doc").alias("_doc"), _AT(F.col("spot")).alias("_at"))
    met = rows.join(many, ["rank", "name"])
    return met.where((F.col("doc") > F.col("_doc")) | ((F.col("doc") == F.col("_doc")) & (_AT(F.col("spot")) > F.col("_at")))).drop("_doc", "_at")


def _open(classes: DataFrame) -> DataFrame:
    """First rows of the classes whose rank other classes have too."""
    shared = classes.groupBy("rank").agg(F.count("*").alias("k")).where("k > 1").select("rank")
    return classes.join(shared, "rank", "left_semi").drop("n")


def _cut_runs(rows: DataFrame, size: int, length: int) -> DataFrame:
    """The runs of `size` starts from `low` on, cut in WAYS: the rank grows by the bytes next to it on both sides."""
    step = size // WAYS
    hi0, lo0, low, high = _HI(F.col("spot")), _LO(F.col("spot")), F.col("low"), F.col("low") + (size - 1)
    parts = []
    for i in range(WAYS):
        a, b = low + i * step, low + (i * step + step - 1)
        lo, hi = F.greatest(lo0, a), F.least(hi0, b)
        cut = F.substring("bytes", hi0 - hi + 1, hi - lo + length)
        left, right = F.substring("bytes", hi0 - a + 1, F.lit(i * step)), F.substring("bytes", hi0 - high + length + 1, F.lit(size - (i + 1) * step))
        spot = F.shiftleft(_AT(F.col("spot")), 20) + F.shiftleft(hi.cast("long"), 10) + lo
        parts.append(F.when(lo <= hi, F.struct(F.xxhash64("rank", F.lit(i), left, right).alias("rank"), F.xxhash64(F.lit(step), lo, hi, cut).alias("name"), spot.alias("spot"), a.alias("low"), cut.alias("bytes"))))
    return rows.select("doc", "var", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.rank", "x.name", "doc", "x.spot", "var", "x.low", "x.bytes")


def repeated_spans(docs: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(docs as (doc, var, text) in a new table of that name, bucketed by doc; (doc, spans) of the bytes to remove)."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("doc"), "text")
    twice = not ids.groupBy("doc").count().where("count > 1").isEmpty()
    narrow = ids.select("doc", (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("var"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = max(8, min(2000, docs.rdd.getNumPartitions() // 2))
    narrow.write.option("compression", "zstd").bucketBy(buckets, "doc").saveAsTable(name)
    table = spark.table(name)
    by_doc = lambda rows, **lists: rows.repartition(buckets, "doc").groupBy("doc").agg(*(F.collect_list(c).alias(n) for n, c in lists.items()))  # noqa: E731  dealt as the table is

    segments = _segments(narrow, length)
    same = stored(_later(segments, _classes(segments, "segments")).select("doc", "var", F.shiftright("spot", 20).alias("start"), "last"), "same-segments")
    skip = by_doc(same, skip=F.struct("var", "start", "last"))
    texts = table.join(skip, "doc", "left").select("doc", "var", "text", "skip")
    grams = _anchor_rows(texts, length).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    cut = stored(_anchor_rows(texts, length, _filter_of(grams)), "anchors")
    found = [same.select("doc", "var", "start", (F.col("last") + length).alias("end")), _spans(cut.where("repeat"), length)]

    rows = cut.where("NOT repeat").drop("repeat")
    classes = _classes(rows, "anchors")
    found.append(_spans(_later(rows, classes), length))
    first = stored(_open(classes), "open")
    asked = by_doc(first, asked=F.struct("rank", "spot", "var"))
    whole = F.encode("text", "utf-8")
    take = F.transform("asked", lambda x: F.struct(x["rank"].alias("rank"), x["spot"].alias("spot"), x["var"].alias("whose"), F.substring(whole, (_AT(x["spot"]) - _HI(x["spot"])).cast("int") + 1, _HI(x["spot"]) - _LO(x["spot"]) + length).alias("bytes")))
    rows = table.join(asked, "doc").select("doc", "var", F.explode(take).alias("x")).where("x.whose = var")
    rows = rows.select("doc", "var", "x.rank", "x.spot", "x.bytes", F.lit(0).alias("low"))
    size = spread_of(length)
    while size > 1:
        rows = stored(rows, f"rows-{size}")
        runs = _cut_runs(rows, size, length)
        size //= WAYS
        classes = _classes(runs, str(size))
        found.append(_spans(_later(runs.drop("bytes", "low"), classes), length))
        if size > 1:
            first = stored(_open(classes), f"open-{size}")
            rows = runs.join(first, ["rank", "name", "doc", "spot", "var"]).drop("name")
    every = reduce(DataFrame.union, found)
    return table, by_doc(every, spans=F.struct("var", "start", "end"))


def _keep(batches):
    for batch in batches:
        text, var = batch.column(2).to_pylist(), np.asarray(batch.column(1))
        spans = batch.column(3)
        size, removed, count, digest, kept = [], [], [], [], []
        for i, t in enumerate(text):
            raw = t.encode()
            runs = spans[i].values if spans[i].is_valid else None
            start, end = (np.asarray(runs.field(k))[np.asarray(runs.field("var")) == var[i]] for k in ("start", "end")) if runs is not None else ((), ())
            if not len(start):
                cut, out, n = raw, 0, 0
            else:
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                begin = np.append(True, start[1:] > end[:-1])
                a, b = start[begin], end[np.append(np.flatnonzero(begin)[1:] - 1, len(end) - 1)]
                edges = np.stack([np.append(0, b), np.append(a, len(raw))], 1)
                cut, out, n = b"".join(raw[x:y] for x, y in edges.tolist()), int((b - a).sum()), len(a)
            size.append(len(raw))
            removed.append(out)
            count.append(n)
            digest.append(hashlib.sha256(cut).hexdigest())
            kept.append(cut.decode("utf-8", "ignore"))
        arrays = [batch.column(0), pa.array(size), pa.array(removed), pa.array(count), pa.array(digest), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _result(docs: DataFrame, length: int, columns: list[str]) -> DataFrame:
    spark = docs.sparkSession
    name = new_folder(spark, "texts").rsplit("/", 1)[1].replace("-", "_")
    try:
        with scratch(spark):
            table, spans = repeated_spans(docs, length, name)
            joined = table.join(spans, "doc", "left").select("doc", "var", "text", "spans")
            out = joined.mapInArrow(_keep, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
            return stored(out.select(F.nullif("doc", F.lit(_LAST_ID)).alias("doc_id"), *columns), "kept", result=True)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept_text): texts without bytes of strings of `length` that also start earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start; rows that repeat an id at the same start leave
    each other alone. Null ids come last. Null and empty texts stay empty; texts under `length` bytes are never touched.
    Characters cut in the middle are dropped from kept_text. An empty table gives an empty one; other columns are left out.
    """
    return _result(docs, length, ["n_removed", "n_spans", "kept_text"])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, for every row of docs."""
    return _result(docs, LENGTH, ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
