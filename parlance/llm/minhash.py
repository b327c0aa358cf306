"""Near-duplicate documents by min-max hashing: both ends of every permutation go into the signature.

A band is the minimum and maximum of four permutations, eight values for four hash evaluations. Documents with one set are a
class; classes that share a band are compared on their full sets: first each with the centre of its bucket, then, in
buckets that still hold several components, those members that differ from the centre in the same shingles.

Python hashes words and reduces permutations over Arrow batches; grouping, linking and verifying are DataFrame work.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit as bk
from .common import scratch, stored, unused
from .components import components

WORDS, PERCENT = 3, 85
#: Permutations per band, each giving two values, and the chance to miss a pair at the threshold, from which bands are counted.
PER_BAND, MISS = 4, 1e-6
_CHUNK = 1 << 19
_SIGNED = "doc_id long, n long, key_a long, key_b long, bands array<long>"


def _sets(column: pa.Array, words: int):
    """Sorted distinct shingle hashes of each text, in order; texts without words give empty arrays."""
    held = []
    for _, _, data, offsets, last in bk.pieces(column, _CHUNK):
        small = bk.lower(data)
        start, end, row = bk.words(small, offsets)
        h = bk.range_hash(bk.prefix(small), start, end)
        if not last:  # a long text is hashed piece by piece
            held.append(h)
            continue
        if held:
            h, held = np.concatenate([*held, h]), []
            row = np.zeros(len(h), np.int64)
        at = np.searchsorted(row, np.arange(len(offsets)))
        m = max(0, len(h) - words + 1)
        mixed = np.zeros(m, np.uint64)
        for k in range(words):
            mixed = bk.mixed(mixed + h[k : k + m] + np.uint64(k + 1))
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= words:
                v = np.sort(mixed[a : b - words + 1])
                yield v[np.append(True, v[1:] != v[:-1])]
            elif b > a:
                one = np.zeros(1, np.uint64)
                for k in range(a, b):
                    one = bk.mixed(one + h[k] + np.uint64(0x51ED2701 + b - a))
                yield one
            else:
                yield np.zeros(0, np.uint64)


def bands_for(percent: int) -> int:
    """Bands that leave a pair of this similarity unseen with probability MISS: 44 at 85, 76 at 80."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** (2 * PER_BAND)))


@functools.cache
def _keys(bands: int) -> np.ndarray:
    return bk.mixed(np.arange(1, 2 * bands * PER_BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _band_hashes(values: np.ndarray, start: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands): hashes of the minima and maxima of each band's permutations."""
    out, keys = np.empty((bands, len(start)), np.uint64), _keys(bands)
    for b in range(bands):
        acc = np.full(len(start), b + 1, np.uint64)
        for j in range(PER_BAND):
            k = 2 * (b * PER_BAND + j)
            v = (values ^ keys[k]) * (keys[k + 1] | np.uint64(1))
            v ^= v >> np.uint64(29)
            for f in (np.minimum, np.maximum):
                acc = bk.mixed(acc * np.uint64(0x9E3779B97F4A7C15) + f.reduceat(v, start))
        out[b] = acc
    return out.T


def _set_keys(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the items of each set, which name it together with its size."""
    return np.add.reduceat(bk.mixed(values), start), np.add.reduceat(bk.mixed(values ^ np.uint64(0xD6E8FEB86659FD93)), start)


def _sign(words: int, n_bands: int):
    def run(batches):
        for batch in batches:
            ids, sets, done = batch.column(0), [], 0
            size = 0

            def flush(sets, first):
                n = np.array([len(s) for s in sets])
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                bands = np.zeros((len(sets), n_bands), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    values = np.concatenate([sets[i] for i in full])
                    start = np.append(0, np.cumsum(n[full])[:-1])
                    a[full], b[full] = _set_keys(values, start)
                    bands[full] = _band_hashes(values, start, n_bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n_bands), pa.array(bands.ravel().view(np.int64)))
                return pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=["doc_id", "n", "key_a", "key_b", "bands"])

            for s in _sets(batch.column(1), words):
                sets.append(s)
                size += len(s)
                if size > 100_000:
                    yield flush(sets, done)
                    done, sets, size = done + len(sets), [], 0
            if sets:
                yield flush(sets, done)

    return run


def _cut_sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [s for s in _sets(batch.column(0), words) if len(s)]
            ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)])
            keys = _set_keys(values, ends[:-1]) if sets else (values, values)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends).astype(np.int64)), *(pa.array(k.view(np.int64)) for k in keys), lists], names=["n", "key_a", "key_b", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
    met = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", met.alias("met"), (F.size("x") + F.size("y") - met).alias("all")).where(F.lit(100) * F.col("met") >= F.lit(percent) * F.col("all")).select("a", "b")


def _pair(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _alike_off_centre(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the similarity, for rest (centre, key, n, at, apart).

    `apart` marks members outside their centre's component. Let D be the shingles in which a member differs from the centre.
    Two sets differ in |Dx| + |Dy| - 2 |Dx and Dy| shingles, so a linked pair shares at least
    o = (|Dx| + |Dy| - (100 - p) / (100 + p) (|x| + |y|)) / 2 of them, and one in the first |D| - o + 1 of either, rarest first.
    As x is not linked with the centre, o is above p / (100 + p) |Dy| for any y: copies that differ from the centre each in
    its own way never meet, however many they are.
    """
    whole = rest.join(sets.select("key", F.col("items").alias("x")), "key").join(sets.select(F.col("key").alias("centre"), F.col("items").alias("y")), "centre")
    apart = whole.select("centre", "key", "n", "at", "apart", F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))
    items = stored(apart.select("centre", "key", "n", "at", "apart", F.size("d").alias("nd"), F.explode("d").alias("item")), "differences")
    held = items.groupBy("centre", "item").agg(F.count("*").alias("held"), F.max("apart").alias("asked"))
    first = Window.partitionBy("centre", "key").orderBy("held", "item")
    placed = items.join(held, ["centre", "item"]).withColumn("left", F.col("nd") + 1 - F.row_number().over(first)).where("held > 1 AND asked")
    placed = stored(placed.where(F.col("apart") | (F.col("left") * (100 + percent) > F.col("nd") * percent)), "prefixes")
    x, y = placed.where("apart").alias("p"), placed.alias("q")
    shared = (100 + percent) * (F.col("p.nd") + F.col("q.nd")) - (100 - percent) * (F.col("p.n") + F.col("q.n"))
    met = (F.col("p.centre") == F.col("q.centre")) & (F.col("p.item") == F.col("q.item")) & (F.col("p.at") != F.col("q.at"))
    near = (2 * (100 + percent) * F.least("p.left", "q.left") >= shared) & (F.lit(100) * F.least("p.n", "q.n") >= F.lit(percent) * F.greatest("p.n", "q.n"))
    return _pair(x.join(y, met & near), "p.key", "q.key").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text), as a stored table.

    Rows of one id are one document whose links add up. A null id is linked with nothing: component_id is null and kept true.
    Null, empty and blank texts have no shingles and no links; texts under `words` words are one shingle. An empty table
    gives an empty one; further columns of docs are left out.
    """
    with scratch(docs.sparkSession):
        return stored(_near_duplicates(docs, words, percent), "near-duplicates", result=True)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    signed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign(words, bands_for(percent)), _SIGNED), "signed")
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    name = ["n", "key_a", "key_b"]
    classes = named.groupBy(*name).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("key", F.monotonically_increasing_id()), "classes")  # numbers hold once they are written
    buckets = classes.select("key", "id", "n", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    inside = stored(buckets.join(sizes, "bucket"), "inside")
    # the centre of a bucket is the member that meets most others: in a family of copies, the text they were made from
    met = inside.groupBy("key").agg(F.sum("size").alias("met"))
    centre = inside.join(met, "key").groupBy("bucket").agg(F.max(F.struct(F.col("met"), (-F.col("id")).alias("first"), F.col("key"), F.col("n"))).alias("top"))
    members = stored(inside.join(centre, "bucket").drop("size"), "members")
    fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    star = members.where((F.col("key") != F.col("top.key")) & fits(F.col("n"), F.col("top.n")))
    pairs = stored(_pair(star, "key", "top.key").distinct(), "pairs")
    ids = stored(members.select("id").distinct(), "ids")
    asked = docs.join(ids, docs["doc_id"].cast("long") == ids["id"], "left_semi").select("text")
    cut = asked.mapInArrow(_cut_sets(words), "n long, key_a long, key_b long, items array<long>").dropDuplicates(name)
    sets = stored(cut.join(classes.select(*name, "key"), name).select("key", "items"), "sets")
    whose = classes.select("key", "id")
    copies = named.select("doc_id", *name).join(classes.select(*name, "id"), name).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))

    def documents(linked):
        a = linked.join(whose, F.col("a") == F.col("key")).select(F.col("id").alias("a"), "b")
        return a.join(whose, F.col("b") == F.col("key")).select("a", F.col("id").alias("b"))

    links = stored(documents(_verified(pairs, sets, percent)).union(copies), "links")
    found = stored(components(links), "components")
    at = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "key", "n", F.col("top.key").alias("centre"), F.coalesce("component", "id").alias("at"))
    at = stored(at, "placed")
    parts = at.groupBy("bucket").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max(F.when(F.col("key") == F.col("centre"), F.col("at"))).alias("home")).where("low <> high")
    rest = at.join(parts, "bucket").where("key <> centre").select("centre", "key", "n", "at", (F.col("at") != F.col("home")).alias("apart")).distinct()
    more = stored(_alike_off_centre(rest, sets, percent).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    if not more.isEmpty():
        extra = stored(documents(_verified(more, sets, percent)), "more-links")
        if not extra.isEmpty():
            found = stored(components(links.union(extra)), "components")
    out = signed.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; all columns stay, rows that repeat an id too.

    Texts are dealt by id to meet their decision, at any size of either side: what leaves may be as many as what stays.
    """
    (gone,) = unused(docs, "gone")
    drop = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct().hint("merge")
    return docs.join(drop, docs["doc_id"].cast("long") == F.col(gone), "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
