"""Hard negatives by an exact distributed search for the largest inner products, over a Voronoi partition.

Candidates get one more component, sqrt(M - |y|^2) with M the largest squared length, and anchors a zero: the largest inner product is
then the smallest distance. Pivots cut the space into cells; the anchors of a cell are a group. What an anchor finds in a bounded sample
bounds how far its answers can lie, and with its distances to all pivots that gives each group an interval of distances to each pivot. A
candidate whose distance to any pivot lies outside of a group's interval cannot serve it and is not sent there. Groups and their
candidates are dealt in blocks and compared exactly; the best of each block are ranked once more. Two such joins follow each other:
positives, which have the anchor's label, then negatives, whose scores must lie in a window below the positive's.

Python: pivots, distances and products of blocks over Arrow batches; dealing, joining and ranking are DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored
from .embedding_dedup import _by_size, _kmeans, _matrix

#: Rows that pivots are fitted on and first bounds are taken from, first by hash; at most so many pivots for vectors of one length.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_PIVOTS = 8_192, 32 << 20, 64
#: Anchors and candidates of the blocks that are compared at once.
ANCHORS, BLOCK = 512, 4096
POSITIVES, NEGATIVES = 5, 10
#: Scores of negatives in hundredths of the positive's: from, to.
WINDOW = (30, 90)


def _integers(column: pa.Array) -> np.ndarray:
    return _matrix(column)


class Space:
    """Pivots, bounds and the sample of vectors of one length; M: the largest squared length."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray, m: float, n: int):
        self.m, self.x, self.rows, self.labels = m, x, rows, labels
        k = int(np.clip(round(np.sqrt(n) / 4), 1, min(MOST_PIVOTS, max(len(x), 1))))
        full = self.lifted(x) if len(x) else np.zeros((1, x.shape[1] + 1))
        self.pivots = _kmeans(full, k)
        #: Per phase: intervals[g, j] of the distances to pivot j that can serve group g.
        self.bounds: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.m - (x * x).sum(1), 0))])

    def distances(self, full: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum((full * full).sum(1)[:, None] - 2 * full @ p.T + (p * p).sum(1)[None], 0))

    def groups(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distances to the pivots) of anchors."""
        d = self.distances(np.column_stack([x, np.zeros(len(x))]))
        return d.argmin(1), d

    def reach(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Distance within which every candidate of at least that score lies, with some room for rounding."""
        square = np.maximum((x * x).sum(1) + self.m - 2 * least, 0)
        return np.sqrt(square) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(self.m))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _inside(score: np.ndarray, positive: float) -> np.ndarray:
    return (WINDOW[0] * positive <= 100 * score) & (100 * score <= WINDOW[1] * positive)


def _least_positive(space: Space, x, row, label, _) -> np.ndarray:
    """A score that the last positive of each anchor has at least: that of the sample; no bound without enough of its label there."""
    out = np.full(len(x), -np.inf)
    s = x @ space.x.T
    for i in range(len(x)):
        of = s[i][(space.labels == label[i]) & (space.rows != row[i])]
        if len(of) >= POSITIVES:
            out[i] = np.partition(of, len(of) - POSITIVES)[len(of) - POSITIVES]
    return out


def _least_negative(space: Space, x, row, label, positives) -> np.ndarray:
    """A score that every negative of each anchor has at least; infinite where none can be."""
    out = np.full(len(x), np.inf)
    s = x @ space.x.T
    for i in range(len(x)):
        other = s[i][space.labels != label[i]]
        for p in positives[i]:
            if p >= 0:
                of = other[_inside(other, p)]
                least = np.partition(of, len(of) - NEGATIVES)[len(of) - NEGATIVES] if len(of) >= NEGATIVES else WINDOW[0] * p / 100
                out[i] = min(out[i], least)
    return out


def _anchor_bounds(spaces: dict[int, Space], least):
    """Of each task: (size, cell, pivot, low, high), and each anchor with its cell."""

    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch, 3):
                space, x = spaces[size], _integers(part.column(3))
                cell, d = space.groups(x)
                row, label = (np.asarray(part.column(c)) for c in (0, 2))
                positives = part.column(4).to_pylist() if part.num_columns > 4 else None
                score = least(space, x, row, label, positives)
                far = np.where(np.isfinite(score), space.reach(x, np.where(np.isfinite(score), score, 0)), np.where(score > 0, -np.inf, np.inf))
                some = far > -np.inf  # others have no answers to look for
                for c in np.unique(cell[some]):
                    of = some & (cell == c)
                    low, high = (d[of] - far[of][:, None]).min(0), (d[of] + far[of][:, None]).max(0)
                    n = len(low)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], names=["size", "cell", "pivot", "low", "high"])

    return run


def _served(spaces: dict[int, Space], phase: str):
    """Candidates (row, id, label, vector) with the groups that they might serve."""

    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch, 3):
                space, x = spaces[size], _integers(part.column(3))
                d = space.distances(space.lifted(x))
                low, high = space.bounds[phase]
                serves = np.ones((len(x), len(low)), bool)
                for j in range(d.shape[1]):
                    serves &= (low[None, :, j] <= d[:, j, None]) & (d[:, j, None] <= high[None, :, j])
                ends = np.append(0, np.cumsum(serves.sum(1))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(serves)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), size, np.int32)), lists], names=["row", "id", "label", "vector", "size", "cells"])

    return run


def _homes(spaces: dict[int, Space]):
    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch, 3):
                cell, _ = spaces[size].groups(_integers(part.column(3)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(cell), size, np.int32)), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "size", "cell"])

    return run


def _sides(anchors: pa.Table, candidates: pa.Table):
    out = []
    for t in (anchors, candidates):
        t = t.combine_chunks()
        out.append({n: np.asarray(t.column(n)) for n in ("row", "id", "label")} | {"x": _integers(t.column("vector").chunk(0))})
    return out


FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _table(found: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], FOUND)


def _positives(_, anchors, candidates):
    """The best of a block of candidates for each anchor of a block."""
    if not anchors.num_rows or not candidates.num_rows:
        return _table([])
    a, c = _sides(anchors, candidates)
    scores, found = a["x"] @ c["x"].T, []
    for i in range(len(scores)):
        may = np.flatnonzero((c["label"] == a["label"][i]) & (c["row"] != a["row"][i]))
        top = may[_best(scores[i][may], c["id"][may], POSITIVES)]
        found.append((np.full(len(top), a["row"][i]), np.full(len(top), -1), c["row"][top], c["id"][top], scores[i][top]))
    return _table(found)


def _negatives(_, anchors, candidates):
    """The best of a block of candidates within the window of each positive of each anchor of a block."""
    if not anchors.num_rows or not candidates.num_rows:
        return _table([])
    a, c = _sides(anchors, candidates)
    scores, found = a["x"] @ c["x"].T, []
    wanted = anchors.column("positives").to_pylist()
    for i in range(len(scores)):
        other = np.flatnonzero(c["label"] != a["label"][i])
        s = scores[i][other]
        for p in wanted[i]:
            may = np.flatnonzero(_inside(s, p["score"]))
            top = other[may[_best(s[may], c["id"][other[may]], NEGATIVES)]]
            found.append((np.full(len(top), a["row"][i]), np.full(len(top), p["row"]), c["row"][top], c["id"][top], scores[i][top]))
    return _table(found)


def _joined(anchors: DataFrame, candidates: DataFrame, by: list[str], compare, k: int) -> DataFrame:
    """The k best of `compare` for each (anchor, positive): groups of anchors against the candidates that serve them, in blocks."""
    from pyspark.sql.pandas.types import from_arrow_schema

    served = candidates.select(*[c for c in candidates.columns if c != "cells"], F.explode("cells").alias("cell"))
    many = served.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    asks = anchors.groupBy(*by).agg(F.ceil(F.count("*") / ANCHORS).alias("asks"))
    blocks = stored(many.join(asks, by), "blocks")
    one = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), F.col("row")), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    fresh = lambda df, *names: [F.col(n).alias(n) for n in (*names, *[c for c in df.columns if c not in names])]
    asked = anchors.join(blocks, by).withColumns({"ask": one(1, "asks")}).withColumn("part", each("parts")).drop("asks", "parts")
    given = served.join(blocks, by).withColumns({"part": one(2, "parts")}).withColumn("ask", each("asks")).drop("asks", "parts")
    key = [*by, "part", "ask"]
    asked, given = asked.select(*fresh(asked, *key)), given.select(*fresh(given, *key))
    found = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(compare, from_arrow_schema(FOUND))
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id", "row")
    return stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")


def _bounded(spaces: dict[int, Space], anchors: DataFrame, least, phase: str) -> None:
    """Intervals of each group, from bounds of its anchors; at most MOST_PIVOTS squared of them for each length of vectors."""
    spark = anchors.sparkSession
    known = spark.sparkContext.broadcast(spaces)

    def run(batches):
        yield from _anchor_bounds(known.value, least)(batches)

    found = anchors.mapInArrow(run, "size int, cell int, pivot int, low double, high double")
    for s in spaces.values():
        shape = (len(s.pivots), len(s.pivots))
        s.bounds[phase] = np.full(shape, np.inf), np.full(shape, -np.inf)
    for x in found.groupBy("size", "cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low, high = spaces[x.size].bounds[phase]
        low[x.cell, x.pivot], high[x.cell, x.pivot] = x.low, x.high
    known.unpersist()


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) as op11's contract has it, as a stored table.

    vectors has vec_id, embedding and label. Rows with a null id, label or vector, or with a null or non-finite component take no part;
    vectors are compared with those of as many components. A row is told from others by its place, so rows that repeat an id are rows of
    their own, as anchors too; ties of score and id fall either way. Scores are exact below 2^53. Other columns are left out, an empty
    table gives an empty one. Vectors may have at most 64 lengths that differ.
    """
    with scratch(vectors.sparkSession):
        return stored(_hard_negatives(vectors), "hard-negatives", result=True)


def _hard_negatives(vectors: DataFrame) -> DataFrame:
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole.alias("vector")), "integers")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).limit(65).collect()
    if len(sizes) > 64:
        raise ValueError("vectors of more than 64 different lengths")
    spaces = {}
    for s in sizes:
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // len(sizes) // (8 * (s.size + 1))))
        t = rows.where(F.size("vector") == s.size).orderBy(F.xxhash64("row"), "row").limit(most).toArrow().combine_chunks()
        spaces[s.size] = Space(_integers(t.column("vector").chunk(0)), np.asarray(t.column("row")), np.asarray(t.column("label")), s.m, s.n)
    anchors = rows.where("id % 100 = 0")

    def through(df, make, *more):
        known = spark.sparkContext.broadcast(spaces)

        def run(batches):
            yield from make(known.value, *more)(batches)

        return df.mapInArrow(run, schema)

    base = "row long, id long, label long, vector array<double>"
    _bounded(spaces, anchors, _least_positive, "positives")
    schema = f"{base}, size int, cell int"
    homes = stored(through(anchors, _homes), "anchors")
    schema = f"{base}, size int, cells array<int>"
    serving = stored(through(rows, _served, "positives"), "serving")
    positives = _joined(homes, serving, ["size", "label", "cell"], _positives, POSITIVES)
    wanted = positives.groupBy("anchor").agg(F.collect_list(F.struct("row", "id", "score")).alias("positives")).withColumnRenamed("anchor", "row")
    homes = stored(homes.join(wanted, "row"), "anchors")
    _bounded(spaces, homes.select("row", "id", "label", "vector", F.transform("positives", lambda x: x["score"]).alias("scores")), _least_negative, "negatives")
    serving = stored(through(rows, _served, "negatives"), "serving")
    found = _joined(homes, serving, ["size", "cell"], _negatives, NEGATIVES)
    pairs = homes.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p"))
    pairs = pairs.select("anchor", "anchor_id", F.col("p.row").alias("positive"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.join(pairs, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(vectors: DataFrame) -> DataFrame:
    return hard_negatives(vectors)
