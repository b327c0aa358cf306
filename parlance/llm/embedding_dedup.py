"""Near-duplicate embeddings through an inverted multi-index over the two halves of each vector.

Each half has its own codebook; the product of both is the grid of cells. A query visits cells by growing distance, by the
multi-sequence order: both halves' codes are sorted by distance, and the sums of the two sorted sequences are taken smallest first.
How many cells are visited follows from the target recall: on the sample the codebooks are fitted on, vectors are turned by the
link angle, the hardest link there is, and so many cells are taken that the target share of them is found. With recall=1 the walk
stops at an exact distance bound instead. What is visited is verified by its cosine. Cells are compared block by block.

Python: k-means on a bounded sample, walks and matrix products over Arrow batches; grouping and linking are DataFrame work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored
from .components import components

THRESHOLD = 0.98
#: Rows that codebooks are fitted on, first by hash; the index itself holds every row.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Vectors per cell and label that the number of codes aims at, and rows of a block that is compared at once.
PER_CELL, BLOCK = 48, 1024
MOST_CODES = 1024
#: Share of the hardest links that the visited cells must find on the sample; links closer than the threshold are found more often.
RECALL = 0.99
_OUT = "kind int, a long, b long"


@dataclass
class Codebook:
    """codes[h]: the codes of half h."""

    codes: tuple[np.ndarray, np.ndarray]
    visits: int = 1

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """(rows, at most n) cells in multi-sequence order: the n smallest sums of two sorted sequences of distances.

        The pair of the i-th and the j-th code can be among the first n only if (i + 1) (j + 1) <= n, so no other sum is formed.
        """
        half = x.shape[1] // 2
        order, ranked = [], []
        for c, part in zip(self.codes, (x[:, :half], x[:, half:]), strict=True):
            d = (c * c).sum(1)[None] - 2 * part @ c.T
            order.append(np.argsort(d, 1, kind="stable"))
            ranked.append(np.take_along_axis(d, order[-1], 1))
        i, j = np.divmod(np.arange(len(self.codes[0]) * min(n, len(self.codes[1]))), min(n, len(self.codes[1])))
        near = (i + 1) * (j + 1) <= n
        i, j = i[near], j[near]
        first = np.argsort(ranked[0][:, i] + ranked[1][:, j], 1, kind="stable")[:, :n]
        cells = order[0][:, i].astype(np.int64) * len(self.codes[1]) + order[1][:, j]
        return np.take_along_axis(cells, first, 1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return self.nearest(0, x[:, :half]).astype(np.int64) * len(self.codes[1]) + self.nearest(1, x[:, half:])

    def visits_for(self, x: np.ndarray, threshold: float, recall: float) -> int:
        """Cells to visit so that vectors turned by the link angle are found with this share; all of them if need be."""
        rng = np.random.default_rng(11)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-12)
        home = self.cell(threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * away)
        every, n = len(self.codes[0]) * len(self.codes[1]), 1
        while n < every:
            if (self.nearest_cells(x, n) == home[:, None]).any(1).mean() >= recall:
                return n
            n = n + max(1, n // 4)
        return every

    def bounds(self, half: int, x: np.ndarray) -> np.ndarray:
        """(rows, codes): a lower bound of the distance from x to any point whose nearest code is the column's."""
        c = self.codes[half]
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]
        apart = 2 * np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)[None], 0))
        np.fill_diagonal(apart, np.inf)
        apart[apart <= 0] = np.inf
        best = np.zeros_like(d)
        for j in range(len(c)):  # against each rival code: distance to the plane between them
            np.maximum(best, (d - d[:, j : j + 1]) / apart[:, j][None], out=best)
        return best

    def nearest(self, half: int, x: np.ndarray) -> np.ndarray:
        c = self.codes[half]
        return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return np.unique(c, axis=0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(vectors: pa.ChunkedArray, rows: int, groups: int, threshold: float, recall: float) -> dict[int, Codebook]:
    """A codebook per number of dimensions; codes grow with the square root of the rows per group."""
    out, size_of = {}, np.asarray(pc.list_value_length(vectors))
    for size in np.unique(size_of).tolist():
        if size < 2:
            continue
        x = _unit(_matrix(vectors.filter(pa.array(size_of == size)).combine_chunks()))
        k = int(np.clip(round(np.sqrt(rows / max(groups, 1) / PER_CELL)), 1, min(MOST_CODES, len(x))))
        book = Codebook((_kmeans(x[:, : size // 2], k), _kmeans(x[:, size // 2 :], k)))
        book.visits = 0 if recall >= 1 else book.visits_for(x[:2000], threshold, recall)
        out[size] = book
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of lists of one length."""
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, at: int):
    """Parts of a batch whose vectors have as many dimensions."""
    size = np.asarray(pc.list_value_length(batch.column(at)))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))


def _walk(book: Codebook | None, x: np.ndarray, radius: float):
    """(row, cell) pairs to visit and the home cell of each row: so many nearest cells, or all that the bound of the radius leaves."""
    if book is None:
        return np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if book.visits:
        cells = book.nearest_cells(x, book.visits)
        return np.repeat(np.arange(len(x)), cells.shape[1]), cells.ravel(), book.cell(x)
    half = x.shape[1] // 2
    parts = (x[:, :half], x[:, half:])
    codes = [len(c) for c in book.codes]
    home = book.nearest(0, parts[0]).astype(np.int64) * codes[1] + book.nearest(1, parts[1])
    bound = [book.bounds(h, parts[h]) ** 2 for h in (0, 1)]
    limit = (radius + 1e-6) ** 2
    order = [np.argsort(b, 1, kind="stable") for b in bound]
    ranked = [np.take_along_axis(b, o, 1) for b, o in zip(bound, order, strict=True)]
    rows, cells = [], []
    width = (ranked[1][:, :, None] + ranked[0][:, None, :1] <= limit).any(2).sum(1)
    for i in range(codes[0]):  # the staircase of the product grid: where one half is farther, fewer codes of the other remain
        near = ranked[0][:, i] <= limit
        if not near.any():
            break
        r = np.flatnonzero(near)
        width[r] = (ranked[1][r] + ranked[0][r, i : i + 1] <= limit).sum(1)
        n = width[r]
        owner = np.repeat(r, n)
        second = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows.append(owner)
        cells.append(order[0][owner, i].astype(np.int64) * codes[1] + order[1][owner, second])
    return np.concatenate(rows), np.concatenate(cells), home


def _place(books: dict[int, Codebook], radius: float):
    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch, 2):
                x = _unit(_matrix(part.column(2)))
                rows, cells, home = _walk(books.get(size), x, radius)
                book = books.get(size)
                ahead = cells >= home[rows] if book is None or not book.visits else np.ones(len(cells), bool)  # the exact walk is the same from both sides
                ends = np.append(0, np.cumsum(np.bincount(rows[ahead], minlength=len(x)))).astype(np.int32)
                order = np.argsort(rows[ahead], kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells[ahead][order]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), size, np.int32)), pa.array(home), lists], names=["label", "id", "vector", "weight", "size", "home", "visits"])

    return run


def _joined(linked: np.ndarray) -> np.ndarray:
    """Smallest column-side position that each row and column of a linkage matrix is joined to, as positions of rows then columns."""
    n, m = linked.shape
    row, col = np.arange(n), np.arange(n, n + m)
    if not linked.any():
        return np.append(row, col)
    while True:
        r = np.minimum(row, np.where(linked, col[None], n + m).min(1))
        c = np.minimum(col, np.where(linked, r[:, None], n + m).min(0))
        if (r == row).all() and (c == col).all():
            return np.append(r, c)
        row, col = r, c


def _compare(threshold: float):
    def run(key, index, asks):
        kind, a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        index, asks = index.combine_chunks(), asks.combine_chunks()
        at = {t: {n: np.asarray(x.column(n)) for n in ("id", "weight", "home")} for t, x in (("i", index), ("q", asks))}
        if index.num_rows and asks.num_rows:
            visited = [set(v) for v in index.column("visits").to_pylist()]
            mi, mq = (_unit(_matrix(x.column("vector").chunk(0))) for x in (index, asks))
            for first in range(0, len(mq), BLOCK):
                cut = slice(first, first + BLOCK)
                ids, weight, home = (at["q"][n][cut] for n in ("id", "weight", "home"))
                same = home[:, None] == at["i"]["home"][None]
                linked = (mq[cut] @ mi.T >= threshold) & (~same | (ids[:, None] < at["i"]["id"][None]))
                # a link between two cells counts from the one that comes first, or from the other one if only that one visits
                r, c = np.nonzero(linked & (home[:, None] > at["i"]["home"][None]))
                if len(r):
                    linked[r, c] = [home[i] not in visited[j] for i, j in zip(r.tolist(), c.tolist(), strict=True)]
                if not linked.any():
                    continue
                every, seen = np.append(ids, at["i"]["id"]), np.append(linked @ at["i"]["weight"], weight @ linked)
                top = _joined(linked)
                one, two = seen > 0, top != np.arange(len(top))
                kind += [np.zeros(one.sum(), np.int64), np.ones(two.sum(), np.int64)]
                a += [every[one], every[two]]
                b += [seen[one], every[top[two]]]
        kind, a, b = (np.concatenate(x) for x in (kind, a, b))
        return pa.table({"kind": pa.array(kind.astype(np.int32)), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding, label), as a stored table.

    `recall` is the share of links at the threshold that are to be found; 1 finds every link by an exact bound, at a cost that grows
    with the square of a label's size where vectors are spread evenly.

    Only vectors with equal, non-null labels and as many dimensions are compared. Null, empty and zero vectors and those with
    null or non-finite components link with nothing, as do rows without vec_id. Rows that repeat an id count as vectors of
    their own. Equal vectors of a label are one class that is compared once; they link with each other. Further columns are
    left out, an empty table gives an empty one.
    """
    with scratch(vectors.sparkSession):
        return stored(_near_duplicates(vectors, threshold, recall), "near-vectors", result=True)


def _near_duplicates(vectors: DataFrame, threshold: float, recall: float) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid = rows.where(good)
    classes = stored(valid.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).select("label", "id", "vector", "weight"), "classes")
    n, groups, widest = classes.agg(F.count(F.lit(1)), F.approx_count_distinct("label"), F.max(F.size("vector"))).first()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (widest or 1))))).select("vector").toArrow().column("vector")
    books = spark.sparkContext.broadcast(fit(sample, n, groups, threshold, recall))
    radius = np.sqrt(max(0.0, 2 - 2 * threshold))
    kind = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"label {kind['label']}, id long, vector {kind['vector']}, weight long, size int, home long, visits array<long>"

    def place(batches):
        yield from _place(books.value, radius)(batches)

    placed = stored(classes.mapInArrow(place, schema), "placed")
    asks = placed.select("label", "size", F.explode("visits").alias("cell"), "id", "weight", "home", "vector")
    cell = ["label", "size", "cell"]
    here = placed.groupBy("label", "size", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    many = placed.select("label", "size", F.explode("visits").alias("cell")).groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias("asks"))
    cells = stored(here.join(many, cell), "cells")
    part = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col(of))
    upto = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    index = placed.withColumn("cell", F.col("home")).join(cells, cell).select(*cell, part(1, "parts").alias("part"), upto("asks").alias("ask"), "id", "weight", "home", "visits", "vector")
    named = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  new columns, which cogroup can tell from those of the other side
    asked = asks.join(cells, cell).select(*named(*cell), upto("parts").alias("part"), part(2, "asks").alias("ask"), *named("id", "weight", "home", "vector"))
    key = [*cell, "part", "ask"]
    found = stored(index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_compare(threshold), _OUT), "compared")
    links = found.where("kind = 1").select("a", "b")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))
    joined = components(links).withColumnRenamed("node", "id")
    whole = classes.join(counts, "id", "left").join(joined, "id", "left").select("label", "vector", "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = valid.join(stored(whole, "linked"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    """near_duplicates() with its defaults: every row has a result, also those that link with nothing; an empty table gives an empty one."""
    return near_duplicates(vectors)
