"""Exact duplicates by a content sort: sampled splitters cut the normalised bytes into ranges, sorting makes equals adjacent.

First each task sorts what it has read and compares neighbours, so that a text leaves it once however many copies it holds. What is
left is dealt by range: Spark samples the splitters from the first bytes of the texts, and from a hash where those are shared by many,
so that splitters are short and a common opening does not fill a range. Each range is sorted on its whole contents, outside of memory
where need be, and whole neighbours are compared. Equal texts have equal splitter keys, so none of them lies in two ranges.

Python: neighbours are compared over Arrow batches; sorting, dealing and joining are DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Characters of the text that splitters hold.
OPENING = 48
#: Copies after which a task begins another run, so that the members of a group are dealt to several tasks.
MOST_RUN = 50_000


def normalised(text: Column) -> Column:
    """Each run of ASCII blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _starts(content: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(content), bool)
    if len(content) > 1:
        out[1:] = np.asarray(pc.not_equal(content.slice(1), content.slice(0, len(content) - 1)))
    if before is not None and len(content):
        out[0] = content[0].as_py() != before.as_py()
    return out


def _runs(batches):
    """Rows sorted by content, of each task: (id, content, ...) with the run they belong to; only the first of a run keeps its content.

    A first row waits until the size of its run is known. A run that has grown too long ends with its batch.
    """
    base = TaskContext.get().partitionId() << 40
    before, run, held, size = None, -1, None, 0

    def out(batch, runs, sizes):
        first = pa.array(np.arange(len(runs)), mask=sizes == 0)
        kept = [c.take(first) for c in batch.columns[1:]]
        return pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.array(base + runs), pa.array(sizes, mask=sizes == 0)], names=[*batch.schema.names, "run", "size"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _starts(batch.column(1), before)
        new[0] |= size >= MOST_RUN
        before = batch.column(1)[-1]
        start = np.flatnonzero(new)
        if not len(start):
            size += len(new)
            yield out(batch, np.full(len(new), run), np.zeros(len(new), np.int64))
            continue
        if held is not None:
            yield out(held, np.array([run]), np.array([size + start[0]]))
        sizes = np.zeros(len(new), np.int64)
        sizes[start[:-1]] = np.diff(start)
        runs, last = run + np.cumsum(new), int(start[-1])
        keep = np.delete(np.arange(len(new)), last)
        yield out(batch.take(pa.array(keep)), runs[keep], sizes[keep])
        run, held, size = int(runs[-1]), batch.slice(last, 1), len(new) - last
    if held is not None:
        yield out(held, np.array([run]), np.array([size]))


def _groups(batches):
    """Runs (run, id, size, text_sha256, content) sorted by content, then id: each with the smallest id and the size of its group."""
    before, group, kind = None, [], None

    def table(groups):
        rows = [(run, g[0][1], sum(x[2] for x in g), run == g[0][0], sha) for g in groups for run, _, _, sha in g]
        columns = zip(zip(*rows, strict=True), (pa.int64(), kind, pa.int64(), pa.bool_(), pa.string()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["run", "keep_id", "group_size", "wins", "text_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind, new, done = batch.column(1).type, _starts(batch.column(4), before), []
        before = batch.column(4)[-1]
        for starts, row in zip(new.tolist(), zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True), strict=True):
            if starts and group:
                done.append(group)
                group = []
            group.append(row)
        if done:
            yield table(done)
    if group:
        yield table([group])


def _found(rows: DataFrame, id_column: str, content: str, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows by run, groups by run) as stored tables; `carried` columns stay with the first row of each run."""
    kind = rows.schema[id_column].dataType.simpleString()
    names = [id_column, content, *carried]
    rows = rows.select(*names, F.left(content, F.lit(OPENING)).alias("_opening"), F.xxhash64(content).alias("_hash"))
    order = ["_opening", "_hash", content]
    id_first = F.col(id_column).asc_nulls_last()
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names) + ", run long, size long"
    local = rows.sortWithinPartitions(*order, id_first).select(*names).mapInArrow(_runs, schema)
    local = stored(local, "runs")
    heads = local.where("size IS NOT NULL").select(
        "run", F.col(id_column).alias("id"), "size", F.sha2(F.col(content).cast("binary"), 256).alias("text_sha256"), F.col(content).alias("content"),
        F.left(content, F.lit(OPENING)).alias("_opening"), F.xxhash64(content).alias("_hash"),
    )
    dealt = heads.repartitionByRange("_opening", "_hash").sortWithinPartitions("_opening", "_hash", "content", F.col("id").asc_nulls_last(), "run")
    groups = dealt.select("run", "id", "size", "text_sha256", "content").mapInArrow(_groups, f"run long, keep_id {kind}, group_size long, wins boolean, text_sha256 string")
    return local, stored(groups, "groups")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs, as a stored table.

    Texts are equal when they are after each run of ASCII blanks became one space; a null text is an empty one, and all empty texts are
    one group. Of a group the row with the smallest id stays, null ids last; of rows that share this id too, exactly one. keep_id
    is null where all ids of a group are. Texts of any length are compared whole; other columns are left out, whatever their names; an
    empty table gives an empty one.

    A group reaches one task as one row for some 50,000 copies of an input partition, not as its rows.
    """
    with scratch(docs.sparkSession):
        rows = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text)).alias("content"))
        local, groups = _found(rows, "doc_id", "content", [])
        first = F.col("size").isNotNull()
        out = local.select("run", "doc_id", first.alias("first")).join(groups, "run")
        out = out.select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("wins")).alias("kept"), "text_sha256")
        return stored(out, "exact-duplicates", result=True)


def without_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns and their text as it was, as a stored table; rules as above."""
    with scratch(docs.sparkSession):
        rows = docs.select(F.col(id_column).alias("_id"), normalised(F.col(text)).alias("_content"), F.struct("*").alias("_row"))
        local, groups = _found(rows, "_id", "_content", ["_row"])
        heads = local.where("size IS NOT NULL").select("run", "_row")
        return stored(heads.join(groups.where("wins").select("run"), "run").select("_row.*"), "distinct-texts", result=True)


def digest(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs)
