"""Training curves from event files: framed records of protobuf messages, read file by file on the executors.

A file is a row of Spark's binary reader, so any file system will do; a task holds one file. A record is its length, a masked checksum
of the length, the message and a masked checksum of the message, all little-endian. Reading a file stops at the first record that is
cut off or does not match its checksum: what came before is kept, and the place and the reason are a row of their own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Fixed values of the format: the reversed Castagnoli polynomial and the mask of checksums; the number of 32-bit floats among tensor types.
CASTAGNOLI, MASK, FLOAT = 0x82F63B78, 0xA282EAD8, 1
SCALARS = pa.schema([("path", pa.string()), ("place", pa.int64()), ("wall_time", pa.float64()), ("step", pa.int64()), ("tag", pa.string()), ("value", pa.float64()), ("bad", pa.string())])


@cache
def _table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ CASTAGNOLI * (x & 1)
        out.append(x)
    return out


def masked_crc(data: bytes) -> int:
    """Checksum of bytes as the format stores it."""
    crc, table = 0xFFFFFFFF, _table()
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def records(content: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, message, None) of each sound record; (place, None, reason) of the first other one, where reading ends."""
    at = 0
    while at < len(content):
        head = content[at : at + 12]
        if len(head) < 12:
            yield at, None, "cut off in a header"
            return
        size, crc = struct.unpack("<QI", head)
        if masked_crc(head[:8]) != crc:
            yield at, None, "checksum of the length"
            return
        end = at + 12 + size
        if len(content) < end + 4:
            yield at, None, "cut off in a message"
            return
        message = content[at + 12 : end]
        if masked_crc(message) != struct.unpack_from("<I", content, end)[0]:
            yield at, None, "checksum of the message"
            return
        yield at, message, None
        at = end + 4


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers of varints, bytes of all else."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            if at + size > len(data):
                raise ValueError("a field ends after its message")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _of_tensor(data: bytes) -> float | None:
    """The value of a tensor of one 32-bit float."""
    kind, found = FLOAT, None
    for number, value in fields(data):
        if number == 1:
            kind = value
        elif number in (4, 5) and len(value) == 4:
            found = struct.unpack("<f", value)[0]
    return found if kind == FLOAT else None


def scalars(message: bytes) -> Iterator[tuple[float, int, str, float]]:
    """(wall_time, step, tag, value) of the scalars of an event; other summaries are left out."""
    wall, step, summary = 0.0, 0, []
    for number, value in fields(message):
        if number == 1:
            wall = struct.unpack("<d", value)[0]
        elif number == 2:
            step = value - (1 << 64) if value >> 63 else value
        elif number == 5:
            summary += [x for n, x in fields(value) if n == 1]
    for part in summary:
        tag, found = "", None
        for number, value in fields(part):
            if number == 1:
                tag = value.decode("utf-8", "replace")
            elif number == 2:
                found = struct.unpack("<f", value)[0]
            elif number == 8:
                found = _of_tensor(value) if found is None else found
        if found is not None:
            yield wall, step, tag, found


def _of_file(path: str, content: bytes) -> Iterator[tuple]:
    for place, message, bad in records(content):
        if message is not None:
            try:
                yield from ((path, place, *x, None) for x in list(scalars(message)))
                continue
            except (ValueError, IndexError, KeyError, struct.error) as error:
                bad = f"message: {error}"
        yield path, place, None, None, None, None, bad


def _of_files(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = list(_of_file(path, content.as_py()))
            for first in range(0, len(rows), 10_000):
                columns = zip(*rows[first : first + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCALARS.types, strict=True)], schema=SCALARS)


def read_events(spark: SparkSession, root: str, names: str = "events.out.tfevents.*") -> DataFrame:
    """path, place, wall_time, step, tag, value, bad: every scalar of the event files under a folder; `bad` says why a file's reading ended early."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    return files.select("path", "content").mapInArrow(_of_files, from_arrow_schema(SCALARS))


def bad_tails(events: DataFrame) -> DataFrame:
    """path, place, bad of the files that were not read to their end."""
    return events.where("bad IS NOT NULL").select("path", "place", "bad")


def boundaries(events: DataFrame) -> DataFrame:
    """run, iteration, first, last: the chained steps of each iteration; every trainer starts at step 0 again.

    run and iteration come from paths such as <run>/iteration_<n>/...; files elsewhere are left out.
    """
    part = lambda i: F.regexp_extract("path", r"([^/]+)/iteration_(\d+)/", i)
    of = events.where("bad IS NULL").withColumns({"run": part(1), "iteration": F.expr("try_cast(regexp_extract(path, '([^/]+)/iteration_(\\\\d+)/', 2) AS INT)")}).where("iteration IS NOT NULL")
    size = of.groupBy("run", "iteration").agg(F.greatest(F.max("step"), F.lit(0)).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("run").orderBy("iteration"))  # a row an iteration
    return size.select("run", "iteration", (upto - F.col("size")).alias("first"), upto.alias("last"))


def training_curves(events: DataFrame) -> DataFrame:
    """run, tag, step (chained over iterations), iteration, value: the last value of a step wins, by file name, then by place in it."""
    b = boundaries(events).select("run", "iteration", "first")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/iteration_(\d+)/", i)
    of = events.where("bad IS NULL AND tag IS NOT NULL").select(part(1).alias("run"), F.expr("try_cast(regexp_extract(path, '([^/]+)/iteration_(\\\\d+)/', 2) AS INT)").alias("iteration"), "tag", "step", "value", "path", "place")
    chained = of.join(b, ["run", "iteration"]).withColumn("step", F.col("step") + F.col("first"))
    last = F.max_by(F.struct("iteration", "value"), F.struct("iteration", "path", "place")).alias("x")
    return chained.groupBy("run", "tag", "step").agg(last).select("run", "tag", "step", "x.iteration", "x.value")


def smoothed(curves: DataFrame, width: int) -> DataFrame:
    """curves with smooth: the mean of the last `width` values of a curve, fewer at its start."""
    w = Window.partitionBy("run", "tag").orderBy("step").rowsBetween(1 - width, 0)
    return curves.withColumn("smooth", F.avg("value").over(w))
