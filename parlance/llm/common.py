"""Small pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII blanks, and words of letters, digits and any non-ASCII character.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Folders of tables that the operators under way have written, innermost last.
_WRITTEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local one is made, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation.

    Within scratch() the table goes when the block ends, unless it is the block's result.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    open_ = _WRITTEN[:-1] if result else _WRITTEN
    if open_:
        open_[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose stored tables are deleted at its end, also if it fails."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            drop(spark, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever body does with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def scan(items: Column, state: Column, step, emit, emitted: str, block: int = 256) -> Column:
    """Walk an array from left to right: emit(state, item) of each item, with the state before it.

    state is a struct, step(state, item) gives the next one; emitted is the type of an emitted value. Values are gathered
    block by block, so that appending stays near linear for arrays of any length.
    """
    nothing = F.array().cast(f"array<{emitted}>")

    def one(acc, x):
        return F.struct(step(acc["at"], x).alias("at"), acc["done"].alias("done"), F.concat(acc["cur"], F.array(emit(acc["at"], x).cast(emitted))).alias("cur"))

    def over_block(acc, part):
        start = F.struct(acc["at"].alias("at"), acc["done"].alias("done"), nothing.alias("cur"))
        return F.aggregate(part, start, one, lambda a: F.struct(a["at"].alias("at"), F.concat(a["done"], F.array(a["cur"])).alias("done")))

    def walk(z):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / block).cast("int")), lambda b: F.slice(z, b * block + 1, block))
        zero = F.struct(state.alias("at"), F.array().cast(f"array<array<{emitted}>>").alias("done"))
        return F.aggregate(parts, zero, over_block, lambda a: F.flatten(a["done"]))

    return let(items, lambda z: F.when(F.size(z) > 0, walk(z)).otherwise(nothing))


_SPAN = "struct<start:int,end:int,hit:string,before:string,after:string>"


def _at_edge(gap: Column, context: int, before: bool) -> Column:
    """The `context` code points of a gap next to its hit, without a word of letters and digits that goes on beyond them."""
    if not context:
        return F.lit("")
    near = F.right(gap, F.lit(context + 1)) if before else F.left(gap, F.lit(context + 1))
    cut = r"(?s)^(?:[A-Za-z0-9]+|.)" if before else r"(?s)(?:[A-Za-z0-9]+|.)$"
    return F.when(F.length(near) > context, F.regexp_replace(near, cut, "")).otherwise(near)


def find_spans(text: Column, pattern: str, context: int = 40) -> Column:
    """All leftmost non-overlapping matches with code point offsets (end exclusive) and the text just before and after each, in whole words.

    split() and regexp_extract_all() walk the same matches, so summed lengths of gaps and hits are offsets.
    """
    gaps = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("gap"), _at_edge(F.get(g, i + 1), context, False).alias("after")))
    zipped = F.zip_with(
        let(F.split(text, pattern, -1), gaps), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda g, hit: F.struct(g["gap"].alias("gap"), g["after"].alias("after"), hit.alias("hit")),
    )
    start = lambda at, x: at["pos"] + F.length(x["gap"])
    end = lambda at, x: start(at, x) + F.coalesce(F.length(x["hit"]), F.lit(0))
    spans = scan(
        zipped, F.struct(F.lit(0).alias("pos")), lambda at, x: F.struct(end(at, x).alias("pos")),
        lambda at, x: F.struct(start(at, x).alias("start"), end(at, x).alias("end"), x["hit"].alias("hit"), _at_edge(x["gap"], context, True).alias("before"), x["after"].alias("after")), _SPAN,
    )
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: s["hit"].isNotNull())).otherwise(F.array().cast(f"array<{_SPAN}>"))


def span_digest(spans: Column) -> Column:
    """kind:start:end of spans that are sorted already, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
