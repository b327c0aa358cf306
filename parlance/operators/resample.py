"""Resampling by hashed draws: replicate b always draws a unit as often, however the data is partitioned.

How often a unit is drawn follows a Poisson distribution of mean one, as for draws with replacement from many units. The counts come
from a hash of (seed, replicate, unit), so a group is never put in order or kept together: sums are combined before the shuffle, and series
with the same units are resampled jointly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio

REPLICATES, SEED = 2000, 12345
#: 65,536 times the distribution function of Poisson(1) at 0 to 7.
POISSON = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)
SLOTS = 8
#: Rows weighed at once, and groups whose sums a task holds.
BLOCK, HELD = 1024, 256


def counts(seed: int, block: Column, unit: Column) -> list[Column]:
    """How often a unit is drawn in each of the eight replicates of a block, from four hexadecimal digits each."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), block.cast("string"), unit.cast("string")))
    drawn = []
    for i in range(SLOTS):
        u = F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int")
        w = (u >= POISSON[0]).cast("int")
        for t in POISSON[1:]:
            w = w + (u >= t).cast("int")
        drawn.append(w)
    return drawn


#: Of MD5: the constant of each step, and its turns by round. Messages digested at once.
_STEP = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_AT = ((1, 0), (5, 1), (3, 5), (7, 0))
_LANES = 16384


def _mix(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


def _digests(block: np.ndarray) -> np.ndarray:
    """MD5 of messages of one padded block each, a row of four words per message; all messages take a step together."""
    words = np.ascontiguousarray(block.view("<u4").T)
    start = [np.full(words.shape[1], v, "uint32") for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        turn, (by, plus) = i // 16, _AT[i // 16]
        f = _mix(turn, b, c, d)
        f += a
        f += words[(by * i + plus) % 16]
        f += np.uint32(_STEP[i])
        left = _TURN[turn][i % 4]
        high = f >> np.uint32(32 - left)
        f <<= np.uint32(left)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    return np.stack([x + y for x, y in zip(start, (a, b, c, d), strict=True)], axis=1)


def drawn(seed: int, units: list[str | None], start: int, stop: int) -> np.ndarray:
    """A row per unit: how often replicates start to stop - 1 draw it, the same numbers as `counts` gives; for use inside tasks.

    Messages of one length are laid out and digested together; names too long for one block of the hash go one by one.
    """
    heads = [f"{seed}|{j}".encode() for j in range(start // SLOTS, -(-stop // SLOTS))]
    keys = [b"" if u is None else b"|" + u.encode() for u in units]
    digests = np.zeros((len(keys), len(heads), 4), "<u4")
    sizes = lambda texts: {n: [i for i, t in enumerate(texts) if len(t) == n] for n in {len(t) for t in texts}}
    of_heads, longest = sizes(heads), max(map(len, heads), default=0)
    for width, own in sizes(keys).items():
        if width + longest > 55:
            for i in own:
                digests[i] = np.frombuffer(b"".join(hashlib.md5(h + keys[i]).digest() for h in heads), "<u4").reshape(-1, 4)
            continue
        for size, at in of_heads.items():
            head = np.frombuffer(b"".join(heads[j] for j in at), "uint8").reshape(-1, size)
            step = max(1, _LANES // len(at))
            for first in range(0, len(own), step):
                rows = own[first : first + step]
                block = np.zeros((len(rows), len(at), 64), "uint8")
                block[:, :, :size] = head
                block[:, :, size : size + width] = np.frombuffer(b"".join(keys[i] for i in rows), "uint8").reshape(len(rows), 1, width)
                block[:, :, size + width] = 0x80
                block[:, :, 56:58] = np.array([8 * (size + width)], "<u2").view("uint8")
                digests[np.ix_(rows, at)] = _digests(block.reshape(-1, 64)).reshape(len(rows), len(at), 4)
    at = digests.view(">u2").reshape(len(units), len(heads) * SLOTS)[:, start % SLOTS : start % SLOTS + stop - start]
    return np.searchsorted(POISSON, np.arange(65536), side="right").astype("uint8")[at]


def unit_draws(rows: DataFrame, unit: str, n: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """_u, _w: of each distinct unit how often it is drawn in each of n replicates, as small integers in one array."""
    blocks = rows.select(F.col(unit).alias("_u")).distinct().withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(-(-n // SLOTS) - 1))))
    drawn = blocks.select("_u", F.struct("_j", F.array(*(w.cast("tinyint") for w in counts(seed, F.col("_j"), F.col("_u")))).alias("w")).alias("_x"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["w"]))
    return drawn.groupBy("_u").agg(F.slice(whole, 1, n).alias("_w"))


def replicates(rows: DataFrame, by: list[str], unit: str, values: list[str], n: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """by, b and the mean of each value over the units drawn in replicate b; rows of one unit share its draws.

    Rows are dealt by unit, so draws are made once a unit; a task weighs a block of rows for all replicates by one product of matrices a group and
    sends a group's sums once, so no row is multiplied by the replicates. Rows without a unit are one unit.
    """
    text = F.to_json(F.array(*(F.col(c).cast("string") for c in by)))
    given = [c for i, v in enumerate(values) for c in (F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"_v{i}"), F.col(v).isNotNull().alias(f"_is{i}"))]
    dealt = rows.select(*by, text.alias("_key"), F.col(unit).cast("string").alias("_u"), *given)
    dealt = dealt.repartition(rows.sparkSession.sparkContext.defaultParallelism, "_u").sortWithinPartitions("_u")
    sums = ["_any", *(f"{kind}{i}" for i in range(len(values)) for kind in ("_sum", "_size"))]

    def sent(held):
        keys = pa.Table.from_batches([k for k, _ in held.values()])
        for i, name in enumerate(sums):
            keys = keys.append_column(name, pa.array([list(x[i]) for _, x in held.values()], pa.list_(pa.float64())))
        return keys.to_batches()

    def weigh(batches):
        held = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                units = part.column("_u").dictionary_encode("encode")
                w = drawn(seed, units.dictionary.to_pylist(), 0, n)[units.indices.to_numpy()].astype("float64")
                v, known = (np.stack([part.column(f"{c}{i}").to_numpy(zero_copy_only=False).astype("float64") for i in range(len(values))]) for c in ("_v", "_is"))
                keys = part.column("_key").dictionary_encode()
                for k, key in enumerate(keys.dictionary.to_pylist()):
                    own = np.flatnonzero(keys.indices.to_numpy() == k)
                    x, odd = v[:, own], ~np.isfinite(v[:, own])
                    total = np.where(odd, 0.0, x) @ w[own]
                    for i, j in zip(*np.nonzero(odd), strict=True):  # what is not drawn adds nothing
                        total[i][w[own[j]] > 0] += x[i, j]
                    new = np.stack([w[own].sum(axis=0), *(s for i in range(len(values)) for s in (total[i], known[i, own] @ w[own]))])
                    if key in held:
                        held[key][1][:] += new
                    else:
                        held[key] = (part.select(by).slice(int(own[0]), 1), new)
                if len(held) >= HELD:
                    yield from sent(held)
                    held = {}
        if held:
            yield from sent(held)

    types = [f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in by] + [f"{s} array<double>" for s in sums]
    each = dealt.mapInArrow(weigh, ", ".join(types)).select(*by, F.posexplode(F.arrays_zip(*sums)).alias("b", "_x"))
    g = each.groupBy(*by, "b").agg(*(F.sum(f"_x.{s}").alias(s) for s in sums)).where("_any > 0")
    return g.select(*by, "b", *(ratio(f"_sum{i}", f"_size{i}").alias(v) for i, v in enumerate(values)))


def interval(draws: DataFrame, by: list[str], value: Column, alpha: float = 0.05) -> DataFrame:
    """by, lo, hi: percentiles of a value over replicates, of which there is a fixed number in a group."""
    return draws.groupBy(*by).agg(F.percentile(value, alpha / 2).alias("lo"), F.percentile(value, 1 - alpha / 2).alias("hi"))


def bootstrap_mean(deltas: DataFrame, by: list[str], unit: str, value: str, n: int = REPLICATES, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """by, n, lo, hi: percentile interval of the mean."""
    size = deltas.groupBy(*by).agg(F.count(value).alias("n"))
    return interval(replicates(deltas, by, unit, [value], n, seed), by, F.col(value), alpha).join(size, by)


def shuffled_groups(rows: DataFrame, by: list[str], ident: list[str], size: int, seed: int, ties: list[str] | None = None) -> DataFrame:
    """rows with `draw`, a group number: rows of a stratum in hashed order, cut in groups of `size`; the last may be smaller.

    The order is that of the hash; a stratum is one window, so strata should be settings crossed with something that grows.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ident)))
    return rows.withColumn("draw", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(key, *ident, *(ties or []))) - 1) / size))
