"""The trie of conversation prefixes, from the sorted conversations and the prefixes that neighbours share.

Each distinct conversation is one key, the digests of its turns in a row. Keys are sorted by range; the LCP array holds the number of
turns that neighbours share. Its Cartesian tree, equal values merged, has a node for each branching prefix: the interval between the
nearest smaller values on both sides. These are found in parallel: every block of neighbours keeps a stack of its own and resolves what
lies within it. What is left open is its chain of prefix minima, the last of which is the minimum of the block, and the nodes still
open at its end. Chains of neighbouring blocks are folded in the same way, level after level, until one is left, and what each level
learns goes back to its blocks. A block then expands the depths that no branching stands at. Sums over an interval (members, leaves,
tokens, smallest member) travel with the nodes.

Python: keys are compared and stacks are kept over Arrow batches of blocks of bounded size; the rest is DataFrame work.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import BLANK_WORD, scratch, stored

#: Bytes of a turn's digest in a key, turns that splitters of the ranges hold, and ids of members that are joined to one row.
DIGEST, SPLIT_TURNS, MEMBERS = 16, 16, 1024
#: Turns after which a block ends, and blocks that are folded at once.
BLOCK_TURNS, FOLD = 65_536, 256
NOTHING = hashlib.sha256(b"").hexdigest()
_LONG, _INT, _TEXT, _FLAG = pa.int64(), pa.int32(), pa.string(), pa.bool_()
_SUMS = [("conv", _LONG), ("n", _LONG), ("s", _LONG), ("leaves", _LONG)]
_NODE = [("v", _INT), ("m", _LONG), ("ended", _FLAG), *_SUMS]
_ABOVE = [("above", _INT), ("parent", _LONG)]
_BLOCK = [("block", _LONG), ("lcp", _INT), ("before", _TEXT)]
_PIECE = [("chain", pa.list_(pa.struct(_NODE))), ("open", pa.list_(pa.struct(_NODE))), ("tail", pa.struct([("length", _INT), *_SUMS]))]
_INFO = pa.list_(pa.struct([*_NODE, *_ABOVE, ("own", _FLAG)]))
ROWS = pa.schema([
    *_BLOCK, ("at", _INT), ("conv_id", _LONG), ("n", _LONG), ("words", pa.list_(_INT)), ("ends", _TEXT), ("edge", pa.binary()), ("last", _FLAG), *_PIECE])
HEADS, FOLDED = pa.schema([*_BLOCK, *_PIECE]), pa.schema([("index", _LONG), *_PIECE])
RESOLVED = pa.schema([("index", _LONG), *_BLOCK, ("chain", _INFO), ("open", _INFO), ("after", pa.struct(_ABOVE))])
NODES = pa.schema([(n, _LONG) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", _TEXT)])


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, key, words): each conversation with its first turns taken from the first of its block of ids.

    The first h turns, h = crc32(conv_id) modulo `most`, are those of conversation conv_id - conv_id % block, fewer if it has fewer and
    none if it does not exist; its own turns after its first h follow. Turns are ordered by number, null first; equal numbers by digest.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, DIGEST)
    each = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(BLANK_WORD)).alias("words")).alias("t"))
    own = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    own = stored(own.select("conv_id", "base", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("t")), "conversations")
    first = own.where("conv_id = base").select("base", F.slice("t", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.array().cast(own.schema["t"].dataType)
    whole = F.concat(F.slice(F.coalesce("first", none), 1, h), F.slice("t", h + 1, F.size("t")))
    made = own.join(first, "base", "left").select("conv_id", whole.alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
    return made.select("conv_id", key.alias("key"), F.transform("t", lambda x: x["words"]).alias("words"))


def _shared(a: bytes, b: bytes) -> int:
    """Digests that two keys share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid)
    return low


class Node:
    """A branching prefix of depth v: m boundaries of that value, whether a conversation ends there, and sums over what is known of it."""

    __slots__ = ("above", "conv", "ended", "first", "info", "leaves", "m", "n", "s", "v")

    def __init__(self, v, m=0, ended=False, conv=None, n=0, s=0, leaves=0, first=None):
        self.v, self.m, self.ended, self.conv, self.n, self.s, self.leaves = v, m, ended, conv, n, s, leaves
        self.first, self.above, self.info = first, None, None

    def take(self, x: dict | None) -> None:
        """Add the sums of a part."""
        if x is not None:
            self.conv = min((c for c in (self.conv, x["conv"]) if c is not None), default=None)
            self.n, self.s, self.leaves = self.n + x["n"], self.s + x["s"], self.leaves + x["leaves"]

    def fields(self) -> dict:
        return {"v": self.v, "m": self.m, "ended": self.ended, "conv": self.conv, "n": self.n, "s": self.s, "leaves": self.leaves}


class Fold:
    """Neighbouring pieces as one.

    A piece has a chain, its strictly falling prefix minima, where what stands between two of them belongs to the first; the strictly
    rising nodes above the last of the chain that are open at its end; and its tail, the conversation that stands last. A conversation
    alone is a piece whose chain is the value before it.
    """

    def __init__(self, pieces: list[dict]):
        self.chain, self.stack, self.tail = [], [], None
        #: Of each piece: its chain and open nodes as nodes of the whole, and the node above its tail.
        self.parts, self.over = [], []
        for p, piece in enumerate(pieces):
            chain = []
            for k, x in enumerate(piece["chain"]):
                node = self._arrive(x["v"], (p, "chain", k))
                node.m, node.ended = node.m + x["m"], node.ended or x["ended"]
                node.take(x)
                chain.append(node)
            opened = [Node(**x, first=(p, "open", k)) for k, x in enumerate(piece["open"])]
            self.stack += opened
            self.parts.append({"chain": chain, "open": opened})
            self.tail = piece["tail"]

    def _arrive(self, v: int, first: tuple) -> Node:
        """The node of a boundary of value v; nodes of higher values end before it."""
        tail, self.tail = self.tail, None
        ended = bool(tail) and tail["length"] == v
        below = {**tail, "leaves": 0} if ended else tail  # a conversation that goes on in the next one is no leaf
        under = None  # the node that the one above it is looked for, at first the tail itself
        above = None
        while self.stack and self.stack[-1].v > v:
            top = self.stack.pop()
            top.take(below)
            below = top.fields()
            above = above or top
            if under is not None:
                under.above = top
            under = top
        if self.stack:
            if self.stack[-1].v < v:
                self.stack.append(Node(v, ended=ended, first=first))
            node = self.stack[-1]
            node.take(below)
            if under is not None:
                under.above = node
        else:  # a new minimum: what stands to its left, and with it what is above the minimum before, lies outside
            node = Node(v, ended=ended, first=first)
            self.chain.append(node)
            self.stack.append(node)
        if tail is not None:
            self.over.append(above or node)
        return node

    def piece(self) -> dict:
        return {"chain": [x.fields() for x in self.chain], "open": [x.fields() for x in self.stack[1:]], "tail": self.tail}

    def resolve(self, chain: list[dict], opened: list[dict], after: dict | None) -> list[dict]:
        """Of each piece what is known of its nodes and of the one above its tail, given that of the chain, the open nodes and the last tail."""
        for x, info in (*zip(self.chain, chain, strict=True), *zip(self.stack[1:], opened, strict=True)):
            x.info = info

        def known(x: Node) -> dict:
            x.info = x.info or x.fields()
            return x.info

        out = []
        for p, part in enumerate(self.parts):
            found = {}
            for kind, nodes in part.items():
                found[kind] = []
                for k, x in enumerate(nodes):
                    info = known(x)
                    up = {"above": x.above.v, "parent": known(x.above)["conv"]} if x.above is not None else {n: info.get(n) for n in ("above", "parent")}
                    found[kind].append({**info, **up, "own": x.first == (p, kind, k) and info.get("own", True)})
            found["after"] = {"above": self.over[p].v, "parent": known(self.over[p])["conv"]} if p < len(self.over) else after
            out.append(found)
        return out


def _alone(lcp: int, conv: int, n: int, total: list[int]) -> dict:
    """The piece of one conversation; total[d]: words of its first d turns."""
    edge = {"v": lcp, "m": 1, "ended": False, "conv": None, "n": 0, "s": total[max(lcp, 0)], "leaves": 0}
    return {"chain": [edge], "open": [], "tail": {"length": len(total) - 1, "conv": conv, "n": n, "s": (n - 1) * total[-1], "leaves": 1}}


#: Ends everything that is open.
_END = {"chain": [{"v": -1, "m": 0, "ended": False, "conv": None, "n": 0, "s": 0, "leaves": 0}], "open": [], "tail": None}


def _totals(words: list[int]) -> list[int]:
    return [0, *accumulate(words)]


def _sequences(batches, block_turns: int):
    """Sorted (key, words, ids, conv_id, n) of a range: a row per distinct key with what it shares with the one before, and a piece per block.

    The first key of a range is a block of its own, as what it shares is not known here.
    """
    pid = TaskContext.get().partitionId() << 20
    chunk, at, turns, pieces, before, held = 0, 0, 0, [], None, None

    def distinct():
        key = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    if key is not None:
                        yield out
                    key, sha = row["key"], hashlib.sha256(row["ids"].encode())
                    out = {**row, "sha": sha}
                else:
                    sha.update(b"," + row["ids"].encode())
                    out["conv_id"], out["n"] = min(out["conv_id"], row["conv_id"]), out["n"] + row["n"]
        if key is not None:
            yield out

    def ended(row):
        """The row closes its block."""
        if chunk:
            row.update(Fold(pieces).piece())
        return row

    rows = []
    for x in distinct():
        key, ends = x["key"], x["sha"].hexdigest()
        lcp = None if before is None else _shared(before["key"], key)
        if held is not None:
            if not chunk or turns >= block_turns:
                rows.append(ended(held))
                chunk, at, turns, pieces = chunk + 1, 0, 0, []
            else:
                rows.append(held)
        held = {
            "block": pid + chunk, "at": at, "lcp": lcp, "conv_id": x["conv_id"], "n": x["n"], "words": x["words"], "ends": ends,
            "before": before["ends"] if before is not None and len(before["key"]) == lcp * DIGEST else None, "edge": key if before is None else None, "last": False,
        }
        if chunk:
            pieces.append(_alone(lcp, x["conv_id"], x["n"], _totals(x["words"])))
        before = {"key": key, "ends": ends}
        at, turns = at + 1, turns + len(x["words"]) + 1
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows, ROWS)
            rows = []
    if held is not None:
        held = ended(held)
        held["edge"], held["last"] = before["key"], True
        yield pa.RecordBatch.from_pylist([*rows, held], ROWS)


def _heads(batches):
    """Pieces of the first conversations of all ranges, from the last key of the range before."""
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            lcp = -1 if x["old"] is None else _shared(x["old"], x["edge"])
            head = {"block": x["block"], "lcp": lcp, "before": x["old_ends"] if x["old"] is not None and len(x["old"]) == lcp * DIGEST else None}
            rows.append(head | _alone(lcp, x["conv_id"], x["n"], _totals(x["words"])))
        yield pa.RecordBatch.from_pylist(rows, HEADS)


def _folded(key, table):
    rows = sorted(table.to_pylist(), key=lambda x: x["index"])
    return pa.Table.from_pylist([{"index": key[0].as_py(), **Fold(rows).piece()}], FOLDED)


def _answers(rows: list[dict], found: list[dict]) -> pa.Table:
    out = [{"index": x["index"], "block": x["block"], "lcp": x["lcp"], "before": x["before"], **f} for x, f in zip(rows, found, strict=True)]
    return pa.Table.from_pylist(out, RESOLVED)


def _topmost(table):
    rows = sorted(table.to_pylist(), key=lambda x: x["index"])
    fold = Fold([*rows, _END])
    nothing = {"above": None, "parent": None, "own": False}
    return _answers(rows, fold.resolve([{**x.fields(), **nothing} for x in fold.chain], [], nothing)[:-1])


def _down(_, table, above):
    rows = sorted(table.to_pylist(), key=lambda x: x["index"])
    (x,) = above.to_pylist()
    return _answers(rows, Fold(rows).resolve(x["chain"], x["open"], x["after"]))


def _expanded(_, table, resolved):
    """The nodes of a block: its branching prefixes, the depths between them, and the ends that conversations have for themselves."""
    rows = sorted(table.to_pylist(), key=lambda x: x["at"])
    (known,) = resolved.to_pylist()
    if rows[0]["lcp"] is None:
        rows[0] |= {"lcp": known["lcp"], "before": known["before"]}
    totals = [_totals(x["words"]) for x in rows]
    fold = Fold([_alone(x["lcp"], x["conv_id"], x["n"], t) for x, t in zip(rows, totals, strict=True)])
    out = []

    def chain(top, bottom, conv, parent, n, s, leaves, children, total, ends):
        for d in range(top + 1, bottom + 1):
            lowest = d == bottom
            above = None if d == 0 else parent if d == top + 1 else conv
            out.append((conv, d, above, n, children if lowest else 1, leaves, s - (n - 1) * total[max(d - 1, 0)], ends if lowest else NOTHING))

    for x, total, f in zip(rows, totals, fold.resolve(known["chain"], known["open"], known["after"]), strict=True):
        (node,) = f["chain"]
        if node["own"]:
            chain(node["above"], node["v"], node["conv"], node["parent"], node["n"], node["s"], node["leaves"], node["m"] + 1 - node["ended"], total, x["before"] if node["ended"] else NOTHING)
        chain(f["after"]["above"], len(total) - 1, x["conv_id"], f["after"]["parent"], x["n"], (x["n"] - 1) * total[-1], 1, 0, total, x["ends"])
    columns = zip(*out, strict=True) if out else [[]] * len(NODES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, NODES.types, strict=True)], NODES)


def _trie(convs: DataFrame, block_turns: int, fold: int) -> DataFrame:
    def sequences(batches):
        yield from _sequences(batches, block_turns)

    bucket = F.floor(F.col("conv_id") / MEMBERS).alias("bucket")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    some = convs.groupBy("key", "words", bucket).agg(ids, F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    opening = F.substring("key", 1, DIGEST * SPLIT_TURNS)
    dealt = some.withColumn("_opening", opening).repartitionByRange("_opening").sortWithinPartitions("key", "bucket")
    rows = stored(dealt.select("key", "words", "ids", "conv_id", "n").mapInArrow(sequences, from_arrow_schema(ROWS)), "sequences")
    pid = F.shiftright("block", 20).alias("pid")
    ranges = rows.groupBy(pid).agg((F.max("block") % (1 << 20) + 1).alias("blocks"))
    order = Window.orderBy("pid")  # a row a range
    ranges = ranges.select("pid", F.lag("pid").over(order).alias("old_pid"), (F.sum("blocks").over(order) - F.col("blocks")).alias("offset"))
    ranges = stored(ranges, "ranges")
    first = rows.where("lcp IS NULL").select(pid, "block", "edge", "conv_id", "n", "words")
    last = rows.where("last").select(pid.alias("old_pid"), F.col("edge").alias("old"), F.col("ends").alias("old_ends"))
    heads = first.join(ranges, "pid").join(last, "old_pid", "left").select("block", "edge", "conv_id", "n", "words", "old", "old_ends")
    heads = heads.mapInArrow(_heads, from_arrow_schema(HEADS))
    inner = rows.where("chain IS NOT NULL").select("block", F.lit(None).cast("int").alias("lcp"), F.lit(None).cast("string").alias("before"), "chain", "open", "tail")
    pieces = heads.unionByName(inner).withColumn("pid", F.shiftright("block", 20)).join(ranges, "pid")
    pieces = pieces.select((F.col("offset") + F.col("block") % (1 << 20)).alias("index"), "block", "lcp", "before", "chain", "open", "tail")
    levels = [stored(pieces, "pieces")]
    group = F.floor(F.col("index") / fold).alias("group")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("block", "long"), ("lcp", "int"), ("before", "string"))]
    while levels[-1].count() > fold:
        up = levels[-1].select("index", "chain", "open", "tail").groupBy(group).applyInArrow(_folded, from_arrow_schema(FOLDED))
        levels.append(stored(up.select("index", *nothing, "chain", "open", "tail"), "pieces"))
    schema = from_arrow_schema(RESOLVED)
    known = levels.pop().groupBy(group).applyInArrow(_topmost, schema)
    for level in reversed(levels):
        known = level.groupBy(group).cogroup(known.groupBy(F.col("index").alias("group"))).applyInArrow(_down, schema)
    known = stored(known, "resolved")
    return rows.select("block", "at", "lcp", "conv_id", "n", "words", "ends", "before").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_expanded, from_arrow_schema(NODES))


def prefix_trie(turns: DataFrame, block: int = 20, most: int = 4, block_turns: int = BLOCK_TURNS, fold: int = FOLD) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations (see rebuilt()), as a stored table; columns as op13's contract names them.

    conv_id is the smallest member of the node, the conversations that begin with the prefix; the root has depth 0 and no parent.
    saved_tokens are the words that need not be read again below the node, itself included; ends_sha256 names the conversations that
    end there.

    Null roles and texts are empty. Turns without conv_id belong to no conversation. Equal turn numbers are ordered by the digest of
    role and text; repeated turns stay. Prefixes are compared by 128 bits of SHA-256 a turn. Other columns are left out; an empty table
    gives an empty one. A task holds the digests of one conversation, a block of about 65,536 turns or a conversation, or 1,024 ids of
    members; the members of one node are hashed in order by one task, as a digest asks for it.
    """
    with scratch(turns.sparkSession):
        return stored(_trie(rebuilt(turns, block, most), block_turns, fold), "trie", result=True)


def digest(turns: DataFrame) -> DataFrame:
    return prefix_trie(turns)
