"""Preference formatting of chats: shared turns become one prompt, the rest two masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scan, unused

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"
_SEGMENT = "struct<start:int,end:int,text:string,body:int,trained:boolean>"


def _safe(text: Column) -> Column:
    """Text that cannot be read as a control marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _turns(column: str) -> Column:
    """Turns as they are rendered: null roles are 'user', null texts empty; roles are one line without markers."""
    plain = lambda t: F.struct(
        F.regexp_replace(_safe(F.coalesce(t["role"], F.lit("user"))), r"[\r\n]+", " ").alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return F.coalesce(F.transform(F.col(column).cast(f"array<{TURN}>"), plain), F.array().cast(f"array<{TURN}>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _render(turn: Column) -> Column:
    return F.concat(_head(turn), _safe(turn["text"]), F.lit(CLOSE + "\n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in both arrays."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def _segments(turns: Column) -> Column:
    """Rendered turns with their offsets; only bodies of assistant turns are trained on, up to and with the end marker."""
    size = lambda x: F.length(_render(x))
    return scan(
        turns, F.struct(F.lit(0).alias("pos")), lambda at, x: F.struct((at["pos"] + size(x)).alias("pos")),
        lambda at, x: F.struct(at["pos"].alias("start"), (at["pos"] + size(x)).alias("end"), _render(x).alias("text"), (at["pos"] + F.length(_head(x))).alias("body"), F.coalesce(x["role"] == "assistant", F.lit(False)).alias("trained")),
        _SEGMENT,
    )


def _mask(segments: Column) -> Column:
    return F.transform(F.filter(segments, lambda s: s["trained"]), lambda s: F.struct(s["body"].alias("start"), (s["end"] - 1).alias("end")))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with n_prompt_turns, prompt, chosen_text, rejected_text and the (start, end) ranges to train on of each.

    chosen and rejected are arrays of (role, text). Their longest common prefix is rendered once. Equal conversations leave
    two empty completions; a null array counts as empty; null roles are 'user', null texts empty, before turns are compared; markers
    inside texts and roles are broken up. Ranges are code points of the completion, end exclusive. Columns of the five names are
    replaced, others pass through; rows never merge; an empty table gives an empty one.
    """
    left, right = _turns(chosen), _turns(rejected)
    c1, r1 = unused(pairs, "chosen_segments", "rejected_segments")
    out = pairs.withColumn("n_prompt_turns", common_prefix(left, right))
    rest = lambda turns: F.slice(turns, F.col("n_prompt_turns") + 1, F.size(turns))
    out = out.withColumns({c1: _segments(rest(left)), r1: _segments(rest(right)), "prompt": F.array_join(F.transform(F.slice(left, 1, F.col("n_prompt_turns")), _render), "")})
    for c, name in ((c1, "chosen"), (r1, "rejected")):
        out = out.withColumns({f"{name}_text": F.array_join(F.transform(c, lambda s: s["text"]), ""), f"{name}_mask": _mask(F.col(c))})
    return out.drop(c1, r1)


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns in order; equal turn numbers are ordered by role, then text. Turns without conv_id belong to none."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(ordered.alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def swapped_reply_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation against itself with the last reply of conversation conv_id XOR 1.

    Turns after the last reply are left out of both. Without a reply of its own or a neighbour with one, rejected is null. Repeated
    turns stay, turns without conv_id belong to no conversation, an empty table gives an empty one.
    """
    convs = conversations_of(turns)
    replies = F.filter(F.transform("turns", lambda x, i: F.struct(i.alias("i"), x["role"].alias("role"), x["text"].alias("text"))), lambda x: x["role"] == "assistant")
    convs = convs.withColumn("last", F.try_element_at(replies, F.lit(-1)))
    other = convs.where("last IS NOT NULL").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"), F.lit(True).alias("has"))
    joined = convs.join(other, "conv_id", "left")
    before = F.slice("turns", 1, F.col("last.i"))
    paired = F.col("last").isNotNull() & F.coalesce("has", F.lit(False))
    reply = lambda text: F.array(F.struct(F.lit("assistant").alias("role"), text.alias("text")))
    return joined.select(
        "conv_id", F.when(paired, F.concat(before, reply(F.col("last.text")))).otherwise(F.col("turns")).alias("chosen"),
        F.when(paired, F.concat(before, reply(F.col("reply")))).alias("rejected"),
    )


def digest(turns: DataFrame) -> DataFrame:
    """A row per conversation: its pair, formatted, with masks as start:end. Turns without conv_id are left out; nulls, ties, repeats and empty tables as above."""
    out = format_preferences(swapped_reply_pairs(turns))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "conv_id", "n_prompt_turns", F.col("rejected").isNotNull().alias("paired"), "prompt", "chosen_text", "rejected_text",
        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"),
    )
