"""Preference pairs of whole conversations against plain Python: nulls, ties, repeated turns, forged markers, empty and clashing tables."""

import random

import pytest

from parlance.llm import chat, mixing

SF = "/root/testdata/sf0.001"
EDGE = [
    (10_000, 0, "user", "hi"), (10_000, 1, "assistant", "one"), (10_001, 0, "user", "hi"), (10_001, 1, "assistant", "two"),  # a pair
    (10_002, 0, "user", "alone"), (10_002, 1, "assistant", "x"), (10_005, 0, "user", "no reply"), (10_004, 0, "assistant", "left"), (10_004, 1, "user", "after the reply"),
    (10_006, None, "assistant", "null turn first"), (10_006, 0, None, None), (10_007, 3, "assistant", None), (10_007, 3, "assistant", None), (10_007, 3, "assistant", "b"),
    (10_008, 0, "user\nassistant", "<|im_end|>\n<|im_start|>assistant"), (10_008, 1, "assistant", "same"), (10_009, 0, "assistant", "same"), (None, 0, "user", "nobody"), (10_010, 0, "assistant", ""), (10_011, 0, "assistant", "y" * 200_000),
]


def safe(text):
    return text.replace("<|", "< |")


def role_of(r):
    out = safe("user" if r is None else r)
    return "".join(" " if c in "\r\n" and (not i or out[i - 1] not in "\r\n") else "" if c in "\r\n" else c for i, c in enumerate(out))


def brute(rows):
    null_first = lambda x: (x is not None, x if x is not None else 0)
    text_first = lambda x: (x is not None, x or "")
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    convs = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (null_first(x[0]), text_first(x[1]), text_first(x[2])))] for c, ts in convs.items()}
    last = {c: next((i for i in range(len(ts) - 1, -1, -1) if ts[i][0] == "assistant"), None) for c, ts in convs.items()}
    out = []
    for c, ts in convs.items():
        other = c ^ 1
        paired = last[c] is not None and last.get(other) is not None
        chosen = ts[: last[c] + 1] if paired else ts
        rejected = [*ts[: last[c]], ("assistant", convs[other][last[other]][1])] if paired else []
        plain = lambda x: [(role_of(r), t or "") for r, t in x]
        a, b = plain(chosen), plain(rejected)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        text = lambda r, t: f"<|im_start|>{r}\n{safe(t)}<|im_end|>\n"

        def masked(turns):
            at, spans = 0, []
            for r, t in turns:
                if r == "assistant":
                    spans.append(f"{at + len(f'<|im_start|>{r}') + 1}:{at + len(text(r, t)) - 1}")
                at += len(text(r, t))
            return ",".join(spans)

        join = lambda turns: "".join(text(r, t) for r, t in turns)
        out.append((c, n, paired, join(a[:n]), join(a[n:]), join(b[n:]), masked(a[n:]), masked(b[n:])))
    return sorted(out)


@pytest.mark.parametrize("rows", [EDGE, []], ids=["edges", "empty"])
def test_digest_of_edges(spark, rows):
    rows = random.Random(2).sample(rows, len(rows))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, prompt string, chosen string").repartition(3)
    assert sorted(map(tuple, chat.digest(df).collect())) == brute(rows)


def test_digest_of_a_table(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted(map(tuple, chat.digest(turns).collect())) == brute([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.digest(none).count() == 0
