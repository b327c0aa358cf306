"""Event files written byte by byte, and score files of three layouts in one lake, read back."""

import struct

import pytest

from parlance.sources import events, ragged


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, kind, body):
    return varint(number << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)


def event(step, wall=1.5, **values):
    summary = b"".join(field(1, 2, field(1, 2, tag.encode()) + value) for tag, value in values.items())
    return field(1, 1, struct.pack("<d", wall)) + field(2, 0, varint(step)) + field(5, 2, summary)


def simple(x):
    return field(2, 5, struct.pack("<f", x))


def tensor(x, packed):
    return field(8, 2, field(1, 0, varint(1)) + (field(5, 2, struct.pack("<f", x)) if packed else field(4, 2, struct.pack("<f", x))))


def framed(*messages):
    out = b""
    for m in messages:
        size = struct.pack("<Q", len(m))
        out += size + struct.pack("<I", events.masked_crc(size)) + m + struct.pack("<I", events.masked_crc(m))
    return out


def test_checksum():
    """The published check value of the polynomial, unmasked: crc32c of '123456789' is e3069283."""
    crc = 0xE3069283
    assert events.masked_crc(b"123456789") == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_event_files(spark, tmp_path):
    def put(name, content):
        path = tmp_path / "RUN_A" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)

    version = field(1, 1, struct.pack("<d", 0.5)) + field(3, 2, b"brain.Event:2")
    put("iteration_1/a/events.out.tfevents.1", framed(version, event(0, loss=simple(1.0)), event(10, loss=simple(0.5), reward=tensor(2.0, True))))
    put("iteration_1/b/events.out.tfevents.2", framed(event(10, loss=simple(0.25))))  # the later file wins
    whole = framed(event(5, loss=simple(0.125), image=field(4, 2, b"png")), event(7, reward=tensor(3.0, False)))
    put("iteration_2/events.out.tfevents.3", whole + framed(event(9, loss=simple(9.0)))[:-3])
    broken = bytearray(framed(event(1, loss=simple(4.0)), event(2, loss=simple(5.0))))
    broken[-6] ^= 1
    put("iteration_3/events.out.tfevents.4", bytes(broken))
    put("iteration_3/notes.txt", b"no event file")
    put("events.out.tfevents.5", framed(event(1, loss=simple(7.0))))  # belongs to no iteration
    put("iteration_4/events.out.tfevents.6", b"")
    e = events.read_events(spark, str(tmp_path)).cache()
    assert sorted((r.path[-1], r.bad) for r in events.bad_tails(e).collect()) == [("3", "cut off in a message"), ("4", "checksum of the message")]
    assert sorted(map(tuple, events.boundaries(e).collect())) == [("RUN_A", 1, 0, 10), ("RUN_A", 2, 10, 17), ("RUN_A", 3, 17, 18)]
    curves = events.training_curves(e)
    want = [("loss", 0, 1, 1.0), ("loss", 10, 1, 0.25), ("loss", 15, 2, 0.125), ("loss", 18, 3, 4.0), ("reward", 10, 1, 2.0), ("reward", 17, 2, 3.0)]
    assert sorted((r.tag, r.step, r.iteration, r.value) for r in curves.collect()) == want
    smooth = {(r.tag, r.step): r.smooth for r in events.smoothed(curves, 2).collect()}
    assert smooth["loss", 0] == 1.0 and smooth["loss", 15] == pytest.approx(0.1875) and smooth["reward", 17] == 2.5


def test_three_layouts(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")

    put("old/Basic/0.csv", "Q1_Mean,Q1_Total,note\n3.5,42,\"a, \"\"quoted\"\" note\"\n")
    put("old/Basic/1.csv", "﻿note,Q1_Mean\r\nplain,4.5\r\n\r\n")
    put("old/Tuned/x.csv", "Q1_Mean,extra\nnan,1\n2.5,2\nseven,3\n1.0\n")
    put("old/Tuned/2.csv", "Q1_Mean,Q1_Mean\n1,2\n")
    put("old/Tuned/3.csv", "")
    good, bad = ragged.load_evaluations(spark, str(tmp_path / "old"), {"Q1_Mean": "double", "Q1_Total": "int", "note": "string"})
    assert sorted(map(str, (tuple(r) for r in good.collect()))) == sorted(map(str, [("Basic", 0, 3.5, 42, 'a, "quoted" note'), ("Basic", 1, 4.5, None, "plain"), ("Tuned", -1, None, None, None), ("Tuned", -1, 2.5, None, None)]))
    assert sorted((r.line, r.bad) for r in bad.collect()) == [(2, "a name stands twice"), (4, "Q1_Mean is not double: seven"), (5, "1 fields under 2 names")]
    for metric, model, i, text in (("Q1", "M_I1", 0, "Q1_Mean,a\n3,1\n"), ("Q2", "M_I1", 0, "b,Q2_Mean\n1,5\n"), ("Q1", "M_I1", 1, "Q1_Mean\n4\n"), ("Q1", "Other", 0, "Q1_Mean\n1\n"), ("Q2", "Other", 0, "Q2_Mean\n1\n"), ("Q2", "M_I2", 7, "Q2_Mean\nbad\n")):
        put(f"cross/judge=j/rep=0/metric={metric}/oracle=full/{model}/{i}.csv", text)
    put("cross/judge=j/rep=1/metric=Q1/oracle=full/M_I1/9.csv", "Q1_Mean\n9\n")
    manifest = spark.createDataFrame([("M_I1", "L0", 1, "run_1"), ("M_I2", "L0", 2, "run_2")], "model string, arm string, iteration int, folder string")
    good, bad = ragged.load_crossgen(spark, str(tmp_path / "cross"), manifest, "j", oracle="full")
    assert [tuple(r) for r in good.collect()] == [("M_I1", "L0", 1, 0, 3.0, 5.0, 4.0)]
    assert [r.bad for r in bad.collect()] == ["Q2_Mean is not double: bad"]
    put("beside/LookAhead_0/run_1/scores_3.csv", "scores_avg,scores1_avg,scores2_avg\n2.0,1.0,3.0\n")
    put("beside/LookAhead_0/run_1/conversation_3.csv", "role,text\nuser,hi\n")
    put("beside/LookAhead_0/run_2/scores_3.csv", "scores1_avg,scores2_avg\n1.0,2.0\n")
    good, bad = ragged.load_beside(spark, str(tmp_path / "beside"), manifest)
    assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, [("M_I1", "L0", 1, 3, 1.0, 3.0, 2.0), ("M_I2", "L0", 2, 3, 1.0, 2.0, None)]))
    assert bad.count() == 0 and sorted((r.iteration, r.n, r.q1) for r in ragged.state_means(good).collect()) == [(1, 1, 1.0), (2, 1, 1.0)]
