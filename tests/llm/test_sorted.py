"""Content sort and the trie of conversation prefixes against brute force, with edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from parlance.llm import content_sort, prefix_trie

SF = "/root/testdata/sf0.001"
EDGE = [
    (900001, None), (900002, ""), (900003, " \t\n"), (900004, " "), (900005, "a  b"), (900006, "a\tb"), (900007, "a\u00a0b"), (900008, "A b"), (900009, "x" * 3_000_000),
    (900010, "x" * 3_000_000), (900010, "x" * 3_000_000), (None, "a b"), (None, "only null"), (None, "only null"), (-5, "a\n\nb"), (900011, "y" * 200 + "1"), (900012, "y" * 200 + "2"),
]


def normalised(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + EDGE + [(1_000_000 + i, "hot  text") for i in range(500)]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], "doc_id long, text string, content string, run int, _row string").repartition(7)
    groups = defaultdict(list)
    for i, t in rows:
        groups[normalised(t)].append(i)
    want = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        want += [(i, ids[0], len(ids), not k, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    got = content_sort.exact_duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame(want, got.schema).collect())
    left = content_sort.without_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), normalised(r.text)) for r in left.collect()) == sorted((str(w[0]), t) for t, w in ((t, sorted(i, key=lambda i: (i is None, i))) for t, i in groups.items()))
    assert {r.text for r in left.collect()} <= {t for _, t in rows}


def test_exact_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert content_sort.exact_duplicates(none).count() == 0 == content_sort.without_exact_duplicates(none).count()


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in by.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(str(c))
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        w = (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += w
            leaves[k[:d]] += not children[k]
    return sorted(
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(ends[k]).encode()).hexdigest()) for k, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check_trie(spark, rows, **settings):
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, block int").repartition(5)
    got = prefix_trie.prefix_trie(turns, **settings)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute_trie(rows), key=str)


def made_turns():
    rng, rows = random.Random(5), []
    for c in [*range(-30, 240), 100_000]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "c d e"]) if rng.random() < 0.8 else f"own {c}"))
    rows += [(c, t, "user", "same words here") for c in range(500, 900) for t in range(4)]  # a hot conversation
    rows += [(c, t, "user", "same words here") for c in range(900, 960) for t in range(c % 60)]  # prefixes of each other
    rows += [(None, 1, "user", "nobody's"), (1000, 1, "user", "twice"), (1000, 1, "user", "twice"), (1001, 0, None, None)]
    rows += [(2000, t, "user", f"long {t}") for t in range(150)] + [(2001, t, "user", f"long {t}") for t in range(140)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block_turns": 40, "fold": 3}])
def test_prefix_trie(spark, settings):
    check_trie(spark, made_turns(), **settings)


def test_prefix_trie_of_few(spark):
    check_trie(spark, [])
    check_trie(spark, [(7, 0, "user", "alone"), (7, 1, "user", "here")])
    check_trie(spark, [(3, 0, "user", "x")])  # its only turn is replaced by nothing or stays
