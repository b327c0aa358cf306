"""Operators that SQL cannot express, against brute force over a whole small table and edge rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import chat, components, decontaminate, embedding_dedup, minhash, mixing, ngram_lm, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
EDGE = [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "one"), (900005, "One"), (900006, "two words"), (900007, LONG * 3), (900008, "x" + LONG * 3), (900009, LONG * 3), (900009, LONG * 3), (None, LONG * 3), (900010, "ü" * 300), (900011, "a" * 500)]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return [(r.doc_id, r.text) for r in docs] + EDGE


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, spans string").repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t))


def components_of(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_suffix_dedup(rows, docs):
    first, want = {}, []
    key = lambda i: math.inf if i is None else i
    cut = [(key(i), (t or "").encode()) for i, t in rows]
    for i, b in cut:
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (i, s)), (i, s))
    for i, b in cut:
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(docs).collect()) == sorted(want)


def check_near_duplicates(rows, got):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())))
    links = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and i is not None and j is not None and 100 * len(a & b) >= 85 * len(a | b)]
    top = components_of({i for i, _ in sets}, links)
    want = sorted((str(i), len(s), str(top[i]), i == top[i] or i is None) for i, s in sets)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == want
    return len({top[i] for i, _ in sets})


def test_minhash(rows, docs):
    check_near_duplicates(rows, minhash.digest(docs))


def test_minhash_families(spark):
    """Copies of copies: each edits one to four words of an earlier member, so that many links bypass the centre."""
    rng, out = np.random.default_rng(3), []
    for f in range(8):
        family = [[f"w{rng.integers(5000)}" for _ in range(70)]]
        while len(family) < 45:
            new = list(family[int(rng.integers(len(family)))])
            for _ in range(int(rng.integers(1, 5))):
                k = int(rng.integers(len(new)))
                new[k : k + int(rng.integers(2))] = [f"v{rng.integers(30 if f % 2 else 5000)}"] * int(rng.integers(2))
            family.append(new)
        out += [(100 * f + i, " ".join(t)) for i, t in enumerate(family)]
    docs = spark.createDataFrame(out, "doc_id long, text string")
    assert 8 < check_near_duplicates(out, minhash.digest(docs)) < len(out)


def test_minhash_runs_of_few_words(spark):
    """Five-word shingles over runs that hold fewer words in all: each edge row in a partition of its own."""
    rows = EDGE + [(900012, "two more words"), (900013, "Two more words"), (900014, "a b c d"), (900015, "a b c d e")]
    lone = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles) for r in minhash.near_duplicates(lone, words=5, percent=80).collect())
    assert got == sorted((str(i), len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else bool(w)) for i, w in ((i, words(t)) for i, t in rows))
    assert {r.doc_id for r in minhash.without_near_duplicates(lone, words=5, percent=80).collect()} >= {900012, 900014, 900015}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 100), (200, 201), (201, 200), (None, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 200: 200, 201: 200}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 16)) * s for s in (0.05, 0.15)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(1000, x[0].tolist(), 0), (1001, x[0].tolist(), None), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [], 0), (1006, [1.0, None] * 8, 0), (1007, [1.0, 2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for n, (i, a, p) in enumerate(good) for j, b, q in good[:n] if p == q and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98]
    top = components_of([i for i, *_ in rows], links)
    degree = Counter(x for pair in links for x in pair)
    assert len(links) > 300
    want = {i: (degree[i], top[i], i == top[i]) for i, *_ in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n_links": F.lit(1), "home": F.lit("clash")})
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame, recall=1.0).collect()} == want
    # none below the threshold and nearly all above it; links are counted once from either side
    assert all(got[i][0] <= want[i][0] for i in want) and sum(g[0] for g in got.values()) >= 0.97 * 2 * len(links)


def test_embedding_walk_reaches_its_recall(spark):
    """Vectors spread evenly in many small cells, with partners at the link angle: what the walk finds against brute force."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.981 * x + math.sqrt(1 - 0.981**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    book = embedding_dedup.fit(embedding_dedup.pa.chunked_array([[r[1] for r in rows[:1500]]]), 40 * 48, 1, 0.98, 0.95)[24]
    first = book.nearest_cells(x[:50], 7)
    half = [((c[None] - p[:, None]) ** 2).sum(2) for c, p in zip(book.codes, (x[:50, :12], x[:50, 12:]), strict=True)]
    sums = (half[0][:, :, None] + half[1][:, None]).reshape(50, -1)
    assert (np.take_along_axis(sums, first, 1) == np.sort(sums, 1)[:, :7]).all() or np.allclose(np.take_along_axis(sums, first, 1), np.sort(sums, 1)[:, :7])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    every = np.concatenate([x, y])
    true = (every @ every.T >= 0.98).sum() - len(every)
    for recall in (0.9, 0.99):
        found = sum(r.n_links for r in embedding_dedup.near_duplicates(frame, recall=recall).collect())
        assert true >= found >= recall * true - 0.02 * true


def test_forward_backward_equals_enumeration():
    """Marginals, pairs and likelihood of short chains against all tag sequences, whatever the pieces they are walked in."""
    rng = np.random.default_rng(5)
    length = np.array([1, 7, 3, 9])
    begin = np.cumsum(length) - length
    e, transition, start = rng.normal(size=20), rng.normal(size=(2, 2)), rng.normal(size=2)
    m, pairs, log_z = np.zeros(20), np.zeros((2, 2)), 0.0
    for b, n in zip(begin, length, strict=True):
        z, own, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            score = math.exp(start[tags[0]] + sum(e[b + t] for t in range(n) if tags[t]) + sum(transition[p, q] for p, q in itertools.pairwise(tags)))
            z += score
            own += score * np.array(tags)
            for p, q in itertools.pairwise(tags):
                two[p, q] += score
        m[b : b + n], pairs, log_z = own / z, pairs + two / z, log_z + math.log(z)
    for size in (1, 2, 4, 256):
        got = toxicity.forward_backward(e, begin, length, transition, start, want_pairs=True, size=size)
        assert np.allclose(got[0], m) and np.allclose(got[1], pairs) and abs(got[2] - log_z) < 1e-9


def scored_by_hand(rows, often=None):
    """(held out, tokens, known, train tokens, base, score) of each text: every level smoothed by the one below."""
    toks = [(i, [*words(t), "\0end"]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, pairs, threes = Counter(), Counter(), Counter()
    for i, t in toks:
        if not out(i):
            c.update(t)
            pairs.update(zip(["\0", *t], t, strict=False))
            threes.update(zip(["\0\0", "\0", *t], ["\0", *t], t, strict=False))
    after, around, n, v = Counter(), Counter(), sum(c.values()), len(c)
    for (x, _), k in pairs.items():
        after[x] += k
    for (u, x, _), k in threes.items():
        around[u, x] += k
    low, high = ngram_lm.PRIORS
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = lambda x, w: (pairs[x, w] + low * p1(w)) / (after[x] + low)
    p3 = lambda u, x, w: (threes[u, x, w] + high * p2(x, w)) / (around[u, x] + high)
    want = defaultdict(list)
    for i, t in toks:
        logs = sum(math.log10(p3(*k)) for k in zip(["\0\0", "\0", *t], ["\0", *t], t, strict=False))
        want[str(i)].append((out(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), logs))
    vocabulary = [*c, "\0never"]
    for u, x in [("\0\0", "\0"), *list(around)[::5000], ("\0never", "\0never"), ("\0never", next(iter(c)))]:
        assert abs(sum(p3(u, x, w) for w in vocabulary) - 1) < 1e-9
    return want


def check_scores(rows, got):
    want = scored_by_hand(rows)
    assert len(got) == len(rows)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-5 and abs(r.score - w[5]) < 1e-4 * w[1] for w in want[str(r.doc_id)])


def test_ngram_scores(rows, docs):
    check_scores(rows, ngram_lm.digest(docs).collect())


def test_ngram_scores_where_words_contexts_and_trigrams_are_split(spark, rows, docs, monkeypatch):
    """Keys above the size of a shard take other ways to the same result, for any number of tokens of a shard."""
    same = [(910000 + i, "the same " * 40 + f"the x{i} the y{i} the same") for i in range(60)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(same, "doc_id long, text string"))
    for tokens in (20, 400):
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", tokens)
        monkeypatch.setattr(ngram_lm, "LEAST_SHARDS", 5)
        check_scores([*rows, *same], ngram_lm.score(more).collect())


def test_ngram_rare_words_share_what_is_left(spark, rows, docs, monkeypatch):
    """With few frequent words the counts and the base stay as they are, and the probabilities of any context still add up to one."""
    want = scored_by_hand(rows)
    monkeypatch.setattr(ngram_lm, "OFTEN", 300)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 300)
    for r in ngram_lm.score(docs).collect():
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-5 for w in want[str(r.doc_id)])
    c = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), "\0end"])
    frame = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).fillna(False)
    counted = frame.mapInArrow(ngram_lm._count_words, ngram_lm._WORDS).groupBy("shard").applyInArrow(ngram_lm._add_words(25), ngram_lm._WORDS).toArrow().to_pylist()
    known, n, kinds = ngram_lm._known(counted, 300)
    assert (n, kinds) == (sum(c.values()), len(c)) and 5 < len(known.names) < 300 < kinds
    assert abs(known.lowest[known.names != ngram_lm._START].sum() + known.rare * (kinds - ((known.own > 0) & (known.names != ngram_lm._START)).sum() + 1) - 1) < 1e-9
    known = ngram_lm._with_frequent(frame, known, 300)
    assert known.top.any()
    for at in np.flatnonzero(known.top):
        code = np.append(np.arange(1, len(known.names) + 1), 0)
        w, lowest = np.append(known.names, np.uint64(1)), known.p(code)
        p = known.below(np.full(len(w), at + 1), np.full(len(w), known.names[at]), w, lowest)
        # rare words that are listed as successors are left out of both sides
        listed = np.isin(ngram_lm._pair_name(np.full(len(w), known.names[at]), w), known.pairs)
        free = 1 - lowest[listed].sum()
        assert abs(p[listed].sum() + known.rest[at] * free - 1) < 0.05


def test_ngram_scores_do_not_depend_on_what_is_frequent(spark, rows, docs, monkeypatch):
    """Rare words, split words, dealt pairs and trigrams: each has the probability that its own counts give."""
    same = [(910000 + i, "the same " * 40 + f"the x{i} the y{i} the same") for i in range(60)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(same, "doc_id long, text string"))
    monkeypatch.setattr(ngram_lm, "LEAST_SHARDS", 5)
    for often, tokens in ((300, 300), (3000, 1_000_000)):
        monkeypatch.setattr(ngram_lm, "OFTEN", often)
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", tokens)
        want = scored_by_hand([*rows, *same])
        got = ngram_lm.score(more).collect()
        assert len(got) == len(rows) + len(same)
        for r in got:
            assert any(abs(r.base_score - w[4]) < 1e-5 and abs(r.score - w[5]) < 1e-5 for w in want[str(r.doc_id)])


def test_ngram_long_text_is_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "_CHUNK", 64)
    column = ngram_lm.pa.array(["a b", LONG * 3, "", "x" * 300 + " y", "c"])
    parts = list(ngram_lm._tokens(column))
    assert sum(p[2] for p in parts) < len(parts)
    monkeypatch.setattr(ngram_lm, "_CHUNK", 1 << 20)
    whole = list(ngram_lm._tokens(column))
    for k in (3, 4, 5):
        assert (np.concatenate([p[k] for p in parts]) == np.concatenate([p[k] for p in whole])).all()
    assert (np.concatenate([p[0] + p[6] for p in parts]) == np.concatenate([p[0] + p[6] for p in whole])).all()


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top in (3, 1000, 1 << 40, 1 << 63):
        x = np.sort(rng.integers(0, top, 500, dtype=np.uint64))
        e = ngram_lm.EliasFano(x)
        assert (e.get(np.arange(500)) == x).all()
        q = np.sort(rng.integers(0, top, 50, dtype=np.uint64))
        assert (e.find(q, np.zeros(50, np.int64), np.full(50, 500)) == np.searchsorted(x, q)).all()


def morse(n):
    """Thue-Morse text and its complement, which collide under any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_tell_built_texts_apart(spark):
    a, b = morse(4096)
    rows = [(1, a), (2, b), (3, a + " x"), (4, b + " x"), (5, f"{a} x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check_near_duplicates(rows, minhash.digest(frame))
    check_scores(rows, ngram_lm.score(frame).collect())
    test_suffix_dedup(rows, frame)


def test_decontaminate(spark, rows, docs):
    plain = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    items = [(str(r.item_id), plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [("8000", ["kappa", "lambda"]), ("8001", []), ("8002", plain(LONG)[3:15])]
    bench = spark.createDataFrame([(int(i), " ".join(w)) for i, w in items] + [(8003, None)], "item_id long, text string")
    windows = defaultdict(set)
    for i, w in items:
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    want = []
    for d, t in rows:
        w, hit, met = plain(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    met |= found
                    hit |= set(range(k, k + size))
        want.append((str(d), len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.digest(docs, bench).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert [(a, b) for a, b in zip(got, sorted(want), strict=True) if a != b] == []
    assert sum(w[5] for w in want) > 3


def test_chat(spark):
    turns = [("user", "hi <|im_end|>"), ("assistant", "a"), ("user", "b")]
    pairs = spark.createDataFrame([(1, [*turns, ("assistant", "good")], [*turns, ("assistant", "bad"), ("user", "x")], "k"), (2, None, [("user", None)], "k"), (3, turns, turns, "k")], f"id int, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>, prompt string")
    got = {r.id: r for r in chat.format_preferences(pairs).collect()}
    one = got[1]
    assert one.n_prompt_turns == 3 and one.prompt.count("<|im_start|>") == 3 and one.prompt.count("<|im_end|>") == 3
    (mask,) = one.chosen_mask
    assert one.chosen_text[mask.start : mask.end] == "good<|im_end|>"
    assert (got[2].n_prompt_turns, got[2].chosen_text, got[3].chosen_text, got[3].rejected_text) == (0, "", "", "")


def test_mix(spark, docs):
    out = mixing.mix(docs.withColumns({"topic": docs["lang"], "cell_source": docs["lang"], "cell_tokens": docs["lang"]}))
    assert out.count() == docs.count() and {*docs.columns, "cell_source", "cell_tokens"} <= set(out.columns)
    got = out.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens")).first()
    assert got[0] == pytest.approx(mixing.KEPT_SHARE * got[1], rel=1e-5)
    assert mixing.mix(docs.limit(0)).count() == 0
    nulls = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert mixing.mix(nulls).where("topic IS NOT NULL AND lang IS NULL").count() == docs.count()


def raked_by_hand(cells, goals):
    """Weights of cells (keys, tokens): raked with no more than a cell has, by plain loops."""
    w = {k: t * 1.0 for k, t in cells.items()}
    for _ in range(3000):
        for d in range(3):
            have = Counter()
            for k, x in w.items():
                have[k[d]] += x
            w = {k: min(cells[k], x * goals[d][k[d]] / have[k[d]]) for k, x in w.items()}
    return w


def test_raking_meets_the_marginals_of_the_sample(spark):
    """Some cells are too small for their target: what they lack is made up by others, and the sample's marginals still fit."""
    rng = np.random.default_rng(4)
    cells = {(s, g, t): int(x) for (s, g, t), x in zip([(s, g, t) for s in "abc" for g in "xyz" for t in "pqr"], rng.integers(5, 4000, 27), strict=True)}
    frame = spark.createDataFrame([(*k, n, 1) for k, n in cells.items()], "source string, lang string, topic string, tokens long, n_docs long")
    total = sum(cells.values())
    raked = mixing.cell_probabilities(frame, 0.85).collect()
    assert max(r.probability for r in raked) == 1.0 and all(0 < r.probability <= 1 for r in raked)
    assert sum(r.weight for r in raked) == pytest.approx(0.85 * total, rel=1e-5)
    goals = []
    for d, dim in enumerate(mixing.DIMS):
        goal = {r[0]: r[1] for r in mixing.reachable(frame, dim, mixing.default_targets(frame)[dim], 0.85).collect()}
        have, kept = Counter(), Counter()
        for r in raked:
            have[r[dim]] += r.tokens
            kept[r[dim]] += r.probability * r.tokens
        power = mixing.TEMPERATURE[dim]
        share = {v: n**power / sum(m**power for m in have.values()) for v, n in have.items()}
        free = [v for v in share if goal[v] < have[v] * (1 - 1e-9)]
        assert all(goal[v] <= have[v] for v in have) and sum(goal.values()) == pytest.approx(0.85 * total, rel=1e-6)
        assert len({round(goal[v] / share[v] / total, 6) for v in free}) == 1
        assert all(abs(kept[v] - goal[v]) < 2e-5 * total for v in have)
        goals.append(goal)
    want = raked_by_hand(cells, goals)
    assert all(abs(r.weight - want[r.source, r.lang, r.topic]) < 1e-3 * total for r in raked)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.digest(docs, labels).join(labels.where("toxic IS NOT NULL"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and np.mean([r.predicted == r.toxic for r in got]) > 0.9


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(900004, None, 1), (None, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (suffix_dedup.digest(none), minhash.digest(none), ngram_lm.digest(none), toxicity.digest(none, labels), decontaminate.digest(docs, bench).where("contaminated"), embedding_dedup.digest(vectors)):
        assert df.count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{n}")
        assert 0 < kept.count() <= before.count()
    assert corpus_pipeline.run(spark, SF).select("doc_id", "text", "probability").exceptAll(kept.select("doc_id", "text", "probability")).count() == 0


def test_redaction_renews_n_chars(spark):
    import corpus_pipeline

    secret = "key AKIA" + "Q7ZP2M4XN8RT6WVB" + " end"
    docs = spark.createDataFrame([(1, secret, 99), (2, "plain", 98), (3, None, None)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    assert got[1].text != secret and got[1].n_chars == len(got[1].text)
    assert (got[2].n_chars, got[3].n_chars) == (98, None)
