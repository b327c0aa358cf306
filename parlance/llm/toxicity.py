"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so training tokens are labelled by evidence: a word of a toxic document is toxic if toxic documents
hold it far more often than clean ones. The field sees each word and its neighbours within a sentence. Forward-backward
marginals give the offending offsets; their sum, share and maximum give the document score through a logistic curve.

Python: forward-backward is a recurrence over positions, which no built-in function runs; each task streams Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as bk

#: Labelled training rows the model is fitted on, drawn by hash from all of them; the only bound here. The field itself is
#: trained on their toxic documents and CLEAN_DOCS of the clean ones, the score curve on all.
SAMPLE_ROWS, CLEAN_DOCS = 3000, 1000
#: Bytes of text that the sample may hold on the driver; rows beyond are left out of the fit, whole.
SAMPLE_BYTES = 64 << 20
#: A word is evidence if toxic sample documents hold it so many times more often than clean ones, with such a likelihood ratio (G).
SEED_RATIO, SEED_G = 12.0, 30.0
#: Sentences are walked in pieces of this many words, with the messages between them exact, so a long one takes no longer than its words.
PIECE = 256
FOLDS = 5
EPOCHS = 30


@dataclass
class Model:
    hashes: np.ndarray  # sorted word hashes
    weights: np.ndarray  # (3, words + 1): word, previous, next; the last column is for other words
    bias: float
    transition: np.ndarray  # (2, 2), log
    start: np.ndarray  # (2,), log
    curve: np.ndarray  # logistic weights over document_features(), bias last
    used: np.ndarray | None = None

    def ids(self, h: np.ndarray) -> np.ndarray:
        if self.used is None:
            self.used = np.zeros(1 << 20, bool)
            self.used[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        out = np.full(len(h), len(self.hashes), np.int32)
        maybe = np.flatnonzero(self.used[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            ok = self.hashes[at] == h[maybe]
            out[maybe[ok]] = at[ok]
        return out


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Words of a run: (start, end, row, hash, chain starts, chain lengths)."""
    small = bk.lower(data)
    start, end, row = bk.words(small, offsets, plain=True)
    h = bk.range_hash(bk.prefix(small), start, end)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.isin(data, np.frombuffer(b".!?\n", np.uint8)), out=breaks[1:])
    sentence = breaks[start]
    first = np.ones(len(start), bool)
    if len(start):
        first[1:] = (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(start)))
    return start, end, row, h, begin, length


def _pieces(begin: np.ndarray, length: np.ndarray, size: int):
    """(begin, length, chain, whether first of its chain) of the pieces that chains are walked in."""
    n = -(-length // size)
    chain = np.repeat(np.arange(len(begin)), n)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return begin[chain] + part * size, np.minimum(length[chain] - part * size, size), chain, part == 0


def _messages(begin, length, chain, first, a, s, psi):
    """(forward message into each piece, backward message out of each), exact; pieces of one-piece chains have the start and ones."""
    into, out = np.tile(s, (len(begin), 1)), np.ones((len(begin), 2))
    many = np.flatnonzero(np.bincount(chain, minlength=chain.max() + 1 if len(chain) else 0)[chain] > 1) if len(chain) else np.zeros(0, np.int64)
    if not len(many):
        return into, out
    step = np.tile(np.eye(2), (len(many), 1, 1))
    b, n, start = begin[many], length[many], first[many]
    for t in range(int(n.max())):
        on = np.flatnonzero(n > t)
        m = step[on] @ a
        if t == 0:
            m = np.where(start[on][:, None, None], step[on], m)
        m[:, :, 1] *= psi[b[on] + t][:, None]
        step[on] = m / m.max((1, 2), keepdims=True)
    for i in range(len(many) - 1):
        if not start[i + 1]:
            v = into[many[i]] @ step[i]
            into[many[i + 1]] = v / v.sum()
    for i in range(len(many) - 2, -1, -1):
        if not start[i + 1]:
            v = step[i + 1] @ out[many[i + 1]]
            out[many[i]] = v / v.sum()
    return into, out


def forward_backward(e, begin, length, transition, start, want_pairs=False, size=PIECE):
    """Marginals of the toxic state; e is the toxic emission against the other. With want_pairs also log-likelihood parts."""
    n = len(e)
    a, s = np.exp(transition), np.exp(start)
    psi = np.exp(np.clip(e, -30, 30))
    begin, length, chain, first = _pieces(begin, length, size)
    into, out = _messages(begin, length, chain, first, a, s, psi)
    order = np.argsort(-length, kind="stable")
    after = np.full(len(begin), -1)  # the piece that goes on from each
    after[:-1] = np.where(first[1:], -1, np.arange(1, len(begin)))
    ends = begin + length - 1
    joints = np.flatnonzero(after >= 0)
    joints = ends[joints], begin[after[joints]]
    begin, length, first, into, out = begin[order], length[order], first[order], into[order], out[order]
    f0, f1, c = np.empty(n), np.empty(n), np.empty(n)
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # length > t
    for t in range(steps):
        at = begin[: active[t]] + t
        p0, p1 = (f0[at - 1], f1[at - 1]) if t else (into[:, 0], into[:, 1])
        u0, u1 = p0 * a[0, 0] + p1 * a[1, 0], (p0 * a[0, 1] + p1 * a[1, 1]) * psi[at]
        if not t:
            u0, u1 = np.where(first, s[0], u0), np.where(first, s[1] * psi[at], u1)
        c[at] = z = u0 + u1
        f0[at], f1[at] = u0 / z, u1 / z
    b0, b1 = np.ones(n), np.ones(n)
    last = begin + length - 1
    scale = f0[last] * out[:, 0] + f1[last] * out[:, 1]
    b0[last], b1[last] = out[:, 0] / scale, out[:, 1] / scale
    pairs = np.zeros((2, 2))

    def joint(at, then):
        v0, v1 = b0[then] / c[then], psi[then] * b1[then] / c[then]
        if want_pairs:
            pairs[:] += a * np.array([[(f0[at] * v0).sum(), (f0[at] * v1).sum()], [(f1[at] * v0).sum(), (f1[at] * v1).sum()]])
        return v0, v1

    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        v0, v1 = joint(at, at + 1)
        b0[at], b1[at] = a[0, 0] * v0 + a[0, 1] * v1, a[1, 0] * v0 + a[1, 1] * v1
    joint(*joints)
    m = f1 * b1
    return (m, pairs, np.log(c).sum()) if want_pairs else m


def _neighbours(ids: np.ndarray, other: int, begin: np.ndarray, length: np.ndarray):
    before, after = np.full(len(ids), other, np.int32), np.full(len(ids), other, np.int32)
    if len(ids):
        before[1:], after[:-1] = ids[:-1], ids[1:]
        before[begin], after[begin + length - 1] = other, other
    return before, after


def document_features(m: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per document: log of one plus the expected toxic words, their share, the largest marginal."""
    total, words = np.bincount(row, m, rows), np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, m)
    return np.stack([np.log1p(total), np.sqrt(total / np.maximum(words, 1)), top], 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fit on a sample. Without both classes the model is constant: everything scores the share of toxic rows."""
    y = np.array(toxic, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros((3, 1)), -10.0, np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0, 0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))]))
    parts, base = [], 0
    for first, end, data, offsets in bk.chunks(pa.array(texts, pa.large_string())):
        _, _, row, h, begin, length = _cut(data, offsets)
        parts.append(((row + first).astype(np.int32), h, begin + base, length))
        base += len(h)
    row, h, begin, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    vocab, ids = np.unique(h, return_inverse=True)
    ids = ids.astype(np.int32)
    seen = np.unique(ids.astype(np.int64) * len(texts) + row)
    doc_y = y[seen % len(texts)]
    used = seen // len(texts)
    df_toxic, df = np.bincount(used, doc_y, len(vocab)), np.bincount(used, minlength=len(vocab))
    rate = (df_toxic + 0.1) / y.sum() / ((df - df_toxic + 0.1) / (len(y) - y.sum()))
    prior = y.mean()
    part = lambda k, share: k * np.log(np.maximum(k, 1e-9) / (df * share))
    seed = (rate >= SEED_RATIO) & (2 * (part(df_toxic, prior) + part(df - df_toxic, 1 - prior)) >= SEED_G)
    del seen, used, doc_y
    keep = seed | (df >= 20)
    hashes = vocab[keep]
    model = Model(hashes, np.zeros((3, len(hashes) + 1)), -4.0, np.zeros((2, 2)), np.zeros(2), np.zeros(4))
    word = model.ids(h)
    del h
    gold = (seed[ids] & (y[row] == 1)).astype(np.float32)
    del ids
    model.weights[0, :-1] = np.where(seed[keep], 6.0, 0.0)
    before, after = _neighbours(word, len(hashes), begin, length)
    inner = np.ones(len(word), bool)
    inner[begin] = False
    taught = (y == 1) | (np.cumsum(y == 0) <= CLEAN_DOCS)
    use = taught[row]
    moved = np.cumsum(use) - 1
    word, before, after, gold, inner = word[use], before[use], after[use], gold[use], inner[use]
    chain = taught[row[begin]]
    begin, length = moved[begin[chain]], length[chain]
    now = np.flatnonzero(inner)
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[now - 1].astype(int), gold[now].astype(int)), 1)
    gold_start = np.array([(1 - gold[begin]).sum(), gold[begin].sum()])
    theta = [model.weights, np.array([model.bias]), model.transition, model.start]
    first_m, second_m = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, EPOCHS + 1):
        w, bias, transition, start = theta
        e = w[0][word] + w[1][before] + w[2][after] + bias[0]
        m, pairs, _ = forward_backward(e, begin, length, transition, start, want_pairs=True)
        off = m - gold
        grads = [
            np.stack([np.bincount(f, off, w.shape[1]) for f in (word, before, after)]) + 0.02 * w, np.array([off.sum()]),
            pairs - gold_pairs + 0.1 * transition, np.array([(1 - m[begin]).sum(), m[begin].sum()]) - gold_start + 0.1 * start,
        ]
        grads[0][:, -1] = 0
        for t, g, a, b in zip(theta, grads, first_m, second_m, strict=True):
            a += 0.1 * (g - a)
            b += 0.02 * (g * g - b)
            t -= 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-6)
    model.weights, model.bias, model.transition, model.start = theta[0], float(theta[1][0]), theta[2], theta[3]
    del word, before, after, gold, inner, use, moved, row, now
    x = np.concatenate([x for *_, x in _passes(pa.array(texts, pa.large_string()), model)])
    curve = np.zeros(4)
    for _ in range(50):  # Newton steps with a little ridge
        p = _sigmoid(x @ curve)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
        curve += np.linalg.solve(hessian, x.T @ (y - p) - 0.5 * curve)
    model.curve = curve
    return model


def _passes(column: pa.Array, model: Model):
    """For each run of texts: first row, end row, bytes, offsets, words (start, end, row), marginals and curve inputs."""
    for first, end, data, offsets in bk.chunks(column):
        start, stop, row, h, begin, length = _cut(data, offsets)
        word = model.ids(h)
        before, after = _neighbours(word, len(model.hashes), begin, length)
        e = model.weights[0][word] + model.weights[1][before] + model.weights[2][after] + model.bias
        m = forward_backward(e, begin, length, model.transition, model.start)
        yield first, end, data, offsets, start, stop, row, m, np.hstack([document_features(m, row, end - first), np.ones((end - first, 1))])


def _score(column: pa.Array, model: Model, spans: bool):
    score, where = np.empty(len(column)), [[] for _ in range(len(column))]
    for first, end, data, offsets, start, stop, row, m, x in _passes(column, model):
        score[first:end] = _sigmoid(x @ model.curve)
        if spans:
            chars = bk.code_points(data)
            for i in np.flatnonzero(m >= 0.5):
                own = chars[offsets[row[i]]]
                where[first + row[i]].append(f"{chars[start[i]] - own}:{chars[stop[i]] - own}")
    return np.round(score, 6), [",".join(w) for w in where]


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of up to `rows` labelled training documents, first by hash of the id, within SAMPLE_BYTES. Fold 0 is never used."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    order = [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")]
    found = docs.select("doc_id", "text").join(picked, "doc_id")
    sizes = np.cumsum([r[0] or 0 for r in found.orderBy(*order).limit(rows).select(F.octet_length("text")).collect()])
    kept = found.orderBy(*order).limit(max(1, int(np.searchsorted(sizes, SAMPLE_BYTES, "right")))).collect()
    return [r["text"] or "" for r in kept], [r["toxic"] for r in kept]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return fit(*sample(docs, labels, rows))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_spans (start:end of offending words in code points, comma-joined).

    Row by row: repeats and ties keep a score each, null texts count as empty, other columns pass through; columns of the two
    names are replaced. A long text is a run of its own, with some dozen arrays of its words in memory at once; a sentence of any length is
    one chain. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("toxic_score", "toxic_spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score, spans = _score(batch.column(batch.schema.get_field_index(text)), shared.value, True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, pa.string())], names=[*batch.schema.names, "toxic_score", "toxic_spans"])

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", T.StringType())])
    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score is 0.5 or more."""
    return score_toxicity(docs, train(docs, labels)).where("toxic_score < 0.5").select(*docs.columns)
