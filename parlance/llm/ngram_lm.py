"""Scores under a three-level n-gram trie with Elias-Fano levels.

The trie is cut into shards by the middle word of a trigram, so a shard holds all of a word's contexts, successors and trigrams and
needs no other shard. Its levels - words, their contexts, the words that follow a context, the words that follow a word - are
monotone sequences in Elias-Fano code with monotone pointers between them and codes of smoothed probabilities, in memory-mapped
pages. A trigram is found by its word, its context and a successor search relative to the context's base; what has no
entry goes on with the weight that its context leaves to the next lower level. Every level is smoothed by its lower level
(p = (count + prior * lower) / (total + prior)), so the probabilities of any context add up to one.

Texts are not regrouped. Each run of texts sends its trigrams once, by shard, which adds them up, builds its trie and answers one sum
per document and run; the answers meet again by run. Frequent words, whose number is fixed, are counted first and known
everywhere, so they travel as numbers; a shard asks for the counts of all other words that end its trigrams. Where a middle word alone
has more trigrams than a shard should, they are dealt by its pair with the last word, then by trigram; what is frequent beyond that is
answered where the texts are. A context of such a word is a pair that another shard counts: it divides there, once for every time the
pair occurs. No task holds the model, the corpus, or all rows of a frequent key, and no probability depends on how words are dealt.
"""

from __future__ import annotations

import math
import mmap
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk

FOLDS, HELD_OUT = 7, 2
#: What the lower level weighs, in tokens: words below pairs, pairs below trigrams.
PRIORS = (8.0, 2.0)
#: A word is frequent if it makes up one in so many tokens: every task knows its count, those of rarer words are asked for.
OFTEN = 2_000_000
#: Tokens among which pairs and trigrams are looked for that are to be dealt; one that is missed makes a shard larger, nothing else.
LOOKED_AT = 8_000_000
#: Tokens per shard that the number of shards aims at; a key with more is split.
SHARD_TOKENS, LEAST_SHARDS = 1_000_000, 48
#: Distinct words a task adds up, and tokens over which it looks for frequent pairs, before it sends them.
_RUN, _WINDOW = 400_000, 4_000_000
_CHUNK = 1 << 20
_END = np.uint64(0x2545F4914F6CDD1D)
_START, _NONE = ~_END, np.uint64(0x5851F42D4C957F2D)


def mapped(values: np.ndarray) -> np.ndarray:
    """values in memory-mapped pages of their own."""
    if not len(values):
        return values
    out = np.frombuffer(mmap.mmap(-1, values.nbytes), values.dtype, len(values))
    out[:] = values
    return out


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with a directory of ones per 64-bit word and a skip over 64 values."""

    def __init__(self, values: np.ndarray):
        n, top = len(values), int(values[-1]) if len(values) else 0
        self.n, self.bits = n, max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.bits) - 1)
        high = (values >> np.uint64(self.bits)).astype(np.int64) + np.arange(n)
        words = np.zeros((int(high[-1]) >> 6) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
        packed = np.zeros((n * self.bits >> 6) + 2, np.uint64)
        if self.bits and n:
            at = np.arange(n, dtype=np.int64) * self.bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(packed, at >> 6, low << shift)
            over = np.flatnonzero((at & 63) + self.bits > 64)
            np.bitwise_or.at(packed, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        self.low, self.high = mapped(packed), mapped(words)
        self.ones = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))
        self.skips = values[::64].copy()

    def values(self) -> np.ndarray:
        """The whole sequence, for questions that touch most of it."""
        high = (np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(np.arange(self.n)) if self.bits else high

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        shift = (bit & 63).astype(np.uint64)
        low = self.low[bit >> 6] >> shift
        low |= np.where(shift > 0, self.low[(bit >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return low & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i: the i-th one of the high bits, minus i, before the low bits."""
        if len(i) * 4 > self.n:
            return self.values()[i]
        word = np.searchsorted(self.ones, i, "right") - 1
        left = i - self.ones[word]
        w, at = self.high[word], np.zeros(len(i), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            part = (w >> at) & np.uint64((1 << step) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            skip = left >= ones
            left = left - np.where(skip, ones, 0)
            at = at + np.where(skip, np.uint64(step), np.uint64(0))
        high = (word * 64 + at.astype(np.int64) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i) if self.bits else high

    def find(self, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position of the first value not below, within [first, end): successor search."""
        if len(value) * 8 > self.n:
            return np.clip(np.searchsorted(self.values(), value), first, end)
        a, b = first.copy(), end.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            below = self.get(middle) < value[open_]
            a[open_] = np.where(below, middle + 1, a[open_])
            b[open_] = np.where(below, b[open_], middle)
        return a

    def place(self, value: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the value is there) within [first, end), or anywhere."""
        if first is None:  # by skips over 64 values
            first = np.maximum(np.searchsorted(self.skips, value, "right") - 1, 0) * 64
            end = np.minimum(first + 65, self.n)
        at = self.find(value, first, end)
        there = at < end
        there[there] = self.get(at[there]) == value[there]
        return at, there


class Quantised:
    """Codes of values, of 16 bits if there are few levels; the levels are the distinct values."""

    def __init__(self, values: np.ndarray):
        self.levels, codes = np.unique(values, return_inverse=True)
        self.codes = mapped(codes.astype(np.uint16 if len(self.levels) <= 1 << 16 else np.uint32))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.levels[self.codes[i]]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, in sorted order."""
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(keys[0]) else np.zeros(0, np.int64)


class Trie:
    """Levels of one shard, from distinct trigrams (v, u, w) in that order: word v, context u before it, successor w, and the logs of
    their probabilities; the logs of what words and contexts leave to the level below; distinct pairs (v, w) with theirs."""

    def __init__(self, v, u, w, trigram_logs, pair_v, pair_w, pair_logs, leave_word, leave_context):
        self.names = EliasFano(np.unique(np.concatenate([u, w, pair_w])))
        names = self.names.get(np.arange(self.names.n))
        number = lambda x: np.searchsorted(names, x).astype(np.uint64)
        self.base = np.uint64(max(1, self.names.n))
        words, of_context, of_pair = _starts(v), _starts(v, u), _starts(pair_v, pair_w)
        self.words = EliasFano(v[words])
        rank = np.cumsum(np.isin(np.arange(len(v)), words)) - 1
        self.contexts = EliasFano(rank[of_context].astype(np.uint64) * self.base + number(u[of_context]))
        self.first_context = EliasFano(np.append(np.searchsorted(of_context, words), len(of_context)).astype(np.uint64))
        context = np.cumsum(np.isin(np.arange(len(v)), of_context)) - 1
        self.successors = EliasFano(context.astype(np.uint64) * self.base + number(w))
        self.first_successor = EliasFano(np.append(of_context, len(v)).astype(np.uint64))
        place = np.searchsorted(v[words], pair_v)
        self.pairs = EliasFano(place.astype(np.uint64) * self.base + number(pair_w))
        self.first_pair = EliasFano(np.searchsorted(place, np.arange(len(words) + 1)).astype(np.uint64))
        self.leave_word, self.leave_context = Quantised(leave_word), Quantised(leave_context)
        self.trigram_logs, self.pair_logs = Quantised(trigram_logs), Quantised(pair_logs)

    @staticmethod
    def _between(pointers: EliasFano, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pointers.get(i).astype(np.int64), pointers.get(i + 1).astype(np.int64)

    def ask(self, v, u, w, lowest: np.ndarray, below_word: np.ndarray, split: np.ndarray) -> np.ndarray:
        """log10 of p(w | u v): `lowest` is log10 of p(w), `below_word` log10 of p(w | v) where it is known elsewhere, else NaN.

        `split` is log10 of the prior where a context's successors are dealt over shards and its count divides elsewhere, else NaN.
        """
        out = np.where(np.isnan(below_word), lowest, below_word)
        dealt = ~np.isnan(split)
        out[dealt] += split[dealt]
        if not self.words.n or not len(v):
            return out
        distinct, turn = np.unique(np.concatenate([v, u, w]), return_inverse=True)
        (word, worded), (number, named) = self.words.place(distinct), self.names.place(distinct)
        n = len(v)
        tv, tu, tw = turn[:n], turn[n : 2 * n], turn[2 * n :]
        i = np.flatnonzero(worded[tv])
        at = word[tv[i]]
        # p(w | v) by its pair, or what the word leaves to p(w)
        own = np.isnan(below_word[i])
        j, a = i[own], at[own]
        known = named[tw[j]]
        pair, met = np.zeros(len(j), np.int64), np.zeros(len(j), bool)
        pair[known], met[known] = self.pairs.place(a[known].astype(np.uint64) * self.base + number[tw[j[known]]].astype(np.uint64), *self._between(self.first_pair, a[known]))
        out[j[met]] = self.pair_logs[pair[met]]
        out[j[~met]] += self.leave_word[a[~met]]
        # p(w | u v) by its trigram, or what the context leaves to p(w | v)
        known = named[tu[i]]
        i, at = i[known], at[known]
        context, met = self.contexts.place(at.astype(np.uint64) * self.base + number[tu[i]].astype(np.uint64), *self._between(self.first_context, at))
        i, context = i[met], context[met]
        known = named[tw[i]]
        place, met = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        place[known], met[known] = self.successors.place(context[known].astype(np.uint64) * self.base + number[tw[i[known]]].astype(np.uint64), *self._between(self.first_successor, context[known]))
        out[i[met]] = self.trigram_logs[place[met]]
        other = ~met & ~dealt[i]
        out[i[other]] += self.leave_context[context[other]]
        return out


# --- tokens of texts ---------------------------------------------------------------------------------------------------------


def _tokens(column: pa.Array):
    """(first row, end row, whether the run starts its text, u, v, w, row of w) of each run of texts.

    w are the tokens, an end after each text; v is the token before, or the start; u the one before that. Texts of more than a few
    MB come in several runs, each with the tokens before it.
    """
    held, fresh = (_NONE, _START), True
    for top, end, data, offsets, last in bk.pieces(column, _CHUNK):
        small = bk.lower(data)
        start, stop, row = bk.words(small, offsets)
        h, rows = bk.range_hash(bk.prefix(small), start, stop), end - top
        size = np.bincount(row, minlength=rows) + 1
        if not last:
            size[-1] -= 1
        w, owner = np.full(size.sum(), _END), np.repeat(np.arange(rows), size)
        w[np.arange(len(h)) + row] = h
        first = np.cumsum(size) - size
        first = first[size > 0]
        v = np.append(held[1], w[:-1])[: len(w)]
        v[first] = _START if fresh else held[1]
        u = np.append(held[0], v[:-1])[: len(w)]
        u[first] = _NONE if fresh else held[0]
        yield top, end, fresh, u, v, w, owner
        if len(w):
            held = (v[-1], w[-1])
        if last:
            held = (_NONE, _START)
        fresh = last


def _pair_name(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return bk.mixed(bk.mixed(x ^ np.uint64(0x27BB2EE687B0B0FD)) + y)


def _trigram_name(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return bk.mixed(_pair_name(u, v) ^ bk.mixed(w ^ np.uint64(0x165667B19E3779F9)))


def _merged(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, counts added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _starts(keys)
    return keys[first], *(np.add.reduceat(c[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64) for c in counts)


def _find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) in sorted names."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


# --- frequent words, pairs and trigrams ---------------------------------------------------------------------------------------

_WORDS = "shard int, names binary, own binary, every binary, totals binary"


def _count_words(batches):
    """Distinct words of what a task has read, with their counts in texts that are learned from and in all."""

    def sent(name, own, every):
        shard = (name % np.uint64(LEAST_SHARDS)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(LEAST_SHARDS + 1))
        cut = [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        columns = [[x[c].tobytes() for c in cut] for x in (name, own.astype(np.uint32), every.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(LEAST_SHARDS, dtype=np.int32)), *(pa.array(c, pa.binary()) for c in columns), pa.nulls(LEAST_SHARDS, pa.binary())], names=["shard", "names", "own", "every", "totals"])

    held: list[tuple] = []
    for batch in batches:
        learned = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
        for top, _, _, _, _, w, row in _tokens(batch.column("text")):
            held.append(_merged(w, learned[top + row].astype(np.int64), np.ones(len(w), np.int64)))
            if sum(len(x[0]) for x in held) > _RUN:
                held = [_merged(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > _RUN // 2:
                    yield sent(*held.pop())
    if held:
        yield sent(*_merged(*map(np.concatenate, zip(*held, strict=True))))


def _add_words(least):
    """Words of a shard: those that are frequent, and how many tokens and distinct words there are."""

    def run(key, table):
        name, own, every = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("names", np.uint64), ("own", np.uint32), ("every", np.uint32)))
        name, own, every = _merged(name, own, every)
        totals = np.array([own.sum(), (own > 0).sum(), every.sum()])
        kept = every >= least
        row = [key[0].as_py(), *(x[kept].tobytes() for x in (name, own, every)), totals.tobytes()]
        return pa.table([pa.array([c], t) for c, t in zip(row, [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["shard", "names", "own", "every", "totals"])

    return run


@dataclass
class Known:
    """What every task holds: the frequent words, and the pairs and trigrams around split words that are frequent enough to be dealt."""

    names: np.ndarray  # of frequent words, sorted
    own: np.ndarray  # counts in texts that are learned from
    lowest: np.ndarray  # p(w) of each
    rare: float  # the mean p(w) of all other words
    top: np.ndarray  # words with more tokens than a shard should have
    split: int
    shards: int
    tokens: int
    mass: int  # tokens and distinct words that are learned from, and one
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_own: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_every: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_p: np.ndarray = field(default_factory=lambda: np.zeros(0))  # p(w | v) where v is split, else NaN
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of split words: p(w | v) over p(w) of all other words
    trigrams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    trigram_logs: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def p(self, code: np.ndarray) -> np.ndarray:
        """p(w) by code: 0 for a rare word, else one more than its place."""
        return np.append(self.rare, self.lowest)[code]

    def code(self, words: np.ndarray) -> np.ndarray:
        at, there = _find(self.names, words)
        return np.where(there, at + 1, 0)

    def codes(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of a run of tokens and of the two before each: most are those of the tokens before in the run."""
        out = [self.code(w)]
        for words, later in ((v, w), (u, v)):
            code = np.append(0, out[-1][:-1])[: len(words)]
            new = np.flatnonzero(np.append(True, words[1:] != later[:-1])[: len(words)])
            code[new] = self.code(words[new])
            out.append(code)
        return out[2], out[1], out[0]

    def is_top(self, code: np.ndarray) -> np.ndarray:
        return np.append(False, self.top)[code]

    def split_pair(self, v: np.ndarray, w: np.ndarray, v_code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether its trigrams are dealt over shards) of each pair."""
        count, dealt = np.zeros(len(v), np.int64), np.zeros(len(v), bool)
        i = np.flatnonzero(self.is_top(v_code)) if len(self.pairs) else ()
        if len(i):
            at, there = _find(self.pairs, _pair_name(v[i], w[i]))
            there[there] = self.pair_every[at[there]] >= self.split
            count[i[there]] = self.pair_own[at[there]]
            dealt[i] = there
        return count, dealt

    def divided(self, v: np.ndarray, w_code: np.ndarray, of_pair: np.ndarray) -> np.ndarray:
        """log10 of what a trigram's pair divides by: the trigram after it if w is split, its own if it starts a text and starts are split."""
        out = np.where(self.is_top(w_code), -np.log10(of_pair + PRIORS[1]), 0.0)
        at, there = _find(self.names, np.array([_START]))
        if there[0] and self.top[at[0]]:
            out[v == _START] -= np.log10(self.own[at[0]] + PRIORS[1])
        return out

    def below(self, v_code: np.ndarray, v: np.ndarray, w: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """p(w | v) where v is split, NaN elsewhere: that of a frequent pair, or the share of the rest that p(w) has."""
        out = np.full(len(v), np.nan)
        i = np.flatnonzero(self.is_top(v_code))
        if len(i):
            at, there = _find(self.pairs, _pair_name(v[i], w[i]))
            out[i] = np.where(there, self.pair_p[at] if len(self.pairs) else 0.0, self.rest[v_code[i] - 1] * lowest[i])
        return out


def _known(words: list[dict], often: int) -> tuple[Known, int, int]:
    """(what is known of words, tokens that are learned from, distinct ones)."""
    name, own, every = (np.frombuffer(b"".join(r[c] for r in words), t) for c, t in (("names", np.uint64), ("own", np.int64), ("every", np.int64)))
    n, kinds, tokens = np.sum([np.frombuffer(r["totals"], np.int64) for r in words], axis=0).tolist() if words else (0, 0, 0)
    end = np.flatnonzero(name == _END)  # texts start as often as they end
    name, own, every = np.append(name, np.full(len(end), _START)), np.append(own, own[end]), np.append(every, every[end])
    order = np.argsort(name)
    name, own, every = name[order], own[order], every[order]
    seen = (own > 0) & (name != _START)
    shared = n - int(own[seen].sum()) + kinds - int(seen.sum()) + 1  # of rare words and one that was never seen
    rare = shared / (n + kinds + 1) / (kinds - int(seen.sum()) + 1)
    split = max(SHARD_TOKENS, -(-tokens // often))
    lowest = np.where(seen, (own + 1) / (n + kinds + 1), rare)
    return Known(name, own, lowest, rare, (every >= split) & (name != _END), split, max(LEAST_SHARDS, -(-tokens // SHARD_TOKENS)), tokens, n + kinds + 1), n, kinds


_NAMED = "name long, n long"
_COUNTED = "name long, u long, v long, w long, own long, every long"


def _around_top(known: Known, column: pa.Array):
    """(first row, row, names, and the words) of the pairs and trigrams around split words in each run; u of a pair is the end."""
    for top, _, _, u, v, w, row in _tokens(column):
        code, middle = known.is_top(known.code(w)), known.is_top(known.code(v))
        pair, three = np.flatnonzero(code | middle), np.flatnonzero(middle)
        name = np.append(_pair_name(v[pair], w[pair]), _trigram_name(u[three], v[three], w[three]))
        yield top, np.append(row[pair], row[three]), name, np.append(np.full(len(pair), _END), u[three]), np.append(v[pair], v[three]), np.append(w[pair], w[three]), len(w)


def _candidates(shared, often: int):
    """Names that make up a quarter of what is frequent in some window of a task; what is left out never adds up to more than that quarter."""

    def run(batches):
        held, size = [], 0

        def sent():
            name, n = _merged(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            kept = n > size / (4 * often)
            return pa.RecordBatch.from_arrays([pa.array(name[kept].view(np.int64)), pa.array(n[kept])], names=["name", "n"])

        for batch in batches:
            for _, _, name, *_, n in _around_top(shared.value, batch.column("text")):
                held.append(name)
                size += n
                if size > _WINDOW:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


def _count_named(shared, wanted):
    def run(batches):
        for batch in batches:
            learned = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            for top, row, name, u, v, w, _ in _around_top(shared.value, batch.column("text")):
                there = np.flatnonzero(_find(wanted.value, name)[1])
                order = there[np.argsort(name[there], kind="stable")]
                first = _starts(name[order])
                own = learned[top + row[order]].astype(np.int64)
                counts = [np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for x in (own, np.ones(len(order), np.int64))]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[order][first].view(np.int64)) for x in (name, u, v, w)), *map(pa.array, counts)], names=[x.split()[0] for x in _COUNTED.split(", ")])

    return run


def _with_frequent(rows: DataFrame, known: Known, often: int, share: float = 1.0) -> Known:
    """known with the frequent pairs and trigrams around split words, looked for in a share of the rows and then counted in all, where there are any."""
    if not known.top.any():
        return known
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(known)
    least = 0.75 * known.tokens / often
    looked = rows.sample(share, 0) if share < 1 else rows
    names = looked.mapInArrow(_candidates(shared, often), _NAMED).groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least * share).select("name").toArrow()
    if not names.num_rows:
        return known
    wanted = context.broadcast(np.sort(np.asarray(names.column("name")).view(np.uint64)))
    t = rows.mapInArrow(_count_named(shared, wanted), _COUNTED).groupBy("name", "u", "v", "w").agg(F.sum("own").alias("own"), F.sum("every").alias("every")).toArrow()
    name, u, v, w = (np.asarray(t.column(c)).view(np.uint64) for c in ("name", "u", "v", "w"))
    own, every = (np.asarray(t.column(c)) for c in ("own", "every"))
    order = np.argsort(name)
    name, u, v, w, own, every = (x[order] for x in (name, u, v, w, own, every))
    two = u == _END
    known.pairs, known.pair_own, known.pair_every = name[two], own[two], every[two]
    code, lowest = known.code(v[two]), known.p(known.code(w[two]))
    first = known.is_top(code)
    total = np.append(0, known.own)[code]
    known.pair_p = np.where(first, (own[two] + PRIORS[0] * lowest) / (total + PRIORS[0]), np.nan)
    listed, free = (np.bincount(code[first], x[first], len(known.names) + 1)[1:] for x in (known.pair_p, lowest))
    known.rest = (1 - listed) / np.maximum(1 - free, 1e-12)
    three = ~two & (every >= known.split)
    three[three] = known.split_pair(v[three], w[three], known.code(v[three]))[1]
    v, w, own = v[three], w[three], own[three]
    code, last = known.code(v), known.code(w)
    of_pair = known.split_pair(v, w, code)[0]
    p2 = (of_pair + PRIORS[0] * (np.append(0, known.own)[last] + 1) / known.mass) / (np.append(0, known.own)[code] + PRIORS[0])
    known.trigrams, known.trigram_logs = name[three], np.log10(own + PRIORS[1] * p2) + known.divided(v, last, of_pair)
    return known


# --- trigrams to their shards, answers back to their runs -----------------------------------------------------------------------

_SENT = "kind int, shard long, run long, rows binary, sizes binary, a binary, b binary, c binary"
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_SENT_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
_OWN, _PACKET, _ANSWER, _COUNTS = range(4)
_ZSTD = "zstd"


def _packed(x: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + pa.Codec(_ZSTD).compress(raw, asbytes=True)


def _unpacked(b: bytes, kind) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.Codec(_ZSTD).decompress(b[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_SENT_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SENT_TYPES, strict=True)], names=_SENT_NAMES)


def _shard_of(known: Known, u, v, w, code) -> np.ndarray:
    """By middle word; by its pair with the last word if it is split, by trigram if the pair is."""
    name, i = v, np.flatnonzero(known.is_top(code))
    if len(i):
        name = v.copy()
        name[i] = _pair_name(v[i], w[i])
        i = np.flatnonzero(known.split_pair(v, w, code)[1])
        name[i] = _trigram_name(u[i], v[i], w[i])
    return (bk.mixed(name ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(known.shards)).astype(np.int64)


_ASKED = "bucket int, names binary, shards binary, own binary"


def _added(name, shard, own):
    """Distinct (name, shard) in order, counts added up."""
    order = np.lexsort((shard, name))
    name, shard = name[order], shard[order]
    first = _starts(name, shard)
    return name[first], shard[first], np.add.reduceat(own[order], first) if len(first) else own


def _ask_rare(shared):
    """Words that are not frequent, the shards of the trigrams that they end, and how often those are learned from."""

    def sent(name, shard, own):
        bucket = (name % np.uint64(LEAST_SHARDS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(LEAST_SHARDS + 1))
        cut = [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        columns = [[x[c].tobytes() for c in cut] for x in (name, shard.astype(np.uint32), own.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(LEAST_SHARDS, dtype=np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=[x.split()[0] for x in _ASKED.split(", ")])

    def run(batches):
        known, held = shared.value, []
        for batch in batches:
            learned = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            for top, _, _, u, v, w, row in _tokens(batch.column("text")):
                i = np.flatnonzero(known.code(w) == 0)
                held.append(_added(w[i], _shard_of(known, u[i], v[i], w[i], known.code(v[i])), learned[top + row[i]].astype(np.int64)))
                if sum(len(x[0]) for x in held) > _RUN:
                    held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > _RUN // 2:
                        yield sent(*held.pop())
        if held:
            yield sent(*_added(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _tell_rare(key, table):
    """How often each word of a bucket is learned from, to every shard that asked."""
    name, shard, own = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("names", np.uint64), ("shards", np.uint32), ("own", np.uint32)))
    name, shard, own = _added(name, shard, own.astype(np.int64))
    if not len(name):
        return pa.Table.from_batches([_batch([])])
    first = _starts(name)
    count = np.repeat(np.add.reduceat(own, first), np.diff(np.append(first, len(name)))).astype(np.uint32)
    kept = np.flatnonzero(count)
    kept = kept[np.argsort(shard[kept], kind="stable")]
    edge = np.append(_starts(shard[kept]), len(kept))
    rows = [(_COUNTS, int(shard[kept[a]]), 0, None, None, name[kept[a:b]].tobytes(), count[kept[a:b]].tobytes(), None) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.Table.from_batches([_batch(rows)])


def _send(shared):
    """Trigrams of each run by shard, and a row for the run with what is known of its texts there and then."""

    def run(batches):
        known, part, number = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            held_out = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            ids = batch.column("doc_id")
            for top, end, fresh, u, v, w, row in _tokens(batch.column("text")):
                number += int(fresh)
                name, n = part << 36 | number, end - top
                codes = known.codes(u, v, w)
                common = codes[2] > 0
                count = np.append(0, known.own)[codes[2]]
                logs = np.bincount(row, np.where(common, np.log10(count + 1), 0.0), n)
                score = np.zeros(n)
                at, there = _find(known.trigrams, _trigram_name(u, v, w)) if len(known.trigrams) else (None, np.zeros(len(w), bool))
                if there.any():
                    score += np.bincount(row[there], known.trigram_logs[at[there]], n)
                own = np.stack([np.bincount(row, minlength=n), np.bincount(row, common & (count > 0), n), logs, score]).astype(float)
                doc = ids.slice(top, n)
                texts = np.stack([np.asarray(doc.fill_null(0)), np.asarray(doc.is_null()), held_out[top:end]]).astype(np.int64) if fresh else np.zeros((3, 0), np.int64)
                shard = _shard_of(known, u, v, w, codes[1])
                shard[there] = known.shards
                order = np.argsort(shard, kind="stable")
                edge = np.searchsorted(shard[order], np.arange(known.shards + 1))
                rows = [(_OWN, name % known.shards, name, _packed(texts.ravel()), _packed(own.ravel()), None, None, None)]
                for s in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                    i = order[edge[s] : edge[s + 1]]
                    met, size = np.unique(row[i], return_counts=True)
                    numbers = np.concatenate([c[i] for c in codes]).astype(np.uint32)
                    words = np.concatenate([x[i] for x in (u, v, w)])[numbers == 0]
                    flag = held_out[top + met].astype(np.uint32)
                    rows.append((_PACKET, s, name, _packed((met << 1 | flag).astype(np.uint32)), _packed(size.astype(np.uint32)), _packed(numbers), words.tobytes(), None))
                yield _batch(rows)

    return run


def _answer(shared):
    """Adds up the trigrams of a shard, builds its trie from those that are learned from and answers all: sums by text of each run."""

    def run(key, table):
        known = shared.value
        kinds = np.asarray(table.column("kind"))
        out = table.filter(pa.array(kinds == _OWN)).to_pylist()
        rows = [tuple(r[n] for n in _SENT_NAMES) for r in out]
        packets = table.filter(pa.array(kinds == _PACKET)).to_pylist()
        if not packets:
            return pa.Table.from_batches([_batch(rows)])
        sizes = [_unpacked(p["sizes"], np.uint32) for p in packets]
        edge = np.append(0, np.cumsum([x.sum(dtype=np.int64) for x in sizes]))
        code, word = np.empty((3, edge[-1]), np.uint32), np.empty((3, edge[-1]), np.uint64)
        for p, a, b in zip(packets, edge[:-1], edge[1:], strict=True):
            code[:, a:b] = _unpacked(p.pop("a"), np.uint32).reshape(3, -1)
            mine = np.append(np.uint64(0), known.names)[code[:, a:b]]
            mine[code[:, a:b] == 0] = np.frombuffer(p.pop("b"), np.uint64)
            word[:, a:b] = mine
        u, v, w = word
        texts = [_unpacked(p["rows"], np.uint32) for p in packets]
        edge = np.append(0, np.cumsum([len(x) for x in texts]))
        texts = np.concatenate(texts)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.concatenate(sizes))
        learned = (texts[owner] & 1 == 0).astype(np.int64)
        order = np.lexsort((w, u, v))
        first = _starts(v[order], u[order], w[order])
        turn = np.empty(len(order), np.int32)
        turn[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
        own = np.add.reduceat(learned[order], first)
        one = order[first]
        u, v, w, code = u[one], v[one], w[one], code[:, one].astype(np.int64)
        del word, order, one, learned
        told = table.filter(pa.array(kinds == _COUNTS))
        names, counts = _merged(*(np.frombuffer(b"".join(told.column(c).to_pylist()), t) for c, t in (("a", np.uint64), ("b", np.uint32))))
        count, asked = np.append(0, known.own)[code[2]], np.flatnonzero(code[2] == 0)
        at, there = _find(names, w[asked])
        count[asked[there]] = counts[at[there]]
        lowest = (count + 1) / known.mass
        # counts of words, contexts and pairs; those of split words and pairs are known, contexts of split words divide as pairs
        at_word, at_context = _starts(v), _starts(v, u)
        spread = lambda starts, x: np.repeat(x, np.diff(np.append(starts, len(v))))
        top = known.is_top(code[1])
        of_word = np.where(top, np.append(0, known.own)[code[1]], spread(at_word, np.add.reduceat(own, at_word)))
        of_context = spread(at_context, np.add.reduceat(own, at_context))
        total, dealt = known.split_pair(v, w, code[1])
        by_pair = np.lexsort((w, v))
        at_pair = _starts(v[by_pair], w[by_pair])
        pair = by_pair[at_pair]
        of_pair = np.empty(len(v), np.int64)
        of_pair[by_pair] = np.repeat(np.add.reduceat(own[by_pair], at_pair), np.diff(np.append(at_pair, len(v))))
        of_pair = np.where(dealt, total, of_pair)
        p2 = (of_pair + PRIORS[0] * lowest) / (of_word + PRIORS[0])
        below = np.where(top, p2, np.nan)
        p3 = (own + PRIORS[1] * p2) / np.where(top, 1.0, of_context + PRIORS[1])
        kept = np.flatnonzero(own)
        pair = pair[(of_pair[pair] > 0) & np.isnan(below[pair])]
        words, contexts = kept[_starts(v[kept])], kept[_starts(v[kept], u[kept])]
        pair = pair[np.isin(v[pair], v[words])]
        leave = lambda prior, total: np.log10(prior / (total + prior))
        trie = Trie(v[kept], u[kept], w[kept], np.log10(p3[kept]), v[pair], w[pair], np.log10(p2[pair]), leave(PRIORS[0], of_word[words]), leave(PRIORS[1], of_context[contexts]))
        logs = trie.ask(v, u, w, np.log10(lowest), np.log10(below), np.where(top, math.log10(PRIORS[1]), np.nan)) + known.divided(v, code[2], of_pair)
        score = np.bincount(owner, logs[turn], len(texts))
        # rare words are middle words of their shard only: what they add to the base
        rare = (code[1] == 0) & (v != _START)
        word = np.where(rare, np.log10(of_word + 1.0), 0.0)
        base, seen = np.bincount(owner, word[turn], len(texts)), np.bincount(owner, (rare & (of_word > 0))[turn], len(texts))
        for p, a, b in zip(packets, edge[:-1], edge[1:], strict=True):
            rows.append((_ANSWER, key[0].as_py(), p["run"], _packed((texts[a:b] >> 1).astype(np.uint32)), None, _packed(score[a:b]), _packed(base[a:b]), _packed(seen[a:b].astype(np.uint32))))
        return pa.Table.from_batches([_batch(rows)])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _gather(key, table):
    """The texts of a run with their sums."""
    rows = table.to_pylist()
    texts = next(t for t in (_unpacked(r["rows"], np.int64) for r in rows if r["kind"] == _OWN) if len(t)).reshape(3, -1)
    sums = np.zeros((4, texts.shape[1]))
    for r in rows:
        if r["kind"] == _OWN:
            sums += _unpacked(r["sizes"], np.float64).reshape(4, -1)
        else:
            i = _unpacked(r["rows"], np.uint32)
            sums[1, i] += _unpacked(r["c"], np.uint32)
            sums[2, i] += _unpacked(r["b"], np.float64)
            sums[3, i] += _unpacked(r["a"], np.float64)
    ids = pa.array(texts[0], mask=texts[1] == 1)
    return pa.table([ids, pa.array(texts[2] == 1), *(pa.array(sums[i].astype(np.int64)) for i in (0, 1)), pa.array(sums[2]), pa.array(sums[3])], names=[x.split()[0] for x in _SCORED.split(", ")])


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs (doc_id, text).

    Learned from the rows that `held_out` (boolean; by default the fold of the id) leaves. A null text is empty: one end
    token. Rows that repeat have a result each; a row without id is learned from. A text of any length is read in pieces. Other
    columns are left out; an empty table gives an empty one. The rows of docs should come in the same order whenever a part is read
    again, as those of a stored table do.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(1, size // 8 // OFTEN)  # tokens are at least an eighth of the bytes or so; only which words are asked for follows from it
    counted = rows.mapInArrow(_count_words, _WORDS).groupBy("shard").applyInArrow(_add_words(least), _WORDS).toArrow().to_pylist()
    known, n, kinds = _known(counted, OFTEN)
    shared = context.broadcast(_with_frequent(rows, known, max(1, known.tokens // known.split), min(1.0, LOOKED_AT / max(1, known.tokens))))
    told = rows.mapInArrow(_ask_rare(shared), _ASKED).groupBy("bucket").applyInArrow(_tell_rare, _SENT)
    answers = rows.mapInArrow(_send(shared), _SENT).union(told).groupBy("shard").applyInArrow(_answer(shared), _SENT)
    sums = answers.groupBy("run").applyInArrow(_gather, _SCORED)
    unit = math.log10(n + 1 + kinds)
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        F.round(F.col("logs") - F.col("n_tokens") * unit, 6).alias("base_score"), F.round("score", 6).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return score(docs)
