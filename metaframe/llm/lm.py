"""Language-model scoring by deleted interpolation of word bigrams, unigrams and a uniform distribution.

    P(w | h) = l2[b] * c(h, w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1)

b is the bucket of the context h by its relative frequency, in powers of two. The mixture weights of each bucket
are learned by expectation-maximisation on counts held out of training: of the training documents one part in
four gives the held-out events, the others the counts that predict them. Scores then use the counts of all
training documents. A context that training lacks has a bucket of its own, whose l2 is 0, so P sums to 1 over the
V words and the unknown one, whatever the context.

Every word and every pair of words is counted, however many there are, in two scans:

1. Words, and the pairs that may be hot: those of a share of HOT / 2 in some block of tokens. The WORDS most frequent
   words are broadcast with their counts; all other words are rare.
2. Events: a document's pairs with their numbers, sorted and packed by blocks of documents, and dealt by pair to
   buckets of about BUCKET tokens. A bucket has all events of its pairs, so it has their counts. Pairs with one rare
   word are dealt by that word, whose own count then is there too. Pairs of two rare words, a small part, are joined
   with the table of words. Hot pairs (at most 2 / HOT) stay with their documents; only their counts are added up.

Buckets give the held-out events by context and estimate, from which the weights are learned; then their logarithms
are added up by block of documents. What travels is some 3 bytes an event each way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.llm.kernels import U64, Texts, batches, trim
from metaframe.llm.shared import written

#: Most words that are broadcast; all others are counted in the buckets.
WORDS = 1 << 20
#: Relative frequency from which a pair is hot: it may be from half of that on.
HOT = 2e-5
#: Tokens that a scan aggregates at once, and tokens of a bucket.
BLOCK, BUCKET = 600_000, 1_000_000
BUCKETS = 24
END, START = U64(0xE17D), U64(0x57A27)
TRAIN, HELD, TEST = 0, 1, 2
DOC, TOPS, PAIRS, RARE, BOTH_RARE = range(5)
_ODD = 0x9E3779B97F4A7C15


def _rest(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _part(id_col: str) -> Column:
    return F.when(_rest(id_col) == 1, TEST).when(_rest(id_col) == 0, HELD).otherwise(TRAIN).cast("int")


class Tokens:
    """Tokens of some batches with an end for each document; doc is their document's place in all of these batches."""

    def __init__(self, columns: list[pa.Array]):
        parts, docs, size = [], 0, 0
        firsts = []
        for column in columns:
            words = Texts(column).words()
            counts = np.diff(words.first)
            n = len(counts)
            first = words.first + np.arange(n + 1)
            hashes = np.full(first[-1], END)
            hashes[np.arange(len(words.starts)) + np.repeat(np.arange(n), counts)] = words.hashes()
            parts.append((hashes, np.repeat(np.arange(docs, docs + n), counts + 1)))
            firsts.append(first[:-1] + size)
            docs, size = docs + n, size + len(hashes)
        self.hashes, self.doc = (np.concatenate([x[i] for x in parts]) for i in range(2))
        self.first = np.append(np.concatenate(firsts), size)

    def before(self, values: np.ndarray, start: int) -> np.ndarray:
        """For each token, the value of the one before it; `start` for a document's first."""
        out = np.concatenate(([start], values[:-1])).astype(values.dtype)[: len(values)]
        out[self.first[:-1]] = start
        return out


def _blocks(stream: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[Tokens, list[pa.RecordBatch]]]:
    """Batches whose texts have about BLOCK tokens together, and these tokens."""
    held, size = [], 0
    for batch in batches(stream):
        held.append(batch)
        size += batch.column(column).nbytes // 6
        if size >= BLOCK:
            yield Tokens([b.column(column) for b in held]), held
            held, size = [], 0
            trim()
    if held:
        yield Tokens([b.column(column) for b in held]), held
    trim()


def _of(batches_: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.concatenate([b.column(column).to_numpy(zero_copy_only=False) for b in batches_])


# Packed arrays: the bytes of each array's numbers in the fewest bytes, plane by plane, compressed.


def pack(*arrays: np.ndarray) -> bytes:
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        head += [len(a), a.itemsize, a.dtype.kind == "f"]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, dtype=np.int64).tobytes() + b"".join(body))


def unpack(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 3 * n, 8).reshape(-1, 3).tolist(), 8 + 24 * n, []
    for size, width, real in head:
        flat = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        values = np.ascontiguousarray(flat).view({(4, 1): np.float32, (8, 1): np.float64}.get((width, real), f"u{width}")).reshape(-1)
        out.append(values.astype(np.float64 if real else np.int64))
        at += size * width
    return out


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=0)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the first most important; where runs of equal ones begin in it; and their lengths."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    return order, begin, np.diff(np.append(begin, len(order)))


@dataclass
class Model:
    """What every step needs: the frequent words (sorted hashes) with their counts, START's behind them, hot pairs, and the corpus' sizes.

    Counts are pairs: in TRAIN documents, and in all training documents. A word's code is its place, START's is the last.
    """

    keys: np.ndarray
    train: np.ndarray
    every: np.ndarray
    tokens: tuple[int, int]
    types: int
    hot: np.ndarray
    weights: np.ndarray
    buckets: int

    @property
    def size(self) -> int:
        return len(self.keys) + 1

    @property
    def bits(self) -> int:
        return max(33, (self.size * self.size - 1).bit_length())

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for rare ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def spread(self, key: np.ndarray) -> np.ndarray:
        """A pair's key, scattered over the same bits; an odd factor can be undone."""
        return ((key.astype(U64) * U64(_ODD)) & U64((1 << self.bits) - 1)).astype(np.int64)

    def gathered(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(pow(_ODD, -1, 1 << 64))) & U64((1 << self.bits) - 1)).astype(np.int64)

    def bucket_of(self, key: np.ndarray, bits: int) -> np.ndarray:
        return (key >> (bits - 32)) * self.buckets >> 32

    def context(self, count: np.ndarray, which: int, start: np.ndarray | bool = False) -> np.ndarray:
        """The bucket of contexts: 0 those that are not there, 1 START, then by relative frequency from 2**-22 on."""
        with np.errstate(divide="ignore"):
            octave = np.floor(np.log2(np.maximum(count, 1) / max(self.tokens[which], 1))) + 22
        return np.where(count > 0, np.where(start, 1, 2 + np.clip(octave, 0, BUCKETS - 3)), 0).astype(np.int64)

    def log10p(self, context: np.ndarray, start: np.ndarray | bool, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P by the counts of context, pair and word in all training documents."""
        w = self.weights[self.context(context, 1, start)]
        p2 = pair / np.maximum(context, 1)
        return np.log10(w[:, 0] * p2 + w[:, 1] * word / max(self.tokens[1], 1) + w[:, 2] / (self.types + 1))

    def base(self, word: np.ndarray) -> np.ndarray:
        return np.log10((word + 0.5) / (self.tokens[1] + 0.5 * (self.types + 1)))

    def held_events(self, context: np.ndarray, start: np.ndarray | bool, pair: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Held-out events by context's bucket and, in steps of a quarter octave, the estimates of pair and word; all counts are of TRAIN."""
        octave = lambda p: np.where(p > 0, 400 + np.round(4 * np.log2(np.maximum(p, 1e-30))), 0).astype(np.int64)
        keys = self.context(context, 0, start), octave(pair / np.maximum(context, 1)), octave(word / max(self.tokens[0], 1))
        order, begin, _ = _runs(*keys)
        return *(k[order][begin] for k in keys), np.add.reduceat(n[order], begin) if len(begin) else n


def learn_weights(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, n: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """(l2, l1, l0) of each bucket by expectation-maximisation; a bucket without events has the first guess. Bucket 0 has no l2."""
    p = np.stack([p2, p1, np.full(len(n), 1 / (types + 1))], axis=1)
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    mass = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        for k in range(3):
            weights[:, k] = np.where(mass > 0, np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) / np.maximum(mass, 1), weights[:, k])
        weights = np.maximum(weights, 1e-4)  # no event, seen or not, is impossible
        weights[0, 0] = 0
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in TRAIN and HELD documents; and, with their context, pairs of a share of HOT / 2 in a block."""
    for t, held in _blocks(stream, 0):
        found, place = np.unique(t.hashes, return_inverse=True)
        flag = (_of(held, 1) == HELD)[t.doc]
        n, h = np.bincount(place, minlength=len(found)), np.bincount(place[flag], minlength=len(found))
        pair, m = np.unique(t.before(place, len(found)) * len(found) + place, return_counts=True)
        pair, m = pair[m >= max(2, HOT / 2 * len(place))], m[m >= max(2, HOT / 2 * len(place))]
        before = np.append(found, START)[pair // len(found)]
        words = np.concatenate([found, found[pair % len(found)]]).view(np.int64)
        none = np.zeros(len(found), np.int64)
        yield pa.record_batch(
            [pa.array(words), pa.array(np.concatenate([none, before.view(np.int64)]), mask=np.arange(len(words)) < len(found)), pa.array(np.concatenate([n - h, m])), pa.array(np.concatenate([h, m * 0]))],
            names=["word", "before", "train", "held"],
        )


_ROWS = "kind int, place long, chunk long, idx int, id {id}, held_out boolean, n_tokens long, known long, base double, h long, w long, blob binary"


def _events(model: Broadcast, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a block of documents: the documents; its hot pairs; events of pairs and of rare words, by bucket; and pairs of rare words."""

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = max(len(c) for c in columns.values())
        return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def dealt(kind: int, bucket: np.ndarray, order: np.ndarray, key: np.ndarray, rest: list[np.ndarray], chunk: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket; order sorts by bucket and key."""
        bucket, key, rest = bucket[order], key[order], [x[order] for x in rest]
        if not len(key):
            return
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = [(int(bucket[a]), pack(_steps(key[a:b]), *(x[a:b] for x in rest))) for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True)]
        yield rows(kind=pa.array(np.full(len(parts), kind), pa.int32()), place=pa.array([p for p, _ in parts], pa.int64()), chunk=pa.array(np.full(len(parts), chunk)), blob=pa.array([x for _, x in parts], pa.binary()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        chunk = TaskContext.get().partitionId() << 32
        for t, held in _blocks(stream, 2):
            part, docs = _of(held, 1).astype(np.int64), len(t.first) - 1
            w = m.codes(t.hashes)
            h = t.before(w, m.size - 1)
            common = w >= 0
            base = np.zeros(len(w))
            base[common] = m.base(m.every[w[common]])
            yield rows(
                kind=pa.array(np.full(docs, DOC), pa.int32()), place=pa.array(np.full(docs, chunk)), chunk=pa.array(np.full(docs, chunk)), idx=pa.array(np.arange(docs), pa.int32()), id=pa.chunked_array([b.column(0) for b in held]).combine_chunks(), held_out=pa.array(part == TEST),
                n_tokens=pa.array(np.diff(t.first)), known=pa.array(np.bincount(t.doc[common], minlength=docs)), base=pa.array(np.bincount(t.doc, weights=base, minlength=docs)),
            )
            both = np.flatnonzero(common & (h >= 0))
            key = h[both] * m.size + w[both]
            order, begin, n = _runs(key, t.doc[both])
            key, doc = key[order][begin], t.doc[both][order][begin]
            at = np.minimum(np.searchsorted(m.hot, key), max(len(m.hot) - 1, 0))
            hot = m.hot[at] == key if len(m.hot) else np.zeros(len(key), bool)
            if hot.any():
                yield rows(kind=pa.array([TOPS], pa.int32()), place=pa.array([chunk], pa.int64()), chunk=pa.array([chunk], pa.int64()), blob=pa.array([pack(_steps(at[hot]), doc[hot], n[hot] * 4 + part[doc[hot]])], pa.binary()))
            key, doc, n = m.spread(key[~hot]), doc[~hot], n[~hot]
            yield from dealt(PAIRS, m.bucket_of(key, m.bits), np.argsort(key, kind="stable"), key, [doc, n * 4 + part[doc]], chunk)
            # events of one rare word: with a frequent context, in a frequent word's place, or for the word's own count alone
            rare = lambda at: (t.hashes[at] >> U64(2)).astype(np.int64)  # noqa: E731, B023
            late, early, two = np.flatnonzero(~common & (h >= 0)), np.flatnonzero(common & (h < 0)), np.flatnonzero(~common & (h < 0))
            own, doc = np.concatenate([rare(late), rare(early - 1), rare(two)]), t.doc[np.concatenate([late, early, two])]
            side = np.repeat([0, 1, 2], [len(late), len(early), len(two)])
            other = np.concatenate([h[late], w[early], two * 0])
            yield from dealt(RARE, m.bucket_of(own, 62), np.argsort(own, kind="stable"), own, [side, other, doc, part[doc]], chunk)
            if len(two):
                yield rows(kind=pa.array(np.full(len(two), BOTH_RARE), pa.int32()), place=pa.array(np.full(len(two), chunk)), chunk=pa.array(np.full(len(two), chunk)), idx=pa.array(t.doc[two], pa.int32()), h=pa.array(t.hashes[two - 1].view(np.int64)), w=pa.array(t.hashes[two].view(np.int64)), n_tokens=pa.array(part[t.doc[two]]))
            chunk += 1

    return run


def _sums(inverse: np.ndarray, size: int, n: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in TRAIN and in HELD documents."""
    return tuple(np.bincount(inverse, weights=n * (part == p), minlength=size).astype(np.int64) for p in (TRAIN, HELD))


def _by_chunk(chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by chunk (they come as runs), the chunks, and their sizes."""
    order = np.argsort(chunk, kind="stable")
    found, n = np.unique(chunk, return_counts=True)
    return order, found, n


def _paired(model: Broadcast, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by kind and place: each bucket's events with the counts of their pairs, and in `held` its held-out events; other rows as they are.

    The held-out events of a task's hot pairs are counts by pair, which follow at its end.
    """

    def packed(kind: int, place: int, blob: bytes, held: bytes) -> pa.RecordBatch:
        own = {"kind": kind, "place": place, "blob": blob, "held": held}
        return pa.record_batch([pa.array([own.get(f.name)], f.type) for f in schema], schema=schema)

    def of(kind: int, place: int, parts: list[tuple[int, bytes]], m: Model) -> pa.RecordBatch:
        events = [[np.cumsum(a[0]), *a[1:]] for a in (unpack(x) for _, x in parts)]
        chunk = np.repeat([c for c, _ in parts], [len(e[0]) for e in events])
        columns = [np.concatenate(x) for x in zip(*events, strict=True)]
        if kind == PAIRS:
            key, doc, n, part = columns[0], columns[1], columns[2] >> 2, columns[2] & 3
            found, inverse = np.unique(key, return_inverse=True)
            train, held = _sums(inverse, len(found), n, part)
            h, w = np.divmod(m.gathered(found), m.size)
            at = np.flatnonzero(held)
            told = m.held_events(m.train[h[at]], h[at] == m.size - 1, train[at], m.train[w[at]], held[at])
            order, chunks, sizes = _by_chunk(chunk)
            return packed(kind, place, pack(_steps(found), train + held, chunks, sizes, inverse[order], doc[order], n[order]), pack(*told))
        own, side, other, doc, part = columns
        word, inverse = np.unique(own, return_inverse=True)
        one = np.ones(len(own), np.int64)
        token = side != 1  # a rare word's own count is that of the events in which it is the word
        w_train, w_held = _sums(inverse[token], len(word), one[token], part[token])
        order, begin, _ = _runs(inverse, side, other)
        pair = np.empty(len(own), np.int64)
        pair[order] = np.cumsum(np.isin(np.arange(len(order)), begin)) - 1
        lead = order[begin]
        train, held = _sums(pair, len(lead), one, part)
        x, side, other = inverse[lead], side[lead], other[lead]
        at = np.flatnonzero((held > 0) & (side < 2))
        late = side[at] == 0
        context, word_n = np.where(late, m.train[other[at]], w_train[x[at]]), np.where(late, w_train[x[at]], m.train[other[at]])
        told = m.held_events(context, late & (other[at] == m.size - 1), train[at], word_n, held[at])
        order, chunks, sizes = _by_chunk(chunk)
        return packed(kind, place, pack((w_train + w_held)[x], side, other, train + held, chunks, sizes, pair[order], doc[order]), pack(*told))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        hot = np.zeros((2, len(m.hot)), np.int64)
        now, parts = None, []
        for batch in stream:
            kinds = batch.column(0).to_numpy()
            keep = np.flatnonzero((kinds != PAIRS) & (kinds != RARE))
            if len(keep):
                rest = batch.take(pa.array(keep))
                yield pa.record_batch([*rest.columns, pa.nulls(len(keep), pa.binary())], schema=schema)
            for i in np.flatnonzero(kinds == TOPS):
                at, _, n = unpack(batch.column(11)[i].as_py())
                for k, p in enumerate((TRAIN, HELD)):
                    hot[k] += np.bincount(np.cumsum(at), weights=(n >> 2) * (n & 3 == p), minlength=len(m.hot)).astype(np.int64)
            for i in np.flatnonzero((kinds == PAIRS) | (kinds == RARE)):
                key = int(kinds[i]), batch.column(1)[i].as_py()
                if parts and key != now:
                    yield of(*now, parts, m)
                    parts = []
                    trim()
                now = key
                parts.append((batch.column(2)[i].as_py(), batch.column(11)[i].as_py()))
        if parts:
            yield of(*now, parts, m)
        if hot.any():
            yield packed(-1, 0, b"", pack(*hot))
        trim()

    return run


def _scores(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From hot pairs and buckets: what they add to each document's sums, packed by block of documents."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hot = model.value
        start = m.size - 1
        h, w = np.divmod(m.hot, m.size)
        hot_p = m.log10p(m.every[h], h == start, hot, m.every[w])
        for batch in stream:
            for kind, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = unpack(blob)
                if kind == TOPS:
                    p = hot_p[np.cumsum(a[0])] * (a[2] >> 2)
                    chunks, ends, doc, base, known = [chunk], np.array([len(p)]), a[1], None, None
                elif kind == PAIRS:
                    h, w = np.divmod(m.gathered(np.cumsum(a[0])), m.size)
                    p = m.log10p(m.every[h], h == start, a[1], m.every[w])[a[4]] * a[6]
                    chunks, ends, doc, base, known = a[2].tolist(), np.cumsum(a[3]), a[5], None, None
                else:
                    own, side, other, pair, chunks, sizes, at, doc = a
                    other = np.where(side < 2, other, 0)
                    late = side == 0
                    p = m.log10p(np.where(late, m.every[other], own), late & (other == start), pair, np.where(late, own, m.every[other]))
                    p, token = np.where(side < 2, p, 0)[at], (side != 1)[at]
                    base, known = np.where(token, m.base(own)[at], 0), (token & (own[at] > 0)).astype(np.int64)
                    chunks, ends = chunks.tolist(), np.cumsum(sizes)
                out = []
                for a0, b0 in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                    found, inverse = np.unique(doc[a0:b0], return_inverse=True)
                    total = lambda x: np.bincount(inverse, weights=x[a0:b0], minlength=len(found))  # noqa: E731, B023
                    out.append(pack(_steps(found), total(p).astype(np.float32), *((total(base), total(known).astype(np.int64)) if base is not None else ())))
                yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "blob"])
                del a, p, doc, base, known, out
                trim()
        trim()

    return run


def _added(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk: the sums of each document."""

    def out(chunk: int, sums: np.ndarray) -> pa.RecordBatch:
        n = sums.shape[1]
        return pa.record_batch([pa.array(np.full(n, chunk)), pa.array(np.arange(n), pa.int32()), *(pa.array(x) for x in sums)], names=["chunk", "idx", "p", "b", "k"])

    now, sums = None, np.zeros((3, 0))
    for batch in stream:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if chunk != now:
                if now is not None:
                    yield out(now, sums)
                now, sums = chunk, np.zeros((3, 0))
            doc, *values = unpack(blob)
            doc = np.cumsum(doc)
            if len(doc) and doc[-1] >= sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, int(doc[-1]) + 1 + sums.shape[1])))
            for k, v in enumerate(values):
                sums[k, doc] += v
    if now is not None:
        yield out(now, sums)


def _held_of_both(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            context, pair, word, n = (c.to_numpy() for c in batch.columns)
            yield pa.record_batch([pa.array([pack(*model.value.held_events(context, False, pair, word, n))], pa.binary())], names=["held"])

    return run


def _numbers(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for raw in batch.column(0).to_pylist():
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in unpack(raw)], names=["bucket", "o2", "o1", "n"])


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes and counts (TRAIN, and all) of the most frequent words, WORDS at most, and of END."""
    total = F.col("train") + F.col("held")
    steps = counts.groupBy(F.floor(8 * F.log2(total)).alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # some hundreds
    least, held = 0, 0
    for r in steps:
        held += r.n
        if held > WORDS:
            least = r.step + 1
            break
    t = counts.where((F.floor(8 * F.log2(total)) >= least) | (F.col("word") == int(END))).select("word", "train", total.alias("every")).toArrow()
    keys = t["word"].to_numpy().view(U64) if t.num_rows else np.zeros(0, U64)
    order = np.argsort(keys)
    return keys[order], t["train"].to_numpy()[order], t["every"].to_numpy()[order]


def model_of(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model before its weights, and all words' counts. training: text and part, TRAIN or HELD."""
    found = written(training.mapInArrow(_words, "word long, before long, train long, held long").groupBy("word", "before").agg(F.sum("train").alias("train"), F.sum("held").alias("held")), "words")
    counts = found.where("before is null").drop("before")
    size = counts.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("train"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.count("*").alias("types")).first()
    tokens = size.train, size.train + size.held
    keys, train, every = _frequent(counts)
    end = np.flatnonzero(keys == END)
    docs = (int(train[end[0]]), int(every[end[0]])) if len(end) else (0, 0)
    model = Model(keys, np.append(train, docs[0]), np.append(every, docs[1]), tokens, size.types, np.zeros(0, np.int64), np.tile([0.3, 0.6, 0.1], (BUCKETS, 1)), 1 + int(1.25 * tokens[1]) // BUCKET)
    hot = found.where(F.col("before").isNotNull() & (F.col("train") >= HOT / 2 * tokens[1])).select("word", "before").toArrow()  # 2 / HOT at most
    h, w = (hot[c].to_numpy().view(U64) if hot.num_rows else np.zeros(0, U64) for c in ("before", "word"))
    h, w = np.where(h == START, model.size - 1, model.codes(h)), model.codes(w)
    model.hot = np.sort((h * model.size + w)[(h >= 0) & (w >= 0)])
    return model, counts


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    Null, empty and blank texts are an end alone. Repeated rows are rows of their own, in training as well. A
    null id counts as the id "". With no training documents at all, N and V are 0. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), _part(id_col).alias("part"), F.col(text_col).alias("text"))
    model, counts = model_of(docs.where(F.col("part") != TEST).select("text", "part"))
    shared = spark.sparkContext.broadcast(model)
    ddl = _ROWS.format(id=docs.schema["id"].dataType.simpleString())
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = lambda x: to_arrow_schema(_parse_datatype_string(x))
    events = docs.mapInArrow(_events(shared, shape(ddl)), ddl).repartition("place").sortWithinPartitions("kind", "place")
    paired = written(events.mapInArrow(_paired(shared, shape(f"{ddl}, held binary")), f"{ddl}, held binary"), "paired")

    # pairs of two rare words, by joins; there are none while all words are frequent
    both = paired.where(F.col("kind") == BOTH_RARE).select("chunk", "idx", "h", "w", F.col("n_tokens").alias("part"))
    pairs = both.groupBy("h", "w").agg(F.count_if(F.col("part") == TRAIN).alias("train"), F.count_if(F.col("part") == HELD).alias("held"))
    for c in ("h", "w"):
        own = counts.select(F.col("word").alias(c), F.col("train").alias(f"{c}_train"), (F.col("train") + F.col("held")).alias(f"{c}_every"))
        pairs = pairs.join(own, c, "left")
    pairs = written(pairs.fillna(0), "rare-pairs")

    told = paired.where(F.col("held").isNotNull() & (F.col("kind") >= 0)).select("held").unionByName(pairs.where("held > 0").select("h_train", "train", "w_train", "held").mapInArrow(_held_of_both(shared), "held binary"))
    usual = told.mapInArrow(_numbers, "bucket long, o2 long, o1 long, n long").groupBy("bucket", "o2", "o1").agg(F.sum("n").alias("n")).toArrow()  # bounded by the buckets and steps
    hot = np.zeros((2, len(model.hot)), np.int64)
    for r in paired.where("kind = -1").select("held").toLocalIterator():
        hot += np.stack(unpack(r.held))
    h, w = np.divmod(model.hot, model.size)
    at = np.flatnonzero(hot[1])
    own = model.held_events(model.train[h[at]], h[at] == model.size - 1, hot[0][at], model.train[w[at]], hot[1][at])
    bucket, o2, o1, n = (np.concatenate([usual[c].to_numpy(), x]) for c, x in zip(("bucket", "o2", "o1", "n"), own, strict=True))
    back = lambda o: np.where(o <= 0, 0.0, 2.0 ** ((o - 400) / 4))
    model.weights = learn_weights(bucket, back(o2), back(o1), n.astype(float), model.types)

    final = spark.sparkContext.broadcast((model, hot.sum(axis=0)))
    parts = paired.where(F.col("kind").isin(TOPS, PAIRS, RARE)).select("kind", "chunk", "blob").mapInArrow(_scores(final), "chunk long, blob binary")
    sums = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_added, "chunk long, idx int, p double, b double, k double")
    weight = lambda k: F.element_at(F.array(*(F.lit(float(x)) for x in model.weights[:, k])), F.col("bucket"))
    octave = F.floor(F.log2(F.col("h_every") / F.lit(float(max(model.tokens[1], 1))))).cast("int") + 22
    bucket = F.when(F.col("h_every") > 0, 2 + F.least(F.greatest(octave, F.lit(0)), F.lit(BUCKETS - 3))).otherwise(0) + 1
    p = weight(0) * (F.col("train") + F.col("held")) / F.greatest("h_every", F.lit(1)) + weight(1) * F.col("w_every") / F.lit(float(max(model.tokens[1], 1))) + weight(2) / F.lit(float(model.types + 1))
    single = both.join(pairs.withColumn("bucket", bucket).select("h", "w", F.log10(p).alias("p")), ["h", "w"]).groupBy("chunk", "idx").agg(F.sum("p").alias("p2"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    out = paired.where(F.col("kind") == DOC).select("chunk", "idx", "id", "held_out", "n_tokens", "known", "base").join(sums, ["chunk", "idx"], "left").join(single, ["chunk", "idx"], "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + none("k").cast("long")).alias("n_known"), F.lit(int(model.tokens[1])).cast("long").alias("train_tokens"), (F.col("base") + none("b")).alias("base_score"), (none("p") + none("p2")).alias("score")
    )
