"""Fuzzy line deduplication by MinHash over character shingles.

A line is compared without white space and with A-Z lowered. Its shingles are all runs of SHINGLE characters.
Signatures are made of all shingles, in 32 bits, and banded for a recall of 0.995 at the threshold. Candidates are
verified by the exact Jaccard similarity of all shingles, links become components by distributed union-find,
and the first line of each component stays, in the order of document id and line number. Lines too short for a
shingle link with equal ones alone.

Nodes are distinct lines, so that any number of equal lines is one node; a task signs a line once, not each of its
copies. Keys travel packed, in parts by their first bits, and a part's buckets are found by one sort. Members of a
band's bucket are compared with its least member first; where that leaves a bucket with several components, its
members of different ones are compared with each other, in blocks of bounded size.

A line's node is a hash of 64 bits; of n distinct lines n * n / 4e19 pairs would share one by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaframe.llm.components import components, local_forest
from metaframe.llm.kernels import LOWER, U64, WHITE, Texts, batches, distinct, int64, mix, trim
from metaframe.llm.shared import small, written

SHINGLE = 8  # a power of two
# Lines link when 10 * intersection >= 8 * union, a similarity of 0.8.
BANDS, ROWS = 10, 4
#: Bytes of texts and shingles that are worked on at once, so that arrays stay in a core's cache.
BYTES, PIECE = 1 << 19, 1 << 15
#: Hashes of lines that a task remembers to have signed.
SEEN = 300_000
#: Parts of the keys, a power of two, and pairs of key and line that a task holds before it packs or reduces them.
PARTS, PAIRS = 1 << 12, 1 << 20
#: Most lines whose shingles are sorted together.
LINES = 1 << 13
#: Most lines of a block in which all are compared, and most characters, about.
BLOCK, BLOCK_CHARS = 256, 1 << 18
_LOWER, _WHITE = LOWER.tobytes(), bytes(np.flatnonzero(WHITE).tolist())
_STEPS = [(1 << i, U64(pow(0x5851F42D4C957F2D, 1 << i, 1 << 64))) for i in range(SHINGLE.bit_length() - 1)]
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)).astype(np.uint32) | np.uint32(1)


class Lines:
    """The lines of a batch of texts without white space, A-Z lowered: line i is the bytes data[start[i]:end[i]], and the code points points[first[i]:last[i]]."""

    def __init__(self, column: pa.Array):
        texts = Texts(column)
        raw = texts.bytes
        breaks = np.flatnonzero(raw == 10)
        starts = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([texts.offsets[1:], breaks]), kind="stable")
        white = np.flatnonzero((raw == 32) | (raw - np.uint8(9) < 5))
        self.text = raw.tobytes().translate(_LOWER, _WHITE)
        self.data = np.frombuffer(self.text, dtype=np.uint8)
        self.start, self.end = starts - np.searchsorted(white, starts), ends - np.searchsorted(white, ends)
        per_doc = np.diff(np.searchsorted(breaks, texts.offsets)) + 1
        self.doc = np.repeat(np.arange(len(texts)), per_doc)
        self.number = np.arange(len(starts)) - np.repeat(np.concatenate(([0], np.cumsum(per_doc)[:-1])), per_doc)
        inner = np.flatnonzero((self.data & 0xC0) == 0x80)
        self.first, self.last = self.start - np.searchsorted(inner, self.start), self.end - np.searchsorted(inner, self.end)
        self.size = len(self.data) - len(inner)

    def filled(self) -> np.ndarray:
        return np.flatnonzero(self.end > self.start)

    def with_shingles(self) -> np.ndarray:
        return np.flatnonzero(self.last - self.first >= SHINGLE)

    def hashes(self, lines: np.ndarray) -> np.ndarray:
        spans = zip(self.start[lines].tolist(), self.end[lines].tolist(), strict=True)
        return np.fromiter((xxhash.xxh3_64_intdigest(self.text[a:b]) for a, b in spans), dtype=U64, count=len(lines))

    @cached_property
    def points(self) -> np.ndarray:
        found = np.frombuffer(self.text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        return found if len(found) == self.size else self.data[(self.data & 0xC0) != 0x80].astype(np.uint32)  # what is no UTF-8

    def rolled(self, lo: int, hi: int) -> np.ndarray:
        """The hash of the shingle that begins at each of these characters: a polynomial, by its halves, mixed."""
        h = self.points[lo : hi + SHINGLE - 1].astype(U64)
        for step, power in _STEPS:
            h = h[:-step] * power + h[step:]
        return mix(h)

    def keys(self, lines: np.ndarray) -> np.ndarray:
        """The BANDS keys of each line, which has SHINGLE characters or more. Lines are signed in pieces of bounded size."""
        width = self.last[lines] - self.first[lines] - SHINGLE + 1
        many = -(-width // PIECE)
        lead = np.cumsum(many) - many
        begin = np.repeat(self.first[lines], many) + (np.arange(many.sum()) - np.repeat(lead, many)) * PIECE
        size = np.minimum(np.repeat(self.first[lines] + width, many) - begin, PIECE)
        least = np.empty((BANDS * ROWS, len(begin)), dtype=np.uint32)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + PIECE)))
            lo, hi = int(begin[i]), int(begin[j - 1] + size[j - 1])
            place = np.cumsum(size[i:j]) - size[i:j]
            at = np.repeat(begin[i:j] - lo - place, size[i:j]) + np.arange(size[i:j].sum())
            h = self.rolled(lo, hi)[at]
            low, high = h.astype(np.uint32), (h >> U64(32)).astype(np.uint32)
            own = np.empty_like(low)
            for k, salt in enumerate(_SALTS):
                np.multiply(low, salt, out=own)
                np.bitwise_xor(own, high, out=own)
                np.minimum.reduceat(own, place, out=least[k, i:j])
            i = j
        if len(begin) > len(lines):
            least = np.minimum.reduceat(least, lead, axis=1)
        keys = np.empty((len(lines), BANDS), dtype=U64)
        for band in range(BANDS):
            key = np.full(len(lines), U64(band + 1))
            for row in range(ROWS):
                key = mix(key ^ least[band * ROWS + row].astype(U64))
            keys[:, band] = key
        return keys

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct shingles of all lines, in 50 bits, and the lines' bounds. At most LINES lines."""
        width = np.maximum(self.last - self.first - SHINGLE + 1, 0)
        line = np.repeat(np.arange(len(width)), width)
        at = np.repeat(self.first - np.cumsum(width) + width, width) + np.arange(len(line))
        key = distinct((line.astype(U64) << U64(50)) | (self.rolled(0, max(0, self.size - SHINGLE + 1))[at] >> U64(14)))
        return key & U64((1 << 50) - 1), np.searchsorted(key, np.arange(len(width) + 1, dtype=U64) << U64(50))


def _packed(held: list[tuple[np.ndarray, np.ndarray]], ids: pa.DataType) -> pa.RecordBatch:
    """A row for each part: its pairs of key and hash. held: lines' keys and hashes."""
    keys = np.concatenate([k for k, _ in held]).ravel()
    part = (keys >> U64(65 - PARTS.bit_length())).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    pairs = np.empty((len(keys), 2), dtype=U64)
    pairs[:, 0], pairs[:, 1] = keys[order], np.repeat(np.concatenate([h for _, h in held]), BANDS)[order]
    sizes = np.bincount(part, minlength=PARTS)
    parts = np.flatnonzero(sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes[parts]) * pairs.strides[0])).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(bounds), pa.py_buffer(pairs)])
    none = pa.nulls(len(parts), pa.int64())
    return pa.record_batch([pa.nulls(len(parts), ids), none, none, pa.array(parts.astype(np.int32)), blobs], names=["id", "line", "hash", "part", "pairs"])


def _signatures(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each filled line's hash, without a part; by parts, the keys of lines that the task meets first, if they have a shingle."""
    seen: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    ids = None
    for batch in batches(stream, BYTES):
        lines = Lines(batch.column(1))
        own = lines.filled()
        hashes = lines.hashes(own)
        new = np.zeros(len(own), dtype=bool)
        for i, h in enumerate(hashes.tolist()):
            if h not in seen:
                seen.add(h)
                new[i] = True
        if len(seen) > SEEN:
            seen.clear()
        new &= lines.last[own] - lines.first[own] >= SHINGLE
        ids = batch.column(0).type
        rows = [batch.column(0).take(pa.array(lines.doc[own])), pa.array(lines.number[own].astype(np.int64)), int64(hashes), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())]
        yield pa.record_batch(rows, names=["id", "line", "hash", "part", "pairs"])
        for at in range(0, int(new.sum()), PAIRS // BANDS):
            some = np.flatnonzero(new)[at : at + PAIRS // BANDS]
            held.append((lines.keys(own[some]), hashes[some]))
            if BANDS * sum(len(h) for _, h in held) >= PAIRS:
                yield _packed(held, ids)
                held = []
    if held:
        yield _packed(held, ids)
        held = []
    trim()


def _buckets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: key, hash and low, the members of each key that several lines have and the least of them.

    A part of more than PAIRS pairs is met in steps, each of which leaves the least hash of every key to the next.
    So memory goes by a part's keys, not by their members; such a least one may be a member of two steps, and then
    comes twice.
    """
    part, held, size, limit = None, [], 0, PAIRS

    def met() -> pa.RecordBatch:
        pairs = np.concatenate(held)
        order = np.argsort(pairs[:, 0])
        key = pairs[order, 0]
        same = key[1:] == key[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        single = pairs[order[~many]]
        key, node = pairs[order[many]].T
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        members = np.diff(first, append=len(key))
        low, several = np.repeat(node[first], members), np.repeat(members > 1, members)
        held[:] = [single, np.stack([key[first], node[first]], axis=1)]
        return pa.record_batch([pa.array(x[several]) for x in (key, node, low)], names=["key", "hash", "low"])

    for batch in stream:
        for at, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if at != part and size >= PAIRS // 8:  # small parts are met together
                yield met()
                held[:], size, limit = [], 0, PAIRS
            part = at
            held.append(np.frombuffer(pairs.as_buffer(), dtype=np.int64).reshape(-1, 2))
            size += len(held[-1])
            if size >= limit:
                yield met()
                size = sum(map(len, held))
                limit = max(PAIRS, 2 * size)
    if held:
        yield met()
    trim()


def _squeezed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash and the characters of each line that has a shingle, where the task meets it first."""
    seen: set[int] = set()
    for batch in batches(stream, BYTES):
        lines = Lines(batch.column(0))
        own = lines.with_shingles()
        own = own[[h not in seen and not seen.add(h) for h in lines.hashes(own).tolist()]] if len(own) else own
        if len(seen) > SEEN:
            seen.clear()
        chars = pa.LargeStringArray.from_buffers(len(lines.start), pa.py_buffer(np.append(lines.start, lines.end[-1:]).tobytes()), pa.py_buffer(lines.text))
        yield pa.record_batch([int64(lines.hashes(own)), chars.take(pa.array(own)).cast(pa.string())], names=["hash", "chars"])


def _verified(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v and both lines' characters: the pairs that link."""
    for whole in batches(stream, 1 << 19, "left"):
        for at in range(0, whole.num_rows, LINES):
            batch = whole.slice(at, LINES)
            (a, a_at), (b, b_at) = Lines(batch.column(2)).sets(), Lines(batch.column(3)).sets()
            place = lambda bounds: np.repeat(np.arange(batch.num_rows, dtype=U64) << U64(50), np.diff(bounds))  # noqa: E731, B023
            both = np.sort(np.concatenate([a | place(a_at), b | place(b_at)]))
            same = np.bincount((both[1:][both[1:] == both[:-1]] >> U64(50)).astype(np.int64), minlength=batch.num_rows)
            mask = pa.array(10 * same >= 8 * (np.diff(a_at) + np.diff(b_at) - same))
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _compared(root: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links between members of different components; those of sides 1 and 2 are compared across the sides only."""
    n = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), n)
    _, which, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = held > 1  # the others are in no intersection
    place = np.cumsum(common) - 1
    member, which = member[common[which]], place[which[common[which]]]
    order = np.argsort(which, kind="stable")
    member, which = member[order], which[order]
    same = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = min(4096, int(common.sum()))
    for lo in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(which, [lo, lo + 4096])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[member[a:b], which[a:b] - lo] = 1
        same += part @ part.T
    linked = (10 * same >= 8 * (n[:, None] + n - same)) & (root[:, None] != root) & ((side[:, None] != side) | (side == 0))
    return np.nonzero(np.triu(linked, 1))


def _block_links(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: u and v, links of each block between different components, without those that follow from others."""

    def of(t: pa.Table, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        root, side, node = (t.column(c).to_numpy() for c in ("root", "side", "hash"))
        if (root == root[0]).all():
            return
        u, v = _compared(root, side, sets)
        if len(u):
            u, v = local_forest(node[u], node[v])
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    rest: pa.Table | None = None
    sets: list[np.ndarray] = []
    for batch in stream:
        t = pa.Table.from_batches([batch])
        for at in range(0, batch.num_rows, LINES):
            values, bounds = Lines(batch.column(4).slice(at, LINES)).sets()
            sets += np.split(values, bounds[1:-1])
        rest = t.drop(["chars"]) if rest is None else pa.concat_tables([rest, t.drop(["chars"])])
        last = 0
        for c in np.flatnonzero(np.diff(rest.column("block").to_numpy())) + 1:
            yield from of(rest.slice(last, c - last), sets[last:c])
            last = c
        rest, sets = rest.slice(last).combine_chunks(), sets[last:]
    if rest is not None and rest.num_rows:
        yield from of(rest, sets)
    trim()


def _within_buckets(met: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that the stars of the buckets leave out. met: each bucket's key and members; found: the components so far."""
    rooted = met.join(found, F.col("hash") == F.col("node"), "left").select("key", "hash", F.coalesce("root", "hash").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1 and size > 2")
    members = written(rooted.join(several.select("key", "size"), "key").join(texts.select("hash", F.length("chars").alias("width")), "hash"), "members")
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("width") / BLOCK_CHARS)).cast("int").alias("blocks"))
    spread = members.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("hash", "key"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    blocks = spread.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), side.alias("side"), "hash", "root")
    blocks = blocks.join(texts, "hash").repartition("block").sortWithinPartitions("block")
    return blocks.select("block", "side", "hash", "root", "chars").mapInArrow(_block_links, "u long, v long").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, line, hash, component) of each filled line, and (component, id, line) of the one that stays."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    signed = written(docs.mapInArrow(_signatures, f"id {id_type}, line long, hash long, part int, pairs binary"), "signed")
    parts = signed.where("part is not null").select("part", "pairs").repartition("part").sortWithinPartitions("part")
    met = written(parts.mapInArrow(_buckets, "key long, hash long, low long"), "met")
    pairs = written(met.where("hash <> low").select(F.col("hash").alias("u"), F.col("low").alias("v")).distinct(), "pairs")
    asked = small(written(pairs.select(F.explode(F.array("u", "v")).alias("hash")).distinct(), "asked"))
    texts = written(docs.select("text").mapInArrow(_squeezed, "hash long, chars string").join(asked, "hash").dropDuplicates(["hash"]), "texts")
    linked = pairs.join(texts.select(F.col("hash").alias("u"), F.col("chars").alias("left")), "u").join(texts.select(F.col("hash").alias("v"), F.col("chars").alias("right")), "v")
    found = components(written(linked.select("u", "v", "left", "right").mapInArrow(_verified, "u long, v long"), "links"))
    more = written(_within_buckets(met.drop("low"), found, texts), "more")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    lines = signed.where("part is null").select("id", "line", "hash").join(small(found), F.col("hash") == F.col("node"), "left").select("id", "line", "hash", F.coalesce("root", "hash").alias("component"))
    lines = written(lines, "lines")
    return lines, written(lines.groupBy("component").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first.id", "first.line"), "stay")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gone): the numbers, from 0, of the lines that each document loses; documents that lose none are not there."""
    lines, stay = repeated_lines(docs, id_col, text_col)
    stay = stay.select("component", F.col("id").alias("kept_id"), F.col("line").alias("kept_line"))
    gone = lines.join(stay, "component").where(~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("line") == F.col("kept_line"))))
    return gone.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A struct `row` of each document's columns, its text less the repeated lines, and `gone`, the numbers of these lines.

    Lines are cut at line feeds; blank ones always stay. A document whose text is null stays as it is; one that
    loses every line has the empty text. Rows that repeat an id are one document: equal line numbers stay or go in
    all of them. Null ids are one id, the least. An empty table gives none; other columns may have any name.
    """
    gone = written(removals(docs, id_col, text_col), "gone").select(F.col("id").alias("gone_id"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.join(small(gone), F.col("id").eqNullSafe(F.col("gone_id")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i.cast("long")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(F.struct(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]).alias("row"), F.coalesce("gone", F.array().cast("array<long>")).alias("gone"))
