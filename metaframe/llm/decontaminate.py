"""Benchmark decontamination: a prefix-filtered containment join of documents with item windows.

A window is 13 consecutive words of an item, or a shorter item's words. To be contained, all of a window's
words must occur, so one necessary word is a sufficient prefix: the window's rarest in the documents. The
scan looks documents' words up among the prefix words, drops what fails the length and positional bounds,
and compares the rest word by word. The items are the stated query set; they are held in blocks of bounded
size, and with several blocks the documents pass through one after the other, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaframe.llm.kernels import NOT_ALNUM, U64, Texts, batches, distinct
from metaframe.llm.shared import with_row

WINDOW = 13
#: Most bytes of item texts in one block.
BLOCK_BYTES = 8 << 20
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """Windows of a block of items, ordered by their prefix word."""

    def __init__(self, names: list[str], texts: list[str | None], counts: dict[int, int] | None = None):
        words = Texts(pa.array(texts, pa.string())).words(NOT_ALNUM)
        self.hashes, first = words.hashes(), words.first
        self.vocabulary = distinct(self.hashes)
        self.names = names
        seen = np.array([(counts or {}).get(int(h), 0) for h in self.vocabulary])
        rarity = seen[np.searchsorted(self.vocabulary, self.hashes)]
        rows = []
        for item in range(len(names)):
            a, b = int(first[item]), int(first[item + 1])
            size = min(WINDOW, b - a)
            for start in range(a, b - size + 1) if size else ():
                offset = min(range(size), key=lambda i: (rarity[start + i], int(self.hashes[start + i])))
                rows.append((int(self.hashes[start + offset]), start, size, offset, item))
        rows.sort()
        self.prefix = np.array([r[0] for r in rows], dtype=U64)
        self.start, self.size, self.offset, self.item = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(1, 5))

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word position at which a window begins, and the window."""
        lo, hi = np.searchsorted(self.prefix, hashes, "left"), np.searchsorted(self.prefix, hashes, "right")
        at = np.flatnonzero(hi > lo)
        many = hi[at] - lo[at]
        window = np.repeat(lo[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
        begin = np.repeat(at, many) - self.offset[window]
        doc = np.searchsorted(first, np.repeat(at, many), "right") - 1
        fits = (begin >= first[doc]) & (begin + self.size[window] <= first[doc + 1])
        begin, window = begin[fits], window[fits]
        for j in range(WINDOW):
            short = self.size[window] <= j
            same = short | (hashes[np.minimum(begin + j, len(hashes) - 1)] == self.hashes[np.minimum(self.start[window] + j, len(self.hashes) - 1)])
            begin, window = begin[same], window[same]
        return begin, window


def _counter(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches(stream, 1 << 20):
            hashes = Texts(batch.column(0)).words(NOT_ALNUM).hashes()
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(vocabulary[at].view(np.int64)), pa.array(total[at])], names=["word", "n"])

    return count


def _scanner(windows: Windows, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1 << 20):
            words = Texts(batch.column(1)).words(NOT_ALNUM)
            first, n = words.first, len(words.starts)
            begin, window = windows.occurrences(words.hashes(), first)
            doc = np.searchsorted(first, begin, "right") - 1
            spans = batch.column(2).to_pylist()
            items = batch.column(3).to_pylist()
            for d in np.unique(doc):
                own = doc == d
                spans[d] += np.stack([begin[own] - first[d], windows.size[window[own]]], axis=1).ravel().tolist()
                items[d] += [windows.names[i] for i in np.unique(windows.item[window[own]])]
            if not last:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)
                continue
            edge = np.zeros(n + 1, dtype=np.int64)
            for d, span in enumerate(spans):
                if span:
                    s = np.array(span).reshape(-1, 2)
                    np.add.at(edge, first[d] + s[:, 0], 1)
                    np.add.at(edge, first[d] + s[:, 0] + s[:, 1], -1)
            hit = np.concatenate(([0], np.cumsum(np.cumsum(edge[:n]) > 0)))
            n_hit, n_words = hit[first[1:]] - hit[first[:-1]], np.diff(first)
            items = [sorted(set(x)) for x in items]  # rows that repeat an id are one item
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.record_batch([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array((n_hit > 0) & (20 * n_hit >= n_words))], names=["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return scan


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A struct `row` of each document's columns, with n_words, n_hit, n_items, items_sha256 and contaminated.

    Words are runs of 0-9, a-z (A-Z lowered) and characters from U+0080 on. n_hit counts words inside any
    occurrence of a window, n_items the items with an occurring window, and items_sha256 is the digest of
    their ids, sorted as strings and joined by commas (of the empty string if none). A document is
    contaminated when n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words; items without
    words have no windows; a null item id is written as the empty string; item rows that repeat an id are one item
    with the windows of all of them. Repeated documents each get a row, an empty table gives none, and other columns
    may have any name. Words are compared by 64-bit hashes, one by one for each word of a window.
    """
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    out = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), F.lit(None).cast("array<long>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    out = out.withColumn("spans", F.array().cast("array<long>")).withColumn("items", F.array().cast("array<string>"))
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # a block, bounded by BLOCK_BYTES or so
        names, texts = [r.id for r in held], [r.text for r in held]
        vocabulary = Windows(names, texts).vocabulary
        counts = {}
        if len(vocabulary):
            rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_counter(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # bounded by the block's words
            counts = {r.word & 0xFFFFFFFFFFFFFFFF: r.n for r in rows}
        last = b == blocks - 1
        out = out.mapInArrow(_scanner(Windows(names, texts, counts), last), with_row(out.schema["row"].dataType, _RESULT if last else "text string, spans array<long>, items array<string>"))
    return out
