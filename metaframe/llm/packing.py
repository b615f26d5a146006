"""Harmonic packing of tokenised documents into sequences of at most 2048 tokens.

Class k has pieces of the capacity's k-th part, 2048 // k tokens, of which k fill a sequence but for less than k
tokens. A document is cut into full sequences, then greedily into the largest classes that what is left allows: some three
pieces, as in expansions into unit fractions. Each class of each partition fills its bins with its fixed count of
pieces, independently of all others, so there is no shuffle and no state beyond one open bin a class. At the end the
pieces of bins that are not full are cut into powers of two, whose bins close at a power of two of tokens, which
needs no padding. All padding is what classes leave of full bins, less than one token in a thousand.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaframe.llm.kernels import batches, trim

CAPACITY = 2048
END_ID = 1
#: Most words whose ids a worker remembers.
CACHE = 120_000
_COLUMNS = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# A text is cut at its single spaces and line feeds alone unless other white space or the special token occurs in it.
_ODD = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "  ", " \n", "\n ", "\n\n"]
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    No pre-token of this tokenizer goes on from other characters to white space, so texts are cut there, and
    the ids of each distinct part are found once and remembered. New parts are encoded with the vocabulary of
    the same file by tiktoken, in which a call costs a tenth; a token's rank is its id. Texts with the special
    token go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the bytes that a byte-level vocabulary writes as they are
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        assert set(byte_of) == set(pre_tokenizers.ByteLevel.alphabet())
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token != _SPECIAL}
        self.ordinary = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.after_space: dict[str, bytes] = {}
        self.exact: dict[str, bytes] = {}

    def _look(self, known: dict[str, bytes], parts: list[str], lead: str) -> bytes:
        if len(known) > CACHE:
            known.clear()
        out, at = list(map(known.get, parts)), -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            p = parts[at]
            if p not in known:
                known[p] = array("I", self.ordinary(p if p[:1] == "\n" else lead + p)).tobytes()
            out[at] = known[p]
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if _SPECIAL in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if text[-1:] == " " or any(x in text for x in _ODD):
            return self._look(self.exact, _CUT.split(text), "")
        first, *parts = text.replace("\n", " \n").split(" ")
        return self._look(self.exact, [first], "") + self._look(self.after_space, parts, " ")


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then the largest class sizes that fit into what is left."""
    out, at = [], 0
    while at < n:
        left = min(n - at, capacity)
        out.append((at, capacity // -(-capacity // left)))
        at += out[-1][1]
    return out


#: A piece: its document's id, its place there, its ids as bytes, and the document's tokens.
Piece = tuple[Any, int, bytes, int]


class Bins:
    """The open bins of one partition, a list of pieces for each class. What closes becomes rows."""

    def __init__(self, partition: int, with_ids: bool, capacity: int = CAPACITY):
        self.next, self.capacity, self.with_ids = partition << 40, capacity, with_ids
        self.open: dict[int, list[Piece]] = {}

    def _close(self, held: list[Piece]) -> list[tuple]:
        self.next += 1
        out, offset = [], 0
        for doc_id, start, part, n in held:
            length = len(part) // 4
            out.append((doc_id, *((np.frombuffer(part, "<u4").tolist(),) if self.with_ids else ()), start, length, zlib.crc32(part), n, self.next - 1, offset))
            offset += length
        return out

    def add(self, piece: Piece) -> list[tuple]:
        length = len(piece[2]) // 4
        held = self.open.setdefault(length, [])
        held.append(piece)
        if len(held) < self.capacity // length:
            return []
        self.open[length] = []
        return self._close(held)

    def rest(self) -> list[tuple]:
        out = []
        for length in [x for x in self.open if x & (x - 1)]:
            for doc_id, start, part, n in self.open.pop(length):
                at = 0
                for bit in range(length.bit_length() - 1, -1, -1):
                    if length >> bit & 1:
                        out += self.add((doc_id, start + at, part[4 * at : 4 * (at + (1 << bit))], n))
                        at += 1 << bit
        for held in self.open.values():
            at = 0
            while at < len(held):
                size = 1 << (len(held) - at).bit_length() - 1
                out += self._close(held[at : at + size])
                at += size
        self.open = {}
        return out


def _packer(path: str, with_ids: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, out = Encoder(path), Bins(TaskContext.get().partitionId(), with_ids), []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches(stream):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                for start, length in pieces(n):
                    out += bins.add((doc_id, start, ids[4 * start : 4 * (start + length)], n))
                if len(out) > 20_000 or with_ids and len(out) > 200:
                    yield flush()
                    out.clear()
        out += bins.rest()
        yield flush()
        out.clear()
        encode = bins = None
        trim()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, (ids,) start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids and END_ID; a null or empty text has END_ID alone. Pieces of a document follow each
    other without gap, and so do the pieces of a sequence. A sequence whose length is no power of two is to be
    padded to the capacity; it lacks less of that than it has pieces. Repeated rows and null ids are documents like any other. A long text is one array of ids, cut
    at once; nothing else grows with it. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = _COLUMNS.format(id=docs.schema["doc_id"].dataType.simpleString() + (", ids array<int>" if with_ids else ""))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return docs.mapInArrow(_packer(tokenizer_path, with_ids, schema), ddl)
