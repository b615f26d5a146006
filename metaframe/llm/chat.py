"""Chat formatting by token-level assembly.

Each turn is three segments between reserved ids: TURN role TEXT content END; a conversation lies between BOS
and EOS. Segments are encoded separately, by a tokenizer that knows none of the control strings, and reserved
ids are spliced between them: no content can make a control token. As text, control strings in a role or content are
escaped with a backslash after their first character (one more if there are some already), which is undone
exactly. The loss mask covers the content of assistant turns and is the prefix sum of +1 where a segment begins
and -1 where it ends.

A row of output is a turn, so conversations of any length are formatted without being gathered.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaframe.llm.kernels import batches

# The control strings. The first five have reserved ids; the others are escaped too, as other templates' marks.
CONTROLS = ("<s>", "</s>", "[TURN]", "[TEXT]", "[END]", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
BOS, EOS, TURN, TEXT, END = range(5)
RESERVED = 5
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


class Assembler:
    """Ids of a turn: the tokenizer's, and reserved ids above them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def turns(self, roles: list[str], texts: list[str], opens: list[bool], closes: list[bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, loss mask) of each turn."""
        n = len(roles)
        encoded = self.tokenizer.encode_batch([*map(escape, roles), *map(escape, texts)], add_special_tokens=False)
        reserved = lambda *marks: np.array([self.base + m for m in marks], dtype=np.int32)
        for i in range(n):
            role, text = (np.array(encoded[j].ids, dtype=np.int32) for j in (i, n + i))
            segments = [reserved(*(BOS, TURN) if opens[i] else (TURN,)), role, reserved(TEXT), text, reserved(*(END, EOS) if closes[i] else (END,))]
            ends = np.cumsum([len(s) for s in segments])
            step = np.zeros(ends[-1] + 1, dtype=np.int8)
            if roles[i] == "assistant":
                step[ends[2]] += 1
                step[ends[3]] -= 1
            yield np.concatenate(segments), np.cumsum(step)[:-1].astype(np.int8)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str | None, int]:
        """Back from a turn's ids: role, text, the text under the mask (None if nothing is), and the code points of the formatted turn."""
        marks = np.flatnonzero(ids >= self.base)
        kinds = ids[marks] - self.base
        role_at, text_at, end_at = (marks[np.flatnonzero(kinds == k)[0]] for k in (TURN, TEXT, END))
        decode = lambda x: self.tokenizer.decode(x.tolist(), skip_special_tokens=False) if len(x) else ""
        role, text = decode(ids[role_at + 1 : text_at]), decode(ids[text_at + 1 : end_at])
        under = decode(ids[mask.astype(bool)]) if mask.any() else None
        size = len(role) + len(text) + sum(len(CONTROLS[k]) for k in kinds)
        return unescape(role), unescape(text), None if under is None else unescape(under), size


def _formatter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assemble = Assembler(path)
        for batch in batches(stream, 1 << 20):
            roles, texts, opens, closes = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            done = list(assemble.turns(roles, texts, opens, closes))
            lists = lambda k, t: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(d[k]) for d in done]))).astype(np.int32)), pa.array(np.concatenate([d[k] for d in done]), t))  # noqa: E731, B023
            yield pa.record_batch([batch.column(0), batch.column(1), lists(0, pa.int32()), lists(1, pa.int8())], names=["conv_id", "position", "ids", "mask"])

    return run


def format_turns(conversations: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, ids, mask): a row for each turn, in each conversation's order of turns.

    Null roles and texts are empty. Null turns come first; rows of one turn number are ordered by role and
    text, and rows that repeat each other are turns of their own. Null conversation ids are one conversation.
    Other columns are not looked at.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("position", F.row_number().over(order) - 1).withColumn("last", F.lead(F.lit(False), 1, True).over(order))
    rows = rows.select("conv_id", "position", "role", "text", (F.col("position") == 0).alias("first"), "last")
    return rows.mapInArrow(_formatter(tokenizer_path), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position int, ids array<int>, mask array<tinyint>")


def _reader(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns sorted by conversation and position to one row a conversation; only running digests are held."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assemble = Assembler(path)
        now: list | None = None
        rows: list[tuple] = []
        for batch in stream:
            ids, masks = batch.column(2), batch.column(3)
            values, bits, at = ids.values.to_numpy(), masks.values.to_numpy(), ids.offsets.to_numpy()
            mask_at = masks.offsets.to_numpy()
            for i, conv in enumerate(batch.column(0).to_pylist()):
                role, text, under, size = assemble.read(values[at[i] : at[i + 1]], bits[mask_at[i] : mask_at[i + 1]])
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if under is not None:
                    now[3] += len(under)
                    now[4].update(under.encode())
                now[5] += size
            if len(rows) > 5000:
                yield _rows(rows, batch.schema.field(0).type)
                rows = []
        if now is not None:
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
            yield _rows(rows, batch.schema.field(0).type)

    return run


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def read_back(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """From the ids and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    held = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return held.mapInArrow(_reader(tokenizer_path), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
