"""Packing of tokenized documents into windows of a fixed length.

Online sum-of-squares packing: the level array counts, for each fill level, the partially filled
windows of that level. A piece goes to the level (an empty window included) that makes the sum of
the squared counts least; ties go to the fuller window. This keeps every count low, so that windows
of all levels stay at hand and nearly all close exactly full. A document longer than a window is
first cut into whole windows and a rest. A packer holds MOST_OPEN windows at most: where lengths are
so unlucky that it would open more, the piece is cut to fill a window of the most crowded level.

Packing goes in rounds. In the first, each input partition is packed by itself, as its rows arrive, so
no closed window is shuffled. Windows that stay open are the pieces of the next round: FAN_IN packers'
windows meet in one task, are packed by the same rule, and so on until one packer is left. Only what
it leaves open (no more than MOST_OPEN windows, whatever the table's size) is joined and cut again into
full windows, and the last rest into windows whose lengths are powers of two, which need no padding.
These pieces are marked ``recut``. Every round is a table in the checkpoint folder, with ids as bytes
(little-endian 32-bit numbers), which cost less to write and read than arrays.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.bpe_automaton import byte_symbols
from attestor.llm.common import prepare

WINDOW = 2048
END_OF_DOCUMENT = 1
#: Fixed value: the pre-splitting pattern of the byte-level format.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: sequence_id = (round * 2^24 + packer) * SPAN + number of the window.
SPAN, PACKERS = 1 << 33, 1 << 24
#: Packers whose open windows meet in one of the next round; windows that a packer holds open, at most.
FAN_IN, MOST_OPEN = 8, 4096

#: A piece: document, place of its first id, ids, ids of the document.
Piece = tuple[int, int, np.ndarray, int]


def cut_pieces(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` ids of some pieces, and the rest."""
    head, tail = [], []
    for doc, start, ids, total in pieces:
        take = min(size, len(ids))
        size -= take
        if take:
            head.append((doc, start, ids[:take], total))
        if take < len(ids):
            tail.append((doc, start + take, ids[take:], total))
    return head, tail


class LevelPacker:
    """Sum-of-squares packer. place() takes some pieces that stay together and returns the windows that it closed."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open, self.opened = window, most_open, 0
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that makes the sum of the squared counts least; the fuller one of equals."""
        top = self.window - size
        # change of the sum of squares: -1 window at level h, +1 at h + size (full windows count nothing)
        counts = self.counts
        change = np.zeros(top + 1, dtype=np.int64)
        change[1:] -= 2 * counts[1 : top + 1] - 1
        change[:top] += 2 * counts[size : size + top] + 1
        usable = counts[: top + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, pieces: list[Piece], size: int | None = None) -> list[list[Piece]]:
        """Put pieces of ``size`` <= window ids in all into the best level."""
        size = sum(len(p[2]) for p in pieces) if size is None else size
        level = self.level_for(size)
        if not level and size < self.window and self.opened >= self.most_open:
            level = 1 + int(np.argmax(self.counts[1 : self.window]))  # the most crowded one
            if level + size > self.window:
                head, tail = cut_pieces(pieces, self.window - level)
                return self._put(head, self.window - level, level) + self.place(tail)
        return self._put(pieces, size, level)

    def _put(self, pieces: list[Piece], size: int, level: int) -> list[list[Piece]]:
        held = []
        if level:
            self.counts[level] -= 1
            self.opened -= 1
            held = self.open[level].pop()
        held = held + pieces
        if level + size == self.window:
            return [held]
        self.counts[level + size] += 1
        self.opened += 1
        self.open.setdefault(level + size, []).append(held)
        return []

    def rest(self) -> list[list[Piece]]:
        """The windows that are still open, fullest first."""
        return [pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level]]


def cut_rest(pieces: Iterable[Piece], window: int) -> Iterator[list[Piece]]:
    """Cut leftover pieces into full windows, then into windows of powers of two."""
    left, pieces = 0, list(pieces)
    left = sum(len(p[2]) for p in pieces)
    while left:
        goal = window if left >= window else 1 << (left.bit_length() - 1)
        done, size = [], 0
        while size < goal:
            doc, start, ids, total = pieces[0]
            take = min(goal - size, len(ids))
            done.append((doc, start, ids[:take], total))
            size += take
            if take == len(ids):
                pieces.pop(0)
            else:
                pieces[0] = (doc, start + take, ids[take:], total)
        yield done
        left -= goal


def document_pieces(doc: int, ids: np.ndarray, window: int = WINDOW) -> Iterator[Piece]:
    """Whole windows of a document, and its rest."""
    for start in range(0, len(ids), window):
        yield doc, start, ids[start : start + window], len(ids)


def byte_encoding(spec: str) -> tiktoken.Encoding:
    """A byte-level tokenizers file as a table of ranks (same ids, faster); its special tokens' strings in a text are special, as in the format."""
    spec = json.loads(spec)
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)


_encodings: dict[int, tiktoken.Encoding] = {}


def _encoding(spec: str) -> tiktoken.Encoding:
    key = zlib.crc32(spec.encode())
    if key not in _encodings:
        _encodings[key] = byte_encoding(spec)
    return _encodings[key]


def _table(kind: str) -> str:
    """Schema of a round's table: pieces of closed windows, and of open ones (number and place: order in the packer)."""
    return f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary, recut boolean, open boolean, packer long, number long, place long"


class _Writer:
    """Rows of windows, in frames of some hundred."""

    def __init__(self, kind: str, round_: int):
        self.names, self.round, self.rows = [c.split()[0] for c in _table(kind).split(", ")], round_, []

    def add(self, packer: int, number: int, pieces: list[Piece], recut: bool = False, open_: bool = False) -> Iterator[pd.DataFrame]:
        offset, sequence = 0, (self.round * PACKERS + packer) * SPAN + number
        for place, (doc, start, ids, total) in enumerate(pieces):
            raw = ids.astype("<i4", copy=False).tobytes()
            self.rows.append((doc, start, len(ids), total, -1 if open_ else sequence, offset, zlib.crc32(raw), raw, recut, open_, packer, number, place))
            offset += len(ids)
        if len(self.rows) >= 500:
            yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            frame = pd.DataFrame(self.rows, columns=self.names)
            self.rows = []
            yield frame


def _pack(items: Iterable[tuple[int, list[Piece]]], writer: _Writer, window: int, last: bool) -> Iterator[pd.DataFrame]:
    """Rows of all windows of (packer, pieces that stay together); a packer's items follow each other."""
    packer, at, number = None, None, 0

    def end() -> Iterator[pd.DataFrame]:
        rest = [] if packer is None else packer.rest()
        for k, pieces in enumerate(cut_rest([p for w in rest for p in w], window) if last else rest):
            yield from writer.add(at, number + k, pieces, recut=last, open_=not last)

    for to, pieces in items:
        if to != at:
            yield from end()
            packer, at, number = LevelPacker(window), to, 0
        for closed in packer.place(pieces):
            yield from writer.add(at, number, closed)
            number += 1
    yield from end()
    yield from writer.flush()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids array<int>, recut).

    Tokens of a document: its text's ids, then end_id; a null text is the empty text, so every
    document has at least the end. Repeated rows are packed each on its own; pieces of rows with
    the same id can only be told apart by their sequence. An empty table gives an empty result;
    other columns are not read. A worker holds one packer's open windows (MOST_OPEN at most) and
    one batch. Which windows form depends on how the table is split; that all ids lie in exactly one
    piece, and that nothing is padded, does not.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_column].dataType.simpleString()
    folder, schema = f"{spark.sparkContext.getCheckpointDir()}/packing-{uuid.uuid4().hex}", _table(kind)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, packer = _encoding(spec.value), TaskContext.get().partitionId()

        def items() -> Iterator[tuple[int, list[Piece]]]:
            for batch in batches:
                for doc, text in zip(batch["id"], batch["text"], strict=True):
                    ids = np.append(encoding.encode_to_numpy(text or "", allowed_special="all").astype(np.int32), np.int32(end_id))
                    for piece in document_pieces(doc, ids, window):
                        yield packer, [piece]

        yield from _pack(items(), _Writer(kind, 0), window, False)

    def following(round_: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def items() -> Iterator[tuple[int, list[Piece]]]:
                window_of, held = None, []
                for batch in batches:
                    for doc, start, ids, total, packer, number in batch[["id", "start", "ids", "doc_tokens", "packer", "number"]].itertuples(index=False, name=None):
                        if (packer, number) != window_of:
                            if held:
                                yield window_of[0] // FAN_IN, held
                            window_of, held = (packer, number), []
                        held.append((doc, start, np.frombuffer(ids, dtype="<i4"), total))
                if held:
                    yield window_of[0] // FAN_IN, held

            yield from _pack(items(), _Writer(kind, round_), window, last)

        return run

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInPandas(first, schema)
    read, round_, tables = lambda k: spark.read.schema(schema).parquet(f"{folder}/{k}"), 0, []
    while True:
        rows.write.parquet(f"{folder}/{round_}")
        table = read(round_)
        tables.append(table.where("NOT open"))
        open_ = table.where("open")
        most = open_.agg(F.max("packer")).first()[0]
        if most is None:
            break
        round_, packers = round_ + 1, most // FAN_IN + 1
        dealt = open_.withColumn("to", F.floor(F.col("packer") / FAN_IN)).repartition(packers, "to").sortWithinPartitions("packer", "number", "place")
        rows = dealt.drop("to").mapInPandas(following(round_, packers == 1), schema)
    @F.pandas_udf("array<int>")
    def as_ids(raw: pd.Series) -> pd.Series:  # not run where a query does not select ids
        return raw.map(lambda b: np.frombuffer(b, dtype="<i4"))

    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    columns = [F.col(c) if c != "ids" else as_ids("ids").alias("ids") for c in out.columns if c not in ("open", "packer", "number", "place")]
    return out.select(*columns).withColumnRenamed("id", id_column)
