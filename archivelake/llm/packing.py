"""Sum-of-squares online packing of token sequences into windows.

A document is its ids and an end id.  Whole windows are cut off its front; what
remains, if anything, is placed online: among the fill levels at which it fits,
and a new window, it goes where the sum of the squared numbers of partially
filled windows per level becomes least (the fullest such level on ties).  The
counts are one array indexed by level.  Windows that fill up are done; the pieces of
windows that are open at the end of a partition are dealt anew to a few packers, each
of some ``PACKER_PIECES`` pieces of many partitions, which place them the same way.
Of the windows that are open at the end of a packer, the fullest stay as they are, as long
as their padding is at most ``MOST_PADDING`` of its ids; the others, whose number doesn't
grow with the pieces, are cut anew, the last of them at powers of two, which need no padding.

Nulls: a null text counts as empty, a null doc_id is kept.  An empty text is a
piece of one id, the end id.  Repeated rows are packed as often as they come.
A very long text is encoded whole and gives whole windows at once.  An empty table gives
no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick, releasing, written
from .tokenizing import MEMORY_PIECES, encoder, runs

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that one packer of the second round gets, about; with ids, some 2 KB each.
PACKER_PIECES = 1 << 14
#: Characters of texts that are encoded at once, about: a word is looked up once for all of them, and
#: what that takes on the way, some 15 to 20 bytes for each, is missed beside the heap.
RUN_CHARS = 1 << 20
#: Share of a packer's ids that windows left open may have as padding.
MOST_PADDING = 0.005
_ARROW = pa.schema([(n, pa.int64()) for n in PIECES.replace(" long", "").split(", ")])


class SumOfSquares:
    """Open windows by fill level; ``put`` returns a window as soon as it is full.

    A piece is (doc, start, length); ``doc`` is anything.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.placed = 0  # ids
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]

    def level(self, size: int) -> int:
        """The fill level for a piece of ``size``: 0 opens a window."""
        room = self.capacity - size
        at = np.flatnonzero(self.counts[: room + 1])
        after = self.counts[at + size]
        change = 2 * (after - self.counts[at]) + 2
        if len(at) and at[-1] == room:
            change[-1] = 1 - 2 * self.counts[room]  # a full window counts no more
        opening = 1 + 2 * self.counts[size]
        if not len(at):
            return 0
        best = change.min()
        return 0 if opening < best else int(at[np.flatnonzero(change == best)[-1]])

    def put(self, piece: tuple) -> list[tuple] | None:
        size = piece[2]
        at = self.level(size) if size < self.capacity else 0
        if at:
            window = self.windows[at].pop()
            self.counts[at] -= 1
        else:
            window = []
        window.append(piece)
        self.placed += size
        if at + size == self.capacity:
            return window
        self.windows[at + size].append(window)
        self.counts[at + size] += 1
        return None

    def open(self) -> Iterator[list[tuple]]:
        """All windows still open, the fullest first."""
        for level in range(self.capacity - 1, 0, -1):
            yield from self.windows[level]

    def rest(self, share: float) -> Iterator[list[tuple]]:
        """All windows still open: as they are, if of a power of two or with padding that is, in
        all, at most ``share`` of the ids placed; else laid end to end and cut at the
        capacity, the last of them into windows whose lengths are powers of two."""
        loose: list[tuple] = []
        padding = int(self.placed * share)
        for window in self.open():
            level = sum(p[2] for p in window)
            if level & (level - 1) == 0:
                yield window
            elif self.capacity - level <= padding:
                padding -= self.capacity - level
                yield window
            else:
                loose += window
        left = sum(p[2] for p in loose)
        loose.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, length = loose.pop()
                if length > room:
                    loose.append((doc, start + room, length - room))
                    length = room
                window.append((doc, start, length))
                room -= length
            yield window


def _batch(rows: list[tuple], columns: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), columns, strict=True)], schema=columns)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024, with_ids: bool = True, packer_pieces: int = PACKER_PIECES, memory_pieces: int = MEMORY_PIECES) -> DataFrame:
    """One row per piece of a document (see PIECES); ``sequence_id`` and ``offset``
    say where it lies; ``with_ids`` adds ``ids``, its ids as little-endian unsigned
    32-bit integers.  A sequence is to be padded to ``capacity`` unless its length is a
    power of two.  With fewer ``memory_pieces``, a worker takes less memory, some 150 bytes for
    each, and more time, and the ids are the same.

    Texts aren't shuffled: each partition is packed by itself, and only the pieces of
    windows that it leaves open are dealt anew.  Sequences are numbered from the
    partition's number times 2**40, those of the second round from 2**61 on.
    """
    columns = _ARROW.append(pa.field("ids", pa.binary()))
    kinds = PIECES + ", ids binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, True, memory_pieces).encode
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        packer = SumOfSquares(capacity)
        rows: list[tuple] = []

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs(texts, RUN_CHARS):
                for doc_id, ids in zip(doc_ids[a:b], encode([t or "" for t in texts[a:b]]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        if window := packer.put(((doc_id, total, part), start, len(part) // 4)):
                            offset = 0
                            for (key, size, own), at, length in window:
                                rows.append((key, at, length, zlib.crc32(own), size, sequence, offset, own if with_ids else None))
                                offset += length
                            sequence += 1
                if rows:
                    yield _batch(rows, columns)
                    rows.clear()
        for window in packer.open():
            rows += [(key, at, length, None, size, None, None, own) for (key, size, own), at, length in window]
            if len(rows) > 4096:
                yield _batch(rows, columns)
                rows.clear()
        if rows:
            yield _batch(rows, columns)

    def repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (1 << 61) + (TaskContext.get().partitionId() << 40)
        packer = SumOfSquares(capacity)
        rows: list[tuple] = []

        def close(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (key, base, size, own), start, length in window:
                ids = own[4 * (start - base) : 4 * (start - base + length)]
                rows.append((key, start, length, zlib.crc32(ids), size, sequence, offset, ids if with_ids else None))
                offset += length
            sequence += 1

        for batch in batches:
            for key, start, length, _, size, _, _, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if window := packer.put(((key, start, size, own), start, length)):
                    close(window)
            if rows:
                yield _batch(rows, columns)
                rows.clear()
        for window in packer.rest(MOST_PADDING):
            close(window)
            if len(rows) > 4096:
                yield _batch(rows, columns)
                rows.clear()
        if rows:
            yield _batch(rows, columns)

    pieces = written(pick(docs, "doc_id", "text").mapInArrow(releasing(packed), kinds), "pieces")
    left = pieces.where("sequence_id is null")
    packers = max(1, -(-left.count() // packer_pieces))
    out = pieces.where("sequence_id is not null").union(left.repartition(packers).mapInArrow(releasing(repacked), kinds))
    return out if with_ids else out.drop("ids")
