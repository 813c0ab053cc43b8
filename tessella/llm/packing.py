"""Packing of documents into windows by the sum-of-squares rule.

Documents come one at a time, each task packing its own rows without a shuffle. Whole windows are cut from a long
document; its rest goes to the fill level that minimises the sum of the squared numbers of partially filled windows
by level, kept in an array with a count for each level. At the end of a task the windows still open are poured
together into whole ones, and what is left, less than a window, is cut into windows whose lengths are powers of
two. So there is no padding at all.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import sliced

SIZE, END = 4096, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: (doc id, start in the document, ids, tokens of the document)
Piece = tuple[int, int, bytes, int]


class SumOfSquares:
    """Online packing into windows of size tokens; take() and flush() give finished windows, as lists of pieces."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def place(self, n: int) -> int:
        """The fill level to put n tokens on: 0 opens a window. Ties go to the fullest level."""
        to = self.level[n:].copy()
        to[-1] = -1  # a full window is no longer counted, so reaching it costs 0 where another level h costs 2 h + 1
        cost = 2 * to + 1
        at = self.level[: self.size + 1 - n]
        cost = np.where(at > 0, cost - 2 * at + 1 + (to == -1), np.iinfo(np.int64).max)
        cost[0] = 2 * self.level[n] + 1
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def take(self, doc: int, ids: bytes) -> Iterator[list[Piece]]:
        n = len(ids) // 4
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            yield [(doc, start, ids[4 * start : 4 * (start + self.size)], n)]
        if rest := n - whole:
            h = self.place(rest)
            window = self.open[h].pop() if h else []
            self.level[h] -= 1 if h else 0
            window.append((doc, whole, ids[4 * whole :], n))
            if h + rest == self.size:
                yield window
            else:
                self.level[h + rest] += 1
                self.open[h + rest].append(window)

    def flush(self) -> Iterator[list[Piece]]:
        left = [piece for h in sorted(self.open, reverse=True) for window in self.open[h] for piece in window]
        total = sum(len(p[2]) for p in left) // 4
        rooms = [self.size] * (total // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if total % self.size >> b & 1]
        left.reverse()
        for room in rooms:
            window, filled = [], 0
            while filled < room:
                doc, start, ids, n = left.pop()
                fit = min(room - filled, len(ids) // 4)
                window.append((doc, start, ids[: 4 * fit], n))
                if 4 * fit < len(ids):
                    left.append((doc, start + fit, ids[4 * fit :], n))
                filled += fit
            yield window
        self.level[:] = 0
        self.open.clear()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of its text by the tokenizer file at path, without special tokens added, then end.
    Every id lies in exactly one piece; the pieces of a sequence fill it from offset 0 without a gap, to size tokens
    or, at the end of a task, to a power of two. A null or empty text is the end id alone; a text of any length is
    taken whole, its full windows cut off first. Of fill levels that cost the same the fullest is taken. Rows with
    equal ids are packed each on its own; rows with a null id come back with a null id. Other columns are not looked
    at. An empty table gives no rows.

    sequence_id holds the number of the task's partition and counts up within it, so the rows of docs must come to
    the same partitions in the same order when a task is repeated; a table read from files does that.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = load(path), SumOfSquares(size)
        last = end.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 36

        def windows() -> Iterator[list[Piece]]:
            for batch in sliced(it):
                ids = batch.column(0).to_pylist()
                for doc, tokens in zip(ids, bpe.encode(batch.column(1).to_pylist()), strict=True):
                    yield from packer.take(doc, tokens + last)
            yield from packer.flush()

        def rows(held: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)

        held: list[tuple] = []
        for window in windows():
            offset = 0
            for doc, start, ids, n in window:
                held.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, number, offset))
                offset += len(ids) // 4
            number += 1
            if len(held) >= 8192:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, PIECES)
