"""Packing token sequences by the sum-of-squares rule.

Each task packs the documents of its partition as they come, in one pass. A
document longer than a window gives whole windows; what is left (or the document)
goes into the fill level h that makes the sum over levels of the squared number of
partially filled windows smallest, a new window being level 0. The numbers are one
array over the levels, so a placement is one vector expression.

When the partition ends, the windows still open are drained: the fullest are
filled with pieces cut from the emptiest, and the last is cut at powers of two,
at which a sequence needs no padding. A task holds at most `most` open windows (a
parameter): one more, and all are drained in the same way, but that the last stays
open. This bounds a task's memory at `most` windows of ids; a smaller number means
more cut documents, never more padding. A task that is run again packs the same
rows in the same way; sequence numbers start from the partition's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import giving_back
from loomgraph.llm.tokenizing import default_path, encoder, text_blocks

WINDOW, END, MOST = 1024, 0, 4096
#: Characters whose ids are worked out at once; a longer text is alone.
BLOCK = 500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Windows of one partition. A piece is (document, start, ids, document's tokens)."""

    def __init__(self, window: int = WINDOW, first: int = 0, most: int = MOST):
        self.window, self.next, self.most = window, first, most
        self.number = np.zeros(window + 1, np.int64)  # of open windows by level
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.opened = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for i in range(0, whole, self.window):
            self.close([(doc, i, ids[i : i + self.window], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:].copy(), len(ids)))

    def level(self, size: int) -> int:
        """The level at which the sum of squares grows least; the fullest of equals."""
        top = self.window - size
        grown = 2 * self.number[size : self.window + 1] + 1
        grown[top] = 0  # a full window counts no more
        cost = grown - 2 * self.number[: top + 1] + 1
        cost[0] = grown[0]
        cost[1:][self.number[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        at = self.level(size)
        if at:
            pieces = self.open[at].pop()
            self.number[at] -= 1
        else:
            pieces = []
            self.opened += 1
        pieces.append(piece)
        if at + size == self.window:
            self.close(pieces)
            self.opened -= 1
        else:
            self.open[at + size].append(pieces)
            self.number[at + size] += 1
        if self.opened > self.most:
            self.drain(last=False)

    def drain(self, last: bool = True) -> None:
        left = [(h, pieces) for h in range(self.window - 1, 0, -1) for pieces in self.open[h]]
        self.number[:] = 0
        self.open = [[] for _ in range(self.window)]
        self.opened = 0
        i, j = 0, len(left) - 1
        while i < j:
            fill, pieces = left[i]
            give, given = left[j]
            take = min(self.window - fill, give)
            want = take
            while want:
                doc, start, ids, total = given.pop()
                cut = max(0, len(ids) - want)
                if cut:
                    given.append((doc, start, ids[:cut], total))
                pieces.append((doc, start + cut, ids[cut:], total))
                want -= len(ids) - cut
            left[i], left[j] = (fill + take, pieces), (give - take, given)
            if fill + take == self.window:
                self.close(pieces)
                i += 1
            if give == take:
                j -= 1
        if i == j:
            fill, pieces = left[i]
            if fill == self.window:
                self.close(pieces)
            elif last:
                self.powers(pieces, fill)
            else:
                self.open[fill].append(pieces)
                self.number[fill] += 1
                self.opened += 1

    def powers(self, pieces: list[tuple], fill: int) -> None:
        for bit in range(fill.bit_length() - 1, -1, -1):
            if not fill >> bit & 1:
                continue
            room, own = 1 << bit, []
            while room:
                doc, start, ids, total = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                own.append((doc, start, ids, total))
                room -= len(ids)
            self.close(own)


def _packing(path: str, window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        packer = Packer(window, TaskContext.get().partitionId() << 36, most)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in text_blocks(texts, BLOCK):
                ids, bounds = own.encode(texts[a:b])
                for k in range(b - a):
                    packer.add(docs[a + k], np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END)))
                yield out()
        packer.drain()
        yield out()

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    A document's ids are those the library gives for its text and then id 0, so a null
    or empty text is one token, and <|endoftext|> in a text is its special id. Each id
    lies in one piece; pieces of a sequence follow one another from offset 0. A very
    long text is encoded by itself and gives whole windows first. Of levels that cost
    the same the fullest is filled. Repeated rows are packed each on its own; a null
    doc_id stays null; extra columns are ignored; no rows in, no rows out. Which rows
    share a sequence depends on the partitioning.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(giving_back(_packing(path or default_path(), window, most)), SCHEMA)
