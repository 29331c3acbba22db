"""Sum-of-squares online packing of documents into sequences of a fixed length.

Each task packs the documents that it reads; nothing is shuffled and no state is shared. A document's whole windows are
sequences by themselves; its rest goes, as it comes, into the open sequence at the fill level for which the sum of the
squared numbers of partly filled sequences per level becomes smallest (Csirik et al., 2006), a level array holding
these numbers. At a task's end, and when the open sequences hold more than HELD_IDS ids (a bound of its memory), each open
sequence is cut where it is into sequences whose lengths are powers of two, the binary digits of its fill, which need no padding;
no piece is moved from where the method has put it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import default_path, tokenizer

LENGTH, END_ID = 4096, 2
#: Ids that a task's open sequences may hold.
HELD_IDS = 1 << 24
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int, np.ndarray]  # index of the document, its tokens, start, ids


class Packer:
    """Packs pieces into sequences; done() is called with each one's pieces, in order."""

    def __init__(self, done, length: int = LENGTH):
        self.done, self.length = done, length
        self.level = np.zeros(length + 1, np.int64)  # open sequences by fill
        self.open: dict[int, list[list[Piece]]] = {}
        self.held = 0

    def add(self, key: int, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.length:
            self.done([(key, n, at, ids[at : at + self.length])])
            at += self.length
        if at < n:
            self.place((key, n, at, ids[at:]))

    def place(self, piece: Piece) -> None:
        size, n = len(piece[3]), self.level
        # what the sum of squares changes by, for fills 0 (a new sequence) to length - size (a full one, no longer open)
        change = 2 * n[size:].copy() + 1
        change[-1] = 0
        change[1:] += 1 - 2 * n[1 : self.length - size + 1]
        change[1:][n[1 : self.length - size + 1] == 0] = np.iinfo(np.int64).max
        fill = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
        self.held += size
        pieces = []
        if fill:
            pieces = self.open[fill].pop()
            n[fill] -= 1
        pieces.append(piece)
        if fill + size == self.length:
            self.held -= self.length
            self.done(pieces)
        else:
            n[fill + size] += 1
            self.open.setdefault(fill + size, []).append(pieces)

    def close(self) -> None:
        """Cuts each open sequence, in place, into powers of two: the largest first."""
        for fill in sorted(self.open, reverse=True):
            for pieces in self.open[fill]:
                room, left, out = 1 << fill.bit_length() - 1, fill, []
                for key, total, start, ids in pieces:
                    at = 0
                    while at < len(ids):
                        take = min(room, len(ids) - at)
                        out.append((key, total, start + at, ids[at : at + take]))
                        at, room, left = at + take, room - take, left - take
                        if not room:
                            self.done(out)
                            room, out = 1 << max(left.bit_length() - 1, 0), []
        self.open, self.held = {}, 0
        self.level[:] = 0


def pack(docs: DataFrame, path: str | None = None, *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    length must be a power of two. path: the tokenizer's file, which each worker opens. Each document ends with end_id;
    null and empty texts have this id only. Null and repeated doc_ids are documents of their own, though their pieces
    can't be told apart by id. Documents longer than a sequence are cut. sequence_id holds the task's number in its
    upper bits, so it is unique. A task that runs again packs the same. Extra columns are ignored; no rows give none.
    """
    path = path or default_path()
    if length & (length - 1):
        raise ValueError("length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], "<u4")
        context = TaskContext.get()
        base, sequence = (context.partitionId() if context else 0) << 40, 0
        rows: list[tuple] = []

        def done(pieces: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for key, total, start, ids in pieces:
                rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, at))
                at += len(ids)
            sequence += 1

        packer = Packer(done, length)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in slices(batches, limit=1 << 20):
            for key, ids in zip(batch.column("doc_id").to_pylist(), tok.ids_of(batch.column("text").to_pylist())):
                packer.add(key, np.concatenate([ids, end]))
                if packer.held > HELD_IDS:
                    packer.close()
            yield emit()
        packer.close()
        yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
