"""Packing token streams into fixed windows with the online sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procgraph.llm.common import doc_text
from procgraph.llm.token_ids import UnitEncoder, release_unused, text_batches, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Windows of `size` tokens, filled online.

    levels[l] counts the open windows that hold l tokens. A remainder of s
    tokens goes to the level (0: a new window) where the sum of squared counts
    grows least: leaving level l gains 1 - 2 levels[l], reaching l + s costs
    1 + 2 levels[l + s], and a full window costs nothing. Ties take the fullest
    level. Whole windows of a long document are closed at once.
    """

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id, self.seen = size, first_id, 0
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size + 1)]  # by level: (sequence_id, pieces)
        self.out: list[tuple] = []

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _place(self, piece: tuple, sequence: int, offset: int) -> None:
        doc_id, start, ids, total = piece
        self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.seen += len(ids)
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self._place((doc_id, at, ids[at : at + self.size], len(ids)), self._new_id(), 0)
        if whole == len(ids):
            return
        piece, s = (doc_id, whole, ids[whole:], len(ids)), len(ids) - whole
        n = self.levels
        reach = n[s:]  # the level each window would reach, from 0 on
        cost = 1 + 2 * reach
        cost[-1] = 0
        leave = 1 - 2 * n[: self.size - s + 1]
        leave[0] = 0
        cost = np.where((n[: self.size - s + 1] > 0) | (np.arange(self.size - s + 1) == 0), cost + leave, np.iinfo(np.int64).max)
        level = int(len(cost) - 1 - np.argmin(cost[::-1]))
        sequence, pieces = self.open[level].pop() if level else (self._new_id(), [])
        n[level] -= level > 0
        pieces.append((piece, level))
        if level + s == self.size:
            for p, offset in pieces:
                self._place(p, sequence, offset)
        else:
            n[level + s] += 1
            self.open[level + s].append((sequence, pieces))

    def close(self, most_padding: float = 0.02) -> list[tuple]:
        """Ends all windows. Those of a power of two stand, needing no padding; the others stand, fullest first, while what
        they are padded with stays within most_padding of all tokens seen. What the rest hold is cut anew: full windows, then ever
        smaller powers of two."""
        spare, held = most_padding * self.seen, []
        for level in range(self.size - 1, 0, -1):
            for sequence, pieces in self.open[level]:
                padding = 0 if level & (level - 1) == 0 else self.size - level
                if padding <= spare:
                    spare -= padding
                    for p, offset in pieces:
                        self._place(p, sequence, offset)
                else:
                    held += [p for p, _ in pieces]
        left = sum(len(p[2]) for p in held)
        room, offset, sequence = 0, 0, -1
        for doc_id, start, ids, total in held:
            at = 0
            while at < len(ids):
                if not room:
                    room = min(self.size, 1 << (left.bit_length() - 1))
                    sequence, offset = self._new_id(), 0
                n = min(room, len(ids) - at)
                self._place((doc_id, start + at, ids[at : at + n], total), sequence, offset)
                at, offset, room, left = at + n, offset + n, room - n, left - n
        out, self.out = self.out, []
        self.open = [[] for _ in range(self.size + 1)]
        self.levels[:] = 0
        return out

    def done(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = 1024, end_id: int = 0, most_padding: float = 0.02, remembered: int = 600_000, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row for each piece of a document's ids (its text's ids, then end_id) and its place in a window.

    Each task packs what it scans: no row moves between tasks, a lost task is
    packed anew the same way, and sequence ids hold the partition in their
    upper bits. Sequences have `size` tokens but for those that a partition's end leaves
    open: padding, at most most_padding of its tokens, fills them up, or they have a power of two (LevelPacker.close).

    A null or empty text has only the end id. Rows that repeat a doc_id and a
    null doc_id are packed as documents of their own; an empty table gives no
    rows; other columns aren't read. A task takes batch_bytes of text at once and remembers
    `remembered` units' ids: fewer take less memory and more time, the rows are the same.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = UnitEncoder(vocabulary, remembered), LevelPacker(size, TaskContext.get().partitionId() << 33)
        for table in text_batches(batches, batch_bytes):
            for doc_id, ids in zip(table["doc_id"].to_pylist(), encode(table["text"].to_pylist())):
                packer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"))
            yield as_batch(packer.done())
        yield as_batch(packer.close(most_padding))
        del encode, packer
        release_unused()

    names = [f.split()[0] for f in PIECES.split(", ")]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return doc_text(docs).mapInArrow(run, PIECES)
