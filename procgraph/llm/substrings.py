"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from procgraph.llm.common import batched, ids_of, mix, planes, text_bytes, unplanes
from procgraph.llm.token_ids import WordMemory, hash_words, words_in

#: Bytes of text whose words one group holds at a time, pre-aggregating its windows, and whose windows one bucket compares. Results don't depend on them.
BATCH_BYTES, BUCKET_BYTES = 5 << 20, 20 << 20
#: What a second, independent hash of a window starts from: copies are settled on 128 bits.
SECOND = np.uint64(0xA0761D6478BD642F)
#: First-level windows travel as 48 bits: a collision only adds a candidate, which the next level settles on 64.
SHORT = np.uint64(2**48 - 1)
FORWARD, BACK = "bucket int, batch int, kind int, data binary", "batch int, data binary"


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of `length` words, by doubling."""
    if length == 1:
        return h
    half = length // 2
    a, n = window_hashes(h, half), len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix(a[:n] * np.uint64(0x9E3779B97F4A7C15) + a[half : half + n])
        return mix(out + h[length - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)) if length % 2 else out


class Batch:
    """The words of one batch of documents, always in the same order."""

    def __init__(self, table: pa.Table):
        table = table.set_column(table.schema.get_field_index("text"), "text", pc.fill_null(table["text"], "").cast(pa.large_string()))
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.codes, self.offsets, self.words = words_in(self.table["text"].combine_chunks())
        self.docs = ids_of(self.table["doc_id"])
        self.rows = np.repeat(np.arange(len(self.docs)), np.diff(self.offsets))

    def hashes(self) -> np.ndarray:
        return np.array(WordMemory(hash_words, 0)(self.words.to_pylist()), np.uint64)[self.codes]

    def fits(self, length: int) -> np.ndarray:
        """Whether the window that starts at a word stays in its document."""
        n = len(self.codes) - length + 1
        return self.rows[:n] == self.rows[length - 1 :] if n > 0 else np.zeros(0, bool)


def forward(batch: int, buckets: int, values: np.ndarray, width: int, kind: int = 0, *more: np.ndarray) -> pa.Table:
    """One row a bucket, with values sorted and their companions; `width` bytes of a value travel."""
    where = (values % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((values, where))
    where, values, more = where[order], values[order], [m[order] for m in more]
    edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, int)
    ends = np.append(edges[1:], len(where))
    data = []
    for a, b in zip(edges, ends):
        parts = [planes(values[a:b])[: width * (b - a)], *(planes(m[a:b]) for m in more)]
        data.append(b"".join([int(b - a).to_bytes(4, "little"), *parts]))
    n = len(data)
    return pa.table({"bucket": pa.array(where[edges], pa.int32()), "batch": pa.array(np.full(n, batch), pa.int32()), "kind": pa.array(np.full(n, kind), pa.int32()), "data": pa.array(data, pa.binary())})


def unpack(data: bytes, width: int, *kinds: str) -> list[np.ndarray]:
    """The values (filled up to 8 bytes) and companions of a forward() row."""
    n = int.from_bytes(data[:4], "little")
    at = 4 + width * n
    out = [unplanes(data[4:at] + bytes((8 - width) * n), np.uint64)]
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(unplanes(data[at : at + size], kind))
        at += size
    return out


def runs(rows: np.ndarray, starts: np.ndarray) -> bytes:
    """Windows (row, start) as runs of neighbours: the first of each run and how many there are."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] - starts[:-1] > 1)])) if len(rows) else np.zeros(0, int)
    last = np.append(new[1:], len(rows))[: len(new)] - 1
    return len(new).to_bytes(4, "little") + b"".join(planes(x.astype(np.int32)) for x in (rows[new], starts[new], starts[last] - starts[new] + 1))


def unruns(data: bytes) -> list[np.ndarray]:
    n = 4 * int.from_bytes(data[:4], "little")
    return [unplanes(data[4 + i * n : 4 + (i + 1) * n], "<i4") for i in range(3)]


def back(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"batch": pa.array([b for b, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})


def _held(found: pa.Table) -> np.ndarray:
    parts = [unplanes(d, np.uint64) for d in found["data"].to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _candidates(batch: Batch, h: np.ndarray, held: np.ndarray, part: int, length: int) -> np.ndarray:
    """Starts of windows of `length` words whose first and last `part` words are repeated windows."""
    known = np.isin(window_hashes(h, part) & SHORT, held)
    fits = batch.fits(length)
    n = len(fits)
    return np.flatnonzero(fits & known[:n] & known[length - part : length - part + n]) if n else np.zeros(0, int)


def repeated(dealt: DataFrame, buckets: int, length: int, halves: DataFrame | None = None, part: int = 0) -> DataFrame:
    """(batch, data): the windows of `length` words in each batch that occur more than once anywhere.

    Without `halves` every window counts; else only those whose two halves of
    `part` words are among these. A batch sends a window once, or twice if it
    holds it twice, so even the commonest one comes at most twice from a batch.
    """

    def send(key: tuple, table: pa.Table, found: pa.Table | None = None) -> pa.Table:
        batch = Batch(table)
        h = batch.hashes()
        if found is None:
            at = np.flatnonzero(batch.fits(length))
        else:
            at = _candidates(batch, h, _held(found), part, length)
        values, counts = np.unique((window_hashes(h, length) & SHORT)[at], return_counts=True)
        return forward(key[0].as_py(), buckets, np.repeat(values, np.minimum(counts, 2)), 6)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        batches = table["batch"].to_pylist()
        own = [unpack(d, 6)[0] for d in table["data"].to_pylist()]
        values, counts = np.unique(np.concatenate(own), return_counts=True)
        twice = values[counts > 1]
        out = []
        for b, v in zip(batches, own):
            v = np.unique(v)
            v = v[np.isin(v, twice, assume_unique=True)]
            if len(v):
                out.append((b, planes(v)))
        return back(out)

    if halves is None:
        sent = dealt.groupBy("batch").applyInArrow(lambda key, table: send(key, table), FORWARD)
    else:
        sent = dealt.groupBy("batch").cogroup(halves.groupBy("batch")).applyInArrow(lambda key, a, b: send(key, a, b) if len(a) else forward(0, 1, np.empty(0, np.uint64), 6), FORWARD)
    return sent.groupBy("bucket").applyInArrow(meet, BACK)


def first_of(values: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """The place of the first of each run of equal windows."""
    if not len(values):
        return np.zeros(0, int)
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (seconds[1:] != seconds[:-1])])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def later_copies(dealt: DataFrame, buckets: int, length: int, halves: DataFrame, part: int) -> DataFrame:
    """(batch, data): runs of the windows of `length` words whose words also start earlier."""

    def send(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return forward(0, 1, np.empty(0, np.uint64), 8)
        batch, name = Batch(table), key[0].as_py()
        h = batch.hashes()
        at = _candidates(batch, h, _held(found), part, length)
        values, seconds = window_hashes(h, length)[at], window_hashes(mix(h ^ SECOND), length)[at]
        rows = batch.rows[at]
        starts = (at - batch.offsets[:-1][rows]).astype(np.int32)
        docs, rows = batch.docs[rows], rows.astype(np.int32)
        order = np.lexsort((starts, docs, seconds, values))  # the order of values, then of occurrence
        values, seconds, docs, starts, rows = (x[order] for x in (values, seconds, docs, starts, rows))
        lead = first_of(values, seconds)
        later = (docs != docs[lead]) | (starts != starts[lead])
        alike = ~later  # with the first itself, rows that repeat its doc_id
        first = forward(name, buckets, values[alike], 8, 0, seconds[alike], docs[alike], starts[alike], rows[alike])
        data = runs(rows[later], starts[later])  # these are settled, and come back to this batch
        own = pa.table({"bucket": pa.array([name % buckets], pa.int32()), "batch": pa.array([name], pa.int32()), "kind": pa.array([1], pa.int32()), "data": pa.array([data], pa.binary())})
        return pa.concat_tables([first, own])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        out, names, own = [], [], []
        for b, kind, d in zip(*(table[c].to_pylist() for c in ("batch", "kind", "data"))):
            if kind:
                out.append((b, d))
            else:
                own.append(unpack(d, 8, "<u8", "<i8", "<i4", "<i4"))
                names.append(b)
        if own:
            values, seconds, docs, starts, rows = (np.concatenate(x) for x in zip(*own))
            source = np.repeat(names, [len(o[0]) for o in own])
            order = np.lexsort((starts, docs, seconds, values))
            d, s = docs[order], starts[order]
            lead = first_of(values[order], seconds[order])
            gone = order[(d != d[lead]) | (s != s[lead])]
            gone = gone[np.argsort(source[gone], kind="stable")]
            of, edges = np.unique(source[gone], return_index=True)
            out += [(int(b), runs(rows[mine], starts[mine])) for b, mine in zip(of, np.split(gone, edges[1:]))]
        return back(out)

    sent = dealt.groupBy("batch").cogroup(halves.groupBy("batch")).applyInArrow(send, FORWARD)
    return sent.groupBy("bucket").applyInArrow(meet, BACK)


def shape(docs: DataFrame, batch_bytes: int, bucket_bytes: int) -> tuple[int, int]:
    """Numbers of batches and buckets."""
    size = text_bytes(docs)
    return size // batch_bytes + 1, size // bucket_bytes + 1


def remove_repeats(docs: DataFrame, window: int = 20, start: int = 10, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every whole text without the words of windows that also start earlier.

    Windows of `window` words are judged on the input; earlier is a smaller
    doc_id, or the same one and an earlier start. Windows of `start` words that
    repeat are found first; those alone are extended, level by level, to twice
    the length, up to `window`, where the first of each is settled. Documents
    move once, dealt into batches; levels exchange packed hashes by value. Windows of the last level are settled on 128 bits.

    Null and empty texts have no words. A null doc_id comes first. Rows that
    repeat a doc_id are one document: windows at the same start in them don't
    remove each other. One row for each row of docs; an empty table gives none;
    other columns aren't read.
    """
    n_batches, n = shape(docs, batch_bytes, bucket_bytes)
    dealt = batched(docs, n_batches)
    length, held = start, repeated(dealt, n, start)
    while 2 * length < window:
        length, held = 2 * length, repeated(dealt, n, 2 * length, held, length)
    gone = later_copies(dealt, n, window, held, length)

    def keep(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        batch = Batch(table)
        delta = np.zeros(len(batch.codes) + 1, np.int64)
        for d in found["data"].to_pylist():
            rows, starts, many = unruns(d)
            at = batch.offsets[:-1][rows] + starts
            np.add.at(delta, at, 1)
            np.add.at(delta, at + many - 1 + window, -1)
        left = np.cumsum(delta)[:-1] == 0
        before = np.concatenate([[0], np.cumsum(left)])
        edges = before[batch.offsets]
        words = batch.words.take(pa.array(batch.codes[left])).cast(pa.large_string())
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words)
        n_words = np.diff(batch.offsets)
        return pa.table({
            "doc_id": batch.table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - np.diff(edges), pa.int64()),
            "kept": pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
        })

    return dealt.groupBy("batch").cogroup(gone.groupBy("batch")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def repeat_levels(docs: DataFrame, start: int = 10, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> list[tuple[int, DataFrame]]:
    """(length, repeated windows by batch) of every level, doubled until no candidates survive."""
    from procgraph.llm.common import cut

    n_batches, n = shape(docs, batch_bytes, bucket_bytes)
    dealt = batched(docs, n_batches)
    length, held, levels = start, cut(repeated(dealt, n, start)), []
    while not held.isEmpty():
        levels.append((length, held))
        held = cut(repeated(dealt, n, 2 * length, held, length))
        length *= 2
    return levels
