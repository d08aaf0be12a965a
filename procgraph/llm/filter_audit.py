"""Filter interaction audit: what each order of the filters removes, from one look-up a document."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procgraph.llm.token_ids import text_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
NONE = len(FILTERS)
#: Parts whose counts a task holds at once (17 kB each); beyond, it hands them on.
MOST_PARTS = 1_000
CAPITALS = bytes(range(0x41, 0x5B))
MARKS = b"#$%&*|"
#: Bytes that go on with a code point.
FOLLOWING = bytes(range(0x80, 0xC0))
CELLS = len(ORDERS) * (NONE + 1)


def first_failures() -> np.ndarray:
    """[fails, order]: the step (from 0) whose filter is the first that fails, NONE where none does. Bit i of fails is filter i."""
    table = np.full((1 << NONE, len(ORDERS)), NONE, np.int64)
    for fails in range(1 << NONE):
        for at, order in enumerate(ORDERS):
            table[fails, at] = next((step for step, f in enumerate(order) if fails >> FILTERS.index(f) & 1), NONE)
    return table


def judged(text: bytes) -> int:
    """Bits of A to D of a UTF-8 text."""
    words = text.split()  # of bytes: at runs of \x20 and \x09-\x0D
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, FOLLOWING))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def marked(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, fails, key) of every document: bits of A to D, and a 128-bit key of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(batches):
            texts = pc.fill_null(table["text"].combine_chunks(), "").cast(pa.large_binary()).to_pylist()
            keys = pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), table["part"].combine_chunks(), pa.array([judged(t) for t in texts], pa.int32()), keys], names=["doc_id", "part", "fails", "key"]
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, part string, fails int, key binary")


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, fails, good, toxic, n): how many documents of a part fail which filters, E included, in rows of one text or a few.

    Only 40-byte rows move, never texts: once by doc_id to their labels, then, added up
    before they do, by text. A text that a third of all rows share is one row a task and part.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    kind = ["key", "part", "fails", "good", "toxic"]
    rows = marked(docs, part).join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    of_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    of_text = of_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id")
    )
    firsts = of_text.groupBy("key").agg(F.min("least").alias("first"))
    held = of_text.join(firsts, "key")
    first = F.col("n_no_id") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    parts = F.array(
        F.struct(F.col("fails").alias("fails"), first.alias("n")),
        F.struct(F.col("fails").bitwiseOR(1 << FILTERS.index("E")).alias("fails"), (F.col("n") - first).alias("n")),
    )
    return held.select("part", "good", "toxic", F.explode(parts).alias("x")).select("part", "x.fails", "good", "toxic", "x.n").where("n > 0")


def removals(rows: DataFrame) -> DataFrame:
    """(part, counts): for each part the summed counts [all, good, toxic][order][first failing step, or none]."""
    table = first_failures()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def partial() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([a.reshape(-1) for a in held.values()], pa.list_(pa.int64()))], names=["part", "counts"])
            held.clear()
            return made

        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                coded = some["part"].dictionary_encode()
                codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                cells = (codes[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (NONE + 1) + table[some["fails"].to_numpy()]
                n = some["n"].to_numpy()
                labelled = [np.ones(len(some), bool), *(some[c].to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
                counts = [np.bincount(cells[which].reshape(-1), np.repeat(n[which], len(ORDERS)), len(names) * CELLS) for which in labelled]
                counts = np.stack(counts).astype(np.int64).reshape(len(labelled), len(names), CELLS)
                for i, name in enumerate(names):
                    held[name] = held.get(name, 0) + counts[:, i]
                if len(held) > MOST_PARTS:
                    yield partial()
        if held:
            yield partial()

    partials = rows.select("part", "fails", "good", "toxic", "n").mapInArrow(run, "part string, counts array<long>")
    cells = partials.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    # one number a cell of a part: 2160 of them
    return cells.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x.n).alias("counts"))


def report(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, as the audit returns them.

    What fails a filter at all is what it removes as the first step of an order, and what fails
    it alone is what it removes as the last one.
    """
    places = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    leading = np.array([next(i for i, order in enumerate(ORDERS) if order[0] == f) for f in FILTERS])
    closing = np.array([next(i for i, order in enumerate(ORDERS) if order[-1] == f) for f in FILTERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
                every, good, toxic = np.array(data, np.int64).reshape(3, len(ORDERS), NONE + 1)
                removed = every[:, :NONE]
                failing, alone = removed[leading, 0], removed[closing, NONE - 1]
                shapley = np.bincount(places.reshape(-1), removed.reshape(-1), NONE).astype(np.int64)
                columns = {
                    "kept": every.sum(1)[:, None] - removed.cumsum(1), "removed": removed, "redundant": failing[places] - removed, "unique_fails": alone[places],
                    "good_lost": good[:, :NONE], "toxic_lost": toxic[:, :NONE], "shapley": shapley[places],
                }
                n = places.size
                heads = [pa.array([part] * n), pa.array(np.repeat(ORDERS, NONE).tolist()), pa.array(np.tile(np.arange(1, NONE + 1), len(ORDERS)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*heads, *(pa.array(c.reshape(-1)) for c in columns.values())], names=["part", "filter_order", "step", *columns])

    numbers = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counts.mapInArrow(run, f"part string, filter_order string, step int, {numbers}")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For every part, each of the 120 orders of filters A to E and each step: what is kept, removed, redundant, failing this filter alone, and lost of good and toxic documents.

    A fails below 50 words, B below 65 distinct words in 100, C above 5 capitals A-Z in
    100 code points, D at any of `#$%&*|`, E where a smaller doc_id has the same text.

    A null text is empty, a null part the empty string, and both fall together with such rows. Rows that repeat a
    doc_id are documents each, yet none makes another fail E, as neither is smaller; a document without id is never
    smaller nor larger. Several labels of a doc_id count as good (toxic) if one of them is. An empty table gives no
    rows; other columns aren't read. Texts are equal if their 128-bit keys are.
    """
    return report(removals(failures(docs, labels, part)))
