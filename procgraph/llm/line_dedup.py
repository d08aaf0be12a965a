"""Reversible line dedup: exact reference counts of lines, with sharded cuckoo filters over the frequent ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import cut, doc_text, mix
from procgraph.llm.token_ids import text_batches

KEYS_PER_SHARD = 50_000
#: Postings that one copy of a shard's filter probes, about, and the least number of copies.
ROWS_PER_PROBE = 400_000
LEAST_COPIES = 8


class CuckooFilter:
    """Set of 64-bit keys with deletion: four 16-bit fingerprints a bucket, each in one of two buckets.

    Keys that find no place after 200 moves go to an exact stash, so no key is
    ever missed. A key may be reported that is not held (about 8 in 65,536).
    """

    SLOTS = 4

    def __init__(self, keys: int = 0, data: bytes | None = None):
        if data is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (self.SLOTS * 0.5) + 1))))
            self.table, self.stash = np.zeros((buckets, self.SLOTS), np.uint16), []
        else:
            buckets = int.from_bytes(data[:4], "little")
            end = 4 + buckets * self.SLOTS * 2
            self.table = np.frombuffer(data[4:end], np.uint16).reshape(-1, self.SLOTS).copy()
            self.stash = np.frombuffer(data[end:], np.uint64).tolist()

    def dump(self) -> bytes:
        return len(self.table).to_bytes(4, "little") + self.table.tobytes() + np.array(self.stash, np.uint64).tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, mask = mix(keys), np.uint64(len(self.table) - 1)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = h & mask
        return mark, one, (one ^ mix(mark.astype(np.uint64))) & mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        return found | np.isin(keys, np.array(self.stash, np.uint64)) if self.stash else found

    def insert(self, keys: np.ndarray) -> None:
        table, mask = self.table, len(self.table) - 1
        for key, m, *places in zip(keys.tolist(), *(a.tolist() for a in self._places(keys))):
            for bucket in places:
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = m
                    break
            else:
                self._move(table, mask, m, places[key & 1], key)

    def _move(self, table: np.ndarray, mask: int, mark: int, bucket: int, key: int) -> None:
        path = []
        for step in range(200):
            slot = (key >> (step % 32)) % self.SLOTS
            path.append((bucket, slot, int(table[bucket, slot])))
            table[bucket, slot], mark = mark, path[-1][2]
            bucket = (bucket ^ int(mix(np.array([mark], np.uint64))[0])) & mask
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return
        for bucket, slot, old in reversed(path):
            table[bucket, slot] = old
        self.stash.append(key)

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for key, m, *places in zip(keys.tolist(), *(a.tolist() for a in self._places(keys))):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for bucket in places:
                held = np.flatnonzero(self.table[bucket] == m)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def line_keys(text: str | None, least_chars: int) -> list[bytes]:
    """The 128-bit key of every line, b"" for short ones: A-Z in lower case, ASCII white space stripped from both ends."""
    import xxhash

    out = []
    for line in (text or "").encode().lower().split(b"\n"):
        line = line.strip()
        n = len(line)
        long = n >= least_chars and (n >= 4 * least_chars or len(line.decode()) >= least_chars)
        out.append(xxhash.xxh3_128_digest(line) if long else b"")
    return out


def line_postings(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """(k1, k2, doc_id): every row's distinct keys of lines with least_chars code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(batches):
            keys = [list(set(line_keys(t, least_chars)) - {b""}) for t in table["text"].to_pylist()]
            flat = np.frombuffer(b"".join([k for x in keys for k in x]), "<i8").reshape(-1, 2)
            ids = table["doc_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(keys)), list(map(len, keys)))))
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), ids], names=["k1", "k2", "doc_id"])

    return doc_text(docs).mapInArrow(run, "k1 long, k2 long, doc_id long")


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class LineState:
    """What a line index holds: who has which line, the exact counts, and the filters over lines with min_docs documents or more."""

    postings: DataFrame
    refs: DataFrame  # k1, k2, n_docs, last_doc
    filters: DataFrame  # shard, filter
    shards: int
    least_chars: int
    min_docs: int


def reference_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _updated(filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """Filters with keys (k1, is_new) inserted or deleted, each shard in a group of its own."""

    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        keys, is_new = new["k1"].to_numpy().astype(np.int64).view(np.uint64), new["is_new"].to_numpy(bool)
        held = CuckooFilter(data=old["filter"].iloc[0]) if len(old) else CuckooFilter(max(len(keys), KEYS_PER_SHARD))
        held.delete(keys[~is_new])
        held.insert(keys[is_new])
        return pd.DataFrame({"shard": [key[0]], "filter": [held.dump()]})

    spark = changes.sparkSession
    filters = filters if filters is not None else spark.createDataFrame([], "shard int, filter binary")
    changes = changes.select(shard_of(shards).alias("shard"), "k1", "is_new")
    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, "shard int, filter binary")


def index(docs: DataFrame, least_chars: int = 40, min_docs: int = 5) -> LineState:
    """A line index of docs. Postings and counts are kept in the shared folder."""
    postings = cut(line_postings(docs, least_chars))
    refs = cut(reference_counts(postings))
    frequent = refs.where(F.col("n_docs") >= min_docs)
    shards = max(1, frequent.count() // KEYS_PER_SHARD + 1)
    return LineState(postings, refs, cut(_updated(None, frequent.withColumn("is_new", F.lit(True)), shards)), shards, least_chars, min_docs)


def _changed(state: LineState, postings: DataFrame, touched: DataFrame) -> LineState:
    """The state with other postings; counts of the touched keys (k1, k2) alone are taken anew."""
    postings = cut(postings)
    fresh = reference_counts(postings.join(touched, ["k1", "k2"], "left_semi"))
    refs = cut(state.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(fresh))
    was = state.refs.join(touched, ["k1", "k2"], "left_semi").where(F.col("n_docs") >= state.min_docs).select("k1", "k2")
    now = fresh.where(F.col("n_docs") >= state.min_docs).select("k1", "k2")
    moved = now.join(was, ["k1", "k2"], "left_anti").withColumn("is_new", F.lit(True)).unionByName(was.join(now, ["k1", "k2"], "left_anti").withColumn("is_new", F.lit(False)))
    return replace(state, postings=postings, refs=refs, filters=cut(_updated(state.filters, moved, state.shards)))


def insert(state: LineState, docs: DataFrame) -> LineState:
    """The index with the rows of docs added."""
    more = cut(line_postings(docs, state.least_chars))
    return _changed(state, state.postings.unionByName(more), more.select("k1", "k2").distinct())


def delete(state: LineState, ids: DataFrame) -> LineState:
    """The index without the documents in ids (doc_id): as if they had never been inserted."""
    gone = state.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return _changed(state, state.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), gone.select("k1", "k2").distinct())


def drops(state: LineState) -> DataFrame:
    """(doc_id, keys): for each document the 16-byte keys of lines it loses.

    Postings meet the filters by shard, dealt by document over so many copies that one gets about
    ROWS_PER_PROBE rows, so no common line lands in one task. What passes a filter is looked up there in the
    shard's exact counts, which go along and remove false reports.
    """

    def run(key: tuple, held: pa.Table, rows: pa.Table) -> pa.Table:
        nothing = rows.slice(0, 0).select(["k1", "k2", "doc_id"])
        exact = held.filter(pc.is_null(held["filter"]))
        if not len(exact) or not len(rows):
            return nothing
        filters = held["filter"].drop_null()
        keys = rows["k1"].to_numpy().view(np.uint64)
        likely = rows.filter(pa.array(CuckooFilter(data=filters[0].as_py()).contains(keys)))
        found = likely.join(exact.select(["k1", "k2", "last_doc", "known"]), ["k1", "k2"], join_type="inner")
        same = pc.or_(pc.fill_null(pc.equal(found["doc_id"], found["last_doc"]), False), pc.and_(pc.is_null(found["doc_id"]), pc.is_null(found["last_doc"])))
        return found.filter(pc.invert(same)).select(["k1", "k2", "doc_id"])

    exact = state.refs.where(F.col("n_docs") >= state.min_docs)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    held = state.filters.select("shard", "filter", none("k1", "long"), none("k2", "long"), none("last_doc", "long"), F.lit(True).alias("known"))
    held = held.unionByName(exact.select(shard_of(state.shards).alias("shard"), none("filter", "binary"), "k1", "k2", "last_doc", F.lit(True).alias("known")))
    copies = max(LEAST_COPIES, state.postings.count() // (state.shards * ROWS_PER_PROBE) + 1)
    salted = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = state.postings.select("k1", "k2", "doc_id", shard_of(state.shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(copies)).cast("int").alias("salt"))
    hit = salted.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInArrow(run, "k1 long, k2 long, doc_id long")
    return hit.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


KEPT = "text string, n_lines long, n_dropped long"


def _without_lines(docs: DataFrame, lost: DataFrame, least_chars: int) -> DataFrame:
    """(row, kept): the whole row of docs, so that its columns never clash, and struct<text, n_lines, n_dropped>."""

    @F.pandas_udf(KEPT)
    def without(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(text, keys):
            lines = (t or "").split("\n")
            if gone is not None and len(gone):
                gone = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in gone}
                left = [x for x, k in zip(lines, line_keys(t, least_chars)) if k not in gone]
                out.append(("\n".join(left), len(lines), len(lines) - len(left)))
            else:
                out.append((t, len(lines), 0))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), "keys")
    return rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")), "left").select("row", without("text", "keys").alias("kept"))


def apply_drops(docs: DataFrame, lost: DataFrame, least_chars: int) -> DataFrame:
    """docs with __kept struct<text, n_lines, n_dropped>."""
    return _without_lines(docs.drop("__kept"), lost, least_chars).select("row.*", F.col("kept").alias("__kept"))


def dedup(docs: DataFrame, least_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with __kept struct<text, n_lines, n_dropped>: lines whose key (least_chars code points or
    more) min_docs rows hold stay in the largest doc_id alone.

    A null or empty text is one empty line. A document here is a row: rows that
    repeat a doc_id count each and lose the same lines; null doc_ids come before
    all others. An empty table gives none. Other columns stay; __kept is replaced.
    """
    return apply_drops(docs, drops(index(docs, least_chars, min_docs)), least_chars)


def dedup_documents(docs: DataFrame, least_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs, all its own columns, with text as dedup() leaves it."""
    kept = _without_lines(docs, drops(index(docs, least_chars, min_docs)), least_chars)
    return kept.select(*(F.col("kept.text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
