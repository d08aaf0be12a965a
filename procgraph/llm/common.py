"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall

#: Arrays sort a missing doc_id before every other one.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one is set only where none is, as in tests."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one, for files that are written once."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def doc_text(docs: DataFrame) -> DataFrame:
    """Only what the operators read, so that other columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; a scan of one column without a shuffle."""
    return doc_text(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0


def batched(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text, batch): documents dealt by their id into n batches. Equal ids share a batch."""
    return doc_text(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))


def ids_of(column) -> np.ndarray:
    """doc_id column of an Arrow table as int64, nulls as NO_ID."""
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], dtype=np.int64)


def id_or_none(x: int) -> int | None:
    return None if x == NO_ID else int(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes:
    """Stable 64-bit hashes of words, remembered up to a bounded number of short words."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, words: list) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            pass
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 64:
                    known[w] = h
            out[i] = h
        return out


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first: sorted values then compress in the shuffle."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    rows = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.empty((rows.shape[1], size), np.uint8)
    for i in range(size):  # faster than a transposed copy
        out[:, i] = rows[i]
    return out.reshape(-1).view(kind)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
