"""Token ids as flat binary files with 64-bit document offsets, read back by memory maps."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.llm.common import doc_text, shared_folder
from procgraph.llm.token_ids import WordEncoder, text_batches, texts_of, vocabulary_path


def local_path(folder: str) -> str:
    """Memory maps need a file system: the shared folder must be a mount (file:), the same on every executor."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped and need a mounted shared folder, not {folder}")
    return parts.path


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, kind: str = "<u2") -> DataFrame:
    """Writes every document's ids and the end id in ascending doc_id order; returns the table of shards.

    A shard NNNNN has NNNNN.bin (unsigned integers of `kind`), NNNNN.off (64-bit
    offsets of its documents and the end, in ids) and NNNNN.doc (64-bit doc_ids;
    the smallest value stands for a null). A task writes under a name of its
    own attempt and renames, so a task that runs again replaces nothing half
    written. Shards are the range partitions of doc_id; their bases are prefix
    sums of the shards' token counts and stand in index.json.

    Null and empty texts have the end id alone. A null doc_id comes first; rows
    that repeat a doc_id stand together, in the order of their texts. An empty
    table makes no shard.
    """
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, own = task.partitionId(), f"{path}/.{task.partitionId():05d}-{task.taskAttemptId()}"
        encode, offsets, ids, n = WordEncoder(vocabulary), [np.zeros(1, "<i8")], [], 0
        end = np.array([end_id], kind).tobytes()
        with open(f"{own}.bin", "wb") as out:
            for table in text_batches(batches):
                data, ends = encode(texts_of(table))
                data = memoryview(np.frombuffer(data, "<u4").astype(kind))
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    out.write(data[a:b])
                    out.write(end)
                offsets.append((n + np.arange(1, len(ends)) + ends[1:] - ends[0]).astype("<i8"))
                n = int(offsets[-1][-1])
                ids.append(table["doc_id"].fill_null(-(2**63)).to_numpy().astype("<i8"))
        rows = sum(map(len, ids))
        if rows:
            for name, parts in (("off", offsets), ("doc", ids)):
                np.concatenate(parts).tofile(f"{own}.{name}")
                os.replace(f"{own}.{name}", f"{path}/{part:05d}.{name}")
            os.replace(f"{own}.bin", f"{path}/{part:05d}.bin")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([n], pa.int64())], names=["shard", "n_docs", "n_ids"])
        else:
            os.remove(f"{own}.bin")

    session = docs.sparkSession
    n = int(session.conf.get("spark.sql.shuffle.partitions"))
    ordered = doc_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(map(tuple, ordered.mapInArrow(run, "shard int, n_docs long, n_ids long").collect()))  # one row for each partition
    base, index = 0, []
    for shard, n_docs, n_ids in shards:
        index.append((shard, n_docs, n_ids, base))
        base += n_ids
    with open(f"{path}/index.json", "w") as out:
        json.dump({"kind": kind, "ids": base, "shards": [dict(zip(("shard", "n_docs", "n_ids", "base"), x)) for x in index]}, out)
    return shards_of(session, folder)


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    """The table of shards (shard, n_docs, n_ids, base) of written files."""
    with open(f"{local_path(folder)}/index.json") as f:
        rows = [(x["shard"], x["n_docs"], x["n_ids"], x["base"]) for x in json.load(f)["shards"]]
    df = spark.createDataFrame(rows, "shard int, n_docs long, n_ids long, base long")
    return df.repartition(max(1, len(rows)), "shard") if rows else df


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the memory-mapped files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    path = local_path(folder)
    with open(f"{path}/index.json") as f:
        kind = json.load(f)["kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist()):
                ids = np.memmap(f"{path}/{shard:05d}.bin", kind, "r")
                offsets = np.memmap(f"{path}/{shard:05d}.off", "<i8", "r")
                docs = np.memmap(f"{path}/{shard:05d}.doc", "<i8", "r")
                for at in range(0, len(docs), 5000):
                    edges = np.asarray(offsets[at : at + 5001])
                    parts = [ids[a:b].astype("<u4") for a, b in zip(edges[:-1], edges[1:])]
                    names = [None if x == -(2**63) else x for x in docs[at : at + 5000].tolist()]
                    columns = [pa.array(names, pa.int64()), pa.array(base + edges[:-1]), pa.array(np.diff(edges)), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return shards_of(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_table(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the files of docs and reads them back."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")
    write_token_files(docs, folder, **options)
    return read_token_files(spark, folder).select("doc_id", F.col("start"), "n_tokens", "ids_crc32")
