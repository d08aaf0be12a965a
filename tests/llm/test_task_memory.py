"""What tasks of the quality rules and of packing remember is bounded, within a batch too, and changes no row."""

import tracemalloc

import numpy as np
import pyarrow as pa

from procgraph.llm import packing
from procgraph.llm.fertility import Vocabularies
from procgraph.llm.token_ids import UnitEncoder, vocabulary_path


def words(n):
    rng = np.random.default_rng(3)
    return list({"".join(x) for x in rng.choice(list("aeiounrstlé"), (n, 9))})


def test_words_remembered():
    many, files = words(40_000), [vocabulary_path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    few, all_of_them = Vocabularies(*files, most=1000, at_once=500), Vocabularies(*files, most=10**6)
    array = pa.array(many, pa.large_string())
    want = [x.tolist() for x in all_of_them(array)]
    tracemalloc.start()
    got = few(array)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in got] == want
    assert [x.tolist() for x in few(array)] == want
    assert len(few.known) == 1000
    assert peak < 100 * len(many)
    assert [len(x) for x in few(array[:0])] == [0, 0, 0]


def test_units_remembered():
    many = words(5000)
    few, all_of_them = (UnitEncoder(vocabulary_path("byte_bpe_50k.json"), most) for most in (1000, 10**6))
    for texts in ([" ".join(many), None, ""], [" ".join(many[::-1]), "a" * 70]):
        assert [x.tolist() for x in few(texts)] == [x.tolist() for x in all_of_them(texts)]
        assert len(few.known) <= 1000


def test_packing_in_small_batches(spark):
    many = words(3000)
    docs = spark.createDataFrame([(i, " ".join(many[i * 7 : i * 7 + 200])) for i in range(300)], "doc_id long, text string").coalesce(1)
    assert packing.pack(docs, remembered=50, batch_bytes=1000).collect() == packing.pack(docs).collect()
