"""The filter audit, the trie encoder and the clustering against brute force, on ordinary, null, empty, tied, repeated and clashing rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from tokenizers import Tokenizer

from procgraph.llm import clustering, filter_audit, trie_bpe
from procgraph.llm.queries import ORACLES, QUERIES
from procgraph.llm.token_ids import vocabulary_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SF = "/root/testdata/sf0.001"
TEXTS = [
    "", None, " \n\t ", "one", "É à ÉCOLE straße Σ ΑΣ 漢字", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)),
    "LOUD " * 60, " ".join(f"Q{i}" for i in range(80)), " ".join(f"cost ${i}" for i in range(40)), " ".join(f"t{i % 997}" for i in range(30_000)), "z" * 50_000, "don't we'll 12345 x y z",
]
SCHEMA = "doc_id long, text string, source string, part string, key string, fails int, n long, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "", "a", "b"][i % 4], "p", "k", 1, 2, "i") for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "a", "p", "k", 1, 2, "i"), (None, TEXTS[6], "b", "p", "k", 1, 2, "i"), (None, "one", None, "p", "k", 1, 2, "i")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0, "x"), (2, 1, 1, "x"), (7, 1, None, "x"), (7, 0, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (8, None, 1, "x")], "doc_id long, quality int, toxic int, part string")


def fails(rows, text, doc_id):
    w = WORDS(text)
    earlier = doc_id is not None and any(i is not None and i < doc_id and t == text for i, t, _ in rows)
    return {
        "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier,
    }


def test_audit(docs, labels):
    rows = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]
    known = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect() if r["doc_id"] is not None]
    judged = [(p, fails(rows, t, i), any(d == i and q == 1 for d, q, _ in known), any(d == i and x == 1 for d, _, x in known)) for i, t, p in rows]
    expect = {}
    for part in {p for p, *_ in judged}:
        mine = [x[1:] for x in judged if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(gone)
                expect[part, order, step] = [
                    len(left), len(gone), sum(x[0][f] for x in mine) - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in mine),
                    sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]
        for (p, order, step), v in expect.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == len(expect) == 600 * 3
    for r in got:
        assert expect[r["part"], r["filter_order"], r["step"]] == [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")], r
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_hands_parts_on(spark, labels, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id % 7) as text", "concat('s', id % 50) as source")
    whole = filter_audit.audit(docs, labels).orderBy("part", "filter_order", "step").collect()
    assert len(whole) == 600 * 50 and {r["kept"] + r["removed"] for r in whole if r["step"] == 1} == {60}
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 3)
    assert filter_audit.audit(docs, labels).orderBy("part", "filter_order", "step").collect() == whole


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    for at, order in enumerate(filter_audit.ORDERS):
        assert [table[1 << "ABCDE".index(f), at] for f in order] == [0, 1, 2, 3, 4]


def library():
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def test_encode_and_decode(docs, spark):
    tokenizer = library()
    rows = trie_bpe.decode(trie_bpe.encode(docs)).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        by_text.setdefault(len(ids), []).append((ids, tokenizer.decode(ids, skip_special_tokens=False)))
    for r in rows:
        assert (np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) in by_text[r["n_tokens"]]
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows if r["doc_id"] is not None}
    for i, t in enumerate(TEXTS):
        assert ids[i] == tokenizer.encode(t or "", add_special_tokens=False).ids
    assert trie_bpe.decode(trie_bpe.encode(docs.limit(0))).count() == 0


def test_trie_on_odd_strings():
    import pyarrow as pa

    rng, tokenizer = random.Random(3), library()
    letters = "aaaabeht'’sdlmr0129   éßÉΣσ漢字กįİ<|endoftext|>.,!?-_AB​\u0085ſKǺ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    texts += ["".join(chr(rng.choice([rng.randint(33, 0x24F), rng.randint(0x300, 0x2FFF), rng.randint(0x1F300, 0x1FAFF)])) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    texts += ["".join(rng.choice("ab") for _ in range(n)) for n in (63, 64, 65, 66, 700, 20_000)]
    encoder = trie_bpe.TrieEncoder(vocabulary_path("word_bpe_49k.json"), most=500)
    data, ends = encoder(pa.array(texts, pa.large_string()))
    ids = np.frombuffer(data, "<u4")
    for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[ends[i] : ends[i + 1]].tolist(), texts[i]
    merges, words = encoder.merges, {"".join(rng.choice("thes") for _ in range(rng.randint(1, 90))) for _ in range(3000)}
    assert merges.encode(words) == {w: merges.walk(w) for w in words}


def test_trie_query(spark):
    tokenizer, texts = library(), {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_trie_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *digests)


def kmeans(rows, k, rounds, seed=2):
    """(vec_id, cluster, distance) and centroids by plain integers."""
    kept = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, w) in zip(kept, at) if w == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, assign())), key=str), centroids


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.1, 64).tolist()) for i in range(60)] + [(i, [0.25] * 64) for i in range(60, 90)]
    rows += [(5, rows[5][1]), (6, [0.5] * 64), (None, [0.5] * 64), (90, None), (91, []), (92, [0.1] * 63), (93, [0.1] * 65), (94, [0.1] * 63 + [None]), (95, [float("nan")] * 64), (96, [float("inf")] + [0.0] * 63)]
    rows += [(97, [-0.0] * 64), (98, [-1e-9] * 64), (99, [float(2**12)] * 64)]
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, x int, cluster string").repartition(3)
    got = clustering.cluster(table, k=12, rounds=4).collect()
    expect, centroids = kmeans(rows, 12, 4)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == expect
    inertia = {}
    for _, j, d in expect:
        inertia[j] = inertia.get(j, 0) + d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
    assert clustering.cluster(table.limit(0)).count() == 0
    few = clustering.cluster(table.where("vec_id in (1, 2)"))
    assert sorted((r["vec_id"], r["distance"]) for r in few.collect()) == [(1, 0), (2, 0)]
    huge = clustering.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>"), k=1).collect()
    assert len(huge) == 3 and all(0 <= r["distance"] <= r["inertia"] for r in huge)


def test_screening_is_exact_and_screens():
    rng = np.random.default_rng(1)
    for spread in (3, 60, 2**26):
        centres = rng.integers(-spread, spread, (40, 64))
        x = centres[rng.integers(0, 40, 4000)] + rng.integers(-spread, spread, (4000, 64))
        x[:100] = x[0]
        centres[7] = centres[3]
        code, step = clustering.coarse(x)
        near = code * step[:, None].astype(float)
        assert (np.abs(x - near) <= step[:, None] / 2).all()
        which, best, taken = clustering.nearest(x, near, clustering.block_norms(x - near, 8).astype("<f4"), centres)
        plain = ((x[:, None, :] - centres[None]) ** 2).sum(-1)
        assert (best == plain.min(1)).all() and (which == plain.argmin(1)).all()
        assert taken < plain.size / 8


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_block_norm_clustering"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(found.fetchall())
