"""Results that must not depend on sizes: of a corpus, of a batch, of a bucket."""

import pyarrow as pa

from procgraph.llm import fertility, pitman_yor


def test_every_previous_word_has_its_own_restaurant(spark):
    texts = [(i, " ".join(f"p{j} s{j}" for j in range(i, 40_000, 20))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model, spread = pitman_yor.Model(slice_bytes=50_000), pitman_yor.np.array([pitman_yor.START])
    rows = [r for s in pitman_yor.encode(docs, model).collect() for r in pitman_yor.Slice(bytes(s["data"]), 3, spread).rows(s["slice"])]
    sent, contexts, totals = pitman_yor.table(rows), [], {}
    for b in range(3):
        bucket = pitman_yor.Bucket(sent.filter(pa.compute.equal(sent["dest"], b)), model, 2, spread)
        contexts += [c for c in bucket.contexts.tolist() if c != int(pitman_yor.START)]
        for c, n in zip(bucket.contexts[bucket.context].tolist(), bucket.count.tolist()):
            totals[c] = totals.get(c, 0) + n
    assert len(contexts) == len(set(contexts)) == 80_000  # 40,000 of p and of s, each in one bucket
    assert totals[int(pitman_yor.START)] == sum(not pitman_yor.is_held_out(i) for i in range(20))


def test_fences_by_language_and_without_a_jump(spark):
    def measured(rows):
        return spark.createDataFrame([(lang, script, 500, x, x, 8.0) for lang, script, x in rows], "lang string, script string, n_tokens long, chars_per_token double, chars_per_byte_token double, token_entropy double")

    def of(rows):
        return {r["fence"]: r["chars_per_token_fence"] for r in fertility.fences(measured(rows)).collect()}

    got = of([("it", "latin", 2.9)] * 900 + [("vi", "latin", 1.19)] * 150 + [(None, "arabic", 1.02)] * 400 + [(None, "devanagari", 0.8)] * 120)
    assert set(got) == {"latin it", "latin vi", "arabic", "devanagari"}
    for key, x in (("latin it", 2.9), ("latin vi", 1.19), ("arabic", 1.02), ("devanagari", 0.8)):
        assert abs(x - got[key]["middle"]) < 5 * got[key]["sigma"]
    before, after = (of([("it", "latin", 2.9)] * n)["latin it"] for n in (99, 100))
    assert abs(before["middle"] - after["middle"]) < 0.02 and abs(before["sigma"] - after["sigma"]) < 0.01
