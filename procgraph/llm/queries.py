"""The registered queries: each derives its contract's columns from an operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.llm import clustering, fertility, filter_audit, fingerprints, line_dedup, mixing, near_dedup, packing, pitman_yor, secrets, substrings, token_files, trie_bpe
from procgraph.llm.common import read


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; a null text has no words and fails the base rule. See fertility.judge."""
    return fertility.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "chars_per_byte_token", "byte_fallback_share", "token_entropy", "band",
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; a null text has no words, rows of one doc_id are one document. See substrings.remove_repeats."""
    kept = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; a null text has no spans. See secrets.scan."""
    return secrets.report(secrets.scan(read(spark, sf_dir, "documents")))


def op4_consistent_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; texts without words have the fingerprint "". See fingerprints.fingerprint."""
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op5_signature_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; texts without words are linked with nothing. See near_dedup.near_duplicates."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), near_dedup.Rule(width=2))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; a null text is one empty line. See line_dedup.dedup."""
    kept = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce(F.col("__kept.text"), F.lit("")), 256)
    return kept.select("doc_id", F.col("__kept.n_lines").alias("n_lines"), F.col("__kept.n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece; a null text has its end id alone. See packing.pack."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each doc_id; a null text has its end token alone. See pitman_yor.score."""
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; a null text has size 0, a null source is one. See mixing.mix."""
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__taken").alias("taken"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, read from the files; a null text has its end id alone. See token_files.write_token_files."""
    return token_files.token_table(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 rows for each source of documents; null and empty sources are one. See filter_audit.audit."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; a null text has no ids. See trie_bpe.encode and trie_bpe.decode."""
    decoded = trie_bpe.decode(trie_bpe.encode(read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_block_norm_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of embeddings with 64 finite components. See clustering.cluster."""
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tokeniser_fertility,
        op2_substring_dedup,
        op3_secret_scan,
        op4_consistent_weighted_sampling,
        op5_signature_inverted_join,
        op6_line_dedup,
        op7_sum_of_squares_packing,
        op8_pitman_yor,
        op9_source_mixing,
        op10_token_files,
        op11_filter_audit,
        op12_trie_bpe,
        op13_block_norm_clustering,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op9_source_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
    SELECT *, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap
    FROM sources
), levels AS (
    SELECT *, cap / weight AS ratio,
        ((SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(cap) OVER w, 0.0)) / ((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER w, 0.0)) AS level
    FROM weighted
    WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
    SELECT source, source_size, coalesce(least(cap, (SELECT max(level) FROM levels WHERE level <= ratio) * weight), cap) AS target FROM levels
), keyed AS (
    SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
        CASE WHEN size > 0 THEN pow((CAST('0x' || substr(md5('0:' || doc_id), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE, 1 / (size / (size + 100.0::DOUBLE))) ELSE 0.0 END AS key
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), placed AS (
    SELECT *, target - epochs * source_size AS budget,
        coalesce(sum(size) OVER (PARTITION BY source ORDER BY key DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM keyed
)
SELECT doc_id, size, source_size, target,
    CAST((epochs + CASE WHEN start < budget AND 2 * (budget - start) >= size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""

ORACLES["op6_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
        translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), common AS (
    SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT k.doc_id, pos, line, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES["op2_substring_dedup"] = r"""
WITH words AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM words WHERE len(w) >= 20
), windows AS (
    SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 19), ' ')) AS key FROM starts
), later AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS nth FROM windows) WHERE nth > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM later
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), kept AS (
    SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.pos) AS kept
    FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

ORACLES["op11_filter_audit"] = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS first FROM docs GROUP BY text
), known AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), failing AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
        len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 5 * length(d.text),
        regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS fails
    FROM docs d JOIN firsts f ON d.text = f.text LEFT JOIN known k ON d.doc_id = k.doc_id
), kinds AS (
    SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL
), letters AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS f
), orders AS (
    SELECT [a.f, b.f, c.f, d.f, e.f] AS fs, array_to_string(list_transform([a.f, b.f, c.f, d.f, e.f], lambda x: substr('ABCDE', x, 1)), '') AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, fs, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders
), met AS (
    SELECT part, filter_order, step, fs[step] AS f, good, toxic, n, fails[fs[step]] AS failed, list_bool_or(list_transform(fs[1:step - 1], lambda x: fails[x])) AS gone_before,
        list_count(list_filter(fails, lambda x: x)) = 1 AS one
    FROM kinds, steps
), counted AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (WHERE NOT failed AND NOT coalesce(gone_before, false)), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE failed AND NOT coalesce(gone_before, false)), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE failed AND gone_before), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE failed AND one), 0) AS unique_fails,
        coalesce(sum(n) FILTER (WHERE failed AND NOT coalesce(gone_before, false) AND good), 0) AS good_lost,
        coalesce(sum(n) FILTER (WHERE failed AND NOT coalesce(gone_before, false) AND toxic), 0) AS toxic_lost
    FROM met GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

_ROUND = """, near{i} AS MATERIALIZED (
    SELECT any_value(vec_id) AS vec_id, any_value(x) AS x, min_by(j, (d, j)) AS cluster, min(d) AS distance
    FROM (SELECT nth, vec_id, x, j, CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS BIGINT) AS d FROM vectors, centroids{i})
    GROUP BY nth
), centroids{n} AS MATERIALIZED (
    SELECT j, coalesce(mean, c) AS c FROM centroids{i} LEFT JOIN (
        SELECT cluster, list(CAST(floor(total / n) AS DOUBLE) ORDER BY place) AS mean
        FROM (SELECT cluster, place, sum(v) AS total, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM near{i}) GROUP BY cluster, place)
        GROUP BY cluster
    ) ON j = cluster
)"""

ORACLES["op13_block_norm_clustering"] = (
    """
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS j, x AS c FROM vectors ORDER BY sha256('2:' || vec_id) LIMIT 40
)"""
    + "".join(_ROUND.format(i=i, n=i + 1) for i in range(6))
    + """
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM near5 JOIN centroids5 ON j = cluster
"""
)
