"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procgraph.llm.common import cut

SAMPLES = 32
#: Rows of a stretch of ids that one task orders, if there are enough shuffle partitions.
ROWS_PER_STRETCH = 2000


def terms(text: Column) -> Column:
    """Sorted word hashes of a text."""
    return F.sort_array(F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def weighted(df: DataFrame, sorted_terms: str, out: str) -> DataFrame:
    """Adds array<struct<term, weight>> with a weight for each distinct term: its count."""
    starts = f"__{out}_starts"
    n = F.size(sorted_terms)
    here = F.col(sorted_terms)
    first = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(here, i) != F.get(here, i - 1)))
    df = df.withColumn(starts, first)
    pairs = F.transform(starts, lambda i, j: F.struct(F.get(here, i).alias("term"), F.ln((F.coalesce(F.get(F.col(starts), j + 1), n) - i).cast("double")).alias("log_weight")))
    return df.withColumn(out, pairs).drop(starts)


def sample(i: int) -> Column:
    """ln(a) of the term for sample i; the term with the least a is drawn.

    Ioffe's scheme: r, c ~ Gamma(2, 1) and b ~ U(0, 1) by term and sample;
    t = floor(ln w / r + b), ln y = r (t - b), a = c / (y e^r). Two texts
    draw the same (term, t) with the probability of their generalised Jaccard
    similarity, and the same (term, t) has the same a.
    """
    part = lambda h, k: (F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit(2**21 - 1)) + 0.5) / float(2**21)
    one, two = F.xxhash64(F.lit(2 * i), F.col("term")), F.xxhash64(F.lit(2 * i + 1), F.col("term"))
    r = -F.ln(part(one, 0) * part(one, 1))
    log_c = F.ln(-F.ln(part(one, 2) * part(two, 0)))
    b = part(two, 1)
    return log_c - r * (F.floor(F.col("log_weight") / r + b) - b + 1)


def stretches(docs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """docs with `stretch`: consecutive ranges of the order key, as many as rows ask for and shuffle partitions allow."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(parts * 4, math.ceil(rows / ROWS_PER_STRETCH)))
    if n == 1:
        return docs.withColumn("stretch", F.lit(0)), 1
    bounds = docs.approxQuantile("id_key", [i / n for i in range(1, n)], 0.25 / n)
    step = max(1, math.isqrt(n))
    coarse, fine = F.array(*map(F.lit, bounds[::step])), F.array(*map(F.lit, bounds))
    key = F.col("id_key").cast("double")
    block = F.size(F.filter(coarse, lambda b: b <= key))
    within = F.size(F.filter(F.slice(fine, F.greatest(block - 1, F.lit(0)) * step + 1, step), lambda b: b <= key))
    return docs.withColumn("stretch", F.when(block == 0, 0).otherwise((block - 1) * step + within)), n


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with id_key, next_key and next_text: of the following document by doc_id, after the last of the first.

    Rows move once, by stretches of ids. Each stretch also gets the first row of
    the next one, so no order runs over the whole table; those rows, one a
    stretch, are found with a broadcast of as many ids.
    """
    docs = docs.withColumn("id_key", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("text", F.coalesce("text", F.lit("")))
    dealt, _ = stretches(docs, docs.select("doc_id").count())
    ends = dealt.groupBy("stretch").agg(F.min("id_key").alias("first_id"))
    around = Window.orderBy(F.desc("stretch"))
    follows = ends.withColumn("goes_to", F.coalesce(F.lead("stretch").over(around), F.max("stretch").over(Window.partitionBy()))).select(F.col("first_id"), "goes_to")
    borrowed = docs.join(F.broadcast(follows), F.col("id_key") == F.col("first_id")).groupBy("goes_to", "id_key").agg(F.min("text").alias("text"))
    rows = dealt.withColumn("borrowed", F.lit(0)).unionByName(
        borrowed.select(F.lit(None).cast("long").alias("doc_id"), "text", "id_key", F.col("goes_to").alias("stretch"), F.lit(1).alias("borrowed"))
    )
    order = Window.partitionBy("stretch").orderBy("borrowed", "id_key", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_key", F.lead("id_key").over(order)).where("borrowed = 0").drop("borrowed", "stretch")


def likeness(one: Column, two: Column, samples: int) -> Column:
    """Share of equal samples of two fingerprints; 1 for two empty texts, 0 if one is."""
    same = reduce(add, [(F.substring(one, 8 * i + 1, 8) == F.substring(two, 8 * i + 1, 8)).cast("int") for i in range(samples)])
    return F.when((one == "") | (two == ""), (one == two).cast("double")).otherwise(same / float(samples))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row of docs.

    Terms are words weighted by their counts. A fingerprint has 8 hex digits a
    sample, "" for a text without words (null texts are empty ones). The edited
    text has its last quarter of code points replaced by as many of the next
    document's first ones. A null doc_id comes before all others; rows that repeat a
    doc_id follow each other by text; a single row is its own next. An empty
    table gives no rows; other columns aren't read.
    """
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited)
    keys = [
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "id_key", F.xxhash64("text").alias("text_key"),
        "next_key", F.xxhash64("next_text").alias("next_text_key"),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "id_key", "text_key", "next_key", "next_text_key"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), terms(F.col("text")).alias("sorted")), F.struct(F.lit(1).alias("side"), terms(F.col("edited")).alias("sorted"))))
    split = rows.select(*keys, sides.alias("of")).select(*names, F.col("of.side").alias("side"), F.col("of.sorted").alias("sorted"))
    each = weighted(split, "sorted", "pairs").select(*names, "side", F.posexplode_outer("pairs").alias("at", "pair"))
    each = each.select(*names, "side", F.coalesce("at", F.lit(0)).alias("at"), "pair.term", "pair.log_weight")
    least = [F.min(F.when(F.col("side") == side, sample(i))).alias(f"s{side}_{i}") for side in (0, 1) for i in range(samples)]
    drawn = each.groupBy(*names).agg(F.sum(((F.col("side") == 0) & (F.col("at") == 0)).cast("int")).alias("copies"), *least)
    digits = lambda side: F.concat(*[F.coalesce(F.lpad(F.hex(F.xxhash64(f"s{side}_{i}").bitwiseAND(F.lit(2**32 - 1))), 8, "0"), F.lit("")) for i in range(samples)])
    prints = [F.when(F.col(f"s{side}_0").isNull(), "").otherwise(digits(side)).alias(name) for side, name in ((0, "fingerprint"), (1, "edited_fingerprint"))]
    made = cut(drawn.select(*names, "copies", *prints))
    others = made.select(F.col("id_key").alias("next_key"), F.col("text_key").alias("next_text_key"), F.col("fingerprint").alias("next_fingerprint")).dropDuplicates(["next_key", "next_text_key"])
    both = made.join(others, ["next_key", "next_text_key"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
