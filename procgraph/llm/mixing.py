"""Mixing sources to target weights: whole epochs, then a weighted sample without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procgraph.llm.common import cut, n_words

#: Rows of a source that a bin of the sampling key holds or fewer, about; rows are ordered within a bin.
ROWS_PER_BIN = 2000


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 sum: the same in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def length_quality(size: Column) -> Column:
    """The default quality weight: short texts count less, from 0 towards 1 at a hundred words and more."""
    return size / (size + 100.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources by code point, null last, take `weights` in turn and share the sum
    of all sizes; no target passes most_epochs times its source's size, and what
    lies above is shared again by weight. That is a common level L with targets
    min(cap, L * weight): with sources ordered by cap / weight, L is what the
    uncapped ones share at the first place where it fits under the next ratio;
    from there on the levels only fall, so it is the largest that fits.
    Works on sums by source only; the orderings run over one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", most_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    shared = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    fits = ranked.withColumn("level", left / shared).withColumn("level", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    level = fits.withColumn("level", F.max("level").over(everyone))
    return level.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def _mixed(docs: DataFrame, quality: Column | None, seed: int, bins: int | None, targets: dict) -> DataFrame:
    """size, source_size, target and copies of every row, with the columns of docs as row_0, row_1 ..., so that they never clash and those not asked for don't move."""
    size = n_words(F.col("text").cast("string"))
    sized = docs.select(*[F.col(f"`{c}`").alias(f"row_{i}") for i, c in enumerate(docs.columns)], size.alias("size"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), (quality if quality is not None else F.lit(None)).alias("weight"))
    if quality is None:
        sized = sized.withColumn("weight", length_quality(F.col("size")))  # the size is counted once
    sized = sized.withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    # -ln(u) / w, not u^(1/w), which small weights would round to 0; null where nothing is drawn
    sized = sized.withColumn("key", F.when(F.col("weight") > 0, -F.log(uniform(F.col("id"), seed)) / F.col("weight")))
    bins = bins or max(64, docs.count() // ROWS_PER_BIN)  # of one unit of the logarithm; the count comes from the footers
    last = F.when(F.col("size") > 0, F.lit(2**60)).otherwise(F.lit(2**60) + 1 + F.pmod(F.xxhash64("id"), F.lit(bins)))  # no weight; empty texts move no sum
    sized = sized.withColumn("bin", F.coalesce(F.floor(F.log("key") * bins), last))
    by_bin = cut(sized.groupBy("group", "bin").agg(F.first("source").alias("source"), F.sum("size").alias("bin_size")))
    goal = source_targets(by_bin.select("source", F.col("bin_size").alias("size")), **targets)
    goal = goal.withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    in_source = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        by_bin.drop("source").withColumn("before", F.coalesce(F.sum("bin_size").over(in_source), F.lit(0)))
        .join(goal, "group").withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).drop("bin_size")
    )
    rows = sized.drop("source", "weight").join(cut(plan), ["group", "bin"])
    order = Window.partitionBy("group", "bin").orderBy(F.asc_nulls_last("key"), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    nearer = 2 * (F.col("budget") - F.col("start")) >= F.col("size")  # its end lies no further beyond than its start before
    copies = F.col("epochs") + ((F.col("start") < F.col("budget")) & nearer).cast("long")
    return rows.select(*[f"row_{i}" for i in range(len(docs.columns))], "size", "source_size", "target", copies.alias("copies"))


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"row_{i}").alias(c) for i, c in enumerate(docs.columns)]


def mix(docs: DataFrame, quality: Column | None = None, seed: int = 0, bins: int | None = None, **targets) -> DataFrame:
    """docs' columns with __size, __source_size, __target, __copies and __taken for every row.

    A row is taken floor(target / source size) times whole. What the target has
    beyond these epochs is a sample without replacement by Efraimidis and
    Spirakis: with u uniform by doc_id and w the quality weight, rows are taken
    in descending order of u^(1/w), i.e. ascending exponential key -ln(u)/w,
    while the running sum of sizes stays within the budget; the row that would
    cross it is taken too if that comes nearer to the target.

    The running sum needs no source in one task: keys are binned by the logarithm of
    the exponential key, whose spread is alike at every weight, into so many bins that one
    holds about ROWS_PER_BIN rows; sums by source and bin are prefix-summed, and rows are
    ordered within their bin only. The result doesn't depend on the bins.

    Null and empty texts have size 0 and are in every epoch and in the sample
    alike. Rows that repeat a doc_id have the same u and stand together in the order.
    Sources may be null. An empty table gives none; columns of docs that are
    called like the added ones are dropped, all others stay.
    """
    added = {"__size": "size", "__source_size": "source_size", "__target": "target", "__copies": "copies"}
    docs = docs.drop(*added, "__taken")
    return _mixed(docs, quality, seed, bins, targets).select(*_named(docs), *(F.col(c).alias(a) for a, c in added.items()), (F.col("copies") * F.col("size")).alias("__taken"))


def mixed_documents(docs: DataFrame, quality: Column | None = None, seed: int = 0, bins: int | None = None, **targets) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its own columns."""
    mixed = _mixed(docs, quality, seed, bins, targets).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*_named(docs))
