"""Projects by parts of their names: exact, listed and similar ones, the best of each question."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procgraph.operators.graph import cut


def letters(text: Column) -> Column:
    """The letters of a text, each with how often it came before: aba is a0, b0, a1. Two texts share as many of them as letters, repeats counted."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).cast("string")))


def block_ratio(one: Column, other: Column) -> Column:
    """Twice the letters in longest matching blocks over all letters of both; batches of pairs go to Python."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio(one, other)


def similar(asked: DataFrame, texts: DataFrame, least: float = 0.4) -> DataFrame:
    """(a, b, ratio) of all pairs of asked(a) and texts(b) whose ratio of matching blocks is `least` or more, none missed.

    Blocks can't match more letters than both have, so a pair shares at least a share `least` of half its letters, and its lengths differ
    by a factor of 2 / least - 1 at most. Letters are ordered by how few texts have them; a pair that shares so many has one in common among the
    first ones of each, and only such pairs are compared: one equi-join, no cross join.
    """
    factor = 2 / least - 1
    sides = [df.select(F.col(c).alias("s"), F.explode(letters(F.col(c))).alias("x")) for df, c in ((asked.distinct(), "a"), (texts.distinct(), "b"))]
    rarity = sides[1].groupBy("x").agg(F.count("*").alias("df"))

    def firsts(side: DataFrame, name: str) -> DataFrame:
        held = side.join(rarity, "x", "left").groupBy("s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "x"))).alias("xs"))  # as many as the text has letters
        n = F.size("xs")
        needed = F.ceil(n * (least / 2 * (1 + 1 / factor)) - 1e-9)  # letters shared with the shortest partner that may be
        return held.select(F.col("s").alias(name), F.explode(F.slice("xs", F.lit(1), (n - F.greatest(needed, F.lit(1)) + 1).cast("int"))).alias("t")).select(name, F.col("t.x").alias("x"))

    pairs = firsts(sides[0], "a").join(firsts(sides[1], "b"), "x").select("a", "b").distinct()
    size_a, size_b = F.length("a"), F.length("b")
    shared = F.size(F.array_intersect(letters(F.col("a")), letters(F.col("b"))))
    pairs = pairs.where((size_a <= factor * size_b + 1e-9) & (size_b <= factor * size_a + 1e-9) & (2 * shared >= least * (size_a + size_b) - 1e-9))
    return cut(pairs).withColumn("ratio", block_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)


def resolve_projects(questions: DataFrame, projects: DataFrame, listed: DataFrame | None = None, most: int = 5, least: float = 0.4) -> DataFrame:
    """(query, n, slug, name, confidence, match) of questions(query): the `most` best of projects(slug, name), by confidence, then slug.

    A project whose slug or name is the question, in any case, is exact (1.0); one that listed(part, slug) has for the
    question is partial, with the length of the question over that of the slug; any other is fuzzy with the better
    ratio of matching blocks of slug and name, if that is `least` or more. Questions that repeat are one; one that finds nothing has no row.
    """
    asked = questions.where("query is not null").select("query", F.lower("query").alias("a")).distinct()
    known = projects.groupBy("slug").agg(F.first("name").alias("name")).withColumn("name", F.coalesce("name", F.lit("")))
    keys = known.select("slug", "name", F.explode(F.array_distinct(F.array(F.lower("slug"), F.lower("name")))).alias("b"))
    exact = asked.join(keys, F.col("a") == F.col("b")).select("query", "slug", "name", F.lit(1.0).alias("confidence"), F.lit("exact").alias("match"), F.lit(1).alias("step"))
    ratios = similar(asked.select("a"), keys.select("b"), least)
    fuzzy = asked.join(ratios, "a").join(keys, "b").groupBy("query", "slug", "name").agg(F.max("ratio").alias("confidence")).select("*", F.lit("fuzzy").alias("match"), F.lit(3).alias("step"))
    found = exact.unionByName(fuzzy)
    if listed is not None:
        hit = asked.join(listed.select(F.col("part").alias("a"), "slug").distinct(), "a").join(known, "slug")
        found = found.unionByName(hit.select("query", "slug", "name", (F.length("a") / F.length("slug")).alias("confidence"), F.lit("partial").alias("match"), F.lit(2).alias("step")))
    best = found.groupBy("query", "slug").agg(F.min_by(F.struct("name", "confidence", "match"), "step").alias("x")).select("query", "slug", "x.*")
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("confidence"), "slug"))
    return best.withColumn("n", n).where(F.col("n") <= most).select("query", F.col("n").cast("long").alias("n"), "slug", "name", "confidence", "match")
