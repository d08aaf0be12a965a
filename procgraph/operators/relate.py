"""Resolution joins, integrity, sets and latest-row windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixes(path: Column, separator: str = "/") -> Column:
    """Every shorter end of the path that starts at a segment: b/c and c of a/b/c."""
    parts = F.split(path, "\\Q" + separator + "\\E", -1)
    places = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))


def resolve_targets(calls: DataFrame, catalog: DataFrame, separator: str = "/") -> DataFrame:
    """calls(target) with the catalog's id and match: exact path, else a path suffix, else by name; first in catalog order (rank).

    A suffix starts after a separator. Suffixes become equal keys, so both steps are equi-joins; a call that finds nothing has match "missing".
    """
    keyed = catalog.select("id", "rank", F.col("path").alias("key"), F.lit(1).alias("priority"), F.lit("exact").alias("match")).unionByName(
        catalog.select("id", "rank", F.explode(suffixes(F.col("path"), separator)).alias("key"), F.lit(2).alias("priority"), F.lit("suffix").alias("match"))
    )
    best = keyed.groupBy("key").agg(F.min_by(F.struct("id", "match"), F.struct("priority", "rank")).alias("hit"))
    return calls.join(best, calls["target"] == best["key"], "left").drop("key").select("*", "hit.id", F.coalesce("hit.match", F.lit("missing")).alias("match")).drop("hit")


def latest(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The `keep` first rows of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= keep).drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, the latest version of each key."""
    return latest(old.unionByName(new, allowMissingColumns=True), [key], [F.desc(version)])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def usage(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(package, is_declared, is_used) over both sides (package)."""
    d, u = declared.select("package").distinct().withColumn("is_declared", F.lit(True)), used.select("package").distinct().withColumn("is_used", F.lit(True))
    return d.join(u, "package", "full").select("package", F.coalesce("is_declared", F.lit(False)).alias("is_declared"), F.coalesce("is_used", F.lit(False)).alias("is_used"))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, modified or unchanged."""
    both = old.select(F.col(key), F.col(value).alias("was"), F.lit(1).alias("o")).join(new.select(F.col(key), F.col(value).alias("now"), F.lit(1).alias("n")), key, "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("modified")
    return both.select(key, change.alias("change"))


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """df with prev_<column> of the row before in its group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place of each row among its siblings, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
