"""The call-graph model: calls with kinds and targets, dependencies with unresolved ones kept, entry points, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions import expressions, ident
from procgraph.operators import graph, relate

# What a kind of call is in the call graph; any other kind stays as it is.
TYPES = {"invoke": "static", "invoke-missing": "missing", "invoke-dynamic": "dynamic"}
# Marks of a target that is made up when the call is run.
DYNAMIC_MARKS = ("{", "}", "[", "]", "Path.Combine", "+")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """The folder of a path, "" at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def below(folder: Column, path: Column) -> Column:
    return F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path))


def one_spelling(path: Column) -> Column:
    """The path with .xaml in small letters, as file systems that don't tell them apart have it."""
    return F.regexp_replace(path, r"(?i)\.xaml$", ".xaml")


def resolved_calls(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """calls (path, raw, ...) with target, kind and dst, an id of catalog(path, id, rank), by their raw targets.

    A target with a mark of an expression is invoke-dynamic, "dynamic:<target>" where an id is asked; one that ends in .cs is invoke-coded;
    others are invoke if there is such a file in the caller's folder, the one above it or at the top, else invoke-missing. The id is that of
    the first row of the catalog that has the path or ends with it after a slash; then of a file found as above, from
    the top, the caller's folder and the one above; else "missing:<target>". All steps are equi-joins.
    """
    rows = calls.withColumn("__call", F.monotonically_increasing_id())
    target = one_spelling(F.regexp_replace(ident.posix(F.col("raw")), r"^(\./)+", ""))
    catalog = catalog.select("id", "rank", one_spelling(F.col("path")).alias("path"))
    rows = graph.cut(rows.withColumns({"target": target, "__dynamic": expressions.contains_any(F.col("raw"), DYNAMIC_MARKS)}))
    own = folder_of(F.col("path"))
    places = F.array(*[F.struct(F.lit(i).alias("order"), below(f, F.col("target")).alias("__at")) for i, f in enumerate((F.lit(""), own, folder_of(own)))])
    known = catalog.groupBy(F.col("path").alias("__at")).agg(F.min_by("id", "rank").alias("id"))
    near = rows.where("not __dynamic").select("__call", F.inline(places)).join(known, "__at")
    near = near.groupBy("__call").agg(F.min_by("id", "order").alias("__near"))
    # exact and suffix matches are one step: the first in the order of the catalog
    keyed = catalog.select("id", "rank", F.explode(F.concat(F.array("path"), relate.suffixes(F.col("path")))).alias("target"))
    first = keyed.join(rows.where("not __dynamic").select("target").distinct(), "target", "left_semi").groupBy("target").agg(F.min_by("id", "rank").alias("__first"))
    out = rows.join(near, "__call", "left").join(first, "target", "left")
    kind = F.when(F.col("__dynamic"), "invoke-dynamic").when(F.lower("raw").endswith(".cs"), "invoke-coded").when(F.col("__near").isNotNull(), "invoke").otherwise("invoke-missing")
    dst = F.when(~F.col("__dynamic"), F.coalesce("__first", "__near"))
    lost = F.when(dst.isNull(), F.concat(F.when(F.col("__dynamic"), "dynamic:").otherwise("missing:"), F.col("raw")))
    return out.withColumns({"kind": kind, "dst": dst, "unresolved": lost}).drop("__call", "__dynamic", "__near", "__first")


def entry_nodes(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, path, is_entry_point) of catalog(id, path): whether its id or path is an entry (path), in any case too, or its file name is the file name of one."""
    exact = entries.select(F.col("path").alias("key"))
    loose = entries.select(F.lower("path").alias("key")).unionByName(entries.select(F.lower(name_of(F.col("path"))).alias("key")))
    keys = exact.withColumn("how", F.lit("exact")).unionByName(loose.withColumn("how", F.lit("loose"))).distinct()
    tried = F.array(
        *[F.struct(F.col(c).alias("key"), F.lit("exact").alias("how")) for c in ("id", "path")],
        *[F.struct(c.alias("key"), F.lit("loose").alias("how")) for c in (F.lower("id"), F.lower("path"), F.lower(name_of(F.col("path"))))],
    )
    hit = catalog.select("id", F.inline(F.array_distinct(tried))).join(keys, ["key", "how"], "left_semi").select("id").distinct().withColumn("is_entry_point", F.lit(True))
    return catalog.select("id", "path").join(hit, "id", "left").na.fill(False, ["is_entry_point"])


def dependencies(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """(src, dst, target, type) of calls(from, target, kind): one row a call, unresolved ones too, with a null dst.

    src is the workflow of a composite id (its second part of three or more), else all of `from`; calls without one, or from a workflow that the
    catalog (id, path, rank) lacks, are left out. A target is the first workflow of that path, separators and .xaml aside, else the first of its file
    name. What isn't resolved is missing, whatever its kind.
    """
    parts = F.split("from", "#")
    src = F.when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise(F.col("from"))
    plain = lambda c: ident.workflow_id(c)
    rows = calls.select(src.alias("src"), F.col("target"), F.coalesce(F.col("kind"), F.lit("unknown")).alias("kind"), plain(F.col("target")).alias("path")).where(F.length("src") > 0)
    rows = rows.join(catalog.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    by_path = catalog.groupBy(plain(F.col("path")).alias("path")).agg(F.min_by("id", "rank").alias("exact"))
    by_name = catalog.groupBy(name_of(plain(F.col("path"))).alias("name")).agg(F.min_by("id", "rank").alias("named"))
    hit = rows.join(by_path, "path", "left").withColumn("name", name_of(F.col("path"))).join(by_name, "name", "left")
    dst = F.when(F.length("target") > 0, F.coalesce("exact", "named"))
    kind = reduce(lambda c, x: c.when(F.col("kind") == x[0], x[1]), TYPES.items(), F.when(dst.isNull(), "missing")).otherwise(F.col("kind"))
    return hit.select("src", dst.alias("dst"), "target", kind.alias("type"))


def call_graph(catalog: DataFrame, calls: DataFrame, entries: DataFrame, most: int | None = None) -> dict[str, DataFrame]:
    """nodes (id, path, is_entry_point, call_depth; -1 where no entry leads, in `most` calls if that is given), dependencies, and cycles by a witness each."""
    nodes, found = graph.cut(entry_nodes(catalog, entries)), graph.cut(dependencies(calls, catalog))
    edges = found.where("dst is not null").select("src", "dst").distinct()
    depth = graph.call_depth(edges, nodes.where("is_entry_point").select(F.col("id").alias("node")), most).withColumnRenamed("node", "id")
    nodes = nodes.join(depth, "id", "left").select("id", "path", "is_entry_point", F.coalesce("depth", F.lit(-1).cast("long")).alias("call_depth"))
    return {"nodes": nodes, "dependencies": found, "cycles": graph.witness_cycles(edges)}


def metrics(model: dict[str, DataFrame]) -> DataFrame:
    """The nine counts of a call graph in one row; cycles are groups of workflows that reach each other."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    depth, kind = F.col("call_depth"), F.col("type")
    nodes = model["nodes"].agg(
        F.count("*").alias("total_workflows"), n(F.col("is_entry_point")).alias("entry_points"), n(depth == -1).alias("orphaned_workflows"), F.greatest(F.coalesce(F.max("call_depth"), F.lit(0)), F.lit(0)).cast("long").alias("max_call_depth")
    )
    calls = model["dependencies"].agg(F.count("*").alias("total_dependencies"), *[n(kind == t).alias(f"{t}_invocations") for t in ("static", "dynamic", "missing")])
    return nodes.crossJoin(calls).crossJoin(model["cycles"].agg(F.count("*").alias("cycles_detected")))  # one row each
