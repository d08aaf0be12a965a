"""Trees as rows with nested-set positions: nodes(tree, lft, rgt, depth, parent, tag)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from procgraph.operators.graph import cut

# Tags that hold other activities.
CONTAINERS = (
    "Sequence", "If", "TryCatch", "Parallel", "Pick", "Switch",
    "ForEach", "While", "DoWhile", "Flowchart", "State", "StateMachine",
)


def depth_metrics(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """Nodes, deepest level and leaves of each tree."""
    return nodes.groupBy(*tree).agg(F.count("*").alias("nodes"), F.max("depth").cast("long").alias("max_depth"), F.sum((F.col("rgt") == F.col("lft") + 1).cast("long")).alias("leaves"))


def type_counts(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """Activity counts by class: the first of loop, invoke, log, try and selector that the lower-case tag names."""
    tag = F.lower("tag")
    kind = F.when(tag.rlike("while|foreach"), "loop").when(tag.contains("invoke"), "invoke").when(tag.contains("log"), "log").when(tag.contains("try"), "try").when(tag.contains("selector"), "selector").otherwise("other")
    return nodes.groupBy(*tree, kind.alias("kind")).agg(F.count("*").alias("n"))


def pseudocode(depth: Column, name: Column, tag: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth.cast("int")), F.lit("- ["), name, F.lit("] "), tag)


def control_flow(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """(src, dst, kind) between activities and their children, by the parent's tag.

    A Sequence ties each child to the one before (seq-next) and contains the first; an If has branch-then to its first child and
    branch-else to the others, a TryCatch try and catch, a loop loop-enter and loop-back; any other parent contains its children.
    """
    up = nodes.select(*tree, F.col("id").alias("parent"), F.col("tag").alias("above"))
    order = Window.partitionBy(*tree, "parent").orderBy("lft")
    beside = nodes.where("parent is not null").withColumns({"before": F.lag("id").over(order), "place": F.row_number().over(order)}).join(up, [*tree, "parent"])
    first, loop = F.col("place") == 1, F.col("above").isin("While", "DoWhile", "ForEach")
    kind = (
        F.when((F.col("above") == "Sequence") & ~first, "seq-next")
        .when(F.col("above") == "If", F.when(first, "branch-then").otherwise("branch-else"))
        .when(loop, "loop-enter").when(F.col("above") == "TryCatch", F.when(first, "try").otherwise("catch")).otherwise("contains")
    )
    beside = beside.withColumn("kind", kind)
    edges = beside.select(*tree, F.when(F.col("kind") == "seq-next", F.col("before")).otherwise(F.col("parent")).alias("src"), F.col("id").alias("dst"), "kind")
    return edges.unionByName(beside.where(loop).select(*tree, F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("loop-back").alias("kind")))


#: Rows that a task of a shuffle sorts, about.
TASK_ROWS = 1_000_000


def parts(spark: SparkSession, n: int) -> int | None:
    """Partitions that n rows take at TASK_ROWS each, so that a task's sort doesn't grow with them; None where the session has as many."""
    n = math.ceil(n / TASK_ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def in_order(rows: DataFrame, tree: list[str], n: int | None = None) -> DataFrame:
    """rows by tree, and by lft within it: one shuffle and one sort, for tasks that read trees from start to end.

    n is about how many rows there are; they are counted if it isn't given. Tasks take TASK_ROWS each, or a tree that has more.
    """
    some = parts(rows.sparkSession, rows.count() if n is None else n)
    return (rows.repartition(some, *tree) if some else rows.repartition(*tree)).sortWithinPartitions(*tree, "lft")


def _nearest(tree: list[str]):
    def task(batches):
        at, open_ = None, []
        for batch in batches:
            found, keys = [], zip(*[batch[c].to_pylist() for c in tree])
            for key, lft, rgt, own, holds in zip(keys, *[batch[c].to_pylist() for c in ("lft", "rgt", "id", "__holds")]):
                if key != at:
                    at, open_ = key, []
                while open_ and open_[-1][0] < lft:
                    open_.pop()
                found.append(open_[-1][1] if open_ else None)
                if holds:
                    open_.append((rgt, own))
            kept = [c for c in batch.schema.names if c != "__holds"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(found, batch["id"].type)], [*kept, "__found"])

    return task


def enclosing(nodes: DataFrame, tree: list[str], holds: Column, name: str = "container", n: int | None = None) -> DataFrame:
    """nodes with `name`: the id of the nearest ancestor that holds others; null without one. n as in in_order.

    A task reads its trees in order and keeps the nodes that hold others and are still open, so its memory is one sort's and a tree's depth.
    """
    kind = nodes.schema["id"].dataType
    schema = StructType([*nodes.schema.fields, StructField("__found", kind)])
    rows = in_order(nodes.withColumn("__holds", F.coalesce(holds, F.lit(False))), tree, n)
    return rows.mapInArrow(_nearest(tree), schema).withColumnRenamed("__found", name)


def unpruned(nodes: DataFrame, tree: list[str], keep: Column, n: int | None = None) -> DataFrame:
    """The roots, and the nodes to keep that a walk finds which doesn't go below one that isn't kept."""
    root = F.col("parent").isNull()
    met = enclosing(nodes.withColumn("__keep", F.coalesce(keep, F.lit(False)) | root), tree, ~F.col("__keep"), "__above", n)
    return met.where("__keep and __above is null").drop("__keep", "__above")


# Tags of activities, besides those that have a display name or "Activity" in their tag.
ACTIVITY_TAGS = (
    "Sequence", "Flowchart", "If", "While", "ForEach", "DoWhile",
    "TryCatch", "Assign", "WriteLine", "InvokeWorkflowFile",
    "Click", "Type", "GetText", "Delay", "LogMessage",
)


def is_activity(tag: Column, has_name: Column) -> Column:
    return tag.isin(*ACTIVITY_TAGS) | has_name | tag.contains("Activity")


def descendants(nodes: DataFrame, tree: list[str], n: int | None = None) -> DataFrame:
    """nodes below a container, with `run`: the topmost container of those, each directly in the next, that the node lies in.

    A container's descendants are the nodes of its run inside it: they stop at what is no container, whose own children are in no run with it.
    """
    n = nodes.count() if n is None else n
    held = enclosing(nodes.withColumn("__is", F.col("tag").isin(*CONTAINERS)), tree, F.col("__is"), n=n)
    top = F.col("__is") & (F.col("container").isNull() | (F.col("container") != F.col("parent")))
    below = enclosing(held.withColumn("__top", top), tree, F.col("__top"), "run", n)
    return below.where("container = parent").drop("__is", "__top", "container")


def _statistics(tree: list[str]):
    def task(batches):
        at, open_, done, kinds = None, [], [], None

        def close():
            x = open_.pop()
            done.append((*at, x["id"], x["total"], x["visual"], max(x["deepest"] - x["depth"], 0), sorted(x["types"].items())))
            if x["linked"]:
                up = open_[-1]
                up["total"], up["visual"], up["deepest"] = up["total"] + x["total"], up["visual"] + x["visual"], max(up["deepest"], x["deepest"])
                for tag, n in x["types"].items():
                    up["types"][tag] = up["types"].get(tag, 0) + n

        def flush():
            columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [*tree, "id", "total_child_activities", "visual_activities", "max_depth", "activity_type_counts"])

        for batch in batches:
            kinds = [*[batch[c].type for c in (*tree, "id")], pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.int64())]
            keys = zip(*[batch[c].to_pylist() for c in tree])
            for key, lft, rgt, own, parent, depth, tag, visual, holds in zip(keys, *[batch[c].to_pylist() for c in ("lft", "rgt", "id", "parent", "depth", "tag", "is_visual", "__holds")]):
                while open_ and (key != at or open_[-1]["rgt"] < lft):
                    close()
                at = key
                up = open_[-1] if open_ else None
                linked = up is not None and up["id"] == parent
                if linked:
                    up["total"], up["visual"], up["deepest"] = up["total"] + 1, up["visual"] + bool(visual), max(up["deepest"], depth)
                    up["types"][tag] = up["types"].get(tag, 0) + 1
                if holds:
                    open_.append({"rgt": rgt, "id": own, "depth": depth, "linked": linked, "total": 0, "visual": 0, "deepest": depth, "types": {}})
            if done:
                yield flush()
        while open_:
            close()
        if done:
            yield flush()

    return task


def container_statistics(nodes: DataFrame, tree: list[str], n: int | None = None) -> DataFrame:
    """For each container (tree, id): total_child_activities, visual_activities, max_depth below it, and activity_type_counts as a map.

    nodes has lft, rgt, depth, parent, tag and is_visual. What is below a container stops at what is no container. Containers without a child
    have zeros and an empty map. A task reads its trees in order; a container that ends adds its counts to its parent's, if that is one.
    """
    rows = nodes.select(*tree, "id", "parent", "lft", "rgt", "depth", "tag", "is_visual", F.coalesce(F.col("tag").isin(*CONTAINERS), F.lit(False)).alias("__holds"))
    long = [StructField(c, LongType()) for c in ("total_child_activities", "visual_activities", "max_depth")]
    schema = StructType([*[nodes.schema[c] for c in (*tree, "id")], *long, StructField("activity_type_counts", MapType(StringType(), LongType()))])
    return in_order(rows, tree, n).mapInArrow(_statistics(tree), schema)


def containers(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """Each node with its container: the parent, if that is one."""
    up = nodes.where(F.col("tag").isin(*CONTAINERS)).select(*tree, F.col("id").alias("parent"), F.col("tag").alias("container"))
    return nodes.join(up, [*tree, "parent"], "left").withColumn("is_container", F.col("tag").isin(*CONTAINERS))


# Parts of a path that are branches of a container.
BRANCHES = ("Then", "Else", "Catch", "Finally", "Body", "Default", "Cases", "Activities", "Triggers", "Actions")


def branch_of(path: Column) -> Column:
    """The first part of a path, without its index, that is a branch of a container; null without one."""
    parts = F.transform(F.split(path, "/"), lambda p: F.split(p, r"\[")[0])
    return F.try_element_at(F.filter(parts, lambda p: p.isin(*BRANCHES)), F.lit(1))


def by_branch(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """Activities of each container's branches, Body where a path names none: nodes has node_id and parent."""
    return nodes.groupBy(*tree, "parent", F.coalesce(branch_of(F.col("node_id")), F.lit("Body")).alias("branch")).agg(F.count("*").alias("n"))


def flatten(nodes: DataFrame, most: int = 100) -> DataFrame:
    """nodes(id, parent, name) with path: the names from the root down, joined by dots. One join a level, over that level's nodes alone."""
    level = nodes.where("parent is null").withColumn("path", F.col("name"))
    out, below = level, nodes.where("parent is not null")
    for _ in range(most):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        level = cut(below.join(up, "parent").withColumn("path", F.concat_ws(".", "above", "name")).select(*out.columns))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a tree of more than {most} levels, or a circle of parents")
