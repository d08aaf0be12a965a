"""Pseudocode lines and their recursive expansion in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procgraph.operators.graph import cut

# What an expansion writes where it stops, by the way it deals with cycles.
CYCLE_NOTES = {"detect_and_mark": "(already expanded above)", "detect_and_stop": "(expansion stopped)", "ignore": None}


def indented(depth: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth.cast("int")), text)


def line(depth: Column, name: Column, kind: Column, path: Column) -> Column:
    """A line of an activity: its name in brackets if it has one, its type, and its path if it has one."""
    named = F.when(F.length(name) > 0, F.concat(F.lit("["), name, F.lit("] "))).otherwise("")
    placed = F.when(F.length(path) > 0, F.concat(F.lit(" (ActivityPath: "), path, F.lit(")"))).otherwise("")
    return indented(depth, F.concat(F.lit("- "), named, F.coalesce(kind, F.lit("")), placed))


def is_call(kind: Column, name: Column) -> Column:
    """Whether an activity calls a workflow, by its type or its name."""
    return F.coalesce(F.lower(kind).contains("invoke"), F.lit(False)) | F.coalesce(name.contains("Invoke Workflow File"), F.lit(False))


def with_targets(activities: DataFrame, calls: DataFrame) -> DataFrame:
    """activities with `target` filled in, where it is empty, from calls(workflow, activity, target) at the same activity.

    As in a call graph, only an activity whose path names an InvokeWorkflowFile is looked up; of several calls at one activity the smallest target counts.
    """
    found = calls.groupBy("workflow", "activity").agg(F.min("target").alias("found"))
    looked_up = F.when(F.col("path").contains("InvokeWorkflowFile"), F.col("found"))
    return activities.join(found, ["workflow", "activity"], "left").withColumn("target", F.coalesce(F.when(F.length("target") > 0, F.col("target")), looked_up)).drop("found")


def expanded(activities: DataFrame, roots: DataFrame, max_depth: int = 3, cycles: str = "detect_and_mark", known: DataFrame | None = None) -> DataFrame:
    """(root, place, depth, line, mark): the pseudocode of each root (workflow) with that of what it calls below each call.

    activities has (workflow, place, name, type, path, target) and `place` in reading order, alike in no two activities of a
    workflow. Rows carry the places on the way down as an array, so that they sort into reading order at any time: a
    level is one equi-join of the calls that it found with all activities, and nothing is read in sequence. `line` has a marker where the
    expansion stops, and mark says which: "depth limit" at max_depth, "cycle" at a workflow that is on its own way
    down (without a line where cycles are ignored), "missing" at one without activities; `known` (workflow) has those that are there though
    empty. Depth goes before cycle, and cycle before missing. Activities whose target is null or empty
    call nothing. Roots that repeat are one, and a null root gives no rows.
    """
    note = CYCLE_NOTES[cycles]
    lines = activities.select(F.col("workflow").alias("at"), F.struct("place", "name", "type", "path", F.col("target").alias("calls")).alias("a"))
    if known is not None:
        lines = lines.unionByName(known.select(F.col("workflow").alias("at"), F.lit(None).cast(lines.schema["a"].dataType).alias("a")).distinct())
    lines = lines.withColumn("there", F.lit(True))
    now = roots.where("workflow is not null").select(F.col("workflow").alias("root"), F.col("workflow").alias("target"), F.array().cast("array<long>").alias("places"), F.array().cast("array<string>").alias("way")).distinct()
    named, out = F.col("target").cast("string"), None
    for depth in range(max_depth + 1):
        at = F.lit(depth)
        marker = lambda text, more: indented(at, F.concat(F.lit(text), named, F.lit(f"] {more}")))  # noqa: B023, E731
        if depth == max_depth:
            text, mark = marker("[DEPTH LIMIT REACHED: ", f"(max depth: {max_depth})"), F.lit("depth limit")
            met = now.withColumn("a", F.lit(None).cast(lines.schema["a"].dataType))
        else:
            again = F.array_contains("way", named)
            met = now.withColumn("__at", F.when(~again, F.col("target"))).join(lines, F.col("__at") == F.col("at"), "left")
            mark = F.when(again, "cycle").when(F.col("there").isNull(), "missing").otherwise("")
            text = F.when(again, marker("[CYCLE DETECTED: ", note) if note else F.lit(None)).when(F.col("there").isNull(), marker("[MISSING WORKFLOW: ", "(pseudocode not found)"))
            text = text.when(F.col("a").isNotNull(), line(at, F.col("a.name"), F.col("a.type"), F.col("a.path")))
        place = F.concat("places", F.array(F.coalesce(F.col("a.place").cast("long"), F.lit(0).cast("long"))))
        met = cut(met.select("root", place.alias("places"), at.alias("depth"), text.alias("line"), mark.alias("mark"), "a", F.concat("way", F.array(named)).alias("way")).where("line is not null"))
        out = met.drop("a", "way") if out is None else out.unionByName(met.drop("a", "way"))
        calls = is_call(F.col("a.type"), F.col("a.name")) & (F.length(F.col("a.calls").cast("string")) > 0)
        now = met.where(calls).select("root", F.col("a.calls").alias("target"), "places", "way")
    return out.select("root", F.col("places").alias("place"), "depth", "line", "mark")


def numbered_lines(found: DataFrame) -> DataFrame:
    """expanded rows with n, the number of a line in its root's text, from 1."""
    return found.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("place")).cast("long"))


def lines_of(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """activities, as expanded takes them, of the visual XML nodes of workflows; calls has (src, lft, dst): the workflow that the call at an element reaches."""
    from procgraph.functions import ident

    visual = nodes.where("is_visual").select(ident.workflow_id(F.col("path")).alias("workflow"), F.col("lft").alias("place"), F.col("display_name").alias("name"), F.col("tag").alias("type"), F.col("node_id").alias("path"))
    reached = calls.groupBy(F.col("src").alias("workflow"), F.col("lft").alias("place")).agg(F.min("dst").alias("target"))
    return visual.join(reached, ["workflow", "place"], "left")
