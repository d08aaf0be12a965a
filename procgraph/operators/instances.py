"""Activities with all they say: arguments, nested configuration, expressions, variables and selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procgraph.functions import activity_text, ident
from procgraph.operators import trees

#: Attributes that the designer keeps for itself.
METADATA = ("WorkflowViewState.IdRef", "VirtualizedContainerService.HintSize", "IdRef", "HintSize")
#: Types that hold other activities.
CONTAINERS = ("Sequence", "If", "ForEach", "While", "DoWhile", "Switch", "Parallel", "TryCatch", "Flowchart", "StateMachine", "NApplicationCard", "RetryScope")


def configurations(nodes: DataFrame) -> DataFrame:
    """(path, owner, configuration): what hidden elements below an activity say, up to the next activity, as a map.

    nodes has (path, lft, owner, place, tag, attributes, text, is_visual), place being the tags on the way from the owner, with dots.
    A key is that way, then the attribute's name; of several elements with one way the second has [2] at its end, and so on. Elements
    that say nothing have "". What views keep of an activity is left out.
    """
    below = nodes.where("owner is not null and not is_visual").where(~F.col("place").contains("ViewState"))
    nth = F.row_number().over(Window.partitionBy("path", "owner", "place").orderBy("lft"))
    key = F.when(F.col("nth") > 1, F.format_string("%s[%d]", "place", "nth")).otherwise(F.col("place"))
    below = below.withColumn("nth", nth).withColumn("key", key)
    own = F.array(F.struct(F.col("key"), F.coalesce("text", F.lit("")).alias("value")))
    said = F.transform(F.map_entries("attributes"), lambda e: F.struct(F.concat_ws(".", "key", e["key"]).alias("key"), e["value"].alias("value")))
    entries = below.select("path", "owner", F.explode(F.concat(own, said)).alias("e")).select("path", "owner", "e.*")
    entries = entries.groupBy("path", "owner", "key").agg(F.max("value").alias("value"))  # an attribute may be called as an element
    return entries.groupBy("path", "owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("configuration"))


def activity_instances(nodes: DataFrame, project: Column) -> DataFrame:
    """One row for each visual element of sources.projects.xml_nodes.

    activity_id is unique in a project: of activities of one node id and content the second and later are hashed with their number.
    parent_activity_id is the nearest visual element's around it, depth counts elements below the root.
    arguments are the attributes but for the display name and the designer's; properties are all, and metadata the designer's.
    expressions and variables_referenced are sorted and come from arguments and configuration. A file that failed gives no row.
    """
    known = trees.enclosing(nodes.where("error is null").withColumn("id", F.col("lft")), ["path"], F.col("is_visual"), "owner").drop("id")
    way = lambda: F.concat_ws("/", F.nullif(F.col("above"), F.lit("")), "tag")
    visual = known.where("is_visual")
    heads = visual.select("path", F.col("lft").alias("owner"), F.length(way()).alias("skip"))
    placed = known.where("not is_visual").join(heads, ["path", "owner"]).withColumn("place", F.replace(F.expr("substring(concat_ws('/', nullif(above, ''), tag), skip + 2)"), F.lit("/"), F.lit(".")))
    content = F.to_json(F.struct("tag", F.array_sort(F.map_entries("attributes")).alias("said"), "text"))
    nth = F.row_number().over(Window.partitionBy("path", "node_id", "content").orderBy("lft"))
    told = visual.withColumn("content", content).withColumn("nth", nth)
    told = told.withColumn("content", F.when(F.col("nth") > 1, F.concat_ws("#", "content", F.col("nth").cast("string"))).otherwise(F.col("content")))
    told = told.withColumn("activity_id", activity_text.activity_id(project, F.col("path"), F.col("node_id"), F.col("content")))
    parents = told.select("path", F.col("lft").alias("owner"), F.col("activity_id").alias("parent_activity_id"))
    all_of = told.join(parents, ["path", "owner"], "left").join(configurations(placed).withColumnRenamed("owner", "lft"), ["path", "lft"], "left")
    none = F.create_map().cast("map<string,string>")
    all_of = all_of.withColumn("configuration", F.coalesce("configuration", none))
    all_of = all_of.withColumn("arguments", F.map_filter("attributes", lambda k, _: ~k.isin("DisplayName", *METADATA)))
    values = F.concat(F.map_values("arguments"), F.map_values("configuration"))
    found = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(values, f))))
    return all_of.select(
        "activity_id", ident.workflow_id(F.col("path")).alias("workflow_id"), F.col("tag").alias("activity_type"), activity_text.category(F.col("tag")).alias("category"), "display_name", "node_id",
        "parent_activity_id", (F.col("depth") - 1).alias("depth"), "lft", "arguments", "configuration", F.col("attributes").alias("properties"), F.map_filter("attributes", lambda k, _: k.isin(*METADATA)).alias("metadata"),
        found(activity_text.expressions_of).alias("expressions"), found(activity_text.variables_of).alias("variables_referenced"), activity_text.selectors_of(F.col("configuration")).alias("selectors"), "annotation",
        F.lit(True).alias("is_visible"), F.when(F.col("tag").isin(*CONTAINERS), F.col("tag")).alias("container_type"),
    )
