"""What XML nodes say of a workflow: arguments, variables, imports, call arguments, dynamic calls (X8, X13-X16), and its lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions import ident

# Signs that a bracketed text is an expression, and the prefix of an argument by its direction.
OPERATORS = ("+", "&", '"', "'", "Path.", "IO.", "System.")
DIRECTION_PREFIX = {"in": "in_", "out": "out_", "io": "io_", "inout": "io_"}


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def arguments(nodes: DataFrame) -> DataFrame:
    """(path, name, direction, type, default): the Property elements of workflows. The direction is stated, or told by out_ and io_, else In."""
    name, stated = attribute("Name"), attribute("Direction")
    told = F.when(F.lower(name).startswith("out_"), "Out").when(F.lower(name).startswith("io_"), "InOut").otherwise("In")
    direction = F.when(F.length(stated) > 0, stated).otherwise(told)
    found = nodes.where((F.col("tag") == "Property") & (F.length(name) > 0))
    return found.select("path", name.alias("name"), direction.alias("direction"), F.coalesce(attribute("Type"), F.lit("Object")).alias("type"), attribute("DefaultValue").alias("default"))


def variables(nodes: DataFrame) -> DataFrame:
    """(path, name, type, default, scope) of all Variable elements; "" for what isn't there."""
    part = lambda c: F.coalesce(attribute(c), F.lit(""))
    return nodes.where("tag = 'Variable'").select("path", part("Name").alias("name"), part("TypeArguments").alias("type"), part("Default").alias("default"), F.lit("Workflow").alias("scope"))


def imports(nodes: DataFrame) -> DataFrame:
    """(path, import) of the namespaces that a workflow lists for its implementation, in document order as place."""
    lists = nodes.where("tag = 'TextExpression.NamespacesForImplementation'").select("path", F.col("lft").alias("list"))
    names = nodes.where("text is not null").select("path", "parent", "lft", "text")
    return names.join(lists, (names["path"] == lists["path"]) & (names["parent"] == lists["list"])).select(names["path"], F.col("lft").alias("place"), F.col("text").alias("import"))


def call_arguments(nodes: DataFrame) -> DataFrame:
    """(path, lft, arguments): for every InvokeWorkflowFile its arguments as a map.

    They stand in children of an element whose tag ends in Arguments, by Key and Value or as a String or Object with a
    Key, and in attributes called arg_... or ...Argument, which win.
    """
    calls = nodes.where("tag = 'InvokeWorkflowFile'").select("path", "lft", "attributes")
    lists = nodes.where(F.col("tag").endswith("Arguments")).select("path", F.col("parent").alias("lft"), F.col("lft").alias("list"))
    key, value = attribute("Key"), attribute("Value")
    typed = F.col("tag").endswith("String") | F.col("tag").endswith("Object")
    entry = F.when(key.isNotNull() & value.isNotNull(), value).when(typed & (F.length(key) > 0), F.coalesce("text", value, F.lit("")))
    entries = nodes.select("path", F.col("parent").alias("list"), F.col("lft").alias("place"), key.alias("key"), entry.alias("value")).where("value is not null")
    listed = lists.join(entries, ["path", "list"]).groupBy("path", "lft", "key").agg(F.max_by("value", "place").alias("value"))
    listed = listed.groupBy("path", "lft").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("listed"))
    direct = F.map_filter("attributes", lambda k, _: k.startswith("arg_") | k.endswith("Argument"))
    none = F.create_map().cast("map<string,string>")
    named = F.map_filter(F.coalesce("listed", none), lambda k, _: ~F.array_contains(F.map_keys("direct"), k))
    return calls.select("path", "lft", direct.alias("direct")).join(listed, ["path", "lft"], "left").select("path", "lft", F.map_concat(named, "direct").alias("arguments"))


def dynamic_calls(texts: DataFrame) -> DataFrame:
    """(path, target, activity) of calls that the text of a workflow, (path, text), builds at run time: Path.Combine(...) with a
    .xaml in it, and bracketed expressions with a .xaml and an operator."""
    combined = F.regexp_extract_all("text", F.lit(r"(?i)Path\.Combine\([^)]+\.xaml[^)]*\)"), 0)
    bracketed = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\[([^\]]*\.xaml[^\]]*)\]"), 1), F.trim)
    is_code = lambda e: F.array_max(F.array(*[e.contains(x).cast("int") for x in OPERATORS])) == 1
    rows = lambda found, kind: texts.select("path", F.explode(found).alias("target"), F.lit(kind).alias("activity"))
    both = rows(combined, "Dynamic Path.Combine").unionByName(rows(F.filter(bracketed, is_code), "Variable Expression"))
    return both.withColumn("target", ident.posix(F.col("target")))


def texts(nodes: DataFrame) -> DataFrame:
    """(path, text): the texts of a workflow's elements in document order, one a line."""
    parts = nodes.where("text is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("lft", "text"))).alias("parts"))
    return parts.select("path", F.array_join(F.col("parts.text"), "\n").alias("text"))


def argument_naming(found: DataFrame) -> DataFrame:
    """The arguments whose name doesn't start with the prefix of their direction, with the prefix expected."""
    known = F.lower("direction")
    expected = F.coalesce(*[F.when(known == d, F.lit(p)) for d, p in DIRECTION_PREFIX.items()])
    return found.withColumn("expected", expected).where((F.length("name") > 0) & ~F.col("name").startswith(F.col("expected")))


def find(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(identifier) with the first catalog row (id, path, file_name, display_name, rank) that it names, and step.

    Steps: the id, the path, the file name, a part of the path, a part of the display name (both in any case); the first step that finds
    something holds, and in it the smallest rank. The first three are equi-joins; parts are looked for only where these find nothing, with
    the identifiers that are left, a user's questions and not a table that grows with the catalog, broadcast if Spark finds them small.
    """
    wanted = wanted.select("identifier", F.replace("identifier", F.lit("\\"), F.lit("/")).alias("asked")).distinct()
    keys = [catalog.select(F.col(c).alias("asked"), F.lit(step).alias("step"), "rank", "id") for step, c in enumerate(("id", "path", "file_name"), 1)]
    best = keys[0].unionByName(keys[1]).unionByName(keys[2]).groupBy("asked").agg(F.min(F.struct("step", "rank", "id")).alias("hit"))
    exact = wanted.join(best, "asked", "left")
    left = exact.where("hit is null").select("identifier", F.lower("asked").alias("asked"))
    has = lambda c: F.coalesce(F.lower(c).contains(F.col("asked")), F.lit(False))
    partly = catalog.select("id", "rank", "path", "display_name").join(left, has("path") | has("display_name"))
    partly = partly.groupBy("identifier").agg(F.min(F.struct(F.when(has("path"), 4).otherwise(5).alias("step"), "rank", "id")).alias("part"))
    hit = exact.join(partly, "identifier", "left").withColumn("hit", F.coalesce("hit", "part"))
    return hit.select("identifier", "hit.id", F.coalesce("hit.step", F.lit(0)).alias("step"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, callers, callees): sorted lists of whom each node is called by and calls, from (src, dst)."""
    both = edges.select(F.col("dst").alias("node"), F.col("src").alias("caller"), F.lit(None).cast("long").alias("callee")).unionByName(edges.select(F.col("src").alias("node"), F.lit(None).cast("long").alias("caller"), F.col("dst").alias("callee")))
    return both.groupBy("node").agg(F.array_sort(F.collect_set("caller")).alias("callers"), F.array_sort(F.collect_set("callee")).alias("callees"))


