"""More registered queries: expansion in reading order, cycles by a witness, containers by intervals, packages of activities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procgraph.operators import callgraph, documents, graph, lookup, packages, pseudocode, relate, rules, trees
from procgraph.sources import discovery
from procgraph.suite import G_SQL, LEVELS, brand_edges, query, t

# Customers are workflows, their orders the activities; urgent ones call the customer of the day's next order (else the next customer), pending high ones their own

CALLS_SQL = """activity AS (
    SELECT o_custkey AS workflow, o_orderkey AS place, o_orderpriority || ' ' || o_orderkey AS name, CASE WHEN target IS NULL THEN 'Order' ELSE 'InvokeWorkflowFile' END AS type,
        CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Order/' || o_orderstatus END AS path, target
    FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN coalesce(lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey), o_custkey + 1)
        WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN o_custkey END AS target FROM orders)
)"""


def order_calls(spark: SparkSession, d: str) -> DataFrame:
    priority, own = F.col("o_orderpriority"), F.col("o_custkey")
    after = F.lead("o_custkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    target = F.when(priority == "1-URGENT", F.coalesce(after, own + 1)).when((priority == "2-HIGH") & (F.col("o_orderstatus") == "P"), own)
    return t(spark, d, "orders").withColumn("target", target).select(
        own.alias("workflow"), F.col("o_orderkey").alias("place"), F.concat_ws(" ", priority, F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("target").isNull(), "Order").otherwise("InvokeWorkflowFile").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("Order/"), "o_orderstatus")).alias("path"), "target",
    )


@query("recursive_pseudocode", f"""WITH RECURSIVE {CALLS_SQL}, here AS (SELECT DISTINCT workflow FROM activity), walk AS (
    SELECT workflow AS root, workflow AS target, CAST([] AS BIGINT[]) AS places, CAST([] AS BIGINT[]) AS way, 0 AS depth, CAST(NULL AS VARCHAR) AS line, '' AS mark, true AS asks FROM here
    UNION ALL (
        WITH call AS (SELECT * FROM walk WHERE asks),
        stop AS (SELECT c.*, CASE WHEN depth = 3 THEN 'depth limit' WHEN list_contains(way, target) THEN 'cycle' WHEN h.workflow IS NULL THEN 'missing' ELSE '' END AS why FROM call c LEFT JOIN here h ON target = h.workflow)
        SELECT root, target, list_append(places, 0), way, depth, repeat('  ', CAST(depth AS INT)) || CASE why WHEN 'depth limit' THEN '[DEPTH LIMIT REACHED: ' || target || '] (max depth: 3)'
            WHEN 'cycle' THEN '[CYCLE DETECTED: ' || target || '] (already expanded above)' ELSE '[MISSING WORKFLOW: ' || target || '] (pseudocode not found)' END, why, false FROM stop WHERE why <> ''
        UNION ALL SELECT root, a.target, list_append(places, place), list_append(way, workflow), depth + kind.asks::INT, CASE WHEN NOT kind.asks THEN repeat('  ', CAST(depth AS INT)) || '- [' || name || '] ' || type || CASE path WHEN '' THEN '' ELSE ' (ActivityPath: ' || path || ')' END END, '', kind.asks
        FROM stop JOIN activity a ON stop.target = workflow JOIN (SELECT unnest([true, false]) AS asks) kind ON NOT kind.asks OR a.target IS NOT NULL WHERE why = ''
    )
)
SELECT root, row_number() OVER (PARTITION BY root ORDER BY places) AS n, line, mark FROM walk WHERE NOT asks""")
def recursive_pseudocode(spark, d):
    calls = order_calls(spark, d)
    rows = pseudocode.expanded(calls, calls.select("workflow").distinct())
    return pseudocode.numbered_lines(rows).select("root", "n", "line", "mark")


# Cycles, each component's shortest one through its least node

LONGEST = 201  # nodes: the SQL of cycle_rule spreads 200 calls far, and so does that query; witness_cycles and the operators don't stop


def witness_sql(sized: str, spread: str) -> str:
    return f"""{G_SQL}, reach AS (SELECT src, dst FROM edge UNION SELECT reach.src, edge.dst FROM reach JOIN edge ON reach.dst = edge.src),
same AS (SELECT r.src AS node, min(r.dst) AS start FROM reach r JOIN reach b ON r.src = b.dst AND r.dst = b.src GROUP BY r.src),
inside AS (SELECT DISTINCT src, dst, s.start FROM edge JOIN same s ON src = s.node JOIN same e ON dst = e.node WHERE s.start = e.start),
{sized}spread AS (SELECT start, start AS node, 0 AS far FROM (SELECT DISTINCT start FROM inside) UNION SELECT i.start, dst, far + 1 FROM spread p JOIN inside i ON p.start = i.start AND node = src {spread} AND dst <> i.start),
least AS (SELECT start, node, min(far) AS far FROM spread GROUP BY ALL),
parent AS (SELECT l.start, l.node, min(i.src) AS up FROM least l JOIN inside i ON l.start = i.start AND l.node = i.dst JOIN least b ON b.start = i.start AND b.node = i.src AND b.far = l.far - 1 GROUP BY ALL),
closing AS (SELECT i.start, min(l.far) AS far, min({{'far': l.far, 'node': l.node}}).node AS node FROM inside i JOIN least l ON i.start = l.start AND i.src = l.node WHERE i.dst = i.start GROUP BY i.start),
back AS (SELECT start, [node] AS cycle, node AS top FROM closing UNION ALL SELECT b.start, list_prepend(up, cycle), up FROM back b JOIN parent p ON b.start = p.start AND b.top = p.node WHERE b.top <> b.start)"""


WITNESS_SQL = witness_sql("", f"WHERE far < {LONGEST - 1}")
# A shortest cycle has as many nodes as its component at most, so the spread stops there and misses none
ANY_LENGTH_SQL = witness_sql("sized AS (SELECT start, count(*) AS n FROM same GROUP BY start),\n", "JOIN sized z ON z.start = i.start WHERE far < n - 1")


@query("witness_cycles", f"WITH RECURSIVE {ANY_LENGTH_SQL} SELECT start, array_to_string(cycle, '>') AS cycle, CAST(len(cycle) AS BIGINT) AS length, CASE len(cycle) WHEN 1 THEN 'self' WHEN 2 THEN 'mutual' ELSE 'complex' END AS type FROM back WHERE top = start")
def witness_cycles(spark, d):
    found = graph.witness_cycles(brand_edges(spark, d))
    return found.select(F.element_at("cycle", 1).alias("start"), F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "length", graph.cycle_type(F.col("length")).alias("type"))


@query("cycle_rule", f"WITH RECURSIVE {WITNESS_SQL} SELECT 'cycle_detection' AS rule, 'fail' AS severity, CAST(start AS VARCHAR) AS subject, 'Cycle detected: ' || array_to_string(list_append(cycle, start), ' -> ') AS message FROM back WHERE top = start")
def cycle_rule(spark, d):
    return rules.cycle_detection(brand_edges(spark, d), most=LONGEST)


# Trees of customers, orders, lines and a leaf of each line, with nested-set places

PLACED_SQL = """line AS (
    SELECT l.*, o_custkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS nth FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
), node AS (
    SELECT c_custkey AS tree, 'C' || c_custkey AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 'Sequence' AS tag, true AS is_visual, false AS named FROM customer
    UNION ALL SELECT o_custkey, 'O' || o_orderkey, 'C' || o_custkey, 1, CASE o_orderpriority WHEN '1-URGENT' THEN 'If' WHEN '2-HIGH' THEN 'TryCatch' WHEN '3-MEDIUM' THEN 'Assign' WHEN '4-NOT SPECIFIED' THEN 'Switch' ELSE 'ForEach' END, true, o_orderstatus = 'P' FROM orders
    UNION ALL SELECT o_custkey, 'L' || l_orderkey || '.' || nth, 'O' || l_orderkey, 2, CASE l_returnflag WHEN 'A' THEN 'Sequence' WHEN 'R' THEN 'While' ELSE 'Delay' END, true, false FROM line
    UNION ALL SELECT o_custkey, 'P' || l_orderkey || '.' || nth, 'L' || l_orderkey || '.' || nth, 3, CASE l_linestatus WHEN 'F' THEN 'LogMessage' ELSE 'Comment' END, l_linestatus = 'F', false FROM line
), known AS (
    SELECT n.*, n.tag IN ('Sequence', 'If', 'TryCatch', 'Switch', 'ForEach', 'While') AS holds, n.named OR n.tag IN ('Sequence', 'If', 'TryCatch', 'Assign', 'ForEach', 'While', 'Delay', 'LogMessage') AS walked FROM node n
), above AS (
    SELECT n.*, p.holds AS p_holds, g.id AS g_id, g.holds AS g_holds, h.id AS h_id, h.holds AS h_holds, p.walked AS p_walked, g.walked AS g_walked
    FROM known n LEFT JOIN known p ON n.parent = p.id LEFT JOIN known g ON p.parent = g.id LEFT JOIN known h ON g.parent = h.id
)"""


def placed_tree(spark: SparkSession, d: str) -> DataFrame:
    """All customers with their orders, lines and leaves as trees: tree, id, parent, depth, tag, is_visual, named, lft, rgt.

    Orders are placed by a running sum of their sizes, lines and leaves within their order by number; no shuffle takes all nodes,
    and beyond TASK_ROWS for each of the session's partitions there are as many more.
    """
    n_orders, n_lines = (trees.parts(spark, t(spark, d, name).count()) for name in ("orders", "lineitem"))
    deal = lambda rows, n, key: rows.repartition(n, key) if n else rows
    order = deal(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), n_lines, "o_orderkey")
    lines = deal(t(spark, d, "lineitem").select("l_orderkey"), n_lines, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    sized = order.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("size", 2 + 4 * F.coalesce("lines", F.lit(0)))
    before = F.sum("size").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    placed = deal(sized, n_orders, "o_custkey").withColumn("lft", 1 + F.coalesce(before, F.lit(0)))
    whole = t(spark, d, "customer").join(sized.groupBy("o_custkey").agg(F.sum("size").alias("below")), F.col("c_custkey") == F.col("o_custkey"), "left")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    start = placed.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("lft").alias("start"))
    line = deal(t(spark, d, "lineitem"), n_lines, "l_orderkey").withColumn("nth", nth).join(start, "l_orderkey").withColumn("lft", F.col("start") + 4 * F.col("nth") - 3)
    name = lambda letter, *parts: F.concat(F.lit(letter), F.concat_ws(".", *[F.col(p).cast("string") for p in parts]))
    yes, no = F.lit(True), F.lit(False)

    def node(tree, own, parent, depth, tag, visual, named, lft, size):
        """size: places from lft to rgt."""
        parent, lft = parent if parent is not None else F.lit(None).cast("string"), lft.cast("long")
        return F.struct(F.col(tree).alias("tree"), own.alias("id"), parent.alias("parent"), F.lit(depth).alias("depth"), tag.alias("tag"), visual.alias("is_visual"), named.alias("named"), lft.alias("lft"), (lft + size - 1).cast("long").alias("rgt"))

    priority, flag, closed = F.col("o_orderpriority"), F.col("l_returnflag"), F.col("l_linestatus") == "F"
    tag = F.when(priority == "1-URGENT", "If").when(priority == "2-HIGH", "TryCatch").when(priority == "3-MEDIUM", "Assign").when(priority == "4-NOT SPECIFIED", "Switch").otherwise("ForEach")
    nodes = relate.union_all([
        whole.select(F.inline(F.array(node("c_custkey", name("C", "c_custkey"), None, 0, F.lit("Sequence"), yes, no, F.lit(0), 2 + F.coalesce("below", F.lit(0)))))),
        placed.select(F.inline(F.array(node("o_custkey", name("O", "o_orderkey"), name("C", "o_custkey"), 1, tag, yes, F.col("o_orderstatus") == "P", F.col("lft"), F.col("size"))))),
        line.select(F.inline(F.array(
            node("o_custkey", name("L", "l_orderkey", "nth"), name("O", "l_orderkey"), 2, F.when(flag == "A", "Sequence").when(flag == "R", "While").otherwise("Delay"), yes, no, F.col("lft"), F.lit(4)),
            node("o_custkey", name("P", "l_orderkey", "nth"), name("L", "l_orderkey", "nth"), 3, F.when(closed, "LogMessage").otherwise("Comment"), closed, no, F.col("lft") + 1, F.lit(2)),
        ))),
    ])
    return nodes


def n_placed(spark: SparkSession, d: str) -> int:
    """Nodes of placed_tree, by the tables' own counts."""
    return sum(t(spark, d, name).count() * k for name, k in (("customer", 1), ("orders", 1), ("lineitem", 2)))


@query("nearest_containers", f"""WITH {PLACED_SQL} SELECT id, CASE WHEN p_holds THEN parent WHEN g_holds THEN g_id WHEN h_holds THEN h_id END AS container FROM above""")
def nearest_containers(spark, d):
    nodes = placed_tree(spark, d).select("tree", "id", "tag", "lft", "rgt")
    return trees.enclosing(nodes, ["tree"], F.col("tag").isin(*trees.CONTAINERS), n=n_placed(spark, d)).select("id", "container")


@query("walked_activities", f"""WITH {PLACED_SQL} SELECT id, tag FROM above WHERE depth = 0 OR walked AND (depth < 2 OR p_walked) AND (depth < 3 OR g_walked)""")
def walked_activities(spark, d):
    return trees.unpruned(placed_tree(spark, d).drop("depth", "is_visual"), ["tree"], trees.is_activity(F.col("tag"), F.col("named")), n_placed(spark, d)).select("id", "tag")


@query("container_statistics", f"""WITH {PLACED_SQL}, pair AS (
    SELECT parent AS holder, tag, is_visual, 1 AS below FROM above WHERE p_holds
    UNION ALL SELECT g_id, tag, is_visual, 2 FROM above WHERE p_holds AND g_holds
    UNION ALL SELECT h_id, tag, is_visual, 3 FROM above WHERE p_holds AND g_holds AND h_holds
), kind AS (SELECT holder, tag, count(*) AS n, count(*) FILTER (WHERE is_visual) AS visual, max(below) AS deepest FROM pair GROUP BY ALL)
SELECT id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_child_activities, CAST(coalesce(sum(visual), 0) AS BIGINT) AS visual_activities, CAST(coalesce(max(deepest), 0) AS BIGINT) AS max_depth,
    coalesce(string_agg(kind.tag || '=' || n, ',' ORDER BY kind.tag), '') AS types
FROM known LEFT JOIN kind ON id = holder WHERE holds GROUP BY id""")
def container_statistics(spark, d):
    stats = trees.container_statistics(placed_tree(spark, d), ["tree"], n_placed(spark, d))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("activity_type_counts")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return stats.select("id", "total_child_activities", "visual_activities", "max_depth", types.alias("types"))


# Packages: brands are projects; parts are activities of the catalog, of a namespace or of the house's own

TYPES_SQL = """names AS (SELECT ['Assign', 'InvokeWorkflowFile', 'Sequence', 'If', 'LogMessage', 'WriteLine', 'Delay', 'ReadTextFile', 'HttpClient', 'Click', 'Type', 'GetText', 'ExcelReadRange', 'ExcelWriteRange', 'SendMail', 'GetMail'] AS l),
piece AS (SELECT *, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part),
activity AS (SELECT p_brand AS bay, CASE WHEN p_size <= 16 THEN l[p_size] WHEN p_size <= 30 THEN 'House.' || one || '.' || two ELSE one || two || p_size END AS type, p_partkey AS id, p_size % 5 AS depth, p_type = 'ECONOMY' AS holds FROM piece, names),
dependency AS (
    SELECT p_brand AS bay, 'UiPath.System.Activities' AS name, '[' || p_size || '.0]' AS version, 'vendor_official' AS class, p_partkey AS rank FROM piece WHERE p_type = 'ECONOMY'
    UNION ALL SELECT p_brand, 'House.' || one, '1.' || p_size, 'third_party', p_partkey FROM piece WHERE p_size BETWEEN 17 AND 23
    UNION ALL SELECT p_brand, one || '.' || two, '2.' || p_size, 'custom_local', p_partkey FROM piece WHERE p_size < 4
), first AS (SELECT bay, name, min_by({'version': version, 'class': class}, rank) AS dep FROM dependency GROUP BY ALL),
catalog AS (SELECT unnest(l) AS type, unnest(['UiPath.System.Activities', 'UiPath.System.Activities', 'UiPath.System.Activities', 'UiPath.System.Activities', 'UiPath.System.Activities', 'UiPath.System.Activities', 'UiPath.System.Activities', 'UiPath.System.Activities', 'UiPath.System.Activities',
    'UiPath.UIAutomation.Activities', 'UiPath.UIAutomation.Activities', 'UiPath.UIAutomation.Activities', 'UiPath.Excel.Activities', 'UiPath.Excel.Activities', 'UiPath.Mail.Activities', 'UiPath.Mail.Activities']) AS package FROM names),
sought AS (SELECT DISTINCT bay, type FROM activity),
named AS (SELECT s.*, c.package, CASE WHEN contains(s.type, '.') THEN regexp_replace(s.type, '\\.[^.]*$', '') END AS namespace FROM sought s LEFT JOIN catalog c ON s.type = c.type),
own AS (SELECT n.bay, n.type, min({'rank': d.rank, 'name': d.name}).name AS name FROM named n JOIN dependency d ON n.bay = d.bay AND class = 'custom_local'
    AND (contains(lower(n.type), lower(replace(d.name, '.', ''))) OR starts_with(lower(n.type), substr(lower(replace(d.name, '.', '')), 1, 5))) GROUP BY ALL),
resolved AS (
    SELECT n.bay, n.type, coalesce(n.package, CASE WHEN f.name IS NOT NULL THEN namespace END, o.name) AS package,
        CASE WHEN n.package IS NULL AND f.name IS NULL THEN x.dep.version ELSE f.dep.version END AS version,
        CASE WHEN n.package IS NOT NULL THEN coalesce(f.dep.class, 'vendor_official') WHEN f.name IS NOT NULL THEN f.dep.class ELSE x.dep.class END AS class,
        CASE WHEN n.package IS NOT NULL THEN 'catalog' WHEN f.name IS NOT NULL THEN 'namespace' WHEN o.name IS NOT NULL THEN 'prefix' END AS found
    FROM named n LEFT JOIN first f ON n.bay = f.bay AND f.name = coalesce(n.package, namespace) LEFT JOIN own o ON n.bay = o.bay AND n.type = o.type LEFT JOIN first x ON x.bay = o.bay AND x.name = o.name
)"""
TYPES = ("Assign", "InvokeWorkflowFile", "Sequence", "If", "LogMessage", "WriteLine", "Delay", "ReadTextFile", "HttpClient", "Click", "Type", "GetText", "ExcelReadRange", "ExcelWriteRange", "SendMail", "GetMail")


def brand_activities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(activities, dependencies) of all parts."""
    size = F.col("p_size")
    part = t(spark, d, "part").withColumns({"one": F.split_part("p_name", F.lit(" "), F.lit(1)), "two": F.split_part("p_name", F.lit(" "), F.lit(2))})
    kind = F.when(size <= len(TYPES), F.element_at(F.array(*map(F.lit, TYPES)), F.least(size, F.lit(len(TYPES))).cast("int"))).when(size <= 30, F.concat_ws(".", F.lit("House"), "one", "two")).otherwise(F.concat("one", "two", size.cast("string")))
    activities = part.select(F.col("p_brand").alias("bay"), kind.alias("type"), F.col("p_partkey").alias("id"), (size % 5).alias("depth"), (F.col("p_type") == "ECONOMY").alias("is_container"), F.col("p_partkey").alias("place"))
    row = lambda rows, name, version, kind: rows.select(F.col("p_brand").alias("bay"), name.alias("name"), version.alias("version"), F.lit(kind).alias("class"), F.col("p_partkey").alias("rank"))
    text = size.cast("string")
    return activities, relate.union_all([
        row(part.where("p_type = 'ECONOMY'"), F.lit("UiPath.System.Activities"), F.concat(F.lit("["), text, F.lit(".0]")), "vendor_official"),
        row(part.where("p_size between 17 and 23"), F.concat_ws(".", F.lit("House"), "one"), F.concat(F.lit("1."), text), "third_party"),
        row(part.where("p_size < 4"), F.concat_ws(".", "one", "two"), F.concat(F.lit("2."), text), "custom_local"),
    ])


@query("activity_packages", f"WITH {TYPES_SQL} SELECT bay, type, package, version, class, CASE WHEN found <> 'catalog' THEN package || '.dll' END AS own_assembly, found FROM resolved")
def activity_packages(spark, d):
    found = packages.resolved(*brand_activities(spark, d), ["bay"])
    return found.select("bay", "type", "package", "version", "class", F.when(F.col("found") != "catalog", F.col("assembly")).alias("own_assembly"), "found")


@query("activity_collection", f"""WITH {TYPES_SQL}, joined AS (SELECT a.*, coalesce(r.package, 'unknown') AS package FROM activity a LEFT JOIN resolved r ON a.bay = r.bay AND a.type = r.type)
SELECT bay, 'type' AS set, type AS key, count(*) AS n, CAST(NULL AS BIGINT) AS max_depth, CAST(NULL AS BIGINT) AS root_container FROM joined GROUP BY ALL
UNION ALL SELECT bay, 'package', package, count(*), NULL, NULL FROM joined GROUP BY ALL
UNION ALL SELECT bay, 'all', NULL, count(*), max(depth), min(id) FILTER (WHERE holds AND depth = 1) FROM joined GROUP BY ALL""")
def activity_collection(spark, d):
    activities, dependencies = brand_activities(spark, d)
    return packages.collection(activities, packages.resolved(activities, dependencies, ["bay"]), ["bay"])


# The call graph of parts: files by brand and name, each line of an order a call of the supplier's next part in one of several spellings

MODEL_SQL = """catalog AS (SELECT 'w' || p_partkey AS id, replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || p_size || '.xaml' AS path, p_partkey AS rank FROM part),
call AS (
    SELECT CASE l_linenumber WHEN 1 THEN 'w' || l_partkey WHEN 2 THEN 'bay#gone#0' ELSE 'bay#w' || l_partkey || '#0' END AS src,
        CASE WHEN l_linenumber = 3 THEN '["Flow" + name]' WHEN l_linenumber = 4 THEN 'none/' || l_partkey WHEN l_quantity < 4 THEN 'other\\' || split_part(c.path, '/', 2) WHEN l_quantity < 16 THEN replace(c.path, '/', '\\') END AS target,
        CASE l_returnflag WHEN 'A' THEN 'invoke' WHEN 'N' THEN 'invoke-dynamic' ELSE CASE WHEN l_linenumber = 5 THEN 'invoke-coded' ELSE 'invoke-missing' END END AS kind
    FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS next FROM lineitem) LEFT JOIN catalog c ON c.id = 'w' || next
), made AS (SELECT CASE WHEN contains(src, '#') THEN split_part(src, '#', 2) ELSE src END AS src, target, regexp_replace(replace(target, '\\', '/'), '(\\.xaml|\\.XAML)$', '') AS path, kind FROM call),
by_path AS (SELECT regexp_replace(path, '\\.xaml$', '') AS path, min_by(id, rank) AS id FROM catalog GROUP BY 1),
by_name AS (SELECT split_part(regexp_replace(path, '\\.xaml$', ''), '/', 2) AS name, min_by(id, rank) AS id FROM catalog GROUP BY 1),
dependency AS (
    SELECT m.src, CASE WHEN target IS NOT NULL THEN coalesce(p.id, n.id) END AS dst, target, CASE WHEN target IS NULL OR coalesce(p.id, n.id) IS NULL THEN 'missing' WHEN kind = 'invoke' THEN 'static' WHEN kind = 'invoke-missing' THEN 'missing' WHEN kind = 'invoke-dynamic' THEN 'dynamic' ELSE kind END AS type
    FROM made m JOIN catalog c ON m.src = c.id LEFT JOIN by_path p ON m.path = p.path LEFT JOIN by_name n ON split_part(m.path, '/', -1) = n.name
), entry AS (SELECT id AS node FROM catalog WHERE split_part(path, '/', 2) IN (SELECT split_part(path, '/', 2) FROM catalog WHERE rank < 3)),
edge AS (SELECT DISTINCT src, dst FROM dependency WHERE dst IS NOT NULL),
walk AS (SELECT node, 0 AS depth FROM entry UNION SELECT dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < 70), reached AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
reach AS (SELECT src, dst FROM edge UNION SELECT reach.src, edge.dst FROM reach JOIN edge ON reach.dst = edge.src),
ring AS (SELECT r.src, min(r.dst) AS least FROM reach r JOIN reach b ON r.src = b.dst AND r.dst = b.src GROUP BY r.src)"""


def part_calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, calls, entries) of all parts and lines."""
    key = lambda c: F.concat(F.lit("w"), F.col(c).cast("string"))
    path = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"), F.lit(".xaml"))
    catalog = t(spark, d, "part").select(key("p_partkey").alias("id"), path.alias("path"), F.col("p_partkey").alias("rank"))
    after = F.lead("l_partkey").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    lines = t(spark, d, "lineitem").withColumn("next", F.concat(F.lit("w"), after.cast("string"))).join(catalog.select(F.col("id").alias("next"), "path"), "next", "left")
    number, flag, part, little = F.col("l_linenumber"), F.col("l_returnflag"), key("l_partkey"), F.col("l_quantity")
    source = F.when(number == 1, part).when(number == 2, "bay#gone#0").otherwise(F.concat(F.lit("bay#"), part, F.lit("#0")))
    target = F.when(number == 3, '["Flow" + name]').when(number == 4, F.concat(F.lit("none/"), F.col("l_partkey").cast("string"))).when(little < 4, F.concat(F.lit("other\\"), F.split_part("path", F.lit("/"), F.lit(2)))).when(little < 16, F.replace("path", F.lit("/"), F.lit("\\")))
    kind = F.when(flag == "A", "invoke").when(flag == "N", "invoke-dynamic").when(number == 5, "invoke-coded").otherwise("invoke-missing")
    return catalog, lines.select(source.alias("from"), target.alias("target"), kind.alias("kind")), catalog.where("rank < 3").select("path")


@query("call_dependencies", f"WITH RECURSIVE {MODEL_SQL} SELECT src, dst, target, type, count(*) AS n FROM dependency GROUP BY ALL")
def call_dependencies(spark, d):
    catalog, calls, _ = part_calls(spark, d)
    return callgraph.dependencies(calls, catalog).groupBy("src", "dst", "target", "type").agg(F.count("*").alias("n"))


@query("call_graph_metrics", f"""WITH RECURSIVE {MODEL_SQL} SELECT (SELECT count(*) FROM catalog) AS total_workflows, (SELECT count(*) FROM entry) AS entry_points, (SELECT count(*) FROM catalog) - (SELECT count(*) FROM reached) AS orphaned_workflows,
    (SELECT CAST(max(depth) AS BIGINT) FROM reached) AS max_call_depth, count(*) AS total_dependencies, count(*) FILTER (WHERE type = 'static') AS static_invocations, count(*) FILTER (WHERE type = 'dynamic') AS dynamic_invocations,
    count(*) FILTER (WHERE type = 'missing') AS missing_invocations, (SELECT count(DISTINCT least) FROM ring) AS cycles_detected FROM dependency""")
def call_graph_metrics(spark, d):
    return callgraph.metrics(callgraph.call_graph(*part_calls(spark, d), LEVELS))


# Documents of trees, and the nearest marker above a place

FIELDS = {"nodeId": "id", "activityType": "tag", "parentId": "parent"}


@query("tree_documents", f"""WITH {PLACED_SQL}, leaf AS (SELECT parent, id, '{{"nodeId":"' || id || '","activityType":"' || tag || '","parentId":"' || parent || '","children":[]}}' AS doc FROM node WHERE depth = 3),
two AS (SELECT n.parent, n.id, CAST(split_part(n.id, '.', 2) AS BIGINT) AS nth, '{{"nodeId":"' || n.id || '","activityType":"' || n.tag || '","parentId":"' || n.parent || '","children":[' || coalesce(l.doc, '') || ']}}' AS doc FROM node n LEFT JOIN leaf l ON l.parent = n.id WHERE n.depth = 2),
kids AS (SELECT parent, string_agg(doc, ',' ORDER BY nth) AS docs FROM two GROUP BY parent),
one AS (SELECT n.tree, n.id, CAST(substr(n.id, 2) AS BIGINT) AS place, '{{"nodeId":"' || n.id || '","activityType":"' || n.tag || '","parentId":"' || n.parent || '","children":[' || coalesce(docs, '') || ']}}' AS doc FROM node n LEFT JOIN kids ON kids.parent = n.id WHERE n.depth = 1),
below AS (SELECT tree, string_agg(doc, ',' ORDER BY place) AS docs FROM one GROUP BY tree)
SELECT n.tree, '{{"nodeId":"' || n.id || '","activityType":"' || n.tag || '","parentId":null,"children":[' || coalesce(docs, '') || ']}}' AS document FROM node n LEFT JOIN below b ON n.tree = b.tree WHERE n.depth = 0""")
def tree_documents(spark, d):
    return documents.tree_documents(placed_tree(spark, d), ["tree"], FIELDS, n=n_placed(spark, d))


@query("flat_nodes", f"WITH {PLACED_SQL} SELECT tree, id, tag, parent FROM node")
def flat_nodes(spark, d):
    return documents.flat_nodes(tree_documents(spark, d), ["tree"], FIELDS).drop("place")


@query("nearest_markers", """WITH place AS (SELECT p_partkey, string_split(p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/'), '/') AS parts FROM part),
marker AS (SELECT DISTINCT array_to_string(parts[1:1 + (p_partkey % 4)], '/') AS folder FROM place JOIN part USING (p_partkey) WHERE p_size = 50),
way AS (SELECT p_partkey, unnest(range(0, len(parts) + 1)) AS distance, parts FROM place)
SELECT p.p_partkey, arg_min(m.folder || '/project.json', w.distance) AS found, CAST(min(w.distance) AS INTEGER) AS distance
FROM place p LEFT JOIN (way w JOIN marker m ON array_to_string(w.parts[1:len(w.parts) - w.distance], '/') = m.folder) ON p.p_partkey = w.p_partkey GROUP BY p.p_partkey""")
def nearest_markers(spark, d):
    """Parts lie in folders of brand, type and name; those of size 50 have a project file somewhere above."""
    part = t(spark, d, "part").withColumn("folder", F.concat_ws("/", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("/"))))
    parts = F.split("folder", "/")
    files = part.where("p_size = 50").select(F.concat(F.array_join(F.slice(parts, F.lit(1), (1 + F.col("p_partkey") % 4).cast("int")), "/"), F.lit("/project.json")).alias("path"))
    return discovery.nearest_above(part.select("p_partkey", "folder"), files, "project.json").select("p_partkey", "found", "distance")


@query("resolve_projects", None)
def resolve_projects(spark, d):
    """Questions are the names of nations with a letter less, projects are customers by segment and number and nations by name; tested against every pair, as SQL has no matching blocks."""
    nation = t(spark, d, "nation").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))
    customer = t(spark, d, "customer").select(F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"))
    questions = t(spark, d, "nation").select(F.expr("left(n_name, length(n_name) - 1)").alias("query")).unionByName(t(spark, d, "region").select(F.col("r_name").alias("query")))
    return lookup.resolve_projects(questions, nation.unionByName(customer))
