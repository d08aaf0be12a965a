"""More registered queries: rules, lookup, package classes and profiles on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from procgraph.functions import expressions, ident
from procgraph.operators import graph, rules, trees, workflows
from procgraph.suite import E_SQL, TREE_SQL, edge_query, query, t, tree

# Rules


@query("roots_resolvable", """SELECT 'roots_resolvable' AS rule, 'fail' AS severity, o_orderpriority || '/' || o_custkey AS subject, 'Entry point not found: ' || o_custkey AS message
FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders) o ANTI JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey""")
def roots_resolvable(spark, d):
    """Every priority is a project whose entry points are its customers; those without debt are files of all projects."""
    roots = t(spark, d, "orders").select(F.col("o_orderpriority").alias("bay"), F.col("o_custkey").cast("string").alias("path"), F.lit(False).alias("is_main")).distinct()
    files = t(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("path"))
    return rules.roots_resolvable(roots, files)


@query("arguments_presence", "SELECT count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS with_arguments, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS without_arguments FROM events")
def arguments_presence(spark, d):
    return rules.arguments_presence(t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("arguments")))


@query("provenance", """SELECT 'provenance' AS rule, 'fail' AS severity, event_id || '/' || field AS subject, 'Missing provenance field: ' || field AS message
FROM (SELECT event_id, props, unnest(['k', 'toolVersion']) AS field FROM events) WHERE NOT list_contains(json_keys(props), field)""")
def provenance(spark, d):
    return rules.provenance(t(spark, d, "events").select(F.col("event_id").cast("string").alias("bay"), F.col("props").alias("content")), ("k", "toolVersion"))


@query("artifacts_presence", """WITH e AS (SELECT user_id || ' ' || CAST(CAST(ts AS DATE) AS VARCHAR) AS bay, event_type FROM events)
SELECT 'artifacts_presence' AS rule, 'fail' AS severity, u.bay || '/' || r.file AS subject, 'Required artifact missing: ' || r.file AS message
FROM (SELECT DISTINCT bay FROM e) u CROSS JOIN (VALUES ('purchase'), ('signup')) r(file) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.bay = u.bay AND e.event_type = r.file)""")
def artifacts_presence(spark, d):
    """Each user's day is a project, its events the artifacts by type."""
    bay = F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    first = t(spark, d, "events").groupBy(bay.alias("bay"), F.col("event_type").alias("file")).agg(F.min_by("props", "event_id").alias("content"))
    return rules.artifacts_presence(first, ("purchase", "signup"))


@query("argument_prefix", """SELECT l_orderkey, l_linenumber, name, direction, expected FROM (
    SELECT l_orderkey, l_linenumber, lower(l_shipmode) AS name, direction, CASE direction WHEN 'in' THEN 'in_' WHEN 'out' THEN 'out_' WHEN 'io' THEN 'io_' WHEN 'inout' THEN 'io_' END AS expected
    FROM (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'out_' ELSE 'in_' END || l_returnflag AS l_shipmode, CASE l_returnflag WHEN 'A' THEN 'in' WHEN 'R' THEN 'out' ELSE 'inout' END AS direction FROM lineitem))
WHERE NOT starts_with(name, expected)""")
def argument_prefix(spark, d):
    name = F.lower(F.concat(F.when(F.col("l_linestatus") == "O", "out_").otherwise("in_"), "l_returnflag"))
    direction = F.when(F.col("l_returnflag") == "A", "in").when(F.col("l_returnflag") == "R", "out").otherwise("inout")
    return workflows.argument_naming(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), direction.alias("direction")))


# Lookup and neighbours


@query("find_cascade", r"""WITH cat AS (SELECT p_partkey AS rank, CAST(p_partkey AS VARCHAR) AS id, p_type AS path, p_brand AS file_name, p_name AS display_name FROM part),
wanted AS (SELECT unnest(['7', 'Brand#13', 'PROMO\STEEL', 'promo', 'ECONOMY ANODIZED STEEL', 'lace', 'nothing like it']) AS identifier), asked AS (SELECT identifier, replace(identifier, '\', '/') AS a FROM wanted)
SELECT w.identifier, hit.id AS id, coalesce(hit.step, 0) AS step FROM wanted w LEFT JOIN (
    SELECT identifier, min({'step': step, 'rank': rank, 'id': id}) AS hit FROM (
        SELECT identifier, CASE WHEN id = a THEN 1 WHEN path = a THEN 2 WHEN file_name = a THEN 3 WHEN contains(lower(path), lower(a)) THEN 4 WHEN contains(lower(display_name), lower(a)) THEN 5 END AS step, rank, id
        FROM cat CROSS JOIN asked) WHERE step IS NOT NULL GROUP BY identifier) f ON w.identifier = f.identifier""")
def find_cascade(spark, d):
    catalog = t(spark, d, "part").select(F.col("p_partkey").alias("rank"), F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("path"), F.col("p_brand").alias("file_name"), F.col("p_name").alias("display_name"))
    names = ["7", "Brand#13", "PROMO\\STEEL", "promo", "ECONOMY ANODIZED STEEL", "lace", "nothing like it"]
    return workflows.find(catalog, spark.createDataFrame([(n,) for n in names], "identifier string"))


@edge_query("callers_callees", f"""WITH {E_SQL} SELECT node, coalesce((SELECT array_to_string(list_sort(list(src)), ',') FROM edge WHERE dst = node), '') AS callers,
    coalesce((SELECT array_to_string(list_sort(list(dst)), ',') FROM edge WHERE src = node), '') AS callees FROM node""")
def callers_callees(e):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return workflows.neighbours(e).select("node", text("callers"), text("callees"))


@edge_query("cycle_edges", f"""WITH RECURSIVE {E_SQL}, reach AS (SELECT src, dst FROM edge UNION SELECT reach.src, edge.dst FROM reach JOIN edge ON reach.dst = edge.src)
SELECT edge.src, edge.dst, CASE WHEN edge.src = edge.dst THEN 'self' WHEN EXISTS (SELECT 1 FROM edge b WHERE b.src = edge.dst AND b.dst = edge.src) THEN 'mutual' ELSE 'complex' END AS type
FROM edge JOIN reach ON reach.src = edge.dst AND reach.dst = edge.src""")
def cycle_edges(e):
    """Edges on cycles, by the shortest kind of cycle they lie on."""
    on = graph.written(graph.cyclic_edges(e))
    back = on.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("both"))
    kind = F.when(F.col("src") == F.col("dst"), "self").when(F.col("both"), "mutual").otherwise("complex")
    return on.join(back, ["src", "dst"], "left").select("src", "dst", kind.alias("type"))


# Profiles

SIZE_SQL = "size AS (SELECT o_custkey AS workflow, count(*) AS activities FROM orders GROUP BY o_custkey)"


def sizes(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("workflow")).agg(F.count("*").alias("activities"))


@query("complexity_bucket", f"WITH {SIZE_SQL} SELECT CASE WHEN activities <= 5 THEN 'simple' WHEN activities <= 15 THEN 'moderate' ELSE 'complex' END AS bucket, count(*) AS n FROM size GROUP BY 1")
def complexity_bucket(spark, d):
    bucket = F.when(F.col("activities") <= 5, "simple").when(F.col("activities") <= 15, "moderate").otherwise("complex")
    return sizes(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("portrait_depth_hist", f"WITH {TREE_SQL} SELECT depth, count(*) AS nodes, CAST(count(*) FILTER (WHERE tag = 'Order') AS BIGINT) AS leaves FROM tree GROUP BY depth")
def portrait_depth_hist(spark, d):
    return tree(spark, d).groupBy(F.col("depth")).agg(F.count("*").alias("nodes"), F.count_if(F.col("tag") == "Order").alias("leaves"))


@query("signature", """SELECT user_id, string_agg(event_type || ':' || n, '|' ORDER BY event_type) AS signature FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def signature(spark, d):
    """What a workflow consists of, as sorted kinds and counts."""
    n = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit(":"), x["n"].cast("string")))
    return n.groupBy("user_id").agg(F.array_join(parts, "|").alias("signature"))


@query("file_size", """WITH f AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * l_orderkey * (l_linenumber - 1) * 1000 AS BIGINT) AS size FROM lineitem), u AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 WHEN size < 1099511627776 THEN 3 ELSE 4 END AS unit FROM f)
SELECT l_orderkey, l_linenumber, CASE WHEN size = 0 THEN '0B' ELSE regexp_replace(printf('%.2f', round(size::DOUBLE / pow(1024::DOUBLE, unit), 2)), '(\\.[0-9])0$', '\\1') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][unit + 1] END AS size FROM u""".replace("\\\\", "\\"))
def file_size(spark, d):
    size = (F.col("l_orderkey") * F.col("l_orderkey") * (F.col("l_linenumber") - 1) * 1000).cast("long")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ident.human_size(size).alias("size"))


@query("branches", f"""WITH {TREE_SQL}, up AS (SELECT c.id, c.parent, p.tag AS above, row_number() OVER (PARTITION BY c.parent ORDER BY c.place) AS nth FROM tree c JOIN tree p ON c.parent = p.id)
SELECT id AS dst, CASE WHEN above = 'Customer' AND nth > 1 THEN 'seq-next' WHEN above = 'Region' THEN CASE nth WHEN 1 THEN 'branch-then' ELSE 'branch-else' END WHEN above = 'Nation' THEN 'loop-enter' ELSE 'contains' END AS kind FROM up
UNION ALL SELECT parent, 'loop-back' FROM up WHERE above = 'Nation'""")
def branches(spark, d):
    """Control flow where regions are conditions, nations loops and customers sequences."""
    as_tag = F.create_map(*[F.lit(x) for x in ("Region", "If", "Nation", "ForEach", "Customer", "Sequence", "Order", "Assign")])
    nodes = tree(spark, d).select(F.lit("all").alias("path"), "id", "parent", F.col("place").alias("lft"), as_tag[F.col("tag")].alias("tag"))
    return trees.control_flow(nodes, ["path"]).select("dst", "kind")


# Packages and calls


@query("namespace_package", r"""SELECT ns, CASE WHEN starts_with(ns, 'clr-namespace:System') THEN NULL WHEN regexp_matches(ns, 'schemas\.uipath\.com/workflow/activities') THEN 'UiPath.System.Activities'
    WHEN regexp_matches(ns, 'clr-namespace:UiPath\.([^;]+)(?:;assembly=([^;]+))?') THEN regexp_replace(ns, 'clr-namespace:UiPath\.([^;]+)(?:;assembly=([^;]+))?', 'UiPath.\1', 'g')
    WHEN regexp_matches(ns, 'clr-namespace:.*Activities;assembly=([^;]+)') THEN regexp_replace(ns, 'clr-namespace:.*Activities;assembly=([^;]+)', '\1', 'g') END AS package
FROM (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'clr-namespace:System.' || p_brand WHEN 1 THEN 'http://schemas.uipath.com/workflow/activities' WHEN 2 THEN 'clr-namespace:UiPath.' || replace(p_type, ' ', '.') || ';assembly=UiPath.' || p_brand
    WHEN 3 THEN 'clr-namespace:' || p_brand || 'Activities;assembly=' || replace(p_type, ' ', '.') ELSE 'clr-namespace:' || p_brand || ';assembly=' || p_brand END AS ns FROM part)""")
def namespace_package(spark, d):
    dotted = F.replace("p_type", F.lit(" "), F.lit("."))
    ns = (
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("clr-namespace:System."), "p_brand")).when(F.col("p_size") % 5 == 1, "http://schemas.uipath.com/workflow/activities")
        .when(F.col("p_size") % 5 == 2, F.concat(F.lit("clr-namespace:UiPath."), dotted, F.lit(";assembly=UiPath."), "p_brand"))
        .when(F.col("p_size") % 5 == 3, F.concat(F.lit("clr-namespace:"), "p_brand", F.lit("Activities;assembly="), dotted)).otherwise(F.concat(F.lit("clr-namespace:"), "p_brand", F.lit(";assembly="), "p_brand"))
    )
    return t(spark, d, "part").select(ns.alias("ns")).distinct().select("ns", expressions.namespace_package(F.col("ns")).alias("package"))


CLASS_SQL = r"""name AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'UiPath.' || p_brand WHEN 1 THEN replace(p_brand, 'Brand#', 'LuckyBrand') WHEN 2 THEN 'Lucky' || CASE WHEN p_brand < 'Brand#30' THEN 'Lead' ELSE 'Tin' END ELSE lower(p_type) END AS name FROM part),
classified AS (SELECT name, CASE WHEN regexp_matches(name, '^(UiPath|Microsoft|System|Newtonsoft)\.') THEN 'vendor_official' WHEN regexp_matches(name, '^[A-Z][a-zA-Z]*[A-Z][a-zA-Z]*$|^[A-Z][a-z]+[A-Z][a-z]+') THEN CASE WHEN name = 'LuckyLead' THEN 'custom_local' ELSE 'ambiguous' END ELSE 'ambiguous' END AS class,
    CASE WHEN regexp_matches(name, '^(UiPath|Microsoft|System|Newtonsoft)\.') THEN 0.95 WHEN regexp_matches(name, '^[A-Z][a-zA-Z]*[A-Z][a-zA-Z]*$|^[A-Z][a-z]+[A-Z][a-z]+') THEN CASE WHEN name = 'LuckyLead' THEN 0.7 ELSE 0.4 END ELSE 0.2 END::DOUBLE AS confidence FROM name)"""


@query("package_class", f"WITH {CLASS_SQL} SELECT name, class, confidence FROM classified")
def package_class(spark, d):
    brand = F.col("p_brand")
    name = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("UiPath."), brand)).when(F.col("p_size") % 4 == 1, F.replace(brand, F.lit("Brand#"), F.lit("LuckyBrand")))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("Lucky"), F.when(brand < "Brand#30", "Lead").otherwise("Tin"))).otherwise(F.lower("p_type"))
    )
    none = F.lit(None)
    found = t(spark, d, "part").select(name.alias("name")).distinct().withColumn("c", expressions.classified(F.col("name"), none.cast("string"), none.cast("double"), F.col("name") == "LuckyLead"))
    return found.select("name", "c.class", "c.confidence")


@query("package_class_summary", f"WITH {CLASS_SQL} SELECT class, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8) AS sure, count(*) FILTER (WHERE class = 'ambiguous') AS to_ask FROM classified GROUP BY class")
def package_class_summary(spark, d):
    return package_class(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("sure"), F.count_if(F.col("class") == "ambiguous").alias("to_ask"))


@query("call_kind", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR text = '' THEN 'invoke-missing' WHEN (starts_with(text, '[') AND ends_with(text, ']') AND length(text) > 2) OR contains(text, '.ToString()') OR contains(text, 'Path.Combine(')
OR contains(text, 'String.Format(') OR contains(text, 'new ') OR contains(text, ' = ') THEN 'invoke-dynamic' ELSE 'invoke' END AS kind FROM documents) GROUP BY kind""")
def call_kind(spark, d):
    return t(spark, d, "documents").groupBy(expressions.call_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))
