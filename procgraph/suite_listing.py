"""Registered queries of listings and profiles on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from procgraph.functions import ident
from procgraph.operators import profiles, trees
from procgraph.suite import S_SQL, TREE_SQL, query, t, tree, versions

KINDS = ("major", "minor", "patch", "premajor", "preminor", "prepatch", "prerelease", "release")


@query("version_bump", f"""WITH {S_SQL}, p AS (SELECT p_partkey, split_part(v, '-', 1) AS core, regexp_extract(v, '-(.*)$', 1) AS pre,
    CAST(split_part(split_part(v, '-', 1), '.', 1) AS BIGINT) AS a, CAST(split_part(split_part(v, '-', 1), '.', 2) AS BIGINT) AS b, CAST(split_part(split_part(v, '-', 1), '.', 3) AS BIGINT) AS c FROM version)
SELECT p_partkey, CASE pre WHEN '' THEN (a + 1) || '.0.0' ELSE core END AS major, CASE pre WHEN '' THEN a || '.' || (b + 1) || '.0' ELSE core END AS minor, CASE pre WHEN '' THEN a || '.' || b || '.' || (c + 1) ELSE core END AS patch,
    (a + 1) || '.0.0-rc' AS premajor, a || '.' || (b + 1) || '.0-rc' AS preminor, a || '.' || b || '.' || (c + 1) || '-rc' AS prepatch,
    CASE WHEN pre = '' THEN a || '.' || b || '.' || (c + 1) || '-rc' WHEN pre = 'rc' THEN core || '-rc.1' ELSE core || '-rc.' || (CAST(substr(pre, 4) AS BIGINT) + 1) END AS prerelease, core AS release FROM p""")
def version_bump(spark, d):
    return versions(spark, d).select("p_partkey", *[ident.next_version(F.col("v"), k).alias(k) for k in KINDS])


@query("portrait_density", "SELECT c_custkey, CASE WHEN n = 0 THEN '·' WHEN n <= 3 THEN '░' WHEN n <= 8 THEN '▒' WHEN n <= 20 THEN '▓' ELSE '█' END AS density, repeat('█', filled) || repeat('░', 10 - filled) AS bar FROM (SELECT c_custkey, count(o_orderkey) AS n, CAST(round_even(least(1.0, count(o_orderkey) / 20.0::DOUBLE) * 10, 0) AS INT) AS filled FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def portrait_density(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    counted = t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.select("c_custkey", profiles.density(F.col("n")).alias("density"), profiles.bar(F.col("n") / 20.0).alias("bar"))


@query("style_ratios", """WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS invokes, count(*) FILTER (WHERE event_type = 'view') AS selectors, count(*) FILTER (WHERE event_type = 'error') AS tries,
    count(*) FILTER (WHERE value > 50) AS annotated, count(*) AS nodes, count(DISTINCT event_type) AS call_depth FROM events GROUP BY ALL)
SELECT user_id, round(coalesce(sum(invokes) / nullif(sum(invokes) + sum(selectors), 0)::DOUBLE, 0.5), 6) AS orchestration, round(least(1.0, max(call_depth) / 8.0::DOUBLE), 6) AS deep,
    round(sum(annotated) / sum(nodes)::DOUBLE, 6) AS documented, round(least(1.0, sum(tries) / count(*)::DOUBLE), 6) AS defensive FROM m GROUP BY user_id""")
def style_ratios(spark, d):
    n = lambda c: F.count_if(c)
    kind = F.col("event_type")
    daily = t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        n(kind == "click").alias("invokes"), n(kind == "view").alias("selectors"), n(kind == "error").alias("tries"), n(F.col("value") > 50).alias("annotated"), F.count("*").alias("nodes"), F.count_distinct(kind).alias("call_depth")
    )
    return profiles.style(daily, ["user_id"]).select("user_id", *[F.round(c, 6).alias(c) for c in ("orchestration", "deep", "documented", "defensive")])


@query("error_counts", "SELECT severity, count(event_id) AS n FROM (VALUES ('info'), ('warning'), ('error'), ('critical')) s(severity) LEFT JOIN events ON event_type = severity GROUP BY severity")
def error_counts(spark, d):
    return profiles.error_counts(t(spark, d, "events").select(F.col("event_type").alias("severity")))


@query("bay_resolve", """WITH hint AS (SELECT unnest(['FRANCE', 'united', 'saudi', 'nowhere']) AS hint), part AS (SELECT hint, count(*) AS n, min(n_name) AS bay FROM hint JOIN nation ON contains(lower(n_name), lower(hint)) GROUP BY hint)
SELECT h.hint, coalesce(e.n_name, CASE WHEN p.n = 1 THEN p.bay END) AS bay, CASE WHEN e.n_name IS NOT NULL THEN 1 ELSE coalesce(p.n, 0) END AS matches FROM hint h LEFT JOIN nation e ON e.n_name = h.hint LEFT JOIN part p ON p.hint = h.hint""")
def bay_resolve(spark, d):
    hints = spark.createDataFrame([(h,) for h in ("FRANCE", "united", "saudi", "nowhere")], "hint string")
    return profiles.resolve_bays(t(spark, d, "nation").select(F.col("n_name").alias("bay")), hints)


@query("flatten_tree", f"WITH RECURSIVE {TREE_SQL}, flat AS (SELECT id, name AS path FROM tree WHERE parent IS NULL UNION ALL SELECT tree.id, path || '.' || name FROM flat JOIN tree ON tree.parent = flat.id) SELECT id, path FROM flat")
def flatten_tree(spark, d):
    return trees.flatten(tree(spark, d).select("id", "parent", "name")).select("id", "path")


@query("entry_point_table", """WITH a AS (SELECT o_orderpriority || '/' || o_custkey AS path, count(*) FILTER (WHERE o_orderstatus = 'O') AS ins, count(*) FILTER (WHERE o_orderstatus <> 'O') AS outs FROM orders GROUP BY o_orderpriority, o_custkey),
p AS (SELECT '1-URGENT/' || c_custkey AS file_path, CAST(c_custkey AS VARCHAR) AS file FROM customer), n AS (SELECT split_part(path, '/', 2) AS file, min_by({'ins': ins, 'outs': outs}, path) AS named FROM a GROUP BY 1)
SELECT p.file_path, p.file_path = '1-URGENT/1' AS is_main, coalesce(a.ins, n.named.ins, 0) AS ins, coalesce(a.outs, n.named.outs, 0) AS outs FROM p LEFT JOIN a ON a.path = p.file_path LEFT JOIN n ON n.file = p.file""")
def entry_point_table(spark, d):
    open_ = F.col("o_orderstatus") == "O"
    o = t(spark, d, "orders").groupBy(F.concat_ws("/", "o_orderpriority", "o_custkey").alias("path")).agg(F.count_if(open_).alias("ins"), F.count_if(~open_).alias("outs"))
    points = t(spark, d, "customer").select(F.concat(F.lit("1-URGENT/"), F.col("c_custkey").cast("string")).alias("file_path"))
    return profiles.entry_points(points, o, F.lit("1-URGENT/1"))


@query("catalog_statistics", "SELECT count(*) AS workflows, count(*) FILTER (WHERE c_acctbal < 0) AS entry_points FROM customer")
def catalog_statistics(spark, d):
    return t(spark, d, "customer").agg(F.count("*").alias("workflows"), F.count_if(F.col("c_acctbal") < 0).alias("entry_points"))


@query("camel_case", "SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_type), ' ', '_'), '_'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), '') AS name FROM part")
def camel_case(spark, d):
    return t(spark, d, "part").select("p_partkey", ident.camel(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("name"))


@query("top_folders", "SELECT split_part(p_type, ' ', 1) AS folder, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, folder LIMIT 2")
def top_folders(spark, d):
    return t(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(2)


@query("pseudocode_text", "SELECT o_custkey, string_agg('- [' || o_orderpriority || '] Order', chr(10) ORDER BY o_orderkey) AS text, count(*) AS lines FROM orders GROUP BY o_custkey")
def pseudocode_text(spark, d):
    """The pseudocode of each workflow, a customer's orders, as one text."""
    line = trees.pseudocode(F.lit(0), F.col("o_orderpriority"), F.lit("Order"))
    parts = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("parts"))
    return parts.select("o_custkey", F.array_join("parts.line", "\n").alias("text"), F.size("parts").cast("long").alias("lines"))


@query("local_packages", "SELECT n.name, array_to_string(d.directories, ',') AS directories FROM (SELECT DISTINCT replace(p_type, ' ', '.') AS name FROM part UNION SELECT DISTINCT p_brand FROM part) n LEFT JOIN (SELECT replace(p_type, ' ', '.') AS name, list_sort(list(DISTINCT p_type)) AS directories FROM part GROUP BY 1) d USING (name)")
def local_packages(spark, d):
    part = t(spark, d, "part")
    names = part.select(F.replace("p_type", F.lit(" "), F.lit(".")).alias("name")).union(part.select("p_brand")).distinct()
    return profiles.local_packages(names, part.select(F.col("p_type").alias("directory")).distinct()).select("name", F.array_join("directories", ",").alias("directories"))


@query("id_maps", "SELECT p_name AS workflow, array_to_string(list_sort(list(p_brand || '#' || p_name || '#' || p_partkey)), ',') AS ids FROM part GROUP BY p_name")
def id_maps(spark, d):
    """All full ids of each workflow id."""
    full = F.concat_ws("#", "p_brand", "p_name", "p_partkey")
    return t(spark, d, "part").groupBy(F.col("p_name").alias("workflow")).agg(F.array_join(F.array_sort(F.collect_list(full)), ",").alias("ids"))


@query("container_branches", "SELECT l_suppkey AS parent, CASE l_returnflag WHEN 'A' THEN 'Then' WHEN 'R' THEN 'Else' ELSE 'Body' END AS branch, count(*) AS n FROM lineitem GROUP BY ALL")
def container_branches(spark, d):
    step = F.when(F.col("l_returnflag") == "A", "Then").when(F.col("l_returnflag") == "R", "Else").otherwise("Do")
    path = F.concat(F.lit("Activity/If[0]/"), step, F.lit("[1]/Catch"), F.lit("es[0]"))
    return trees.by_branch(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("parent"), path.alias("node_id")), [])
