"""More registered queries: expressions and variables of texts, ids and categories of activities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from procgraph.functions import activity_text
from procgraph.suite import query, t

# Events are texts of four forms: a format call with their properties as a literal, an assignment, a call outside of brackets, a message with a bracket in it


@query("activity_expressions", """WITH kind AS (SELECT event_id, event_id % 4 AS form, event_type AS name, 'user_' || user_id AS u, replace(props, '"', '""') AS p FROM events)
SELECT event_id, CASE form WHEN 0 THEN 'string.Format("[' || p || ' {0}]", ' || name || ', ' || u || '.Name)' WHEN 1 THEN '' WHEN 2 THEN 'Path.Combine(' || name || ', "a.b(c)", Trim(' || u || '))' ELSE name || '.Count > 0' END AS expressions,
    array_to_string(list_sort(CASE form WHEN 0 THEN [name, u] WHEN 1 THEN [u] WHEN 2 THEN ['Trim', name, u] ELSE [name] END), '|') AS variables FROM kind""")
def activity_expressions(spark, d):
    name, user, said = F.col("event_type"), F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.replace("props", F.lit('"'), F.lit('""'))
    form = F.col("event_id") % 4
    text = (
        F.when(form == 0, F.concat(F.lit('[string.Format("['), said, F.lit(' {0}]", '), name, F.lit(", "), user, F.lit(".Name)]")))
        .when(form == 1, F.concat(user, F.lit(" = "), name)).when(form == 2, F.concat(F.lit("Path.Combine("), name, F.lit(', "a.b(c)", Trim('), user, F.lit("))")))
        .otherwise(F.concat(F.lit("Click on ["), name, F.lit(".Count > 0] of "), user))
    )
    read = t(spark, d, "events").select("event_id", text.alias("text"))
    joined = lambda names: F.array_join(F.array_sort(names), "|")
    return read.select("event_id", joined(activity_text.expressions_of(F.col("text"))).alias("expressions"), joined(activity_text.variables_of(F.col("text"))).alias("variables"))


# Parts are activities of a brand's project in the workflow of their type; types are by size


@query("activity_ids", """SELECT p_partkey, p_brand || '#Flows/' || p_type || '#' || 'Activity/Sequence/' || type || '_' || p_partkey || '#' || substr(sha256(type || ':' || p_name), 1, 8) AS activity_id,
    CASE p_size % 6 WHEN 0 THEN 'ui_automation' WHEN 1 THEN 'flow_control' WHEN 2 THEN 'data_processing' WHEN 3 THEN 'system' WHEN 4 THEN 'exception_handling' ELSE 'other' END AS category
FROM (SELECT *, ['NClick', 'ForEach', 'Assign', 'LogMessage', 'Rethrow', 'CustomActivity'][p_size % 6 + 1] AS type FROM part)""")
def activity_ids(spark, d):
    types = F.array(*map(F.lit, ("NClick", "ForEach", "Assign", "LogMessage", "Rethrow", "CustomActivity")))
    part = t(spark, d, "part").withColumn("type", F.get(types, (F.col("p_size") % 6).cast("int")))
    node = F.concat(F.lit("Activity/Sequence/"), "type", F.lit("_"), F.col("p_partkey").cast("string"))
    made = activity_text.activity_id(F.col("p_brand"), F.concat(F.lit("Flows\\"), "p_type", F.lit(".xaml")), node, F.concat_ws(":", "type", "p_name"))
    return part.select("p_partkey", made.alias("activity_id"), activity_text.category(F.col("type")).alias("category"))
