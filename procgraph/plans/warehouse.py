"""From a project folder to the tables of a warehouse, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.operators import graph, relate
from procgraph.sources import projects


def parse(spark: SparkSession, root: str, bay: str) -> dict[str, DataFrame]:
    """All tables of one project, lazily: projects, workflows, nodes, activities, invocations and coded."""
    found = projects.files(spark, root)
    catalog, nodes = projects.workflows(found, bay), projects.xml_nodes(found)
    return {
        "projects": projects.projects(found), "workflows": catalog, "nodes": nodes, "activities": projects.activities(nodes),
        "invocations": projects.invocations(nodes, catalog), "coded": projects.coded(found),
    }


def write(tables: dict[str, DataFrame], warehouse: str, bay: str) -> None:
    """Each table below warehouse/<table>/bay_id=<bay>, replacing that bay's part alone."""
    for name, df in tables.items():
        df.drop("bay_id").write.mode("overwrite").parquet(f"{warehouse}/{name}/bay_id={bay}")


def load(spark: SparkSession, warehouse: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{warehouse}/{table}")


def call_graph(invocations: DataFrame, entry_ids: DataFrame) -> DataFrame:
    """(node, depth) of resolved calls from the entries; depth is null for orphans."""
    edges = invocations.where("dst is not null").select("src", "dst")
    every = graph.nodes_of(edges).unionByName(entry_ids.select("node")).distinct()
    return every.join(graph.call_depth(edges, entry_ids), "node", "left")


def bays(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index of bays after an update: the latest row of each id."""
    return relate.upsert(old, new, "bay_id", "updated")


def summary(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files, those that parse, and the success rate (1 without files)."""
    failed = nodes.where("error is not null").select("path").distinct()
    marked = workflows.join(failed.withColumn("failed", F.lit(1)), "path", "left")
    return marked.agg(F.count("*").alias("workflows"), F.count("failed").alias("failed"), F.coalesce(1 - F.count("failed") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("success_rate"))
