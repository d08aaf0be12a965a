"""Projects, configurations and warehouses of places, found in the folders above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions import ident

# Files that make a folder a warehouse: any of the first two, or both others.
INDEXES = ("bays.json", "projects.json")
SINGLE = ("manifest.json", "workflows.index.json")
#: Folders below a place, or below the one above it, that may be its warehouse, in this order.
BELOW = (".procgraph-warehouse", ".procgraph-out", "output")
BESIDE = (".procgraph-warehouse", ".procgraph-out")


def folder_of(path: Column) -> Column:
    """The folder of a path, "" at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def folders_up(folder: Column) -> Column:
    """array<struct<distance, folder>>: a folder and all above it up to the top, nearest first."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("distance"), F.array_join(F.slice(parts, 1, F.size(parts) - i), "/").alias("folder")))


def nearest_above(places: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """places(folder) with the file (path) called `name`, in any case, in the nearest folder above (its own first) and its distance; nulls without one.

    The folders above each distinct place meet the folders that have such a file in one equi-join; what multiplies is the depth of
    folders, not their number. Of several spellings in one folder the first in order counts.
    """
    path = ident.posix(F.col("path"))
    holding = files.select(path.alias("path")).where(F.lower(F.element_at(F.split("path", "/"), -1)) == name.lower()).groupBy(folder_of(F.col("path")).alias("__at")).agg(F.min("path").alias("path"))
    ways = places.select("folder").distinct().select("folder", F.explode(folders_up(ident.posix(F.col("folder")))).alias("up")).select("folder", "up.distance", F.col("up.folder").alias("__at"))
    best = ways.join(holding, "__at").groupBy("folder").agg(F.min(F.struct("distance", "path")).alias("best"))
    return places.join(best, "folder", "left").select(*places.columns, F.col("best.path").alias("found"), F.col("best.distance").alias("distance"))


def project_folders(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths(path), a project file or a folder, with the folder of the project (null without one) and error."""
    path, marker = ident.posix(F.col("path")), "project.json"
    named = F.lower(F.element_at(F.split(path, "/"), -1)) == marker
    asked = paths.withColumns({"__named": named, "__folder": F.when(named, folder_of(path)).otherwise(F.regexp_replace(path, "/$", ""))})
    there = files.select(ident.posix(F.col("path")).alias("path")).where(F.lower(F.element_at(F.split("path", "/"), -1)) == marker).select(folder_of(F.col("path")).alias("__folder"), F.lit(True).alias("__there")).distinct()
    error = F.when(F.col("__there").isNull(), F.when(F.col("__named"), F.concat(F.lit("Project file not found: "), "path")).otherwise(F.concat(F.lit("No project.json found in directory: "), "path")))
    return asked.join(there, "__folder", "left").select(*paths.columns, F.when(F.col("__there"), F.col("__folder")).alias("folder"), error.alias("error"))


def warehouses(files: DataFrame) -> DataFrame:
    """(folder, several): the folders that are warehouses, of several bays (an index) or of one."""
    rows = files.select(folder_of(ident.posix(F.col("path"))).alias("folder"), F.element_at(F.split(ident.posix(F.col("path")), "/"), -1).alias("file"))
    marks = rows.where(F.col("file").isin(*INDEXES, *SINGLE)).groupBy("folder").agg(F.collect_set("file").alias("has"))  # four names at most
    several = F.arrays_overlap("has", F.array(*map(F.lit, INDEXES)))
    both = F.size(F.array_intersect("has", F.array(*map(F.lit, SINGLE)))) == len(SINGLE)
    return marks.where(several | both).select("folder", several.alias("several"))


def warehouse_of(places: DataFrame, files: DataFrame, below: tuple[str, ...] = BELOW, beside: tuple[str, ...] = BESIDE) -> DataFrame:
    """places(folder) with its warehouse: itself, else one of `below` in it, else one of `beside` in the folder above; null without one."""
    own = F.regexp_replace(ident.posix(F.col("folder")), "/$", "")
    at = lambda base, name: F.when(base == "", F.lit(name)).otherwise(F.concat(base, F.lit("/"), F.lit(name)))
    tried = [own, *[at(own, n) for n in below], *[at(folder_of(own), n) for n in beside]]
    ways = places.select("folder").distinct().select("folder", F.posexplode(F.array(*tried)).alias("n", "__at"))
    best = ways.join(warehouses(files).select(F.col("folder").alias("__at")), "__at").groupBy("folder").agg(F.min_by("__at", "n").alias("warehouse"))
    return places.join(best, "folder", "left")


def bays(indexes: DataFrame) -> DataFrame:
    """(folder, bay, place, row): the bays of index texts (folder, content), under whatever key older ones have them; a text that isn't JSON has none."""
    part = lambda key: F.from_json(F.get_json_object("content", f"$.{key}"), "array<string>")
    rows = indexes.select("folder", F.posexplode(F.coalesce(part("bays"), part("records"), part("projects"))).alias("place", "row"))
    name = F.coalesce(*[F.get_json_object("row", f"$.{k}") for k in ("bayId", "recordId", "projectSlug", "slug")], F.lit(""))
    return rows.select("folder", name.alias("bay"), "place", "row")
