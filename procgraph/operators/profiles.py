"""What a project looks like as a whole: density, style, counts by severity, ids and entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs of 0, up to 3, up to 8, up to 20 and more activities, and of a bar's full and empty parts.
DENSITY = ("·", "░", "▒", "▓", "█")
BAR = ("█", "░")
SEVERITIES = ("info", "warning", "error", "critical")


def density(count: Column) -> Column:
    out = F.when(count == 0, DENSITY[0])
    for most, sign in zip((3, 8, 20), DENSITY[1:]):
        out = out.when(count <= most, sign)
    return out.otherwise(DENSITY[4])


def bar(ratio: Column, width: int = 10) -> Column:
    """A bar filled from the left by a ratio of 0 to 1; halves go to the even number."""
    filled = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)) * width).cast("int")
    return F.concat(F.repeat(F.lit(BAR[0]), filled), F.repeat(F.lit(BAR[1]), F.lit(width) - filled))


def style(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Four ratios of 0 to 1 for each project, from a row (invokes, selectors, tries, annotated, nodes, call_depth) for each workflow."""
    total = lambda c: F.sum(c).cast("double")
    invokes, selectors = total("invokes"), total("selectors")
    return metrics.groupBy(*keys).agg(
        F.coalesce(invokes / F.nullif(invokes + selectors, F.lit(0.0)), F.lit(0.5)).alias("orchestration"), F.least(F.lit(1.0), F.max("call_depth") / 8.0).alias("deep"),
        F.coalesce(total("annotated") / F.nullif(total("nodes"), F.lit(0.0)), F.lit(0.0)).alias("documented"), F.least(F.lit(1.0), total("tries") / F.count("*")).alias("defensive"),
    )


def error_counts(errors: DataFrame, severities: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """(severity, n) for every severity, those without errors too."""
    every = errors.sparkSession.createDataFrame([(s,) for s in severities], "severity string")
    return every.join(errors.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_bays(bays: DataFrame, hints: DataFrame) -> DataFrame:
    """hints(hint) with bay and matches: the bay of that id, else the one whose id has it as a part in any case; null where none or several have.

    Hints are what users type; bays that have a part of one are counted, not listed.
    """
    exact = hints.join(bays.select(F.col("bay").alias("hint"), F.col("bay").alias("exact")), "hint", "left")
    left = exact.where("exact is null").select("hint")
    part = bays.join(left, F.lower("bay").contains(F.lower("hint"))).groupBy("hint").agg(F.count("*").alias("n"), F.min("bay").alias("part"))
    found = exact.join(part, "hint", "left")
    return found.select("hint", F.coalesce("exact", F.when(F.col("n") == 1, F.col("part"))).alias("bay"), F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("matches"))


def entry_points(points: DataFrame, arguments: DataFrame, main: Column) -> DataFrame:
    """points(file_path) with is_main and how many arguments go in and out, by path, else by the file's name: arguments has (path, ins, outs)."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    by_path = arguments.select(F.col("path").alias("file_path"), F.struct("ins", "outs").alias("own"))
    by_name = arguments.groupBy(name("path").alias("file")).agg(F.min_by(F.struct("ins", "outs"), "path").alias("named"))
    found = points.withColumn("file", name("file_path")).join(by_path, "file_path", "left").join(by_name, "file", "left")
    count = lambda c: F.coalesce(f"own.{c}", f"named.{c}", F.lit(0)).alias(c)
    return found.select("file_path", (F.col("file_path") == main).alias("is_main"), count("ins"), count("outs"))


def local_packages(names: DataFrame, projects: DataFrame) -> DataFrame:
    """names(name) with the directories of projects(directory) that hold such a package: their name with dots for blanks."""
    kept = projects.groupBy(F.replace("directory", F.lit(" "), F.lit(".")).alias("name")).agg(F.array_sort(F.collect_set("directory")).alias("directories"))
    return names.join(kept, "name", "left")
