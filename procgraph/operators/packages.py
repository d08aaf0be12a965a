"""The package that an activity comes from: a catalog of known ones, versions from a project's dependencies, and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Packages, their assemblies and the activities they are known for.
CATALOG = (
    ("UiPath.System.Activities", "UiPath.Core.Activities.dll", (
        "Assign", "InvokeWorkflowFile", "Sequence", "If", "TryCatch", "Parallel", "Pick", "Switch", "ForEach", "While", "DoWhile",
    )),
    ("UiPath.System.Activities", "UiPath.System.Activities.dll", (
        "LogMessage", "WriteLine", "MessageBox", "Delay", "TerminateWorkflow",
        "ReadTextFile", "WriteTextFile", "FileExists", "DirectoryExists", "CreateDirectory", "DeleteFile", "CopyFile", "MoveFile",
        "DeserializeJson", "SerializeJson", "BuildDataTable", "AddDataRow", "GetRowItem", "HttpClient", "HttpRequest",
    )),
    ("UiPath.UIAutomation.Activities", "UiPath.UIAutomation.Activities.dll", (
        "Click", "Type", "GetText", "GetAttribute", "FindElement", "WaitElement", "ElementExists", "HighlightElement",
    )),
    ("UiPath.Excel.Activities", "UiPath.Excel.Activities.dll", (
        "ExcelReadRange", "ExcelWriteRange", "ExcelOpenWorkbook", "ExcelCloseWorkbook", "ExcelCreatePivotTable",
    )),
    ("UiPath.Mail.Activities", "UiPath.Mail.Activities.dll", ("SendOutlookMail", "GetOutlookMail", "SendMail", "GetMail")),
)
#: Letters of a house's own package that begin the names of its activities.
PREFIX = 5


def catalog(spark: SparkSession) -> DataFrame:
    """(type, package, assembly) of the activities known."""
    return spark.createDataFrame([(a, package, assembly) for package, assembly, names in CATALOG for a in names], "type string, package string, assembly string")


def resolved(activities: DataFrame, dependencies: DataFrame, bay: list[str], known: DataFrame | None = None) -> DataFrame:
    """(bay, type, package, version, class, assembly, found) of the distinct types of activities(bay, type).

    dependencies has (bay, name, version, class, rank); of several of one name the smallest rank counts. found says how a package was found, by the first that holds:
    - catalog: a type of the catalog; its version and class are the dependency's, else the vendor's packages are vendor_official and others third_party;
    - namespace: all but the last of the type's dotted parts are a dependency;
    - prefix: a custom_local dependency whose name, without dots and in lower case, is in the type's, or whose first five letters begin it; the smallest rank.
    Other types have nulls. All three are equi-joins: the last meets on pieces of at most five letters and then compares whole names, so it works
    alike with any number of dependencies. A dependency whose name has no letters besides dots is in no type.
    """
    spark = activities.sparkSession
    types = activities.select(*bay, "type").where("type is not null").distinct()
    first = dependencies.groupBy(*bay, "name").agg(F.min_by(F.struct("version", "class"), "rank").alias("dep"))
    listed = types.join(F.broadcast(known if known is not None else catalog(spark)), "type", "left")  # the catalog: 48 rows
    namespace = F.when(F.instr("type", ".") > 0, F.regexp_replace("type", r"\.[^.]*$", ""))
    named = listed.withColumn("name", F.coalesce("package", namespace)).join(first, [*bay, "name"], "left")
    own = dependencies.where("class = 'custom_local'").select(*bay, "name", "rank", F.lower(F.replace("name", F.lit("."), F.lit(""))).alias("base")).where("base <> ''")
    own = own.withColumn("piece", F.left("base", F.lit(PREFIX)))
    rest = named.where("package is null and dep is null").select(*bay, "type", F.lower("type").alias("small"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("small"), F.lit(1)))).alias("at")
    pieces = rest.select("*", at).select("*", F.explode(F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda n: F.substring(F.col("small"), F.col("at"), n))).alias("piece")).distinct()
    hit = pieces.join(own, [*bay, "piece"]).where((F.col("at") == 1) | F.contains("small", F.col("base")))
    hit = hit.groupBy(*bay, "type").agg(F.min(F.struct("rank", "name")).alias("hit")).select(*bay, "type", F.col("hit.name").alias("own"))
    out = named.join(hit, [*bay, "type"], "left").join(first.select(*bay, F.col("name").alias("own"), F.col("dep").alias("own_dep")), [*bay, "own"], "left")
    by_name = F.col("package").isNull() & F.col("dep").isNotNull()
    class_ = F.when(F.col("package").isNotNull(), F.coalesce("dep.class", F.when(F.col("package").startswith("UiPath."), "vendor_official").otherwise("third_party"))).otherwise(F.coalesce("dep.class", "own_dep.class"))
    package = F.coalesce("package", F.when(by_name, F.col("name")), "own")
    found = F.when(F.col("package").isNotNull(), "catalog").when(by_name, "namespace").when(F.col("own").isNotNull(), "prefix")
    assembly = F.coalesce("assembly", F.concat(package, F.lit(".dll")))
    return out.select(*bay, "type", package.alias("__package"), F.coalesce("dep.version", "own_dep.version").alias("version"), class_.alias("class"), assembly.alias("assembly"), found.alias("found")).withColumnRenamed("__package", "package")


def activities_of(package: str, spark: SparkSession) -> DataFrame:
    """(type) of the activities that the catalog has for a package, in order."""
    return catalog(spark).where(F.col("package") == package).select("type").orderBy("type")


def all_packages(dependencies: DataFrame) -> DataFrame:
    """(package) of the catalog, and the dependencies of a house's own or of third parties."""
    more = dependencies.where("class in ('custom_local', 'third_party')").select(F.col("name").alias("package"))
    return catalog(dependencies.sparkSession).select("package").unionByName(more).distinct()


def collection(activities: DataFrame, packages: DataFrame, bay: list[str]) -> DataFrame:
    """Statistics of the activities (bay, id, type, depth, is_container, place) of each bay, by type, by package and whole, in one pass of grouping sets.

    Rows (bay, set, key, n, max_depth, root_container): set is "type", "package" ("unknown" without one) or "all"; the row of all has the deepest
    level and the first container, in order of place, at level 1.
    """
    joined = activities.join(packages.select(*bay, "type", "package"), [*bay, "type"], "left").withColumn("package", F.coalesce("package", F.lit("unknown")))
    at_root = F.min(F.when(F.col("is_container") & (F.col("depth") == 1), F.struct("place", "id"))).alias("root")
    keys = [F.col(c) for c in bay]
    sets = joined.groupingSets([[*keys, F.col("type")], [*keys, F.col("package")], keys], *keys, F.col("type"), F.col("package"))
    out = sets.agg(F.grouping("type").alias("no_type"), F.grouping("package").alias("no_package"), F.count("*").alias("n"), F.max("depth").cast("long").alias("deepest"), at_root)
    kind = F.when(F.col("no_type") == 0, "type").when(F.col("no_package") == 0, "package").otherwise("all")
    whole = kind == "all"
    return out.select(*bay, kind.alias("set"), F.coalesce("type", "package").alias("key"), "n", F.when(whole, F.col("deepest")).alias("max_depth"), F.when(whole, F.col("root.id")).alias("root_container"))
