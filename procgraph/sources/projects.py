"""Project folders as DataFrames: metadata, workflow catalog, XML nodes with visual ids, coded workflows and calls."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.functions import csharp, expressions, ident

EXCLUDED = (".local/**", ".settings/**", ".screenshots/**", "TestResults/**")
PROJECT = "name STRING, main STRING, schemaVersion STRING, projectId STRING, description STRING, projectVersion STRING, targetFramework STRING, expressionLanguage STRING, dependencies MAP<STRING, STRING>, entryPoints ARRAY<STRUCT<filePath STRING, uniqueId STRING>>, designOptions STRUCT<outputType STRING>, _corrupt STRING"
NODES = "path string, lft int, rgt int, depth int, parent int, tag string, display_name string, attributes map<string,string>, annotation string, text string, is_visual boolean, node_id string, visual_parent string, error string, above string"
#: The attribute that holds a note on its element.
ANNOTATION = "Annotation.AnnotationText"
# Parts of the names of coded files that hold no workflow.
NO_WORKFLOW = ("assemblyinfo", "globalusings", "program.cs", "startup.cs")
# Tags that are metadata or structure and show no activity of their own, and those that count without a display name.
HIDDEN = (
    "Members", "HintSize", "Property", "TypeArguments", "WorkflowFileInfo",
    "Annotation", "ViewState", "Collection", "Dictionary", "ActivityAction",
    "Variables", "Arguments", "Imports", "NamespacesForImplementation",
    "ReferencesForImplementation", "TextExpression", "VisualBasic",
    "WorkflowViewState", "WorkflowViewStateService", "Ignorable",
    "Then", "Else", "Catches", "Catch", "Finally", "States", "Transitions",
    "Body", "Handler", "Condition", "Default",
)
ALWAYS_SHOWN = ("Sequence", "TryCatch", "Flowchart", "Parallel", "StateMachine")


def files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root: path relative to it, size, time and content (read only if used)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(ident.posix(F.col("path")), "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    return found.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a path matches a glob whose * crosses slashes."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike("^" + fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$"))
    return out


def projects(found: DataFrame) -> DataFrame:
    """One row per project.json with its fields and error (null, "invalid JSON" or "missing fields")."""
    text = F.decode("content", "UTF-8")
    parsed = found.where("path = 'project.json' or path like '%/project.json'").select(
        "path", F.from_json(text, PROJECT, {"columnNameOfCorruptRecord": "_corrupt"}).alias("p")
    )
    error = F.when(F.col("p._corrupt").isNotNull(), "invalid JSON").when(F.col("p.name").isNull() | F.col("p.main").isNull() | F.col("p.schemaVersion").isNull(), "missing fields")
    kind = F.when(F.lower("p.designOptions.outputType") == "library", "library").otherwise("process")
    return parsed.select("path", "p.*", error.alias("error"), kind.alias("project_type")).drop("_corrupt")


def workflows(found: DataFrame, bay: str, patterns: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """The catalog of .xaml files (any spelling) and coded workflows that no pattern excludes."""
    name = F.element_at(F.split("path", "/"), -1)
    xaml, code = F.lower("path").endswith(".xaml"), F.lower("path").endswith(".cs") & ~expressions.contains_any(F.lower(name), NO_WORKFLOW)
    kept = found.where((xaml | code) & ~excluded(F.col("path"), patterns))
    content_hash = F.sha2("content", 256)
    return kept.select(
        ident.composite_id(F.lit(bay), ident.workflow_id(F.col("path")), content_hash).alias("id"), F.lit(bay).alias("bay_id"),
        ident.workflow_id(F.col("path")).alias("workflow_id"), "path", name.alias("file_name"), content_hash.alias("content_hash"), "size", "modified",
        F.when(xaml, "xaml").otherwise("coded").alias("kind"),
    )


def xml_nodes(found: DataFrame) -> DataFrame:
    """Every element of every .xaml file in document order, with nested-set places; a file that fails gives one row with error.

    A visual element has node_id, `/A/B/Tag[n]`: the tags on the way from the root, then its own with its place among the
    visual elements of that tag under the same parent; visual_parent is the node_id of the nearest visual ancestor of any element.
    Its display name is `<tag>` where it has none, its note is in annotation, and above has the tags on the way to it. Declarations of types and entities are refused.
    """

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def flat(path: str, content: bytes) -> list[tuple]:
        try:
            text = content.decode("utf-8-sig", errors="replace")
            if "<!DOCTYPE" in text or "<!ENTITY" in text:
                raise ValueError("declarations are not allowed")
            root = ElementTree.fromstring(text)
        except (ElementTree.ParseError, ValueError) as e:
            return [(path, *[None] * 12, str(e), None)]
        rows, count, seen = [], 0, {}
        stack: list[tuple] = [(root, 0, None, "", None, None)]
        while stack:
            element, depth, parent, above, visual, row = stack.pop()
            if row is not None:  # all below is done
                row[2] = count
                count += 1
                continue
            attributes = {local(k): v for k, v in element.attrib.items()}
            tag, note = local(element.tag), attributes.pop(ANNOTATION, None)
            shown, own = tag not in HIDDEN and ("DisplayName" in attributes or tag in ALWAYS_SHOWN), None
            if shown:
                nth = seen[parent, tag] = seen.get((parent, tag), -1) + 1
                own = f"{above}/{tag}[{nth}]"
            row = [path, count, None, depth, parent, tag, attributes.get("DisplayName", f"<{tag}>"), attributes, note, (element.text or "").strip() or None, shown, own, visual, None, above]
            rows.append(row)
            stack.append((element, depth, parent, above, visual, row))
            stack += [(child, depth + 1, count, f"{above}/{tag}" if above else tag, own or visual, None) for child in reversed(list(element))]
            count += 1
        return [tuple(r) for r in rows]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in NODES.split(", ")]
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in flat(p, c)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("lft", "rgt", "depth", "parent")})

    return found.where(F.lower("path").endswith(".xaml")).select("path", "content").mapInPandas(run, NODES)


def activities(nodes: DataFrame) -> DataFrame:
    """Visual nodes: not hidden, and named or of a kind that is always shown."""
    return nodes.where("is_visual")


def invocations(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(src, target, kind, dst, lft, activity, unresolved): calls of other workflows, those built at run time too (without lft and dst).

    Kinds are invoke, invoke-missing, invoke-dynamic and invoke-coded, as callgraph.resolved_calls has them; dst is a workflow id.
    """
    from procgraph.operators import callgraph, workflows

    raw = F.col("attributes")["WorkflowFileName"]
    calls = nodes.where("tag = 'InvokeWorkflowFile' and error is null").where(F.length(raw) > 0).select("path", raw.alias("raw"), "lft", F.col("attributes")["DisplayName"].alias("activity"))
    known = catalog.select(F.col("workflow_id").alias("id"), "path", F.col("path").alias("rank"))
    found = callgraph.resolved_calls(calls, known).select(ident.workflow_id(F.col("path")).alias("src"), "target", "kind", "dst", "lft", ident.posix(F.col("activity")).alias("activity"), "unresolved")
    made = workflows.dynamic_calls(workflows.texts(nodes))
    none = lambda kind: F.lit(None).cast(kind)
    made = made.select(ident.workflow_id(F.col("path")).alias("src"), "target", F.lit("invoke-dynamic").alias("kind"), none("string").alias("dst"), none("int").alias("lft"), "activity", F.concat(F.lit("dynamic:"), "target").alias("unresolved"))
    return found.unionByName(made)


def coded(found: DataFrame) -> DataFrame:
    """Usings, namespace, first class with its base, methods with their parameters, arguments and packages of coded workflows."""
    code = found.where(F.lower("path").endswith(".cs")).dropDuplicates(["path"]).select("path", F.decode("content", "UTF-8").alias("code"))
    read = code.select("path", "code", csharp.usings(F.col("code")).alias("usings"), csharp.methods(F.col("code")).alias("signatures"))
    part = lambda pattern, i: F.trim(F.regexp_extract("code", pattern, i))
    return read.select(
        "path", "usings", part(csharp.NAMESPACE, 1).alias("namespace"), part(csharp.CLASS, 1).alias("class_name"), part(csharp.CLASS, 2).alias("base_class"), F.col("signatures.name").alias("methods"),
        "signatures", csharp.arguments(F.col("signatures")).alias("arguments"), csharp.packages(F.col("usings"), F.col("code")).alias("packages"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Artifact lines; comments (#), blank and malformed ones are passed over."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt is null").select("r.*").drop("_corrupt")
