"""Signatures of C# text as column functions: usings, class, methods with their parameters, arguments, packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of declarations, and usings that are the platform's own.
USING = r"using\s+([^;]+);"
NAMESPACE = r"namespace\s+([^\s{;]+)"
CLASS = r"(?:public\s+)?class\s+(\w+)(?:\s*:\s*([^{]+))?"
METHOD = r"(?:public|private|protected|internal)?\s*(?:static\s+)?(?:async\s+)?(\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)\s*\{"
PLATFORM = ("System", "System.Collections.Generic", "System.Linq", "System.Threading.Tasks")
DIRECTIONS = {"out": "out", "ref": "in_out", "in": "in"}


def split_at_commas(text: Column) -> Column:
    """The parts of a text between commas outside of angle brackets; the last one is left out if it is empty.

    One fold over the characters that carries the depth of brackets and the parts so far.
    """
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(state, c):
        depth = state.depth + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        ends = (c == ",") & (state.depth == 0)
        last = F.concat(F.element_at(state.parts, -1), c)
        parts = F.when(ends, F.concat(state.parts, F.array(F.lit("")))).otherwise(F.concat(F.slice(state.parts, 1, F.size(state.parts) - 1), F.array(last)))
        return F.struct(depth.cast("int").alias("depth"), parts.alias("parts"))

    characters = F.filter(F.split(text, ""), lambda c: c != "")
    parts = F.aggregate(characters, start, step, lambda s: s.parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def parameter(text: Column) -> Column:
    """struct(name, type, direction, default) of one parameter, null where it has no type and name."""
    own = F.trim(text)
    word = F.regexp_extract(own, r"^(out|ref|in) ", 1)
    direction = F.coalesce(*[F.when(word == w, F.lit(d)) for w, d in DIRECTIONS.items()], F.lit("in"))
    bare = F.trim(F.regexp_replace(own, r"^(?:out|ref|in) ", ""))
    default = F.when(F.instr(bare, "=") > 0, F.trim(F.regexp_extract(bare, r"(?s)^[^=]*=(.*)$", 1)))
    tokens = F.filter(F.split(F.regexp_extract(bare, r"(?s)^([^=]*)", 1), r"\s+"), lambda x: x != "")
    kind = F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(1))), " ")
    return F.when(F.size(tokens) >= 2, F.struct(F.element_at(tokens, -1).alias("name"), kind.alias("type"), direction.alias("direction"), default.alias("default")))


def parameters(text: Column) -> Column:
    """The parameters of a list of them."""
    return F.filter(F.transform(split_at_commas(F.coalesce(text, F.lit(""))), parameter), lambda p: p.isNotNull())


def usings(code: Column) -> Column:
    return F.transform(F.regexp_extract_all(code, F.lit(USING), 1), F.trim)


def methods(code: Column) -> Column:
    """array of struct(name, return_type, parameters, is_execute) in order of their declaration."""
    of = lambda i: F.regexp_extract_all(code, F.lit(METHOD), i)
    rows = F.arrays_zip(of(2).alias("name"), of(1).alias("return_type"), of(3).alias("list"))
    return F.transform(rows, lambda m: F.struct(m["name"].alias("name"), m["return_type"].alias("return_type"), parameters(m["list"]).alias("parameters"), (F.lower(m["name"]) == "execute").alias("is_execute")))


def arguments(found: Column) -> Column:
    """The parameters that are a workflow's arguments: those of the first Execute, else of a constructor, else of the first method that has any."""
    first = lambda test: F.try_element_at(F.filter(found, test), F.lit(1))["parameters"]
    none = F.filter(F.flatten(F.transform(found, lambda m: m["parameters"])), lambda p: F.lit(False))
    return F.coalesce(first(lambda m: m["is_execute"]), first(lambda m: m["name"].isin("Constructor", "__init__")), first(lambda m: F.size(m["parameters"]) > 0), none)


def packages(found: Column, code: Column) -> Column:
    """The packages that usings and text speak of, in order."""
    vendor = F.transform(F.filter(found, lambda u: u.startswith("UiPath.")), lambda u: F.regexp_extract(u, r"^(UiPath\.[^.]*)", 1))
    own = F.when(F.exists(found, lambda u: u.isin(*PLATFORM)), F.array(F.lit("System"))).otherwise(F.array().cast("array<string>"))
    named = F.concat(F.regexp_extract_all(code, F.lit(r"UiPath\.(\w+)\."), 1), F.regexp_extract_all(code, F.lit(r"Activities\.(\w+)"), 1))
    return F.array_sort(F.array_distinct(F.concat(vendor, own, F.transform(named, lambda n: F.concat(F.lit("UiPath."), n)))))
