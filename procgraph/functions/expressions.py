"""Predicates over expression text and the classes drawn from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments that mark an expression in either language, and in C# alone.
SHARED_MARKS = (".ToString()", "Path.Combine(", "String.Format(", "new ", " = ")
CSHARP_MARKS = ("??", "?.", "=>")


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | text.contains(mark)
    return out


def is_expression(text: Column, language: str = "VisualBasic") -> Column:
    bracketed = text.startswith("[") & text.endswith("]") & (F.length(text) > 2)
    shared = contains_any(text, SHARED_MARKS)
    if language == "VisualBasic":
        return bracketed | shared
    ternary = text.contains(" ? ") & text.contains(" : ")
    return (text.startswith("{") & text.endswith("}")) | contains_any(text, CSHARP_MARKS) | ternary | shared


def call_kind(target: Column) -> Column:
    """invoke-missing without a target, invoke-dynamic for an expression (in brackets or with a mark of one), else invoke."""
    return F.when(target.isNull() | (target == ""), "invoke-missing").when(is_expression(target), "invoke-dynamic").otherwise("invoke")


# Beginnings of namespaces of the platform itself, and, in this order, what package other namespaces name.
PLATFORM_NAMESPACES = (
    "http://schemas.microsoft.com/winfx/2006/xaml",
    "http://schemas.microsoft.com/netfx/2009/xaml/activities",
    "http://schemas.microsoft.com/winfx/2006/xaml/presentation",
    "http://schemas.openxmlformats.org/markup-compatibility/2006",
    "http://schemas.microsoft.com/netfx/2009/xaml/activities/presentation",
    "http://schemas.microsoft.com/netfx/2010/xaml/activities/presentation",
    "clr-namespace:System",
    "clr-namespace:System.Activities",
    "clr-namespace:System.Collections",
    "clr-namespace:System.Collections.Generic",
    "clr-namespace:Microsoft.VisualBasic",
)
NAMESPACE_PACKAGES = (
    (r"http://schemas\.uipath\.com/workflow/activities", "UiPath.System.Activities"),
    (r"clr-namespace:UiPath\.([^;]+)(?:;assembly=([^;]+))?", "UiPath.$1"),
    (r"clr-namespace:.*\.Activities(?:\.([^;]+))?;assembly=UiPath\.([^;]+)\.Activities", "UiPath.$2.Activities"),
    (r"clr-namespace:.*Activities;assembly=([^;]+)", "$1"),
)
# Names of official packages, names that look like a house's own, and how sure each class is.
OFFICIAL = (r"^UiPath\..*$", r"^Microsoft\..*$", r"^System\..*$", r"^Newtonsoft\..*$")
HOUSE = (r"^[A-Z][a-zA-Z]*[A-Z][a-zA-Z]*$", r"^[A-Z][a-z]+[A-Z][a-z]+.*$")
CONFIDENCE = {"told": 1.0, "official": 0.95, "found": 0.7, "house": 0.4, "unknown": 0.2}


def namespace_package(namespace: Column) -> Column:
    """The package of a namespace: null for the platform's own; else the first rewrite that matches, else the dotted
    assembly of a namespace of the vendor."""
    platform = F.lit(False)
    for prefix in PLATFORM_NAMESPACES:
        platform = platform | namespace.startswith(prefix)
    assembly = F.regexp_extract(namespace, "assembly=([^;]+)", 1)
    out = F.when(platform, F.lit(None).cast("string"))
    for pattern, package in NAMESPACE_PACKAGES:
        out = out.when(namespace.rlike(pattern), F.regexp_replace(namespace, pattern, package) if "$" in package else F.lit(package))
    return out.when(namespace.contains("clr-namespace:") & namespace.contains("UiPath") & assembly.contains("."), assembly)


def namespaces_of(text: Column) -> Column:
    """map<prefix, namespace> of all xmlns declarations of a text; "default" without a prefix, the last one wins."""
    pattern = r'xmlns(?::([^=]+))?="([^"]+)"'
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("n"))
    named = F.transform(pairs, lambda x: F.struct(F.when(x["p"] == "", "default").otherwise(x["p"]).alias("k"), x["n"].alias("v")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def classified(name: Column, told: Column, told_confidence: Column, is_local: Column) -> Column:
    """struct<class, confidence>: what the user told, else official by its name, else of the house if it looks so and lies there, else ambiguous."""
    like = lambda patterns: name.rlike("|".join(f"(?:{p})" for p in patterns))
    pick = lambda kind, sure: F.struct(kind.alias("class"), sure.alias("confidence"))
    of = lambda kind, key: pick(F.lit(kind), F.lit(CONFIDENCE[key]))
    return (
        F.when(told.isNotNull(), pick(told, F.coalesce(told_confidence, F.lit(CONFIDENCE["told"])))).when(like(OFFICIAL), of("vendor_official", "official"))
        .when(like(HOUSE), F.when(is_local, of("custom_local", "found")).otherwise(of("ambiguous", "house"))).otherwise(of("ambiguous", "unknown"))
    )


def resource_kind(name: Column, value: Column) -> Column:
    """file, url, selector, queue, dynamic or null, by the first rule that holds."""
    return (
        F.when(F.lower(value).rlike(r"\.(xaml|json|txt|csv|xlsx)$"), "file").when(value.startswith("http"), "url")
        .when(F.lower(name).contains("selector"), "selector").when(F.lower(name).contains("queue"), "queue")
        .when(value.contains("{") & value.contains("}"), "dynamic")
    )


def dependency_class(name: Column, vendor_prefix: str, local: Column) -> Column:
    """vendor, local, custom (two capitalised words or a dotted second part) or ambiguous."""
    return F.when(name.startswith(vendor_prefix), "vendor").when(local, "local").when(name.rlike(r"^[A-Z][a-z]+[A-Z][a-z]+"), "custom").otherwise("ambiguous")
