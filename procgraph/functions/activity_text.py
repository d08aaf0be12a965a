"""What the text of an activity holds: expressions, variables, selectors, its category and its id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procgraph.functions import ident

# Repetitions are possessive, so that texts of any length are matched in a loop and none is scanned twice.
LITERAL = r'"[^"]*+(?:""[^"]*+)*+"'
#: A bracketed expression (brackets within string literals don't close it), and a call of a dotted name with one level of brackets inside.
BRACKETED = rf'\[((?:[^\[\]"]++|{LITERAL})++)\]'
CALL = rf'(?<![\w.])([A-Za-z_]\w*+(?:\.\w++)++\((?:[^()"]++|{LITERAL}|\((?:[^()"]++|{LITERAL})*+\))*+\))'
ASSIGNED = r"(?:^|[\s;(,])([A-Za-z_]\w*+)\s*+=(?:[^=>]|$)"
# Words of both languages and names of common types, which are no variables; in lower case.
NO_VARIABLES = (
    "if", "then", "else", "and", "or", "not", "andalso", "orelse", "xor", "mod", "like", "is", "isnot", "as", "of", "in",
    "new", "nothing", "null", "true", "false", "function", "sub", "from", "where", "select", "typeof", "gettype", "ctype", "directcast", "trycast",
    "cstr", "cint", "clng", "cdbl", "cdec", "cbool", "cdate", "string", "integer", "int", "int32", "int64", "long", "double", "decimal", "single",
    "boolean", "bool", "object", "char", "byte", "date", "datetime", "timespan", "guid", "path", "file", "directory", "convert", "math", "environment",
    "regex", "enumerable", "system", "microsoft", "array", "list", "dictionary", "exception", "datatable", "datarow", "console", "nameof",
)
# Types of activities by category.
CATEGORIES = {
    "ui_automation": ("NClick", "Click", "TypeText", "NTypeInto", "TypeInto", "GetFullText", "GetText", "NGetText", "WaitForReady", "NApplicationCard", "ElementExists"),
    "flow_control": ("Sequence", "If", "ForEach", "While", "DoWhile", "Switch", "Parallel", "ParallelForEach", "Flowchart", "StateMachine"),
    "data_processing": ("Assign", "MultipleAssign", "InvokeWorkflowFile", "InvokeCode", "BuildDataTable", "AddDataRow", "FilterDataTable"),
    "system": ("LogMessage", "WriteLine", "Delay", "KillProcess", "StartProcess"),
    "exception_handling": ("TryCatch", "Throw", "Rethrow", "RetryScope"),
}
#: Names, the last of a dotted one, that hold a selector: any with "Selector" in it, and these.
SELECTORS = ("TargetAnchorable",)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def expressions_of(text: Column) -> Column:
    """array<string>, in order, without repeats: what stands in brackets, then calls of dotted names outside of them; empty for null."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.transform(_all(text, BRACKETED), lambda e: F.trim(e)), _all(F.regexp_replace(text, BRACKETED, " "), CALL)))


def variables_in(expression: Column) -> Column:
    """array<string>: the first names of dotted chains of an expression, without literals, words of the language and types."""
    bare = F.regexp_replace(F.regexp_replace(expression, LITERAL, " "), r"\.\s*[A-Za-z_]\w*", "")
    return F.filter(_all(bare, r"\b([A-Za-z_]\w*)"), lambda name: ~F.lower(name).isin(*NO_VARIABLES))


def variables_of(text: Column) -> Column:
    """array<string> without repeats: variables of a text's expressions, and what it assigns to outside of brackets and literals; markup (a selector) assigns nothing."""
    told = F.when(text.isNull() | text.rlike(r"^\s*<"), "").otherwise(text)
    outside = F.regexp_replace(F.regexp_replace(told, BRACKETED, " "), LITERAL, " ")
    assigned = F.filter(_all(outside, ASSIGNED), lambda name: ~F.lower(name).isin(*NO_VARIABLES))
    return F.array_distinct(F.concat(F.flatten(F.transform(expressions_of(text), variables_in)), assigned))


def selectors_of(configuration: Column) -> Column:
    """The entries of map<dotted name, value> that hold a selector."""
    last = lambda key: F.element_at(F.split(key, r"\."), -1)
    return F.map_filter(configuration, lambda k, v: (last(k).contains("Selector") | last(k).isin(*SELECTORS)) & (F.length(v) > 0))


def category(activity_type: Column) -> Column:
    """The category of a type of activity, else other."""
    out = F.when(F.lit(False), "")
    for name, types in CATEGORIES.items():
        out = out.when(activity_type.isin(*types), name)
    return out.otherwise("other")


def activity_id(project: Column, path: Column, node: Column, content: Column) -> Column:
    """project#workflow#node#, then eight hexadecimal digits of the content's hash."""
    return F.concat_ws("#", project, ident.workflow_id(path), node, F.substring(F.sha2(content, 256), 1, 8))
