"""Expansion in reading order, witness cycles, containers by intervals, packages, the call graph and signatures, against fixtures and brute force."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from procgraph.functions import csharp
from procgraph.operators import callgraph, documents, graph, lookup, packages, pseudocode, rules, trees
from procgraph.sources import discovery

LINES = [
    ("main.xaml", 1, "Start Main", "LogMessage", "Main/Start", None), ("main.xaml", 2, "Call Process", "InvokeWorkflowFile", "Main/InvokeWorkflowFile", "process.xaml"), ("main.xaml", 3, "End Main", "LogMessage", "Main/End", None),
    ("process.xaml", 1, "Process Step 1", "Assign", "Process/Assign", None), ("process.xaml", 2, "Call Helper", "InvokeWorkflowFile", "", "helper.xaml"), ("helper.xaml", 1, "", "LogMessage", "Helper/Task", None),
    ("loop.xaml", 1, "Invoke Workflow File: it", "Other", None, "loop.xaml"), ("loop.xaml", 2, "Not a call", "Assign", None, "main.xaml"),
]
ACTIVITY = "workflow string, place long, name string, type string, path string, target string"


def texts(spark, rows, **options):
    table = spark.createDataFrame(rows, ACTIVITY)
    out = {}
    for r in pseudocode.numbered_lines(pseudocode.expanded(table, table.select("workflow"), **options)).orderBy("root", "n").collect():
        out.setdefault(r["root"], []).append(r["line"])
    return out


def test_expansion(spark):
    found = texts(spark, LINES)
    assert found["main.xaml"] == [
        "- [Start Main] LogMessage (ActivityPath: Main/Start)", "- [Call Process] InvokeWorkflowFile (ActivityPath: Main/InvokeWorkflowFile)", "  - [Process Step 1] Assign (ActivityPath: Process/Assign)", "  - [Call Helper] InvokeWorkflowFile",
        "    - LogMessage (ActivityPath: Helper/Task)", "- [End Main] LogMessage (ActivityPath: Main/End)",
    ]
    assert found["loop.xaml"] == ["- [Invoke Workflow File: it] Other", "  [CYCLE DETECTED: loop.xaml] (already expanded above)", "- [Not a call] Assign"]
    assert texts(spark, LINES, cycles="detect_and_stop")["loop.xaml"][1] == "  [CYCLE DETECTED: loop.xaml] (expansion stopped)"
    assert len(texts(spark, LINES, cycles="ignore")["loop.xaml"]) == 2
    assert texts(spark, LINES, max_depth=1)["main.xaml"][2] == "  [DEPTH LIMIT REACHED: process.xaml] (max depth: 1)"
    without = [r for r in LINES if r[0] != "helper.xaml"]
    assert texts(spark, without)["main.xaml"][4] == "    [MISSING WORKFLOW: helper.xaml] (pseudocode not found)"
    assert "MISSING" not in "".join(texts(spark, without, known=spark.createDataFrame([("helper.xaml",)], "workflow string"))["main.xaml"])
    assert texts(spark, []) == {}


def test_targets_from_calls(spark):
    rows = spark.createDataFrame([("a", "1", "A/InvokeWorkflowFile", None), ("a", "2", "A/Other", None), ("a", "3", "A/InvokeWorkflowFile", "own")], "workflow string, activity string, path string, target string")
    calls = spark.createDataFrame([("a", "1", "c"), ("a", "1", "b"), ("a", "2", "b"), ("a", "3", "b")], "workflow string, activity string, target string")
    assert {(r["activity"], r["target"]) for r in pseudocode.with_targets(rows, calls).collect()} == {("1", "b"), ("2", None), ("3", "own")}


def shortest(edges, start):
    """Length of the shortest circle through start."""
    level, seen, n = {start}, set(), 0
    while level:
        n += 1
        level = {b for a, b in edges if a in level} - seen
        if start in level:
            return n
        seen |= level


def test_witness_cycles(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]
    rng = random.Random(4)
    more = [(f"m{rng.randint(0, 11):02}", f"m{rng.randint(0, 11):02}") for _ in range(16)]
    edges = spark.createDataFrame([*ring, *more, ("self", "self"), ("n2", "out"), ("in", "n3"), (None, "x")], "src string, dst string")
    found = {tuple(r["cycle"]) for r in graph.witness_cycles(edges).collect()}
    plain = {e for e in [*ring, *more, ("self", "self")]}
    reach = {a: set() for e in plain for a in e}
    for a in reach:
        level = {a}
        while level := {y for x, y in plain if x in level} - reach[a]:
            reach[a] |= level
    groups = {min(b for b in reach if b in reach[a] and a in reach[b]) for a in reach if a in reach[a]}
    assert {c[0] for c in found} == groups and ("self",) in found and tuple(f"n{i}" for i in range(6)) in found
    for c in found:
        assert all(e in plain for e in zip(c, c[1:] + c[:1])) and len(c) == shortest(plain, c[0])
    issues = {(r["severity"], r["message"]) for r in rules.cycle_detection(edges).collect()}
    assert ("fail", "Cycle detected: n0 -> n1 -> n2 -> n3 -> n4 -> n5 -> n0") in issues and len(issues) == len(groups)
    assert {r["severity"] for r in rules.cycle_detection(edges, fail_on_cycles=False).collect()} == {"warn"}
    assert graph.witness_cycles(edges.where("src = 'in'")).count() == 0


def random_tree(rng, tree):
    rows, place = [], 0

    def grow(parent, depth):
        nonlocal place
        own, lft = f"{tree}-{len(rows)}", place
        rows.append(None)
        at, place = len(rows) - 1, place + 1
        for _ in range(rng.randint(0, 3) if depth < 7 and len(rows) < 80 else 0):
            grow(own, depth + 1)
        rows[at] = (tree, own, parent, lft, place, depth, rng.choice(["Sequence", "If", "Assign", "Other", "ForEach", "Comment"]), rng.random() < 0.7)
        place += 1

    grow(None, 0)
    return rows


def test_containers_of_random_trees(spark):
    rng = random.Random(7)
    rows = [r for i in range(25) for r in random_tree(rng, f"t{i}")]
    nodes = spark.createDataFrame(rows, "tree string, id string, parent string, lft int, rgt int, depth int, tag string, is_visual boolean")
    by_id = {r[1]: r for r in rows}
    holds = lambda i: by_id[i][6] in trees.CONTAINERS

    def above(i):
        while (i := by_id[i][2]) is not None:
            yield i

    nearest = {r["id"]: r["container"] for r in trees.enclosing(nodes, ["tree"], F.col("tag").isin(*trees.CONTAINERS)).collect()}
    assert nearest == {i: next((a for a in above(i) if holds(a)), None) for i in by_id}
    keep = lambda i: by_id[i][2] is None or by_id[i][6] in trees.ACTIVITY_TAGS
    walked = {r["id"] for r in trees.unpruned(nodes, ["tree"], trees.is_activity(F.col("tag"), F.lit(False))).collect()}
    assert walked == {i for i in by_id if keep(i) and all(keep(a) for a in above(i))}

    def inside(i):
        for r in rows:
            if r[2] == i:
                yield r
                if holds(r[1]):
                    yield from inside(r[1])

    got = {r["id"]: r for r in trees.container_statistics(nodes, ["tree"]).collect()}
    assert set(got) == {i for i in by_id if holds(i)}
    for i, r in got.items():
        found = list(inside(i))
        types = {}
        for x in found:
            types[x[6]] = types.get(x[6], 0) + 1
        assert (r["total_child_activities"], r["visual_activities"], r["activity_type_counts"]) == (len(found), sum(x[7] for x in found), types)
        assert r["max_depth"] == max([x[5] for x in found], default=by_id[i][5]) - by_id[i][5]


def test_packages(spark):
    names = [a for _, _, x in packages.CATALOG for a in x]
    assert len(names) == len(set(names)) == 48
    deps = spark.createDataFrame([
        ("p", "UiPath.System.Activities", "[23.10]", "vendor_official", 1), ("p", "Acme.Invoices", "1.0", "custom_local", 2), ("p", "Acme.Invoices", "9.9", "custom_local", 7), ("p", "Other.Lib", "2.0", "third_party", 3),
        ("p", "Inv", "3.0", "custom_local", 4), ("q", "Zeta", "1", "custom_local", 1),
    ], "bay string, name string, version string, class string, rank int")
    types = spark.createDataFrame([("p", x) for x in ("Assign", "Click", "Other.Lib.Do", "AcmeInvoicesRead", "acmeiOther", "DoInvThing", "Nothing", "No.Such.Thing", "Assign", None)] + [("q", "Assign")], "bay string, type string")
    got = {(r["bay"], r["type"]): (r["package"], r["version"], r["class"], r["assembly"], r["found"]) for r in packages.resolved(types, deps, ["bay"]).collect()}
    assert got == {
        ("p", "Assign"): ("UiPath.System.Activities", "[23.10]", "vendor_official", "UiPath.Core.Activities.dll", "catalog"),
        ("p", "Click"): ("UiPath.UIAutomation.Activities", None, "vendor_official", "UiPath.UIAutomation.Activities.dll", "catalog"),
        ("p", "Other.Lib.Do"): ("Other.Lib", "2.0", "third_party", "Other.Lib.dll", "namespace"),
        ("p", "AcmeInvoicesRead"): ("Acme.Invoices", "1.0", "custom_local", "Acme.Invoices.dll", "prefix"), ("p", "acmeiOther"): ("Acme.Invoices", "1.0", "custom_local", "Acme.Invoices.dll", "prefix"),
        ("p", "DoInvThing"): ("Inv", "3.0", "custom_local", "Inv.dll", "prefix"), ("p", "Nothing"): (None,) * 5, ("p", "No.Such.Thing"): (None,) * 5,
        ("q", "Assign"): ("UiPath.System.Activities", None, "vendor_official", "UiPath.Core.Activities.dll", "catalog"),
    }
    assert [r[0] for r in packages.activities_of("UiPath.Mail.Activities", spark).collect()] == ["GetMail", "GetOutlookMail", "SendMail", "SendOutlookMail"]
    assert {r[0] for r in packages.all_packages(deps).collect()} >= {"Other.Lib", "Zeta", "UiPath.Excel.Activities"}


@pytest.fixture(scope="module")
def model(spark):
    catalog = spark.createDataFrame([("main.xaml", "Main.xaml", 1), ("processes/process.xaml", "Processes/Process.xaml", 2), ("common/helper.xaml", "Common/Helper.xaml", 3)], "id string, path string, rank int")
    calls = spark.createDataFrame([
        ("bay#main.xaml#hash", "Processes\\Process.xaml", "invoke"), ("processes/process.xaml", "Common/Helper.xaml", "invoke"), ("processes/process.xaml", "Missing.xaml", "invoke-dynamic"),
        ("processes/process.xaml", "Helper.xaml", "invoke-coded"), ("gone", "Common/Helper.xaml", "invoke"), ("", "Common/Helper.xaml", "invoke"),
    ], "from string, target string, kind string")
    return callgraph.call_graph(catalog, calls, spark.createDataFrame([("Main.xaml",)], "path string"))


def test_call_graph(model):
    assert {(r["id"], r["is_entry_point"], r["call_depth"]) for r in model["nodes"].collect()} == {("main.xaml", True, 0), ("processes/process.xaml", False, 1), ("common/helper.xaml", False, 2)}
    assert {(r["src"], r["dst"], r["type"]) for r in model["dependencies"].collect()} == {
        ("main.xaml", "processes/process.xaml", "static"), ("processes/process.xaml", "common/helper.xaml", "static"), ("processes/process.xaml", None, "missing"), ("processes/process.xaml", "common/helper.xaml", "invoke-coded"),
    }
    assert callgraph.metrics(model).first().asDict() == {
        "total_workflows": 3, "entry_points": 1, "orphaned_workflows": 0, "max_call_depth": 2, "total_dependencies": 4, "static_invocations": 2, "dynamic_invocations": 0, "missing_invocations": 1, "cycles_detected": 0,
    }


def test_kinds_of_calls(spark):
    catalog = spark.createDataFrame([(1, "Main.xaml"), (2, "lib/A.xaml"), (3, "lib/sub/B.xaml"), (4, "x/A.xaml"), (5, "lib/C.cs")], "rank int, path string").withColumn("id", F.col("path"))
    raw = ["A.xaml", "B.xaml", "..\\x", "sub\\B.xaml", "[name]", "C.cs", "gone.cs", "Main.xaml", "x/A.xaml", "None.xaml", "./sub/B.xaml"]
    calls = spark.createDataFrame([("lib/Here.xaml", r) for r in raw], "path string, raw string")
    got = {r["raw"]: (r["kind"], r["dst"], r["unresolved"]) for r in callgraph.resolved_calls(calls, catalog).collect()}
    assert got == {
        "A.xaml": ("invoke", "lib/A.xaml", None), "B.xaml": ("invoke-missing", "lib/sub/B.xaml", None), "..\\x": ("invoke-missing", None, "missing:..\\x"), "sub\\B.xaml": ("invoke", "lib/sub/B.xaml", None),
        "[name]": ("invoke-dynamic", None, "dynamic:[name]"), "C.cs": ("invoke-coded", "lib/C.cs", None), "gone.cs": ("invoke-coded", None, "missing:gone.cs"), "Main.xaml": ("invoke", "Main.xaml", None),
        "x/A.xaml": ("invoke", "x/A.xaml", None), "None.xaml": ("invoke-missing", None, "missing:None.xaml"), "./sub/B.xaml": ("invoke", "lib/sub/B.xaml", None),
    }


def test_signatures(spark):
    code = """using System; using UiPath.Core.Activities;
namespace My.Flows { public class Run : CodedWorkflow<Map<int, string>>, IOther {
    private static bool Check(string first) { return true; }
    public async Task<int> Execute(string in_Name, out Dictionary<string, List<int>> out_Map, ref int io_Count, bool flag = a == b, broken) { Activities.Click(x); }
} }"""
    row = spark.createDataFrame([(code,), ("class Bare { }",), ("class Two { void A() { } int B(int n) { } }",)], "code string").select("code", csharp.usings(F.col("code")).alias("u"), csharp.methods(F.col("code")).alias("m"))
    rows = row.select("u", F.col("m.name").alias("names"), F.col("m.return_type").alias("returns"), csharp.arguments(F.col("m")).alias("a"), csharp.packages(F.col("u"), F.col("code")).alias("p")).collect()
    assert rows[0]["u"] == ["System", "UiPath.Core.Activities"] and rows[0]["names"] == ["Check", "Execute"] and rows[0]["returns"] == ["bool", "Task<int>"]
    assert [tuple(a) for a in rows[0]["a"]] == [
        ("in_Name", "string", "in", None), ("out_Map", "Dictionary<string, List<int>>", "out", None), ("io_Count", "int", "in_out", None), ("flag", "bool", "in", "a == b"),
    ]
    assert rows[0]["p"] == ["System", "UiPath.Click", "UiPath.Core"]
    assert rows[1]["a"] == [] and [a["name"] for a in rows[2]["a"]] == ["n"]
    one = lambda x: spark.createDataFrame([(x,)], "x string").select(csharp.split_at_commas(F.col("x"))).first()[0]
    assert [one(x) for x in ("", "a", "a,b", "M<a,b>,c", "a,,b", "a,")] == [[], ["a"], ["a", "b"], ["M<a,b>", "c"], ["a", "", "b"], ["a"]]


def test_tree_documents_round_trip(spark):
    rng = random.Random(11)
    rows = [r for i in range(8) for r in random_tree(rng, f"t{i}")] + [("two", "x", None, 0, 1, 0, 'say "a}"', True), ("two", "y", None, 2, 3, 0, None, True)]
    # a level is filtered out: its children hang on the level above it
    parent = {r[1]: r[2] for r in rows}
    gone = {r[1] for r in rows if r[5] == 2}
    rows = [(*r[:2], parent[r[2]] if r[2] in gone else r[2], *r[3:]) for r in rows if r[1] not in gone]
    nodes = spark.createDataFrame(rows, "tree string, id string, parent string, lft int, rgt int, depth int, tag string, is_visual boolean")
    fields = {"nodeId": "id", "activityType": "tag", "parentId": "parent"}
    docs = documents.tree_documents(nodes, ["tree"], fields)
    assert docs.count() == 9
    two = json.loads(docs.where("tree = 'two'").first()["document"])
    assert two["nodeId"] == "root" and [c["activityType"] for c in two["children"]] == ['say "a}"', None]
    flat = documents.flat_nodes(docs, ["tree"], fields).where("id <> 'root'").orderBy("tree", "place").collect()
    assert [(r["tree"], r["id"], r["tag"], r["parent"]) for r in flat] == [(r[0], r[1], r[6], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[3]))]
    assert documents.tree_documents(nodes.limit(0), ["tree"], fields).count() == 0 and documents.flat_nodes(docs.limit(0), ["tree"], fields).count() == 0


def test_discovery(spark):
    files = spark.createDataFrame([(p,) for p in ("project.json", "a/b/Project.json", "a\\b\\c\\Main.xaml", "a/out/manifest.json", "a/out/workflows.index.json", "w/.procgraph-warehouse/bays.json", "half/manifest.json", "x/output/projects.json")], "path string")
    places = spark.createDataFrame([("a/b/c",), ("a",), ("",), ("a/b",), ("w/in",), ("w",), ("x",), ("half",), ("a/out",)], "folder string")
    near = {r["folder"]: (r["found"], r["distance"]) for r in discovery.nearest_above(places, files, "project.json").collect()}
    assert near["a/b/c"] == ("a/b/Project.json", 1) and near["a"] == ("project.json", 1) and near[""] == ("project.json", 0) and near["a/b"] == ("a/b/Project.json", 0)
    assert {r["folder"]: r["found"] for r in discovery.nearest_above(places, files.where("path <> 'project.json'"), "project.json").collect()}["w"] is None
    homes = {r["folder"]: r["warehouse"] for r in discovery.warehouse_of(places, files).collect()}
    assert (homes["w"], homes["w/in"], homes["x"], homes["half"], homes["a/out"], homes["a/b"]) == ("w/.procgraph-warehouse", "w/.procgraph-warehouse", "x/output", None, "a/out", None)
    asked = spark.createDataFrame([("a/b",), ("a/b/PROJECT.json",), ("a/b/c",), ("c/project.json",)], "path string")
    got = {r["path"]: (r["folder"], r["error"]) for r in discovery.project_folders(asked, files).collect()}
    assert got == {"a/b": ("a/b", None), "a/b/PROJECT.json": ("a/b", None), "a/b/c": (None, "No project.json found in directory: a/b/c"), "c/project.json": (None, "Project file not found: c/project.json")}
    texts_ = spark.createDataFrame([("n", '{"bays": [{"bayId": "one"}, {"recordId": "two"}]}'), ("o", '{"projects": [{"projectSlug": "p"}, {"slug": "s"}, {}]}'), ("bad", "{")], "folder string, content string")
    assert [(r["folder"], r["bay"]) for r in discovery.bays(texts_).orderBy("folder", "place").collect()] == [("n", "one"), ("n", "two"), ("o", "p"), ("o", "s"), ("o", "")]


def test_projects_by_name(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeilnorst-") for _ in range(rng.randint(1, 14)))
    projects = {word(): word().title() for _ in range(150)} | {"invoice-bot": "Invoice Bot", "x": ""}
    questions = [word() for _ in range(25)] + ["INVOICE-BOT", "invoice", "Invoice bot", "zzzz", ""]
    got = {}
    table = spark.createDataFrame(list(projects.items()), "slug string, name string")
    listed = spark.createDataFrame([("invoice", "invoice-bot")], "part string, slug string")
    for r in lookup.resolve_projects(spark.createDataFrame([(q,) for q in questions], "query string"), table, listed).orderBy("query", "n").collect():
        got.setdefault(r["query"], []).append((r["slug"], round(r["confidence"], 9), r["match"]))
    for q in questions:
        rows = []
        for slug, name in projects.items():
            low = q.lower()
            ratio = max(SequenceMatcher(None, low, x.lower()).ratio() for x in (slug, name))
            if low in (slug.lower(), name.lower()):
                rows.append((slug, 1.0, "exact"))
            elif q == "invoice" and slug == "invoice-bot":
                rows.append((slug, round(len(q) / len(slug), 9), "partial"))
            elif ratio >= 0.4:
                rows.append((slug, round(ratio, 9), "fuzzy"))
        assert got.get(q, []) == sorted(rows, key=lambda r: (-r[1], r[0]))[:5], q
