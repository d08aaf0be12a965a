"""Project folders, graph fix-points and scalar functions on small fixtures."""

import json

from pyspark.sql import functions as F

from procgraph.functions import expressions, ident
from procgraph.operators import graph, rules, trees
from procgraph.plans import warehouse
from procgraph.sources import projects
from procgraph.streaming import invocations

XAML = """<Activity xmlns="http://x" xmlns:x="http://y"><x:Members><x:Property Name="in_A"/></x:Members>
<Sequence DisplayName="Main"><If DisplayName="Check"><If.Then><InvokeWorkflowFile DisplayName="Call" WorkflowFileName="{target}"/></If.Then></If>
<WriteLine DisplayName="Say" Text="hello"/></Sequence></Activity>"""


def project(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / ".local").mkdir()
    (tmp_path / "project.json").write_text(json.dumps({"name": "P", "main": "Main.xaml", "schemaVersion": "4.0", "dependencies": {"A": "1.0"}}))
    (tmp_path / "Main.xaml").write_text(XAML.replace("{target}", "lib\\Helper.xaml"))
    (tmp_path / "lib" / "Helper.XAML").write_text(XAML.replace("{target}", "Nowhere.xaml"))
    (tmp_path / ".local" / "Hidden.xaml").write_text("<a/>")
    (tmp_path / "Bad.xaml").write_text("<a>")
    (tmp_path / "Code.cs").write_text("using System;\nnamespace My.Flows { public class Run : CodedWorkflow { public void Execute(int a) {} } }")
    return str(tmp_path)


def test_project_folder_to_tables(spark, tmp_path):
    tables = warehouse.parse(spark, project(tmp_path), "bay")
    p = tables["projects"].first()
    assert (p["name"], p["error"], p["project_type"], p["dependencies"]) == ("P", None, "process", {"A": "1.0"})
    assert {r["workflow_id"] for r in tables["workflows"].collect()} == {"Main", "lib/Helper", "Bad", "Code.cs"}
    shown = [r["display_name"] for r in tables["activities"].where("path = 'Main.xaml'").orderBy("lft").collect()]
    assert shown == ["Main", "Check", "Call", "Say"]
    calls = {(r["src"], r["kind"], r["dst"]) for r in tables["invocations"].collect()}
    assert calls == {("Main", "invoke", "lib/Helper"), ("lib/Helper", "invoke-missing", None)}
    code = tables["coded"].first()
    assert (code["usings"], code["namespace"], code["class_name"], code["base_class"], code["methods"]) == (["System"], "My.Flows", "Run", "CodedWorkflow", ["Execute"])
    assert warehouse.summary(tables["workflows"], tables["nodes"]).first()["failed"] >= 1
    out = str(tmp_path / "out")
    warehouse.write({"workflows": tables["workflows"]}, out, "bay")
    assert warehouse.load(spark, out, "workflows").where("bay_id = 'bay'").count() == 4


def test_depths_cycles_and_expansion(spark):
    e = spark.createDataFrame([("main", "process"), ("process", "helper"), ("helper", "process"), ("alone", "alone")], "src string, dst string")
    start = spark.createDataFrame([("main",)], "node string")
    assert {tuple(r) for r in graph.call_depth(e, start).collect()} == {("main", 0), ("process", 1), ("helper", 2)}
    assert [r[0] for r in graph.orphans(e, start).collect()] == ["alone"]
    assert {tuple(r["cycle"]) for r in graph.cycles(e).collect()} == {("alone",), ("helper", "process")}
    marks = {(r["node"], r["depth"], r["mark"]) for r in graph.expand(e, start, 3).collect()}
    assert ("process", 3, "cycle") in marks
    assert graph.call_depth(e.limit(0), start).count() == 1


def test_control_flow_and_rules(spark):
    n = spark.createDataFrame([("t", "a", None, 0, 9, 0, "Sequence"), ("t", "b", "a", 1, 2, 1, "Assign"), ("t", "c", "a", 3, 6, 1, "While"), ("t", "d", "c", 4, 5, 2, "LogMessage")], "tree string, id string, parent string, lft int, rgt int, depth int, tag string")
    flow = {(r["src"], r["dst"], r["kind"]) for r in trees.control_flow(n, ["tree"]).collect()}
    assert flow == {("a", "b", "contains"), ("b", "c", "seq-next"), ("c", "d", "loop-enter"), ("d", "c", "loop-back")}
    assert trees.depth_metrics(n, ["tree"]).first().asDict() == {"tree": "t", "nodes": 4, "max_depth": 2, "leaves": 2}
    assert {r["kind"]: r["n"] for r in trees.type_counts(n, ["tree"]).collect()} == {"loop": 1, "log": 1, "other": 2}
    assert {r["id"]: r["container"] for r in trees.containers(n, ["tree"]).collect()} == {"a": None, "b": "Sequence", "c": "Sequence", "d": "While"}
    found = rules.issues(n.where("tag = 'While'"), "loops", "warn", F.col("id"), F.lit("loop"))
    assert {r["rule"]: r["status"] for r in rules.status(found, ["loops", "other"]).collect()} == {"loops": "warn", "other": "pass"}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(ident.slug(F.lit(x))) for x in ("My Project", "Prøject Näme", ",,")] == ["my-project", "pr-ject-n-me", ""]
    assert [value(ident.bump(F.lit(v), k)) for v, k in (("1.2.3", "minor"), ("1.2.3-rc.1", "patch"), ("1.2.3-rc.1", "pre"), ("1.2.3", "pre"))] == ["1.3.0", "1.2.3", "1.2.3-rc.2", "1.2.4-alpha.1"]
    assert value(ident.uri_part(ident.resource_uri(F.lit("A B"), F.lit("workflows"), F.lit("x y")), "name")) == "x%20y"
    assert [value(ident.file_size(F.lit(n))) for n in (5, 2048, 3 * 1024 * 1024)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert [value(expressions.is_expression(F.lit(x))) for x in ("[a]", "[]", "plain", "x.ToString()")] == [True, False, False, True]
    assert value(projects.excluded(F.lit(".local/a/b.xaml"))) is True


def test_stream_equals_batch(spark, tmp_path):
    lines = ["# comment", "bad", *(json.dumps({"kind": "invoke", "src": "a", "dst": "b", "ts": f"2024-01-01T0{h}:30:00Z"}) for h in (1, 1, 2, 9))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(lines))
    q = invocations.counts(invocations.read_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("counted").collect()) == [1, 1, 2]
