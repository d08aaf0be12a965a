"""Workflows from real files: visual ids, arguments, variables, imports, calls, packages, rules and lookup."""

import pytest
from pyspark.sql import functions as F

from procgraph.functions import expressions, ident
from procgraph.operators import rules, trees, workflows
from procgraph.sources import projects

MAIN = """<Activity xmlns="http://schemas.microsoft.com/netfx/2009/xaml/activities" xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml"
  xmlns:ui="http://schemas.uipath.com/workflow/activities" xmlns:sap2010="http://schemas.microsoft.com/netfx/2010/xaml/activities/presentation">
  <x:Members>
    <x:Property Name="in_Path" Type="InArgument(x:String)" /><x:Property Name="out_Sum" /><x:Property Name="Flag" Direction="Out" DefaultValue="1" /><x:Property Name="io_Row" />
  </x:Members>
  <TextExpression.NamespacesForImplementation><x:String>System</x:String><x:String> System.Linq </x:String></TextExpression.NamespacesForImplementation>
  <Sequence DisplayName="Main" sap2010:Annotation.AnnotationText="what it does">
    <Sequence.Variables><Variable x:TypeArguments="x:String" Name="a" Default="1" /><Variable Name="b" /></Sequence.Variables>
    <ui:LogMessage DisplayName="Log" />
    <If DisplayName="Check"><If.Then><Sequence><ui:Click DisplayName="One" /><ui:Click DisplayName="Two" /></Sequence></If.Then></If>
    <ui:InvokeWorkflowFile DisplayName="Call" WorkflowFileName="Sub/Do.xaml" arg_x="7">
      <ui:InvokeWorkflowFile.Arguments><InArgument Key="in_A" Value="[a]" /><x:String Key="in_B">text</x:String><x:String Key="arg_x">lost</x:String></ui:InvokeWorkflowFile.Arguments>
    </ui:InvokeWorkflowFile>
    <Assign><Value>[Path.Combine(root, "Other.xaml")]</Value></Assign>
    <Assign><Value>["Flows/" + name + ".xaml"] and [plain.xaml]</Value></Assign>
  </Sequence>
</Activity>"""


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "Main.xaml").write_text(MAIN)
    (root / "Broken.xaml").write_text("<Activity><Sequence></Activity>")
    return projects.xml_nodes(projects.files(spark, str(root))).cache()


def test_visual_nodes(nodes):
    got = {r["node_id"]: r for r in projects.activities(nodes).collect()}
    assert set(got) == {
        "Activity/Sequence[0]", "Activity/Sequence/LogMessage[0]", "Activity/Sequence/If[0]", "Activity/Sequence/If/If.Then/Sequence[0]",
        "Activity/Sequence/If/If.Then/Sequence/Click[0]", "Activity/Sequence/If/If.Then/Sequence/Click[1]", "Activity/Sequence/InvokeWorkflowFile[0]",
    }
    main, inner = got["Activity/Sequence[0]"], got["Activity/Sequence/If/If.Then/Sequence[0]"]
    assert (main["visual_parent"], main["annotation"], "Annotation.AnnotationText" in main["attributes"]) == (None, "what it does", False)
    assert (inner["display_name"], inner["visual_parent"]) == ("<Sequence>", "Activity/Sequence/If[0]")
    assert got["Activity/Sequence/If/If.Then/Sequence/Click[1]"]["visual_parent"] == "Activity/Sequence/If/If.Then/Sequence[0]"
    errors = nodes.where("error is not null").collect()
    assert [r["path"] for r in errors] == ["Broken.xaml"]


def test_declarations_of_a_workflow(nodes):
    assert {tuple(r)[1:] for r in workflows.arguments(nodes).collect()} == {
        ("in_Path", "In", "InArgument(x:String)", None), ("out_Sum", "Out", "Object", None), ("Flag", "Out", "Object", "1"), ("io_Row", "InOut", "Object", None),
    }
    assert {tuple(r)[1:] for r in workflows.variables(nodes).collect()} == {("a", "x:String", "1", "Workflow"), ("b", "", "", "Workflow")}
    assert [r["import"] for r in workflows.imports(nodes).orderBy("place").collect()] == ["System", "System.Linq"]
    assert [(r["name"], r["expected"]) for r in workflows.argument_naming(workflows.arguments(nodes)).collect()] == [("Flag", "out_")]


def test_calls_of_a_workflow(nodes):
    assert [r["arguments"] for r in workflows.call_arguments(nodes).collect()] == [{"in_A": "[a]", "in_B": "text", "arg_x": "7"}]
    found = {(r["target"], r["activity"]) for r in workflows.dynamic_calls(workflows.texts(nodes)).collect()}
    assert found == {
        ('Path.Combine(root, "Other.xaml")', "Dynamic Path.Combine"), ('Path.Combine(root, "Other.xaml")', "Variable Expression"), ('"Flows/" + name + ".xaml"', "Variable Expression"),
    }


def test_kinds_namespaces_and_packages(spark):
    one = lambda f, rows: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]
    assert one(expressions.call_kind, [None, "", "A.xaml", "[a]", "Path.Combine(a, b)"]) == ["invoke-missing", "invoke-missing", "invoke", "invoke-dynamic", "invoke-dynamic"]
    assert one(expressions.namespace_package, [
        "http://schemas.microsoft.com/winfx/2006/xaml", "clr-namespace:System.Data;assembly=System.Data", "http://schemas.uipath.com/workflow/activities", "clr-namespace:UiPath.Excel;assembly=UiPath.Excel.Activities",
        "clr-namespace:My.Own.Activities;assembly=UiPath.Mail.Activities", "clr-namespace:My.Activities;assembly=My.Package", "clr-namespace:Other;assembly=Other",
    ]) == [None, None, "UiPath.System.Activities", "UiPath.Excel", "UiPath.Mail.Activities", "My.Package", None]
    assert one(expressions.namespaces_of, ['<A xmlns="one" xmlns:x="two" xmlns:x="three">']) == [{"default": "one", "x": "three"}]
    assert one(ident.human_size, ["0", "1", "1023", "1536", "1048576", "5000000000000000"]) == ["0B", "1.0 B", "1023.0 B", "1.5 KB", "1.0 MB", "4547.47 TB"]


def test_rules_on_artifacts(spark):
    files = spark.createDataFrame([("a", "manifest.json", '{"toolVersion": 1, "generatedAt": 2}'), ("a", "workflows.index.json", "{"), ("b", "workflows.index.json", "{}")], "bay string, file string, content string")
    found = {(r["subject"], r["message"]) for r in rules.artifacts_presence(files).collect()}
    assert found == {("a/workflows.index.json", "Invalid JSON in workflows.index.json"), ("b/manifest.json", "Required artifact missing: manifest.json")}
    manifests = spark.createDataFrame([("a", '{"toolVersion": 1, "generatedAt": 2}'), ("b", None)], "bay string, content string")
    assert {r["message"] for r in rules.provenance(manifests, ("toolVersion", "schemaVersion", "generatedAt")).collect()} == {"Missing provenance field: schemaVersion", "Manifest required for provenance validation"}
    issues, status = rules.run_rules(spark, {"presence": lambda: rules.artifacts_presence(files).withColumn("rule", F.lit("presence")), "broken": lambda: files.select("absent")})
    assert {r["rule"]: (r["issues"], r["status"]) for r in status.collect()} == {"presence": (2, "fail"), "broken": (1, "fail")}
    assert issues.where("rule = 'broken'").first()["message"].startswith("Rule execution failed")


def test_lookup_and_flow(spark):
    catalog = spark.createDataFrame([(1, "p#Main#1", "Main.xaml", "Main.xaml", "Main"), (2, "p#Sub/Do#2", "Sub/Do.xaml", "Do.xaml", "Does it"), (3, "p#Sub/Do2#3", "Sub/Do2.xaml", "Do2.xaml", "Twice")], "rank int, id string, path string, file_name string, display_name string")
    wanted = spark.createDataFrame([("p#Main#1",), ("Sub\\Do.xaml",), ("Do2.xaml",), ("sub",), ("twi",), ("none",)], "identifier string")
    assert {r["identifier"]: (r["id"], r["step"]) for r in workflows.find(catalog, wanted).collect()} == {
        "p#Main#1": ("p#Main#1", 1), "Sub\\Do.xaml": ("p#Sub/Do#2", 2), "Do2.xaml": ("p#Sub/Do2#3", 3), "sub": ("p#Sub/Do#2", 4), "twi": ("p#Sub/Do2#3", 5), "none": (None, 0),
    }
    tree = [("t", "if", None, 0, "If"), ("t", "a", "if", 1, "Assign"), ("t", "b", "if", 2, "Assign"), ("t", "try", None, 3, "TryCatch"), ("t", "c", "try", 4, "Assign"), ("t", "d", "try", 5, "Assign")]
    n = spark.createDataFrame(tree, "tree string, id string, parent string, lft int, tag string")
    assert {(r["src"], r["dst"], r["kind"]) for r in trees.control_flow(n, ["tree"]).collect()} == {("if", "a", "branch-then"), ("if", "b", "branch-else"), ("try", "c", "try"), ("try", "d", "catch")}
