"""Activity instances: texts by cases, instances from a real file, queries against their SQL."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from procgraph import suite, suite_instances  # noqa: F401
from procgraph.functions import activity_text
from procgraph.operators import instances
from procgraph.sources import projects

DATA = "/root/testdata/sf0.001"
# text, expressions, variables
TEXTS = [
    ('[row("Name").ToString]', {'row("Name").ToString'}, {"row"}),
    ('[String.Format("a ]{0}[ ""b""", total, Math.Abs(x1))]', {'String.Format("a ]{0}[ ""b""", total, Math.Abs(x1))'}, {"total", "x1"}),
    ("order.GetLines().Count", {"order.GetLines()"}, {"order"}), ("Path.Combine(dir, Trim(name))", {"Path.Combine(dir, Trim(name))"}, {"dir", "name", "Trim"}),
    ("say [greeting] to [person.Name], [greeting]", {"greeting", "person.Name"}, {"greeting", "person"}), ("total = other", set(), {"total"}), ("a == b", set(), set()),
    ("[DateTime.Now]", {"DateTime.Now"}, set()), ("[items.Count > 0 AndAlso Not done]", {"items.Count > 0 AndAlso Not done"}, {"items", "done"}), ("If this Then that", set(), set()),
    ('a "x = 1" text', set(), set()), ("<ctrl id='[key]' tag='A' />", {"key"}, {"key"}), ("[unclosed", set(), set()), ("[]", set(), set()), ("", set(), set()), (None, set(), set()), ("[" + "a + " * 5000 + "b]", {"a + " * 5000 + "b"}, {"a", "b"}),
]
FLOW = """<Activity xmlns:x="urn:x" xmlns:ui="urn:ui" xmlns:p="urn:p"><x:Members><x:Property Name="in_A" /></x:Members>
  <Sequence DisplayName="All" p:Annotation.AnnotationText="the whole">
    <ui:NClick DisplayName="Press" ClickType="Single" p:WorkflowViewState.IdRef="NClick_1"><ui:NClick.Target>
      <ui:Target Element="[field]"><ui:FullSelector><![CDATA[<ctrl id='ok' />]]></ui:FullSelector><ui:Part>1</ui:Part><ui:Part>2</ui:Part></ui:Target>
    </ui:NClick.Target><p:WorkflowViewStateService.ViewState><x:Boolean>True</x:Boolean></p:WorkflowViewStateService.ViewState></ui:NClick>
    <ForEach DisplayName="Each" Values="[people]"><ActivityAction><ui:LogMessage DisplayName="Log" Message="[String.Format(&quot;{0}&quot;, person.Name)]" /></ActivityAction></ForEach>
    <Sequence DisplayName="One"><ui:LogMessage DisplayName="Same" /></Sequence><Sequence DisplayName="Two"><ui:LogMessage DisplayName="Same" /></Sequence>
  </Sequence></Activity>"""


def test_texts(spark):
    table = spark.createDataFrame([(i, x[0]) for i, x in enumerate(TEXTS)], "i int, text string")
    got = {r["i"]: (r["e"], r["v"]) for r in table.select("i", activity_text.expressions_of(F.col("text")).alias("e"), activity_text.variables_of(F.col("text")).alias("v")).collect()}
    for i, (text, expressions, variables) in enumerate(TEXTS):
        assert (set(got[i][0]), set(got[i][1])) == (expressions, variables), text
        assert len(got[i][0]) == len(expressions) and len(got[i][1]) == len(variables)


def test_selectors_and_categories(spark):
    config = F.create_map(*map(F.lit, ("Target.FullSelector", "<a/>", "Target.TargetAnchorable", "x", "In.Inner.FullSelectorArgument", "<b/>", "FullSelector.Note", "n", "Target.FuzzySelector", "", "DisplayName", "Selector")))
    row = spark.range(1).select(activity_text.selectors_of(config).alias("s"), activity_text.category(F.lit("Throw")).alias("c"), activity_text.category(F.lit("Own")).alias("o")).first()
    assert row["s"] == {"Target.FullSelector": "<a/>", "Target.TargetAnchorable": "x", "In.Inner.FullSelectorArgument": "<b/>"} and (row["c"], row["o"]) == ("exception_handling", "other")


def test_instances(spark, tmp_path):
    (tmp_path / "Sub").mkdir()
    (tmp_path / "Sub" / "Flow.xaml").write_text(FLOW)
    (tmp_path / "Broken.xaml").write_text("<Activity>")
    found = instances.activity_instances(projects.xml_nodes(projects.files(spark, str(tmp_path))), F.lit("proj-1")).orderBy("lft").collect()
    assert [r["display_name"] for r in found] == ["All", "Press", "Each", "Log", "One", "Same", "Two", "Same"]
    whole, press, each, log, one, same, two, again = found
    assert all(re.fullmatch(r"proj-1#Sub/Flow#[^#]+#[0-9a-f]{8}", r["activity_id"]) for r in found) and len({r["activity_id"] for r in found}) == 8
    assert whole["parent_activity_id"] is None and whole["depth"] == 0 and whole["annotation"] == "the whole" and whole["container_type"] == "Sequence"
    assert [r["parent_activity_id"] for r in (press, each, log, same, again)] == [x["activity_id"] for x in (whole, whole, each, one, two)]
    assert press["arguments"] == {"ClickType": "Single"} and press["metadata"] == {"WorkflowViewState.IdRef": "NClick_1"} and press["properties"]["DisplayName"] == "Press"
    assert press["configuration"] == {
        "NClick.Target": "", "NClick.Target.Target": "", "NClick.Target.Target.Element": "[field]", "NClick.Target.Target.FullSelector": "<ctrl id='ok' />", "NClick.Target.Target.Part": "1", "NClick.Target.Target.Part[2]": "2",
    }
    assert press["selectors"] == {"NClick.Target.Target.FullSelector": "<ctrl id='ok' />"} and press["variables_referenced"] == ["field"] and press["category"] == "ui_automation"
    assert each["arguments"] == {"Values": "[people]"} and each["expressions"] == ["people"] and each["configuration"] == {"ActivityAction": ""}
    assert log["expressions"] == ['String.Format("{0}", person.Name)'] and log["variables_referenced"] == ["person"] and log["configuration"] == {}
    assert "Property" not in {r["activity_type"] for r in found}


@pytest.mark.parametrize("name", ["activity_expressions", "activity_ids"])
def test_queries(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = suite.QUERIES[name](spark, DATA), con.sql(suite.ORACLES[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
