"""Trees are read in order by tasks: one shuffle of the nodes, no window and no rewriting of texts."""

import json

from pyspark.sql import functions as F

from procgraph.operators import documents, trees

FIELDS = {"nodeId": "id", "parentId": "parent"}


def nodes_of(spark):
    # two trees of 300 nodes: a chain of containers, every other one with a leaf
    rows = []
    for tree in ("a", "b"):
        for i in range(200):
            rows.append((tree, f"c{i}", f"c{i - 1}" if i else None, 3 * i, 3000 - 3 * i, i, "Sequence", True))
            if i % 2:
                rows.append((tree, f"l{i}", f"c{i}", 3 * i + 1, 3 * i + 2, i + 1, "Delay", False))
    return spark.createDataFrame(rows, "tree string, id string, parent string, lft int, rgt int, depth int, tag string, is_visual boolean").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle(spark):
    nodes = nodes_of(spark)
    held = F.col("tag").isin(*trees.CONTAINERS)
    for df in (trees.enclosing(nodes, ["tree"], held), trees.unpruned(nodes, ["tree"], held), trees.container_statistics(nodes, ["tree"]), documents.tree_documents(nodes, ["tree"], FIELDS)):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text and "Join" not in text


def test_deep_trees(spark):
    nodes = nodes_of(spark)
    got = {(r["tree"], r["id"]): r for r in trees.container_statistics(nodes, ["tree"]).collect()}
    assert len(got) == 400
    for i in range(200):
        leaves = sum(1 for j in range(i, 200) if j % 2)
        r = got["a", f"c{i}"]
        want = {"Delay": leaves} | ({"Sequence": 199 - i} if i < 199 else {})
        assert (r["total_child_activities"], r["visual_activities"], r["max_depth"], r["activity_type_counts"]) == (199 - i + leaves, 199 - i, 200 - i, want)
    docs = documents.tree_documents(nodes, ["tree"], FIELDS).collect()
    found, todo = [], [(r["tree"], json.loads(r["document"])) for r in docs]
    for tree, node in todo:
        found.append((tree, node["nodeId"], node["parentId"]))
        todo += [(tree, c) for c in node["children"]]
    assert len(docs) == 2 and sorted(found, key=str) == sorted(((r["tree"], r["id"], r["parent"]) for r in nodes.collect()), key=str)


def test_absent_parents_and_odd_documents(spark):
    rows = [("t", "r", None, 0, 0), ("t", "x", "r", 1, 1), ("t", "y", "gone", 2, 2), ("t", "z", "y", 3, 3), ("t", "w", "x", 4, 4), ("u", "alone", "gone", 0, 1)]
    docs = documents.tree_documents(spark.createDataFrame(rows, "tree string, id string, parent string, lft int, depth int"), ["tree"], {"nodeId": "id"}).collect()
    assert len(docs) == 1 and json.loads(docs[0]["document"]) == {"nodeId": "r", "children": [{"nodeId": "x", "children": [{"nodeId": "w", "children": []}]}]}
    odd = spark.createDataFrame([("a", '{"nodeId": 1, "children": [null, {"nodeId": "x", "children": "no"}, {"nodeId": {"k": 2}}]}'), ("b", "{"), ("c", None)], "tree string, document string")
    assert sorted((r["tree"], tuple(r["place"]), r["id"]) for r in documents.flat_nodes(odd, ["tree"], {"nodeId": "id"}).collect() if r["id"]) == [("a", (), "1"), ("a", (1,), "x"), ("a", (2,), '{"k":2}')]


def test_flat_nodes_write_nothing(spark, monkeypatch):
    rows = [("a", '{"nodeId": 1.50, "x": "é\\ud800", "children": [null, "{\\"nodeId\\": true}", [1], {"nodeId": [1e5, {"k": "ü"}], "children": "[{\\"nodeId\\": \\"in\\"}]"}]} z'), ("b", "3"), ("c", '{"nodeId": NaN}')]
    odd = spark.createDataFrame(rows, "tree string, document string")
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", None)
    flat = documents.flat_nodes(odd, ["tree"], {"nodeId": "id", "x": "x"})
    assert "Exchange" not in plan(flat) and "Scan parquet" not in plan(flat)
    got = sorted((r["tree"], tuple(r["place"]), r["id"], r["x"]) for r in flat.collect())
    assert got == [
        ("a", (), "1.5", "é?"), ("a", (0,), None, None), ("a", (1,), "true", None), ("a", (2,), None, None), ("a", (3,), '[100000.0,{"k":"ü"}]', None), ("a", (3, 0), "in", None), ("b", (), None, None),
    ]


def test_tasks_have_bounded_rows(spark, monkeypatch):
    nodes = nodes_of(spark)
    held = F.col("tag").isin(*trees.CONTAINERS)
    some = nodes.where("lft < 30").crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("tree", F.concat_ws("/", "tree", "copy"))
    want = sorted(map(tuple, trees.enclosing(some, ["tree"], held).select("tree", "id", "container").collect()))
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    n = some.count()
    for df in (trees.enclosing(some, ["tree"], held), trees.unpruned(some, ["tree"], held), trees.container_statistics(some, ["tree"]), documents.tree_documents(some, ["tree"], FIELDS, n=n)):
        assert df.rdd.getNumPartitions() == -(-n // 100)
    assert sorted(map(tuple, trees.enclosing(some, ["tree"], held).select("tree", "id", "container").collect())) == want
