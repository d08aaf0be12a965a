"""Trees as nested JSON documents and back."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from procgraph.operators.trees import in_order


def _nested(tree: list[str], children: str, head: str):
    begin, size = f',"{children}":[', 8 << 20

    def task(batches):
        # open_: the ids from a root down, and whether each has children yet
        at, open_, parts, roots, done, kinds, waiting = None, [], [], [], [], None, 0

        def close(level):
            parts.append("]}" * (len(open_) - level))
            del open_[level:]
            if not level:
                roots.append("".join(parts))
                parts.clear()

        def end():
            nonlocal waiting
            if open_:
                close(0)
            if roots:
                done.append((*at, roots[0] if len(roots) == 1 else head[:-1] + begin + ",".join(roots) + "]}"))
                waiting += len(done[-1][-1])
                roots.clear()

        def flush():
            nonlocal waiting
            columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(columns, [*tree, "document"])

        for batch in batches:
            kinds = [*[batch[c].type for c in tree], pa.string()]
            keys = zip(*[batch[c].to_pylist() for c in tree])
            for key, own, parent, text in zip(keys, *[batch[c].to_pylist() for c in ("id", "parent", "__own")]):
                if key != at:
                    end()
                    if waiting > size:
                        yield flush()
                    at = key
                level = 0
                if parent is not None:
                    level = next((i for i in range(len(open_), 0, -1) if open_[i - 1][0] == parent), None)
                    if level is None:  # what it hangs on isn't there
                        continue
                if len(open_) > level:
                    close(level)
                if level:
                    parts.append("," if open_[-1][1] else "")
                    open_[-1][1] = True
                parts.append(text[:-1] + begin)
                open_.append([own, False])
        end()
        if done:
            yield flush()

    return task


def tree_documents(nodes: DataFrame, tree: list[str], fields: dict[str, str], children: str = "children", root: dict[str, str] | None = None, n: int | None = None) -> DataFrame:
    """(tree, document): each tree of nodes(id, parent, lft, ...) as one JSON text, children in order of lft.

    fields are JSON names and the columns that they hold, in order; an absent value is null. A task reads its trees in order and writes
    a node's text as it begins and ends, so nodes are shuffled once and texts never; gaps in depth (levels that were filtered out) do no harm, and
    what hangs on an absent node is left out. Several roots of a tree come below one of `root`'s fields. A tree without nodes has no document. n as in trees.in_order.
    """
    root = root or {"nodeId": "root", "activityType": "Activity", "displayName": "Activity"}
    own = F.to_json(F.struct(*[F.col(c).alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})
    rows = in_order(nodes.select(*dict.fromkeys([*tree, "id", "parent", "lft", *fields.values()])), tree, n).select(*tree, "id", "parent", own.alias("__own"))
    head = json.dumps({k: v for k, v in root.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))
    schema = StructType([*[nodes.schema[c] for c in tree], StructField("document", StringType())])
    return rows.mapInArrow(_nested(tree, children, head), schema)


def _flat(tree: list[str], names: list[str], columns: list[str], children: str):
    size = 20_000

    def parsed(text):
        try:
            return json.JSONDecoder().raw_decode(text.strip())[0]
        except (ValueError, RecursionError):
            return None

    def task(batches):
        for batch in batches:
            kinds = [*[batch[c].type for c in tree], pa.list_(pa.int32()), *[pa.string()] * (len(names) + 1)]
            done = []

            def flush():
                made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [*tree, "place", *columns, "__odd"])
                done.clear()
                return made

            for i, key in enumerate(zip(*[batch[c].to_pylist() for c in tree])):
                todo = [([], parsed(batch["document"][i].as_py()))]
                while todo:
                    place, node = todo.pop()
                    if isinstance(node, str):  # a text that holds JSON
                        node = parsed(node)
                    said, odd, below = [], {}, None
                    if isinstance(node, dict):
                        below = node.get(children)
                        for j, name in enumerate(names):
                            value = node.get(name)
                            if value is not None and not isinstance(value, str):
                                if isinstance(value, bool):
                                    value = "true" if value else "false"
                                elif isinstance(value, int):
                                    value = str(value)
                                else:
                                    odd[f"f{j}"], value = value, None
                            said.append(value if value is None or value.isascii() else value.encode("utf-8", "replace").decode())
                    done.append((*key, place, *(said or [None] * len(names)), json.dumps(odd) if odd else None))
                    if isinstance(below, str):
                        below = parsed(below)
                    if isinstance(below, list):
                        todo += [([*place, n], below[n]) for n in range(len(below) - 1, -1, -1)]
                    if len(done) >= size:
                        yield flush()
            if done:
                yield flush()

    return task


def flat_nodes(documents: DataFrame, tree: list[str], fields: dict[str, str], children: str = "children") -> DataFrame:
    """The nodes of documents(tree, document): the columns of `fields` as strings, and place, the way to a node by numbers of children, which sorts into reading order.

    One pass: a task reads one document at a time and writes nothing but nodes. Numbers with fractions, lists and objects as fields are
    given as Spark's JSON functions write them. A document that isn't JSON gives no rows.
    """
    names, columns = list(fields), list(fields.values())
    strings = [StructField(c, StringType()) for c in (*columns, "__odd")]
    schema = StructType([*[documents.schema[c] for c in tree], StructField("place", ArrayType(IntegerType())), *strings])
    found = documents.select(*tree, "document").where(F.try_parse_json("document").isNotNull()).mapInArrow(_flat(tree, names, columns, children), schema)
    return found.select(*tree, "place", *[F.coalesce(F.col(c), F.get_json_object("__odd", f"$.f{j}")).alias(c) for j, c in enumerate(columns)])
