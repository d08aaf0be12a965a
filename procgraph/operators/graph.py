"""Fix-points over edges(src, dst): depth, reachability, cycles with their witnesses, paths.

Loops run one job a level over a frontier; the frontier, not the graph, is what
moves. Frontiers are written to the folder that all executors share. Components that
fit into a task are settled there, many in one, as their ways may be as long as they are large.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared(df: DataFrame) -> str:
    """The folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    shared(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: a checkpoint keeps what the optimizer knows of its columns, and that doubles with each round of some loops."""
    path = f"{shared(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def call_depth(edges: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): least number of calls from an entry (node); entries have 0, unreached nodes are absent.

    A level writes its new nodes alone; the levels before are read where they lie, and folded into one table every tenth level.
    """
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = seen = written(entries.select("node", F.lit(0).cast("long").alias("depth")).distinct())
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 10 == 0:
            seen = written(seen)
    return seen


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def orphans(edges: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """(node): those that no entry reaches, in `most` calls if that is given."""
    far = reached(edges, entries) if most is None else call_depth(edges, entries, most).select("node")
    return nodes_of(edges).join(far, "node", "left_anti")


def paths(edges: DataFrame, hops: int) -> DataFrame:
    """(path, hops): simple walks of 1 to `hops` edges as node arrays."""
    one = edges.select("src", "dst").distinct()
    now = one.where("src <> dst").select(F.array("src", "dst").alias("path"))
    out = now
    for _ in range(hops - 1):
        ends = now.withColumn("src", F.element_at("path", -1))
        now = ends.join(one, "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(now)
    return out.withColumn("hops", (F.size("path") - 1).cast("long"))


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(cycle, length): simple cycles of at most `longest` nodes, each once, from its least node.

    A bounded listing: longer cycles are absent. cyclic_nodes and cyclic_edges are exact.
    """
    one = edges.select("src", "dst").distinct()
    loops = one.where("src = dst").select(F.array("src").alias("cycle"))
    now, out = one.where("src < dst").select(F.array("src", "dst").alias("cycle")), loops
    for length in range(2, longest + 1):
        ends = now.withColumn("src", F.element_at("cycle", -1)).withColumn("head", F.col("cycle")[0])
        nexts = ends.join(one, "src")
        out = out.unionByName(nexts.where("dst = head").select("cycle"))
        if length < longest:
            now = nexts.where((F.col("dst") > F.col("head")) & ~F.array_contains("cycle", F.col("dst"))).select(F.concat("cycle", F.array("dst")).alias("cycle"))
    return out.withColumn("length", F.size("cycle").cast("long"))


def trim(edges: DataFrame) -> DataFrame:
    """edges without those that start where none ends or end where none starts, until none is left to drop."""
    now, n = edges, edges.count()
    while n:
        starts, ends = now.select(F.col("src").alias("dst")).distinct(), now.select(F.col("dst").alias("src")).distinct()
        kept = written(now.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"))
        before, now, n = n, kept, kept.count()
        if n == before:
            break
    return now


def greatest_ancestor(edges: DataFrame) -> DataFrame:
    """(node, color): the greatest node that reaches it, itself included.

    A round writes the nodes alone whose color rises; colors are the greatest of all rows of a node, folded every tenth round.
    """
    color = frontier = written(nodes_of(edges).withColumn("color", F.col("node")))
    rounds, most = 0, F.max("color").alias("color")
    while not frontier.isEmpty():
        rounds += 1
        offer = edges.join(frontier.toDF("src", "offer"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("offer").alias("offer"))
        now = color.join(offer.select("node"), "node", "left_semi").groupBy("node").agg(most)
        frontier = written(now.join(offer, "node").where("offer > color").select("node", F.col("offer").alias("color")))
        color = color.unionByName(frontier)
        if rounds % 10 == 0:
            color = written(color.groupBy("node").agg(most))
    return written(color.groupBy("node").agg(most))


def stars(edges: DataFrame) -> DataFrame:
    """(node, weak): the least node of each component of edges(src, dst) taken without direction.

    Neighbours of a node are hung on the least of them, the greater ones and then the others, until the edges are stars: in
    about log(n) rounds, however long the ways are. A node's neighbours are streamed in order, not held.
    """
    order = Window.partitionBy("a").orderBy("b")
    fresh, least = F.lag("b").over(order).eqNullSafe(F.col("b")), F.first("b").over(order)
    in_order = lambda df: df.select("a", "b", fresh.alias("again"), least.alias("least")).where("not again")
    now, before = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        greater = in_order(both).where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        now = written(in_order(greater).select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            heads = now.select("b").distinct()
            return now.toDF("node", "weak").unionByName(heads.select(F.col("b").alias("node"), F.col("b").alias("weak")))
        before = state


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, weak): the weakly connected component of every node by its least node.

    Stars are first made of each node's least and greatest callee alone; what edges still lie between components is joined in the
    same way. So the rounds move some rows a node, not the edges, which are read once a pass, and dense graphs take two.
    """
    rest, known = edges, None
    while True:
        ends = rest.groupBy("src").agg(F.array(F.min("dst"), F.max("dst")).alias("dst")).select("src", F.explode("dst").alias("dst"))
        found = stars(ends)
        if known is None:
            known = nodes_of(edges).join(found, "node", "left").select("node", F.coalesce("weak", "node").alias("weak"))
        else:
            known = known.join(found.toDF("weak", "next"), "weak", "left").select("node", F.coalesce("next", "weak").alias("weak"))
        known = written(known)
        between = edges.join(known.toDF("src", "a"), "src").join(known.toDF("dst", "b"), "dst").where("a <> b")
        rest = written(between.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        if rest.isEmpty():
            return known


# Edges of one task at once: small components are dealt into blocks of about BLOCK, one between the two is its own; what is greater goes through frontiers
BLOCK, LARGEST = 200_000, 1_000_000


def blocks(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(edges of components (key) of at most LARGEST edges with their block, edges of greater ones)."""
    sizes = written(edges.groupBy(key).agg(F.count("*").alias("__n")))
    total = sizes.where(F.col("__n") <= BLOCK).agg(F.sum("__n")).first()[0] or 0
    name = F.xxhash64(key)
    sized = edges.join(sizes, key)
    block = F.when(F.col("__n") > BLOCK, name).otherwise(F.pmod(name, F.lit(total // BLOCK + 1)))
    return sized.where(F.col("__n") <= LARGEST).withColumn("block", block).drop("__n"), sized.where(F.col("__n") > LARGEST).drop("__n")


def _numbered(table: pa.Table) -> tuple[pa.Array, list[int], list[int], np.ndarray, np.ndarray]:
    """Nodes of a block in ascending order; where each one's callees start in the list that follows; the ends of all edges by their callers' order."""
    src, dst = table["src"].combine_chunks(), table["dst"].combine_chunks()
    names = pc.unique(pa.chunked_array([src, dst]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return names, np.searchsorted(a, np.arange(len(names) + 1)).tolist(), b.tolist(), a, b


def _strong(table: pa.Table) -> pa.Table:
    """(node, component) of a block: strongly connected components of two nodes and more (Tarjan's stack), by their greatest node."""
    names, at, to, _, _ = _numbered(table)
    n, count = len(names), 0
    after, seen, low, of, stack = at[:-1], [0] * n, [0] * n, [-1] * n, []
    for root in range(n):
        way = [] if seen[root] else [root]
        while way:
            v = way[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                stack.append(v)
            while after[v] < at[v + 1]:
                w = to[after[v]]
                if not seen[w]:
                    way.append(w)
                    break
                after[v] += 1
                if of[w] < 0 and low[w] < low[v]:
                    low[v] = low[w]
            else:
                way.pop()
                if low[v] == seen[v]:
                    place = len(stack) - 1
                    while stack[place] != v:
                        place -= 1
                    greatest = max(stack[place:])
                    for w in stack[place:]:
                        of[w] = greatest
                    del stack[place:]
    of = np.array(of)
    held = np.flatnonzero(np.bincount(of, minlength=n)[of] > 1)
    return pa.table({"node": names.take(pa.array(held)), "component": names.take(pa.array(of[held]))})


def _in_blocks(edges: DataFrame, task, schema: str) -> DataFrame:
    return edges.groupBy("block").applyInArrow(task, schema)


def _spread(table: pa.Table) -> pa.Table:
    """(node) of a block: those that lie behind a node that starts, itself included."""
    names, at, to, _, _ = _numbered(table)
    seen = np.zeros(len(names), dtype=bool)
    todo = np.unique(pc.index_in(table["src"].filter(table["starts"]).combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
    seen[todo] = True
    seen = seen.tolist()
    while todo:
        v = todo.pop()
        for w in to[at[v] : at[v + 1]]:
            if not seen[w]:
                seen[w] = True
                todo.append(w)
    return pa.table({"node": names.filter(pa.array(seen, pa.bool_()))})


def reached(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node): entries and what they reach in any number of calls.

    Weakly connected components without an entry are left aside, the others dealt into blocks as in cyclic_nodes, so ways of
    any length cost no rounds. A component too large for one task goes through frontiers.
    """
    one = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    starts = written(entries.select("node").distinct())
    if one.isEmpty():
        return starts
    weak = weak_components(one)
    held = weak.join(starts, "node", "left_semi").select("weak").distinct()
    near = one.join(weak.join(held, "weak", "left_semi").select(F.col("node").alias("src"), "weak"), "src").join(starts.select(F.col("node").alias("src"), F.lit(True).alias("starts")), "src", "left")
    small, large = blocks(written(near.select("src", "dst", "weak", F.coalesce("starts", F.lit(False)).alias("starts"))), "weak")
    found = _in_blocks(small.select("src", "dst", "starts", "block"), _spread, f"node {one.schema['src'].dataType.simpleString()}")
    large = written(large)
    if not large.isEmpty():
        found = found.unionByName(call_depth(large, large.where("starts").select(F.col("src").alias("node"))).select("node"))
    return written(starts.unionByName(found).distinct())


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach themselves over cycles of any length, with the greatest node of their strongly connected component.

    Weakly connected components are dealt into blocks of edges, and each block is settled in a task of its own, so ways of any
    length cost no rounds. A component too large for one task goes through frontiers.
    """
    one = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = one.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    apart = written(one.where("src <> dst"))
    if apart.isEmpty():
        return loops
    small, large = blocks(written(apart.join(weak_components(apart).toDF("src", "weak"), "src")), "weak")
    kind = one.schema["src"].dataType.simpleString()
    found = written(_in_blocks(small.select("src", "dst", "block"), _strong, f"node {kind}, component {kind}"))
    large = written(large.select("src", "dst"))
    if not large.isEmpty():
        found = written(found.unionByName(cyclic_by_frontiers(large)))
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def cyclic_by_frontiers(edges: DataFrame) -> DataFrame:
    """cyclic_nodes of two nodes and more, of edges(src, dst) of any size, in as many rounds as ways are long.

    Edges are trimmed, nodes take the color of their greatest ancestor, and what
    reaches a color's own node inside the color is its component; the rest goes round again.
    """
    left, found = trim(edges), None
    while found is None or not left.isEmpty():
        color = greatest_ancestor(left)
        of_src, of_dst = color.toDF("src", "color"), color.toDF("dst", "dst_color")
        inner = written(left.join(of_src, "src").join(of_dst, "dst").where("color = dst_color").select("src", "dst", "color"))
        seen = frontier = written(color.where("node = color").select("node", F.col("color").alias("component")))
        while not frontier.isEmpty():
            step = inner.join(frontier.toDF("dst", "color"), ["dst", "color"]).select(F.col("src").alias("node"), F.col("color").alias("component")).distinct()
            frontier = written(step.join(seen.select("node"), "node", "left_anti"))
            seen = seen.unionByName(frontier)
        large = seen.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        more = seen.join(large, "component", "left_semi").select("node", "component")
        found = written(more if found is None else found.unionByName(more))
        rest = inner.join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = trim(written(rest.select("src", "dst")))
    return found


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, component): edges on a cycle of any length, which are those inside a component."""
    one = written(edges.select("src", "dst").distinct())
    nodes = written(cyclic_nodes(one))
    starts, ends = nodes.toDF("src", "component"), nodes.toDF("dst", "dst_component")
    return one.join(starts, "src").join(ends, "dst").where("component = dst_component").select("src", "dst", "component")


def _shortest(most: int | None):
    """A task that gives (component, cycle) of a block of whole components: level by level from each one's least node."""

    def task(table: pa.Table) -> pa.Table:
        names, at, to, a, b = _numbered(table)
        group = np.zeros(len(names), dtype=np.int64)
        of = pc.index_in(table["component"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        group[pc.index_in(table["src"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)] = of
        kinds, starts = np.unique(group, return_index=True)  # nodes ascend: the first of a group is its least
        start_of = np.empty(len(names), dtype=np.int64)
        start_of[kinds] = starts
        closes = np.zeros(len(names), dtype=bool)
        closes[a[b == start_of[group[a]]]] = True
        closes, parent, cycles = closes.tolist(), [-1] * len(names), []
        for start in starts.tolist():
            parent[start], level, depth, end = start, [start], 0, None
            while level and (most is None or depth < most):
                depth += 1
                end = next((v for v in level if closes[v]), None)
                if end is not None:
                    break
                beyond = []
                for v in level:
                    for w in to[at[v] : at[v + 1]]:
                        if parent[w] < 0:
                            parent[w] = v
                            beyond.append(w)
                level = sorted(beyond)
            if end is not None:
                cycle = [end]
                while cycle[-1] != start:
                    cycle.append(parent[cycle[-1]])
                cycles.append((int(group[start]), cycle[::-1]))
        flat = names.take(pa.array([v for _, c in cycles for v in c], pa.int64()))
        bounds = pa.array(np.cumsum([0, *(len(c) for _, c in cycles)]), pa.int32())
        return pa.table({"component": names.take(pa.array([g for g, _ in cycles], pa.int64())), "cycle": pa.ListArray.from_arrays(bounds, flat)})

    return task


def witness_cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(component, cycle, length): for each strongly connected component with a cycle, a shortest one through its least node, which it starts with.

    Among several it is the one whose nodes, from the last one back, are the smallest. Components whose shortest one has more than `most` nodes are left out
    if that is given. Components are dealt into blocks as in cyclic_nodes, greater ones go through frontiers.
    """
    small, large = blocks(written(cyclic_edges(edges)), "component")
    kind = small.schema["src"].dataType.simpleString()
    found = _in_blocks(small.select("src", "dst", "component", "block"), _shortest(most), f"component {kind}, cycle array<{kind}>")
    large = written(large.select("src", "dst", "component"))
    if not large.isEmpty():
        found = found.unionByName(witnesses_by_frontiers(large, most))
    return found.withColumn("length", F.size("cycle").cast("long"))


def witnesses_by_frontiers(inner: DataFrame, most: int | None = None) -> DataFrame:
    """(component, cycle) of edges(src, dst, component) of any size.

    Frontiers spread over the component's edges from the least node, each node with the smallest node that reached it
    first; when one closes the cycle, the component stops. The way back then follows these parents, a step for all
    components at once. Both loops take as many rounds as the longest such cycle has nodes, and move no graph but its frontier.
    """
    start = written(inner.groupBy("component").agg(F.min("src").alias("start")))
    inner = written(inner.join(start, "component"))
    closing = inner.where("dst = start").select("component", F.col("src").alias("node"), "start")
    frontier = seen = written(start.select("component", F.col("start").alias("node"), F.lit(None).cast(inner.schema["src"].dataType).alias("parent")))
    open_, walks, depth = start, None, 0
    while True:
        depth += 1
        ends = frontier.join(closing, ["component", "node"]).groupBy("component").agg(F.min("node").alias("node"), F.first("start").alias("start"))
        ends = written(ends.select("component", "start", F.array("node").alias("cycle"), F.col("node").alias("at")))
        walks = ends if walks is None else walks.unionByName(ends)
        open_ = written(open_.join(ends.select("component"), "component", "left_anti"))
        if open_.isEmpty() or depth == most:
            break
        step = inner.join(frontier.join(open_.select("component"), "component", "left_semi").select("component", F.col("node").alias("src")), ["component", "src"])
        step = step.groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = written(step.join(seen.select("component", "node"), ["component", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
        if depth % 10 == 0:
            seen, walks = written(seen), written(walks)
    parents, walks, done = seen.select("component", F.col("node").alias("at"), "parent"), written(walks), None
    while True:
        whole = walks.where("at = start")
        done = written(whole if done is None else done.unionByName(whole))
        back = walks.where("at <> start").join(parents, ["component", "at"])
        walks = written(back.select("component", "start", F.concat(F.array("parent"), "cycle").alias("cycle"), F.col("parent").alias("at")))
        if walks.isEmpty():
            return done.select("component", "cycle")


def cycle_type(length) -> F.Column:
    return F.when(length == 1, "self").when(length == 2, "mutual").otherwise("complex")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours."""
    one = edges.select("src", "dst").distinct()
    ins = one.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    outs = one.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    return ins.join(outs, "node", "full").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def roles(edges: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """(node, role): entry, orphan, shared (two callers and more), leaf or inner."""
    reached = call_depth(edges, entries, most).select("node", F.lit(True).alias("reached"))
    marked = degrees(edges).join(entries.select("node").distinct().withColumn("entry", F.lit(True)), "node", "left").join(reached, "node", "left")
    role = F.when(F.col("entry"), "entry").when(F.col("reached").isNull(), "orphan").when(F.col("fan_in") > 1, "shared").when(F.col("fan_out") == 0, "leaf").otherwise("inner")
    return marked.select("node", role.alias("role"))


def expand(edges: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """(root, trail, node, depth, mark): recursive expansion of calls below each entry.

    A call of a node that is on its own trail is marked "cycle" and not expanded; one at
    `most` is marked "depth limit" if it calls on.
    """
    one = edges.select("src", "dst").distinct()
    calls = one.select(F.col("src").alias("caller")).distinct()
    now = entries.select(F.col("node").alias("root"), F.array("node").alias("trail"), "node", F.lit(0).cast("long").alias("depth"), F.lit("").alias("mark"))
    out = now
    for depth in range(1, most + 1):
        nexts = now.where("mark = ''").join(one, F.col("node") == F.col("src"))
        mark = F.when(F.array_contains("trail", F.col("dst")), "cycle")
        if depth == most:
            nexts = nexts.join(calls, F.col("dst") == F.col("caller"), "left")
            mark = mark.when(F.col("caller").isNotNull(), "depth limit")
        now = nexts.select("root", F.concat("trail", F.array("dst")).alias("trail"), F.col("dst").alias("node"), F.lit(depth).cast("long").alias("depth"), mark.otherwise("").alias("mark"))
        out = out.unionByName(now)
    return out
