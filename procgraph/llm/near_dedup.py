"""MinHash near-dedup: an inverted join over signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import cut, doc_text, mix
from procgraph.llm.components import connected_components
from procgraph.llm.substrings import window_hashes
from procgraph.llm.token_ids import WordMemory, hash_words, ragged, text_batches, texts_of, words_in


#: Ids (8 bytes each) up to which the ids whose full sets are read are broadcast; beyond, texts are dealt by id.
MOST_BROADCAST = 4_000_000
#: Ids, and shingles of full sets, that one tile holds (about 2 and 20 MB), and ids that it is asked by; larger groups have more tiles.
TILE = 4096
TILE_SHINGLES = 1_000_000
TILE_ASKS = 4096
#: Further rounds in which each component of a posting list is held against the largest by one pair of members, before all members meet.
ROUNDS = 1


@dataclass(frozen=True)
class Rule:
    """What is near: `width` words a shingle, similarity of `percent` hundredths and more.

    Signatures have `coordinates` values; pairs that agree in fewer than
    `matches` aren't looked at. At 0.8, 64 coordinates and 36 matches that
    loses a pair with a probability below 1 in 100,000.
    """

    width: int = 5
    percent: int = 80
    coordinates: int = 64
    matches: int = 36

    @property
    def beyond(self) -> int:
        """Coordinates besides the prefix: two that agree in `matches` share one among the rarest coordinates - matches + 1."""
        return self.matches - 1


def lower(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, by bytes."""
    joined = texts.buffers()[2]
    if joined is None or not len(texts):
        return texts
    data = pa.py_buffer(joined.to_pybytes().lower())
    return pa.Array.from_buffers(texts.type, len(texts), [texts.buffers()[0], texts.buffers()[1], data], offset=texts.offset)


class Shingles:
    """Sorted distinct 64-bit shingle hashes of the texts of an Arrow batch."""

    def __init__(self, width: int):
        self.width, self.memory = width, WordMemory(hash_words, 400_000)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        codes, offsets, words = words_in(lower(texts))
        hashes = np.array(self.memory(words.to_pylist()), np.uint64)[codes]
        runs = window_hashes(hashes, self.width)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= self.width:
                yield np.unique(runs[a : b - self.width + 1])
            elif b > a:
                yield mix(window_hashes(hashes[a:b], b - a) + np.uint64(b - a))  # the whole sequence as one shingle
            else:
                yield np.empty(0, np.uint64)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128-bit digest of the whole set, null for an empty one) and the signature."""
    seeds = mix(np.arange(1, rule.coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def sign(s: np.ndarray) -> bytes:
        out = np.full(rule.coordinates, 2**32 - 1, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 4096):
                part = mix(s[at : at + 4096])
                out = np.minimum(out, ((part[None, :] * seeds[:, None]) >> np.uint64(32)).min(1))
        return out.astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingles(rule.width)
        for table in text_batches(batches):
            sets = list(shingles(texts_of(table)))
            keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(sizes), pa.array(keys[:, 0], mask=none), pa.array(keys[:, 1], mask=none), pa.array([sign(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "signature"],
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, signature binary")


def full_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, set): the sorted 64-bit shingle hashes of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(rule.width)
        for table in text_batches(batches):
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array([s.tobytes() for s in shingles(texts_of(table))], pa.binary())], names=["doc_id", "set"])

    return doc_text(docs).mapInArrow(run, "doc_id long, set binary")


def coordinates_of(classes: DataFrame, rule: Rule) -> DataFrame:
    """(token, id): the coordinate-value pairs of every signature, a coordinate in the upper bits of the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.arange(rule.coordinates, dtype=np.int64) << 32
        for batch in batches:
            values = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u4").reshape(-1, rule.coordinates).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((values + upper).reshape(-1)), pa.array(np.repeat(batch["id"].to_numpy(), rule.coordinates))], names=["token", "id"])

    return classes.select("id", "signature").mapInArrow(run, "token long, id long")


def postings(classes: DataFrame, rule: Rule) -> DataFrame:
    """(token, id, posted) of prefixes, posted with one bit for each coordinate in the prefix (0 for a repeated id): each signature's rarest coordinates, without those that no other signature has.

    Tokens are ordered by how many signatures have them, then by value, alike in
    all signatures. A token that stands alone fills a place of the prefix but
    pairs with nothing; so of m shared ones the rarest m - (matches - 1) are posted.
    """
    tokens = coordinates_of(classes, rule)
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))  # at most `coordinates` a list
    alone = F.size("held") == F.size(F.array_distinct(F.transform("held", lambda t: F.shiftright(t.token, 32))))  # else rows with several texts repeat the id
    n = F.size("held") - rule.beyond
    held = held.where(n > 0).select("id", alone.alias("alone"), F.slice("held", F.lit(1), n).alias("held"))
    bit = lambda token: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(token, 32).cast("int"))
    bits = F.aggregate("held", F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(bit(t.token)))
    held = held.withColumn("posted", F.when(F.col("alone"), bits).otherwise(0))
    return held.select("id", "posted", F.explode("held").alias("t")).select(F.col("t.token").alias("token"), "id", "posted")


def candidates(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of near sizes that agree in enough coordinates."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    return near.where((100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")) & agree(F.col("s_a"), F.col("s_b"), rule)).select("a", "b")


def sets_of(ids: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, set) of the given ids, read from the texts anew: reading costs less than moving the sets of ids that no candidate has."""
    wanted = cut(ids.select(F.col("id").alias("doc_id")).distinct())
    few = wanted.count() <= MOST_BROADCAST
    return cut(full_sets(docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), rule).withColumnRenamed("doc_id", "id"))


def confirmed(near: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return near.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def agree(one: Column, two: Column, rule: Rule) -> Column:
    """Whether two signatures agree in enough coordinates."""

    @F.arrow_udf("boolean")
    def enough(x: pa.Array, y: pa.Array) -> pa.Array:
        values = [np.frombuffer(b"".join(s.to_pylist()), "<u4").reshape(-1, rule.coordinates) for s in (x, y)]
        return pa.array((values[0] == values[1]).sum(1) >= rule.matches)

    return enough(one, two)


def tiles(batches: Iterator[pa.RecordBatch], meet) -> Iterator[pa.RecordBatch]:
    """meet(members, others) for the rows of each tile, sorted by (tile, side): members (side 0) are held, others (side 1) stream by."""
    tile, held, members = None, [], None
    for batch in batches:
        keys, sides = batch["tile"].to_numpy(), batch["side"].to_numpy()
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
            if start == end:
                continue
            if keys[start] != tile:
                tile, held, members = keys[start], [], None
            if sides[start] == 0:
                held.append(batch.slice(start, end - start))
            elif held:
                members = members or pa.Table.from_batches(held).combine_chunks()
                yield from meet(members, batch.slice(start, end - start))


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tile").sortWithinPartitions("tile", "side")


class Spanning:
    """Labels of a tile's members, joined as rows touch them: a row yields one member of each label it touches, which then are one.

    So all rows of a tile yield no more than rows and members together, however many pairs touch.
    """

    def __init__(self, labels: np.ndarray):
        self.labels = np.unique(labels, return_inverse=True)[1]

    def join(self, touched: np.ndarray) -> np.ndarray:
        found, first = np.unique(self.labels[touched], return_index=True)
        if len(found) > 1:
            self.labels[np.isin(self.labels, found)] = found[0]
        return touched[first]


def meetings(several: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(id, own, component): ids, their component and others that hold a member which agrees with them in enough coordinates.

    Not all such components are named, but so many that, over `own` and
    `component` as edges, all are connected that meet.

    several has (token, id, posted, component, main, n) of posting lists of n ids. Those
    outside a list's main component meet all others, in tiles of about TILE
    members; of two outside it the one with the larger component is asked. Two
    ids that meet in several lists count in the one of the lowest coordinate.
    """
    # one signature moves for each posting, not two for each pair
    signed = several.join(classes.select("id", "n_shingles", "signature"), "id").withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    names = ["tile", "side", "id", "component", "main", "n_shingles", "posted", "at", "signature"]
    signed = signed.withColumn("at", F.shiftright("token", 32).cast("long"))
    members = signed.withColumn("side", F.lit(0)).withColumn("tile", F.xxhash64("token", F.pmod(F.xxhash64("id"), F.col("parts"))))
    asked = signed.where("component <> main").withColumn("side", F.lit(1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.withColumn("tile", F.xxhash64("token", F.col("part").cast("long")))

    def numbers(rows) -> tuple:
        column = lambda c: rows[c].combine_chunks() if isinstance(rows, pa.Table) else rows[c]
        return *(column(c).to_numpy() for c in names[2:8]), np.frombuffer(b"".join(column("signature").to_pylist()), "<u4").reshape(-1, rule.coordinates)

    known = [None, None, None]

    def meet(held, others):
        if known[0] is not held:
            members = numbers(held)
            known[:] = held, members, Spanning(members[1])
        _, theirs, _, sizes, posts, _, values = known[1]
        ids, own, main, n, posted, where, signatures = numbers(others)
        bits = np.int64(1) << np.arange(rule.coordinates)
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            allowed = (own[part, None] != theirs) & ((theirs == main[part, None]) | (own[part, None] > theirs))
            allowed &= 100 * np.minimum(n[part, None], sizes) >= rule.percent * np.maximum(n[part, None], sizes)
            x, y = np.nonzero(allowed)
            for some in range(0, len(x), 20_000):
                i, j = x[some : some + 20_000], y[some : some + 20_000]
                same = signatures[part][i] == values[j]
                shared = same & ((posted[part][i] & posts[j])[:, None] & bits != 0)
                near = (same.sum(1) >= rule.matches) & ((shared.argmax(1) == where[part][i]) | ~shared.any(1))
                i, j = i[near], j[near]
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                named = [known[2].join(touched) for touched in np.split(j, starts[1:])] if len(i) else []
                if named:
                    who = np.repeat(i[starts], [len(x) for x in named])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][who]), pa.array(own[part][who]), pa.array(theirs[np.concatenate(named)])], names=["id", "own", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tiles(batches, meet)

    return dealt(members.select(*names).unionByName(asked.select(*names))).mapInArrow(run, "id long, own long, component long").distinct()


def gathered(wanted: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(tile, side, id, component, set): the ids of wanted beside the members of their group.

    wanted has (id, group) and members (id, component, group, n_shingles). A group's full sets are held in tiles of about
    TILE_SHINGLES, and meet about TILE_ASKS ids at once.
    """
    asks = wanted.groupBy("group").agg(F.ceil(F.count("*") / TILE_ASKS).alias("askers"))
    shape = members.join(asks, "group").groupBy("group").agg(F.ceil(F.sum("n_shingles") / TILE_SHINGLES).alias("parts"), F.first("askers").alias("askers"))
    shape = cut(shape)
    counted = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = F.pmod(F.xxhash64("id"), F.col("parts")), F.pmod(F.xxhash64("id"), F.col("askers"))
    held = members.join(shape, "group").withColumn("asker", counted("askers")).select(F.xxhash64("group", place[0], "asker").alias("tile"), F.lit(0).alias("side"), "id", "component")
    asked = wanted.join(shape, "group").withColumn("part", counted("parts")).select(F.xxhash64("group", "part", place[1]).alias("tile"), F.lit(1).alias("side"), "id", F.lit(None).cast("long").alias("component"))
    return held.unionByName(asked).join(sets, "id")


def linked(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links between ids and members of a tile, enough to join all components that have one.

    An id's shingles are counted against the whole tile, so near misses never leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [None, ()]

        def meet(held, others):
            if known[0] is not held:
                each = [np.frombuffer(x, np.uint64) for x in held["set"].to_pylist()]
                values, owners = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
                order = np.argsort(values, kind="stable")
                known[:] = held, (values[order], owners[order], np.array([len(x) for x in each]), held["id"].to_numpy(), Spanning(held["component"].to_numpy()))
            values, owners, sizes, ids, spanning = known[1]
            pairs = []
            for x, data in zip(others["id"].to_pylist(), others["set"].to_pylist()):
                own = np.frombuffer(data, np.uint64)
                start = np.searchsorted(values, own)
                both = np.bincount(owners[ragged(start, np.searchsorted(values, own, "right") - start)], minlength=len(sizes))
                near = np.flatnonzero(100 * both >= rule.percent * (len(own) + sizes - both))
                pairs += [(x, y) for y in ids[spanning.join(near)].tolist() if x != y] if len(near) else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pairs)], names=["a", "b"])

        return tiles(batches, meet)

    return dealt(rows.select("tile", "side", "id", "component", "set")).mapInArrow(run, "a long, b long")


def links(classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, component) of classes with a near one.

    Each posting list is first tied to its smallest id, a star and not all
    pairs; in ROUNDS more, one member of each component that is left in a list is held against one of the
    list's largest. Lists that then still hold several components are settled in full,
    but only between components: an id outside the list's largest one asks for others. Components that meet so,
    directly or through others, are a group, and its full sets are compared tile by tile. So everything that could join
    two components is checked, and rows grow with members, not with pairs.
    """
    lists = postings(classes, rule)
    heads = lists.groupBy("token").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("token", "a")
    lists = cut(lists.join(heads, "token"))
    ids = cut(lists.select("id").distinct())
    pairs, found, sets = lists.where("id <> a").select("a", F.col("id").alias("b")).distinct(), None, None
    for turn in range(ROUNDS + 1):
        near = cut(candidates(pairs, classes, rule))
        wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        more = sets_of(wanted.join(sets, "id", "left_anti") if sets else wanted, docs, rule)
        sets = sets.unionByName(more) if sets else more
        new = confirmed(near, sets, rule)
        found = cut(found.unionByName(new) if found else new)
        members = cut(ids.join(connected_components(found), "id", "left").withColumn("component", F.coalesce("component", "id")))
        marked = lists.select("token", "id", "posted").join(members, "id")
        pick = F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("b")
        by_list = cut(marked.groupBy("token", "component").agg(F.count("*").alias("n"), pick))
        main = by_list.groupBy("token").agg(F.max_by(F.struct("component", "b"), F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
        main = cut(main.select("token", F.col("main.component").alias("main"), F.col("main.b").alias("a"), "n"))
        pairs = by_list.drop("n").join(main, "token").where("component <> main").select("a", "b").distinct()
    several = marked.join(main.select("token", "main", "n"), "token")
    asks = cut(meetings(several, classes, rule))
    met = connected_components(asks.select(F.col("own").alias("a"), F.col("component").alias("b")))
    met = cut(met.select(F.col("id").alias("component"), F.col("component").alias("group")))
    grouped = cut(members.join(met, "component").join(classes.select("id", "n_shingles"), "id").select("id", "component", "group", "n_shingles"))
    wanted = asks.select("id", F.col("own").alias("component")).distinct().join(met, "component").select("id", "group")
    sets = sets.unionByName(sets_of(grouped.select("id").join(sets, "id", "left_anti"), docs, rule))
    more = linked(gathered(wanted, grouped, sets), rule)
    return connected_components(found.unionByName(more))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Words are lower-cased (A-Z) runs without ASCII white space; a text's set is
    its distinct shingles of rule.width words, or the whole text if it is
    shorter. Documents are linked at a similarity of rule.percent hundredths;
    component_id is the smallest doc_id reachable, and kept the documents that
    have their own.

    Equal sets are one class from the start, so exact copies never meet as
    pairs. Texts without words (null ones too) are linked with nothing. Rows
    that repeat a doc_id are one document: a link of any of them links it. A
    null doc_id is linked with nothing and kept. An empty table gives
    none; other columns aren't read.
    """
    docs = doc_text(docs)
    signed = cut(signatures(docs, rule))
    classes = cut(
        signed.where("s1 is not null and doc_id is not null").groupBy("s1", "s2")
        .agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
    )
    near = links(classes, docs, rule)
    named = classes.join(near, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    joined = signed.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of docs, all columns, that stay: one document of each group."""
    gone = near_duplicates(docs, rule).where("not kept").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))  # so that no column clashes
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
