"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling over the whole corpus."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import doc_text, mix, planes, unplanes
from procgraph.llm.near_dedup import lower
from procgraph.llm.token_ids import hash_words, strings, text_batches, texts_of, words_in

#: The token that ends every text, and what stands before the first one.
END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A27)
#: -log10 of a probability travels as an integer of this many parts of one.
FIXED = 2.0**16
ROWS = "dest long, source long, kind int, data binary"
#: Kinds of rows: pairs of a slice, what a bucket and a root group tell each other, what a bucket keeps for itself.
PAIRS, TO_ROOT, FROM_ROOT, OWN, SCORES = range(5)
#: Root groups: a bucket sends each one row a sweep, so rows grow with the buckets alone.
MOST_GROUPS = 64
#: Customers of a dish up to which its number of tables is drawn from a table of Stirling numbers.
TABULATED = 1024
#: Documents looked at for contexts that are spread over all buckets. The results don't depend on which these are.
SAMPLED_DOCS = 20_000
#: Dishes whose tables are drawn at once.
DISHES = 250_000


@dataclass(frozen=True)
class Model:
    """Discounts and strengths of the two levels, sweeps, and the sizes that work is cut into.

    Each previous word, as a 64-bit hash, has a context restaurant; all share the root as their parent,
    whose own parent is uniform over the known words and one unknown. slice_bytes and bucket_bytes of
    text bound what a task holds; scores don't depend on them.
    """

    discount: float = 0.8
    strength: float = 2.0
    root_discount: float = 0.7
    root_strength: float = 10.0
    burn_in: int = 1
    samples: int = 2
    slice_bytes: int = 8 << 20
    bucket_bytes: int = 28 << 20


def is_held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text is divisible by 10; a null id is "null"."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays, by byte planes and compressed."""
    out = []
    for a in arrays:
        out += [np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], "<i8").tobytes(), planes(a)]
    data = b"".join(out)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpack(data: bytes | pa.Buffer) -> list[np.ndarray]:
    out, at, data = [], 0, memoryview(data)
    data = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    while at < len(data):
        kind, size, n = np.frombuffer(data[at : at + 24], "<i8").tolist()
        at += 24
        out.append(unplanes(data[at : at + size * n], f"<{chr(kind)}{size}"))
        at += size * n
    return out


def table(rows: list[tuple]) -> pa.Table:
    dest, source, kind, data = zip(*rows) if rows else [[]] * 4
    return pa.table({"dest": pa.array(dest, pa.int64()), "source": pa.array(source, pa.int64()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


def messages(rows: pa.Table, kind: int) -> list[tuple[int, pa.Buffer]]:
    """(source, data) of the rows of a kind, by source; data isn't copied."""
    at = np.flatnonzero(rows["kind"].to_numpy() == kind)
    source = rows["source"].to_numpy()[at]
    order = np.argsort(source, kind="stable")
    return [(n, rows["data"][i].as_buffer()) for n, i in zip(source[order].tolist(), at[order].tolist())]


# Draws: functions of a key alone, so that a lost task draws the same again and buckets of any size draw alike


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) by key."""
    with np.errstate(over="ignore"):
        return ((mix(key + np.uint64(salt % 2**64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) + 0.5) * 2.0**-53


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series at x + 8, stepped back."""
    y = x + 8.0
    back = x.copy()
    for i in range(1, 8):
        back *= x + i
    s = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / y - np.log(back)


def gamma(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma(shape, 1) draws for shape >= 1, by Marsaglia and Tsang."""
    out, left, turn = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        k, d = key[left], shape[left] - 1 / 3
        u = [uniform(k, salt + 7 * turn + i) for i in range(3)]
        x = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
        v = (1 + x / np.sqrt(9 * d)) ** 3
        good = v > 0
        good[good] = np.log(u[2][good]) < 0.5 * x[good] ** 2 + d[good] * (1 - v[good] + np.log(v[good]))
        out[left[good]] = (d * v)[good]
        left, turn = left[~good], turn + 1
    return out


@cache
def log_stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t): ways to seat c customers at t tables, weighed by the discount."""
    out = np.full((TABULATED + 1, TABULATED + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, TABULATED):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = np.logaddexp(out[c, :c], out[c, 1 : c + 1] + np.log(c - discount * t))
        out[c + 1, c + 1] = 0.0
    return out


def crp_tables(c: np.ndarray, a: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of c customers in a restaurant of strength a, customer by customer: the wait for the next new table has a closed form."""
    t, n = np.ones(len(c)), np.ones(len(c))
    active = np.flatnonzero(n < c)
    turn = 0
    while len(active):
        end, now, open_, s = c[active].astype(float), n[active], t[active], a[active]
        goal = np.log(uniform(key[active], salt + turn)) + log_gamma(now - discount * open_) - log_gamma(s + now)
        stays = lambda m: log_gamma(m - discount * open_) - log_gamma(s + m) >= goal  # noqa: B023, E731  no new table before the m-th is seated
        low, high = now, end
        done = stays(end)
        for _ in range(int(np.ceil(np.log2(max(2.0, (end - now).max())))) + 1):
            middle = np.floor((low + high) / 2)
            up = stays(np.maximum(middle, now))
            low, high = np.where(up, np.maximum(middle, low), low), np.where(up, high, np.minimum(middle, high))
        high = np.maximum(high, now + 1)
        n[active], t[active] = np.where(done, end, high), open_ + ~done
        active, turn = active[n[active] < c[active]], turn + 1
    return t.astype(np.int64)


def tabulated(c: np.ndarray, log_g: np.ndarray, u: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes with 2 to TABULATED customers, from the weights of every number of tables.

    The n-th customer opens one with a probability below g / ((1 - discount) n), so the tables after the first are rarer than
    in a Poisson law of that mean: weights go as far as it leaves more than 1e-17, with most dishes to a few tables.
    """
    tables, logs = np.ones(len(c), np.int64), log_stirling(discount)
    log_mean = log_g - math.log(1 - discount) + np.log(1 + np.log(c))
    ladder = np.unique(np.concatenate([[2, 3], np.round(4 * 1.3 ** np.arange(23)).astype(int), [TABULATED]]))
    wide = np.full(len(c), TABULATED)
    for k in ladder[::-1]:
        wide[(k * (1 + log_mean - math.log(k)) < -39) & (log_mean < math.log(k))] = k
    wide = ladder[np.searchsorted(ladder, np.minimum(wide, c))]
    order = np.argsort(wide, kind="stable")
    edges = np.searchsorted(wide[order], ladder), np.searchsorted(wide[order], ladder, "right")
    for k, first, last in zip(ladder.tolist(), *(e.tolist() for e in edges)):
        for at in range(first, last, max(1, 400_000 // k)):
            some = order[at : min(at + max(1, 400_000 // k), last)]
            w = logs[c[some], 1 : k + 1] + log_g[some, None] * np.arange(1, k + 1)
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            tables[some] = 1 + (w[:, :-1] < (u[some] * w[:, -1])[:, None]).sum(1)
    return tables


def by_series(c: np.ndarray, log_g: np.ndarray, mean: np.ndarray, u: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes with many customers and mean numbers of tables well below c^discount.

    S(c, t) = sum_j (-1)^j C(t, j) (-j discount)_c / (discount^t t!) then converges fast. The number of tables is a
    sum of independent indicators, so its variance is at most its mean and nine deviations about it hold all.
    """
    tables = np.ones(len(c), np.int64)
    wide = np.ceil(9 * np.sqrt(mean) + 12).astype(np.int64)
    low = np.maximum(1, np.floor(mean).astype(np.int64) - wide)
    width = np.minimum(np.floor(mean).astype(np.int64) + wide, c) - low + 1
    order, at = np.argsort(width, kind="stable"), 0
    all_j = np.arange(1, 225)
    of_all = log_gamma(all_j * discount + 1.0) - log_gamma(all_j + 1.0)
    all_signs = -np.sin(np.pi * all_j * discount) * np.where(all_j % 2, -1.0, 1.0)
    ratio = (low + width) / c.astype(float) ** discount  # of terms that follow each other, about
    while at < len(order):
        some = order[at : at + max(1, int(1_000_000 // (128 * width[order[min(at + 200, len(order) - 1)]])))]
        at += len(some)
        terms = next(n for z, n in ((0.08, 16), (0.3, 32), (0.8, 64), (1.4, 128), (np.inf, 224)) if ratio[some].max() <= z)
        j, of_j, sign = all_j[:terms], of_all[:terms], all_signs[:terms]
        t = low[some, None] + np.arange(width[some].max())
        upto = (np.arange(t.shape[1]) < width[some, None]) & (t <= c[some, None])
        t = np.minimum(t, c[some, None]).astype(float)
        n = c[some, None].astype(float)
        of_c = log_gamma(np.maximum(n - j * discount, 0.1)) - log_gamma(n)
        choose = log_gamma(t + 1)[:, :, None] - log_gamma(np.maximum(t[:, :, None] - j + 1, 1.0))
        total = (np.exp(choose + (of_c + of_j)[:, None, :]) * sign * (t[:, :, None] >= j)).sum(2)
        w = np.log(np.maximum(total, 1e-300)) + t * (log_g[some, None] - math.log(discount)) - log_gamma(t + 1)
        w = np.where(upto & (total > 0), w, -np.inf)
        w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
        tables[some] = low[some] + (w[:, :-1] < (u[some] * w[:, -1])[:, None]).sum(1)
    return tables


def by_rejection(c: np.ndarray, log_g: np.ndarray, a: np.ndarray, key: np.ndarray, discount: float, salt: int) -> np.ndarray:
    """Tables drawn in restaurants of strength a, t accepted with probability w(t) / max w, w(t) = g^t / prod_{0<k<t} (a + discount k)."""
    tables = np.ones(len(c), np.int64)
    weigh = lambda t, a, log_g: t * log_g - (t - 1) * math.log(discount) - log_gamma(a / discount + t) + log_gamma(a / discount + 1)
    best = weigh(np.clip(np.ceil((np.exp(log_g) - a) / discount), 1, c), a, log_g)
    waiting, turn = np.arange(len(c)), 0
    while len(waiting):
        t = crp_tables(c[waiting], a[waiting], discount, key[waiting], salt + 1_000_003 * (2 * turn + 1))
        good = np.log(uniform(key[waiting], salt + 1_000_003 * (2 * turn + 2))) <= weigh(t.astype(float), a[waiting], log_g[waiting]) - best[waiting]
        tables[waiting[good]] = t[good]
        waiting, turn = waiting[~good], turn + 1
    return tables


def draw_tables(c: np.ndarray, g: np.ndarray, key: np.ndarray, discount: float, salt: int) -> np.ndarray:
    """A number of tables for each dish, from P(t) in proportion to S(c, t) g^t: exact at every c.

    Up to TABULATED customers the weights come from a table of Stirling numbers; beyond, from a series where that
    converges, else by rejection. Both need the strength a of the restaurant that has the same mean: g = a + discount * E[t].
    """
    tables, u, log_g = np.minimum(c, 1), uniform(key, salt), np.log(g)
    few, many = np.flatnonzero((c > 1) & (c <= TABULATED)), np.flatnonzero(c > TABULATED)
    tables[few] = tabulated(c[few], log_g[few], u[few], discount)
    if not len(many):
        return tables
    n = c[many].astype(float)
    low, high = np.full(len(many), -discount), g[many] + 1.0
    for _ in range(60):  # log(a + discount E[t]) grows with a
        a = (low + high) / 2
        small = log_gamma(a + n + discount) + log_gamma(a + 1) - log_gamma(a + n) - log_gamma(a + discount) < log_g[many]
        low, high = np.where(small, a, low), np.where(small, high, a)
    a = np.maximum((low + high) / 2, -discount * (1 - 1e-9))
    mean = np.clip((g[many] - a) / discount, 1, n)
    calm = mean + 9 * np.sqrt(mean) + 12 <= 2 * n**discount
    one, two = many[calm], many[~calm]
    tables[one] = by_series(c[one], log_g[one], mean[calm], u[one], discount)
    tables[two] = by_rejection(c[two], log_g[two], a[~calm], key[two], discount, salt)
    return tables


def salt(sweep: int) -> int:
    return (sweep + 1) << 40


# Texts to pairs


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """The batches of a task gathered in tables of about most_bytes of text."""
    held, size = [], 0
    for part in text_batches(batches, most_bytes // 4):
        held.append(part)
        size += pc.sum(pc.binary_length(part["text"])).as_py() or 0
        if size >= most_bytes * 3 // 4:
            yield pa.concat_tables(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(slice, data): doc_ids, numbers of words, distinct words as hashes, the most frequent first, and each word's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, rows in enumerate(slices(batches, model.slice_bytes)):
            codes, offsets, words = words_in(lower(texts_of(rows)))
            hashes, place = np.unique(np.array(hash_words(strings(words)), np.uint64), return_inverse=True)
            codes = place[codes]
            order = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")  # frequent words have small codes, which compress
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            ids = np.array([-(2**63) if x is None else x for x in rows["doc_id"].to_pylist()], np.int64)
            data = pack(ids, np.diff(offsets).astype(np.uint32), hashes[order], rank[codes])
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([data], pa.binary())], names=["slice", "data"])

    return doc_text(docs).mapInArrow(run, "slice long, data binary")


def ordered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ascending order of keys, equal ones by place; the keys in that order), for keys from 0 and below most.

    Key and place are sorted as one number where they fit into one, in a part of the time that sorting places by keys takes.
    """
    bits = max(1, len(keys) - 1).bit_length()
    if most << bits >= 1 << 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = keys << bits
    both |= np.arange(len(keys))
    both.sort()
    order = both & ((1 << bits) - 1)
    both >>= bits
    return order, both


class Slice:
    """The tokens of a slice and its distinct (context, word) pairs, by bucket; the same wherever it is made."""

    def __init__(self, data: bytes, buckets: int, spread: np.ndarray):
        self.ids, n, hashes, codes = unpack(data)
        order = np.argsort(hashes)  # lists in the order of hashes compress
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, codes, n = hashes[order], rank[codes], n.astype(np.int64)
        ends = np.cumsum(n + 1) - 1
        total = int(ends[-1]) + 1 if len(ends) else 0
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        self.hashes = np.concatenate([hashes, [END, START]])  # END and START have the last two codes
        word = np.full(total, len(hashes), np.int64)
        word[~is_end] = codes
        before = np.empty(total, np.int64)
        before[1:] = word[:-1]
        before[np.concatenate([[0], ends[:-1] + 1]).astype(int)] = len(hashes) + 1
        self.n_tokens, self.doc = n + 1, np.repeat(np.arange(len(n)), n + 1)
        order, pairs = ordered(before * len(self.hashes) + word, len(self.hashes) ** 2)
        new = np.ones(total, bool)
        np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
        inverse = np.empty(total, np.int64)
        inverse[order] = np.cumsum(new) - 1
        context, word = np.divmod(pairs[new], len(self.hashes))
        key = mix(self.hashes)[context]
        hot = np.isin(self.hashes, spread)[context]
        key[hot] = pair_key(self.hashes[word[hot]], self.hashes[context[hot]])
        bucket = (key % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # short ones are sorted by their digits
        order = np.argsort(bucket, kind="stable")
        self.context, self.word, self.edges = context[order], word[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[inverse]  # of each token

    def trains(self) -> np.ndarray:
        return np.array([not is_held_out(None if x == -(2**63) else x) for x in self.ids.tolist()], bool)

    def rows(self, name: int) -> list[tuple]:
        """One row a bucket: contexts with the lengths of their runs of pairs, words, and training counts."""
        count = np.bincount(self.pair, self.trains()[self.doc], len(self.word)).astype(np.uint32)
        out = []
        for b in range(len(self.edges) - 1):
            a, z = self.edges[b], self.edges[b + 1]
            if a == z:
                continue
            context, word = self.context[a:z], self.word[a:z]
            starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            words, place = np.unique(word, return_inverse=True)
            runs = np.diff(np.append(starts, z - a)).astype(np.uint32)
            out.append((b, name, PAIRS, pack(self.hashes[context[starts]], runs, self.hashes[words], place.astype(np.uint32), count[a:z])))
        return out

    def words_of(self, b: int) -> np.ndarray:
        return np.unique(self.word[self.edges[b] : self.edges[b + 1]])


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word * np.uint64(0x9E3779B97F4A7C15) + context + np.uint64(1))


def spread_contexts(docs: DataFrame, model: Model, rows: int, buckets: int) -> np.ndarray:
    """Contexts with more than half a bucket of a sample's tokens (so at most two for each bucket): their pairs go to all buckets, not to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, model.slice_bytes):
            codes, offsets, words = words_in(lower(texts_of(part)))
            n = np.bincount(codes, minlength=len(words))
            often = np.flatnonzero(n * 4 * buckets >= n.sum())
            found = np.array(hash_words([words[int(i)].as_py() for i in often]) + [int(START)], np.uint64).view(np.int64)
            total = int(n.sum()) + len(part)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.append(n[often], len(part))), pa.array(np.append(np.zeros(len(often), np.int64), total))], names=["context", "n", "total"])

    part = doc_text(docs).sample(min(1.0, SAMPLED_DOCS / max(1, rows)), 17).mapInArrow(run, "context long, n long, total long")
    found = part.groupBy("context").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    total = found.agg(F.sum("total")).first()[0] or 0
    often = [r["context"] for r in found.where(F.col("n") * 2 * buckets > total).collect()]  # n adds up to total: at most 2 * buckets
    return np.array(sorted(often), np.int64).view(np.uint64)


# Restaurants


class Bucket:
    """A bucket's pairs with their training counts: all pairs of its contexts, and a part of the pairs of those that are spread."""

    def __init__(self, rows: pa.Table, model: Model, groups: int, spread: np.ndarray):
        self.model, self.groups = model, groups
        told = messages(rows, PAIRS)
        names = [unpack(data)[:3] for _, data in told]  # what pairs are made of is few; pairs themselves are held by 32-bit codes
        self.words, self.contexts = distinct([x[2] for x in names]), distinct([x[0] for x in names])
        self.slices, sizes = [], [int(runs.sum()) for _, runs, _ in names]
        del names
        pairs, count, at = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.uint32), 0
        for (source, data), size in zip(told, sizes):
            context, runs, word, place, counts = unpack(data)
            code = np.searchsorted(self.words, word).astype(np.int32)
            pairs[at : at + size] = np.repeat(np.searchsorted(self.contexts, context), runs)
            pairs[at : at + size] *= len(self.words)
            pairs[at : at + size] += code[place]
            count[at : at + size] = counts
            self.slices.append((source, code, size))
            at += size
        order, pairs = ordered(pairs, len(self.contexts) * len(self.words))
        new = np.ones(len(pairs), bool)
        np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
        pairs = pairs[new]
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order, new
        self.count = np.bincount(self.pair, count, len(pairs)).astype(np.int64)
        del count
        self.context, self.word = (pairs // len(self.words)).astype(np.int32), (pairs % len(self.words)).astype(np.int32)
        self.spread = np.flatnonzero(np.isin(self.contexts, spread))
        self.edges, self.spread_edges = (np.searchsorted(group_of(x, groups), np.arange(groups + 1)) for x in (self.words, self.contexts[self.spread]))

    def runs(self) -> list[slice]:
        """Pairs by DISHES: what is computed for each takes the memory of so many, not of a bucket."""
        return [slice(at, at + DISHES) for at in range(0, len(self.count), DISHES)]

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, len(self.contexts)).astype(np.int64)

    def tell(self, name: int, tables: np.ndarray, sums: np.ndarray, counts: bool) -> list[tuple]:
        """To each root group: tables of its words (counts too if asked), both of its spread contexts. To itself: its contexts' tables."""
        of_word = np.bincount(self.word, tables, len(self.words)).astype(np.uint32)
        of_count = np.bincount(self.word, self.count, len(self.words)).astype(np.uint32)
        totals = [self.by_context(x) for x in (self.count, tables)]
        rows = [(name, name, OWN, pack(totals[1].astype(np.uint32)))]
        for g in range(self.groups):
            a, z, own = self.edges[g], self.edges[g + 1], self.spread[self.spread_edges[g] : self.spread_edges[g + 1]]
            rows.append((g, name, TO_ROOT, pack(self.words[a:z], of_word[a:z], of_count[a:z] if counts else of_count[:0], self.contexts[own], *(x[own] for x in totals), sums)))
        return rows

    def read(self, own: list[tuple], told: list[tuple]) -> dict[str, np.ndarray]:
        """The state after a sweep: of words the probability at the root, of contexts customers and tables, and the sums."""
        customers, tables, c = (np.zeros(len(self.words), np.int64) for _ in range(3))
        of_count, of_tables, sums = self.by_context(self.count), unpack(own[0][1])[0].astype(np.int64), np.zeros(4, np.int64)
        for g, data in told:
            a, z, spread = self.edges[g], self.edges[g + 1], self.spread[self.spread_edges[g] : self.spread_edges[g + 1]]
            one, two, three, counts, totals, part = unpack(data)
            sums += part
            customers[a:z], tables[a:z] = one, two
            if len(three):
                c[a:z] = three
            of_count[spread], of_tables[spread] = counts, totals
        m = self.model
        _, known, all_customers, all_tables = sums.tolist()
        rest = (m.root_strength + m.root_discount * all_tables) / (known + 1)
        root = (np.maximum(customers - m.root_discount * tables, 0) + rest) / (m.root_strength + all_customers)
        return {"root": root, "customers": of_count, "tables": of_tables, "sums": sums, "c": c}

    def seat(self, state: dict, sweep: int) -> np.ndarray:
        """The tables of every dish given the state after the sweep before.

        With X drawn from Gamma(strength / discount + tables of the restaurant), the dishes of a restaurant are
        independent given X, P(t) being in proportion to S(c, t) (discount X root)^t: two exact Gibbs steps.
        """
        m = self.model
        x = gamma(m.strength / m.discount + state["tables"], self.contexts, salt(sweep))
        tables = np.minimum(self.count, 1)  # a single customer has one table
        few, many = np.flatnonzero((self.count > 1) & (self.count <= TABULATED)), np.flatnonzero(self.count > TABULATED)
        for some in [*(few[at : at + DISHES] for at in range(0, len(few), DISHES)), many]:
            word, context = self.word[some], self.context[some]
            key = pair_key(self.words[word], self.contexts[context])
            tables[some] = draw_tables(self.count[some], m.discount * x[context] * state["root"][word], key, m.discount, salt(sweep) + (1 << 36))
        return tables

    def predictive(self, tables: np.ndarray, state: dict) -> np.ndarray:
        m, out = self.model, np.empty(len(self.count))
        for some in self.runs():
            own, context = np.maximum(self.count[some] - m.discount * tables[some], 0), self.context[some]
            out[some] = (own + (m.strength + m.discount * state["tables"][context]) * state["root"][self.word[some]]) / (m.strength + state["customers"][context])
        return out


def distinct(arrays: list[np.ndarray]) -> np.ndarray:
    """All values, sorted, each once. Arrays wait until they are as many values as there are: each value is sorted a few times, however many arrays there are."""
    out, waiting, n = arrays[0][:0], [], 0
    for i, array in enumerate(arrays, 1):
        waiting.append(array)
        n += len(array)
        if n >= max(len(out), 1 << 16) or i == len(arrays):
            out = np.concatenate([out, *waiting])
            out.sort()
            new = np.ones(len(out), bool)
            np.not_equal(out[1:], out[:-1], out=new[1:])
            out, waiting, n = out[new], [], 0
    return out


def group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Root groups are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def gather(told: list[tuple], model: Model, sweep: int, group: int) -> list[tuple]:
    """One root group: sums over the buckets and, after the first sweep, the root's own seating under a uniform parent."""
    parts = [unpack(d) for _, d in told]
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = lambda i: np.bincount(place, np.concatenate([p[i] for p in parts]), len(words)).astype(np.int64)
    counted = all(len(p[2]) == len(p[0]) for p in parts)
    customers, c = total(1), total(2) if counted else np.zeros(len(words), np.int64)
    before = parts[0][6]  # tokens, known words, customers and tables at the root after the sweep before
    tables = np.minimum(customers, 1)
    if sweep:
        x = gamma(np.array([model.root_strength / model.root_discount + before[3]]), np.array([START]), salt(sweep) + (2 << 36))[0]
        tables = draw_tables(customers, np.full(len(words), model.root_discount * x / (before[1] + 1)), words, model.root_discount, salt(sweep) + (3 << 36))
    contexts, at_context = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
    totals = [np.bincount(at_context, np.concatenate([p[i] for p in parts]), len(contexts)).astype(np.int64) for i in (4, 5)]
    known = [c.sum(), (c > 0).sum()] if sweep == 0 else before[:2] * (group == 0)
    sums, out, at, from_context = np.array([*known, customers.sum(), tables.sum()], np.int64), [], 0, 0
    for (name, _), p in zip(told, parts):
        own, context = place[at : at + len(p[0])], at_context[from_context : from_context + len(p[3])]
        at, from_context = at + len(p[0]), from_context + len(p[3])
        of = [x[own].astype(np.uint32) for x in (customers, tables, c)]
        out.append((name, group, FROM_ROOT + 5 * sweep, pack(of[0], of[1], of[2] if counted else of[2][:0], *(x[context] for x in totals), sums)))
    return out


def score(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    Tokens are the text's words with A-Z in lower case and an end. Training
    texts are those whose crc32(doc_id as text) isn't divisible by 10. Slices of
    the texts send their distinct pairs of a previous word and a word to
    buckets of whole contexts. A sweep draws every dish's tables in every
    context restaurant from its exact conditional law given the root's
    probabilities, then the root groups gather each word's tables and seat the
    root. After model.burn_in sweeps, model.samples more give predictive
    probabilities, which are averaged; score is the sum of the log10 of the averages, base_score
    the smoothed unigram. Draws depend on hashes of words alone: neither on slices,
    buckets, partitions nor on which contexts are spread over all buckets.

    Null and empty texts have the end token alone. Rows that repeat a doc_id
    count each and share one result row, which has their sums; null
    doc_ids are one document. An empty table gives no rows; other columns aren't read.
    """
    size = doc_text(docs).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n = max(1, math.ceil(size["size"] / model.bucket_bytes))
    groups, last_sweep = min(n, MOST_GROUPS), model.burn_in + model.samples
    spread = spread_contexts(docs, model, size["rows"], n) if n > 1 else np.empty(0, np.uint64)
    to = lambda df: df.groupBy("dest")

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        return table(Slice(rows["data"][0].as_py(), n, spread).rows(key[0].as_py()))

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = Bucket(rows, model, groups, spread)
        return table(bucket.tell(key[0].as_py(), np.minimum(bucket.count, 1), np.zeros(4, np.int64), True))

    def settle(sweep: int):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            told = messages(rows, TO_ROOT)
            own = [(key[0].as_py(), s, OWN + 5 * sweep, d.to_pybytes()) for s, d in messages(rows, OWN)]
            return table(own + (gather(told, model, sweep, key[0].as_py()) if told else []))

        return run

    def after(bucket: Bucket, state: pa.Table, sweep: int) -> dict:
        return bucket.read(messages(state, OWN + 5 * sweep), messages(state, FROM_ROOT + 5 * sweep))

    def again(sweep: int):
        def run(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
            bucket = Bucket(rows, model, groups, spread)
            before = after(bucket, state, sweep - 1)
            return table(bucket.tell(key[0].as_py(), bucket.seat(before, sweep), before["sums"], sweep == last_sweep))

        return run

    def last(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        bucket = Bucket(rows, model, groups, spread)
        before, mean = after(bucket, state, model.burn_in), 0.0
        for sweep in range(model.burn_in + 1, last_sweep + 1):
            now = after(bucket, state, sweep)
            mean = mean + bucket.predictive(bucket.seat(before, sweep), now) / model.samples
            before = now
        term, out, at = np.rint(-np.log10(mean) * FIXED).astype(np.uint32), [], 0
        for source, words, m in bucket.slices:
            count = before["c"][words].astype(np.uint32)
            out.append((source, key[0].as_py(), SCORES, pack(term[bucket.pair[at : at + m]], count, before["sums"])))
            at += m
        return table(out)

    def finish(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        part = Slice(rows["data"][0].as_py(), n, spread)
        term, of_word, sums = np.zeros(len(part.word), np.int64), np.zeros(len(part.hashes), np.int64), np.zeros(4, np.int64)
        for b, data in messages(told, SCORES):
            found, count, sums = unpack(data)
            term[part.edges[b] : part.edges[b + 1]], of_word[part.words_of(b)] = found, count
        total, known = sums[:2].tolist()
        words = of_word[part.word][part.pair]
        base = np.rint(np.log10((of_word + 0.1) / (total + 0.1 * (known + 1))) * 2.0**40).astype(np.int64)
        starts = np.cumsum(part.n_tokens) - part.n_tokens
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        ids = part.ids.tolist()
        return pa.table({
            "doc_id": pa.array([None if x == -(2**63) else x for x in ids], pa.int64()), "held_out": pa.array(~part.trains()), "n_tokens": pa.array(part.n_tokens),
            "n_known": pa.array(add((words > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ids), total)),
            "base_score": pa.array(add(base[part.word][part.pair]) / 2.0**40), "score": pa.array(-add(term[part.pair]) / FIXED),
        })

    encoded = encode(docs, model)
    packed = encoded.groupBy("slice").applyInArrow(send, ROWS)
    state = to(to(packed).applyInArrow(first, ROWS)).applyInArrow(settle(0), ROWS)
    states = state if model.burn_in == 0 else None
    for sweep in range(1, last_sweep + 1):
        sent = to(packed).cogroup(to(state)).applyInArrow(again(sweep), ROWS)
        state = to(sent).applyInArrow(settle(sweep), ROWS)
        if sweep >= model.burn_in:
            states = state if states is None else states.unionByName(state)
    told = to(packed).cogroup(to(states)).applyInArrow(last, ROWS).withColumnRenamed("dest", "slice")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    made = encoded.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(finish, result)
    return made.groupBy("doc_id").agg(
        F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.max("train_tokens").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of base and model over held-out and training texts: 10 to the mean negative log10 a token."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity")
    )
