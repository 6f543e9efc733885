"""N-gram Jaccard join with a count-vector R-tree; exact at similarity >= 0.8 of distinct five-word shingles.

Every set of shingles is a point: its shingles are hashed into GROUPS groups and counted per group. The overlap of two sets is at most
the sum of the smaller counts, coordinate by coordinate; for R-tree nodes the same holds with the largest counts below a node.

1. One pass gives each document its shingle count, its set's digest (equal sets are one node from here on) and its point, and the
   shingles that are frequent within a block of documents. Their summed counts order shingles from rare to common. The order decides
   only what is compared first: any order gives the same links.
2. Two sets that link share one of the first n - ceil(0.8 n) + 1 shingles in that order. Tasks send these as packed arrays, not rows;
   where several sets hold a shingle, neighbours by size become candidate pairs, a number linear in the holders.
3. Candidate pairs that pass the bound are verified on whole sets, and links are joined to components.
4. Only shingles whose holders are still in several components need more: their points go into an R-tree, joined with itself, that
   gives up a pair of nodes when the bound is too small, when sizes differ too much, or when all below is one component. A group sends
   no pairs, but its members that may link with another component, and as many pairs of components as connect what may link.
5. The components connected so are a family. The whole sets of a family's members meet once, in a second R-tree whose leaves verify the
   surviving pairs, and only as many verified links as join the family's parts leave the task.

So copies and near copies in a group of any size cost their chain of neighbours, what leaves a task is linear in what enters it, and no
link between different texts is lost. Groups are cut into blocks by the number of shingles that they hold, and blocks meet in pairs,
but for two blocks of one component.

Shingles are 64-bit hashes throughout, and equal sets are told by a 64-bit hash of them.

Defined cases: null or empty texts have no shingles and link with nothing; fewer than five words make one shingle; repeated rows get
a row each and share a component; a null doc_id takes part, and its own component is null when it is alone; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Union, components, discard, fresh, located, mix64, partitions, release, shingle_sets, slices, store, task, trim

#: Coordinates of a point, at least; larger sets have twice as many until a coordinate counts SHARE shingles or fewer on average.
GROUPS = 64
SHARE = 4
#: Shingles of the sets that one block of a group holds, about; a task joins two blocks.
BLOCK = 1 << 20
#: Shingles whose first ones go to one bucket, about.
BUCKET = 1 << 21
#: Words of the table of wanted documents (64 bits each): a fixed size, beyond which it only lets more documents pass.
WANTED_WORDS = 1 << 20
#: Entries of the table of frequent shingles; the rest count as rare, which changes the order but not the result.
FREQUENT = 1 << 19
_LEAF = 32


def need(a, b):
    """Least overlap of linked sets of a and b shingles: 100 * overlap >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _items(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def node_of(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).astype(np.int64))


def grade(n):
    """Doublings of GROUPS for a set of n shingles."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / (GROUPS * SHARE))), 0, 10).astype(np.int64)


def point(s: np.ndarray) -> bytes:
    """Counts by the top bits of the shingles' hashes; adding neighbours gives the point at half the coordinates."""
    bits = 6 + int(grade(len(s)))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2").tobytes()


def coarse(p: np.ndarray, groups: int) -> np.ndarray:
    return p.reshape(groups, -1).sum(1, dtype=np.int64)


def profile(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, locator, node, n, point; kind 1: a shingle (node) frequent in a block of documents and its count there (n)."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent():
            token, count = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            m = count >= max(4, len(held) // 1000)
            k = int(m.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(token[m].view(np.int64)), pa.array(count[m].astype(np.int64)), pa.nulls(k, pa.binary())], names)

        names = ["kind", "doc_id", "locator", "node", "n", "point"]
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            n = pa.array([len(s) for s in sets], pa.int64())
            points = pa.array([point(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), batch.column("locator"), nodes, n, points], names)
            held += sets
            size += sum(map(len, sets))
            if size > 2 << 20:
                yield frequent()
                held, size = [], 0
                trim()
        yield frequent()

    at = F.col("locator") if "locator" in docs.columns else F.lit(None).cast("string").alias("locator")
    return docs.select("doc_id", "text", at).mapInArrow(run, "kind int, doc_id long, locator string, node long, n long, point binary")


def _pack(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket with all that goes there."""
    bucket = ((mix64(tokens) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # mixed, as of equally rare shingles the least hashes come first
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
    rows = [(b, *(x[order[cut[b] : cut[b + 1]]].tobytes() for x in (tokens, nodes, sizes))) for b in range(buckets) if cut[b] < cut[b + 1]]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["bucket", "tokens", "nodes", "sizes"])


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """bucket, tokens, nodes, sizes: packed arrays of the first shingles of each distinct set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = sent.value
        held: list[tuple[np.ndarray, int, int]] = []
        size, seen = 0, set()

        def flush():
            k = [len(t) for t, _, _ in held]
            nodes = np.repeat(np.array([x for _, x, _ in held], np.int64), k)
            return _pack(np.concatenate([t for t, _, _ in held]), nodes, np.repeat(np.array([n for _, _, n in held], np.int32), k), buckets)

        for batch in slices(batches):
            for s in shingle_sets(batch.column("text")):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:  # equal sets near each other are sent once; others meet as one node
                    continue
                seen.add(node)
                first = prefix_length(len(s))
                if len(common):
                    i = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    c = np.where(common[i] == s, count[i], 0)
                    if c.any():
                        s = s[np.lexsort((s, c))]
                        held.append((s[:first], node, len(s)))
                        size += first
                        continue
                held.append((s[:first].copy(), node, len(s)))
                size += first
            if size > 1 << 19:
                yield flush()
                held, size, seen = [], 0, set() if len(seen) > 1_000_000 else seen
                trim()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, tokens binary, nodes binary, sizes binary")


MEET = "kind int, key long, a long, b long, n long"


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket: kind 0 candidate pairs (a, b); kind 1 holders (a, size n) of a shingle with three or more, named by key; equal lists of holders once."""
    def column(name, kind):
        return np.frombuffer(b"".join(x.as_py() for x in table[name]), kind)

    token, node, n = column("tokens", np.uint64), column("nodes", np.int64), column("sizes", np.int32).astype(np.int64)
    order = np.lexsort((node, n, token))
    token, node, n = token[order], node[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n = token[new], node[new], n[new]
    # a run: holders of one shingle, in order of size, as long as the next one's size can still link
    joined = np.zeros(len(token) + 1, bool)
    joined[1:-1] = (token[1:] == token[:-1]) & (100 * n[:-1] >= 80 * n[1:])
    at = np.flatnonzero(joined)
    pairs = np.stack([np.minimum(node[at - 1], node[at]), np.maximum(node[at - 1], node[at])], 1)
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(0, 2)
    starts = np.flatnonzero(~joined[:-1])
    ends = np.append(starts[1:], len(token))
    out = [[np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)]]
    done = set()
    for i in np.flatnonzero(ends - starts >= 3).tolist():
        a, b = int(starts[i]), int(ends[i])
        key = xxhash.xxh3_64_intdigest(node[a:b].tobytes())
        if key not in done:
            done.add(key)
            k = b - a
            out.append([np.ones(k, np.int32), np.full(k, np.array(key, np.uint64).astype(np.int64)), node[a:b], np.zeros(k, np.int64), n[a:b]])
    return pa.table({c: pa.array(np.concatenate([x[i] for x in out])) for i, c in enumerate(("kind", "key", "a", "b", "n"))})


def _bound(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points allow enough overlap."""
    side = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}")) for c in "ab"]

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                least = need(x.column("n_a").to_numpy(), x.column("n_b").to_numpy())
                m = np.zeros(x.num_rows, bool)
                for i, (p, q) in enumerate(zip(x.column("p_a"), x.column("p_b"), strict=True)):
                    p, q = (np.frombuffer(v.as_buffer(), "<u2") for v in (p, q))
                    g = min(len(p), len(q))
                    m[i] = np.minimum(coarse(p, g), coarse(q, g)).sum() >= least[i]
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(m))

    return pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, items: the packed whole sets of the wanted nodes, from their documents only."""
    spark = docs.sparkSession
    hashed = wanted.join(nodes, "node").select(F.xxhash64("rep").alias("h"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 AS int))")
    bits = hashed.groupBy(F.col("h").bitwiseAND(WANTED_WORDS - 1).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(WANTED_WORDS, np.int64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(table)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.view(np.uint64)
        for batch in slices(batches):
            h = batch.column("h").to_numpy().view(np.uint64)
            m = (table[(h & np.uint64(WANTED_WORDS - 1)).astype(np.int64)] >> ((h >> np.uint64(40)) & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(m.astype(bool)))
            if batch.num_rows:
                sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([_items(s) for s in sets], pa.binary())], ["node", "items"])

    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "node long, items binary")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link."""
    side = [sets.select(F.col("node").alias(c), F.col("items").alias(f"s_{c}")) for c in "ab"]

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("s_a"), x.column("s_b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), "<u8") for x in (p, q))
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * same >= 80 * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


class RTree:
    """Points packed into leaves of near ones, and nodes above that hold the largest coordinates and the range of sizes below.

    twice: the sets with a point of twice as many coordinates, whose pairs among each other are another tree's.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, comp: np.ndarray, twice: np.ndarray | None = None):
        order = self._pack(points, np.lexsort((comp, n)))
        self.order, self.points, self.n, self.comp = order, points[order], n[order], comp[order]
        self.twice = None if twice is None or not twice.any() else twice[order]
        lo = np.arange(0, len(order), _LEAF)
        hi = np.minimum(lo + _LEAF, len(order))
        stats = [np.maximum.reduceat(self.points, lo, axis=0), np.minimum.reduceat(self.n, lo), np.maximum.reduceat(self.n, lo), np.minimum.reduceat(self.comp, lo), np.maximum.reduceat(self.comp, lo)]
        self.levels = [(lo, hi, *stats)]
        while len(lo) > 1:
            at = np.arange(0, len(lo), 8)
            end = np.minimum(at + 8, len(lo))
            p, a, b, c, d = self.levels[-1][2:]
            lo = at
            self.levels.append((at, end, np.maximum.reduceat(p, at, axis=0), np.minimum.reduceat(a, at), np.maximum.reduceat(b, at), np.minimum.reduceat(c, at), np.maximum.reduceat(d, at)))

    @staticmethod
    def _pack(points: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Halve along the coordinate that varies most until a leaf is full; order breaks ties."""
        done, todo = [], [order]
        while todo:
            part = todo.pop()
            if len(part) <= _LEAF:
                done.append(part)
                continue
            x = points[part]
            part = part[np.argsort(x[:, x.var(0, dtype=np.float32).argmax()], kind="stable")]
            half = max(_LEAF, len(part) // 2 // _LEAF * _LEAF)
            todo += [part[half:], part[:half]]
        return np.concatenate(done)

    def leaves(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves (ranges of places in packed order) that the bounds of the nodes above let through."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            lo, hi, p, least, most, c0, c1 = self.levels[level]
            if c0[i] == c1[i] == c0[j] == c1[j]:
                continue
            small, large = (i, j) if most[i] <= most[j] else (j, i)
            if 100 * most[small] < 80 * least[large] or np.minimum(p[i], p[j]).sum(dtype=np.int64) < need(least[i], least[j]):
                continue
            if level:
                todo += [(level - 1, a, b) for a in range(lo[i], hi[i]) for b in range(max(a, lo[j]) if i == j else lo[j], hi[j])]
            else:
                yield np.arange(lo[i], hi[i]), np.arange(lo[j], hi[j])

    def allowed(self, a: np.ndarray, b: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The pairs of two leaves of different parts that the bound lets through."""
        m = part[a][:, None] != part[b][None, :]
        if a[0] == b[0]:
            m = np.triu(m, 1)
        if self.twice is not None:
            m &= ~(self.twice[a][:, None] & self.twice[b][None, :])
        for r in np.flatnonzero(m.any(1)).tolist():
            m[r] &= np.minimum(self.points[a[r]][None, :], self.points[b]).sum(1, dtype=np.int64) >= need(self.n[a[r]], self.n[b])
        return m


def _trees(n: np.ndarray, comp: np.ndarray, point_of) -> Iterator[tuple[RTree, np.ndarray]]:
    """A tree for each number of coordinates, over the sets that have so many or twice as many (linked sets differ by less), and their
    places; point_of(place, coordinates)."""
    grades = grade(n)
    for g in np.unique(grades).tolist():
        own = np.flatnonzero((grades == g) | (grades == g + 1))
        if len(own) > 1:
            points = np.stack([point_of(i, GROUPS << g) for i in own.tolist()])
            yield RTree(points, n[own], comp[own], grades[own] > g), own


MAYBE = "kind int, a long, b long"


def _maybe(table: pa.Table) -> pa.Table:
    """Of a shingle's holders: kind 1 those (a, of component b) that may link with another component; kind 0 pairs of components (a, b), as
    many as connect those that may link."""
    comp, points = table["comp"].to_numpy(), table["point"]
    active, edges, union = np.zeros(len(comp), bool), [], Union()
    for tree, own in _trees(table["n"].to_numpy(), comp, lambda i, k: coarse(np.frombuffer(points[i].as_buffer(), "<u2"), k).astype(np.uint32)):
        for a, b in tree.leaves():
            x, y = np.nonzero(tree.allowed(a, b, tree.comp))
            if len(x):
                x, y = a[x], b[y]
                active[own[tree.order[x]]] = active[own[tree.order[y]]] = True
                for u, v in set(zip(tree.comp[x].tolist(), tree.comp[y].tolist(), strict=True)):
                    if union.join(u, v):
                        edges.append((u, v))
    u, v = (np.array(x, np.int64) for x in (zip(*edges, strict=True) if edges else ((), ())))
    kind = np.repeat(np.array([0, 1], np.int32), [len(u), active.sum()])
    return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate([u, table["a"].to_numpy()[active]])), "b": pa.array(np.concatenate([v, comp[active]]))})


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of shingles that each of a shares with each of b: a product of two 0/1 matrices, a slice of shingles at a time."""
    keys = np.unique(np.concatenate([sets[i] for i in a.tolist()]))
    out = np.zeros((len(a), len(b)), np.float32)
    for s in range(0, len(keys), 1 << 15):
        some = keys[s : s + (1 << 15)]

        def matrix(rows: np.ndarray, some=some) -> np.ndarray:
            m = np.zeros((len(rows), len(some)), np.float32)
            for r, i in enumerate(rows.tolist()):
                own = sets[i][np.searchsorted(sets[i], some[0]) : np.searchsorted(sets[i], some[-1], "right")]
                at = np.minimum(np.searchsorted(some, own), len(some) - 1)
                m[r, at[some[at] == own]] = 1
            return m

        out += matrix(a) @ matrix(b).T
    return out


def _exact(table: pa.Table) -> pa.Table:
    """Of a part of a family (a, n, comp, items) verified links (a, b), as many as join what all of them would join."""
    trim()  # of the group before
    node, comp, n = (table[c].to_numpy() for c in ("a", "comp", "n"))
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["items"]]
    union, out = Union(), []

    def point_of(i: int, groups: int) -> np.ndarray:
        return np.bincount((sets[i] >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.uint32)

    for tree, own in _trees(n, comp, point_of):
        for a, b in tree.leaves():
            part = np.zeros(len(own), np.int64)
            both = np.union1d(a, b)
            part[both] = [union.find(c) for c in tree.comp[both].tolist()]
            m = tree.allowed(a, b, part)
            if not m.any():
                continue
            a, b = a[m.any(1)], b[m.any(0)]
            m = m[m.any(1)][:, m.any(0)]
            x, y = own[tree.order[a]], own[tree.order[b]]
            same = _overlaps(sets, x, y)
            m &= 100 * same >= 80 * (n[x][:, None] + n[y][None, :] - same)
            for i, j in zip(*np.nonzero(m), strict=True):
                if union.join(int(comp[x[i]]), int(comp[y[j]])):
                    out.append((int(node[x[i]]), int(node[y[j]])))
    a, b = (np.array(v, np.int64) for v in (zip(*out, strict=True) if out else ((), ())))
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is stored for it, and members (group, a, n, comp) with pair: groups are cut into blocks of about BLOCK shingles, a row for each pair of blocks that a member
    is in. Components over that size have blocks of their own, and two blocks of one component don't meet."""
    c = F.col
    per = store(members.groupBy("group", "comp").agg(F.sum("n").alias("own_size")), "sizes")
    rest = store(per.groupBy("group").agg(F.coalesce(F.sum(F.when(c("own_size") <= BLOCK, c("own_size"))), F.lit(0)).alias("rest")), "rest")
    large = c("own_size") > BLOCK

    def number(size: str, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.greatest(F.lit(1), F.ceil(c(size) / BLOCK)))

    block = F.struct(large.alias("large"), F.when(large, c("comp")).otherwise(0).alias("comp"), F.when(large, number("own_size", "a")).otherwise(number("rest", "comp")).alias("number"))
    placed = store(members.join(per, ["group", "comp"]).join(rest, "group").select("group", "a", "n", "comp", block.alias("block")), "placed")
    one = placed.select("group", "block").distinct()
    two = one.alias("x").join(one.alias("y"), "group").filter("x.block <= y.block AND NOT (x.block.large AND y.block.large AND x.block.comp = y.block.comp)")
    pairs = two.select("group", F.col("x.block").alias("x"), F.col("y.block").alias("y")).withColumn("pair", F.xxhash64("x", "y"))
    either = pairs.select("group", "pair", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    discard(per, rest)
    return placed, placed.join(either, ["group", "block"]).select("group", "pair", "a", "n", "comp")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile of the documents, nodes, components of nodes that have a link), all of them stored."""
    spark = docs.sparkSession
    facts = store(profile(docs), "profile")
    top = facts.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).toArrow()
    token, count = top["node"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(token)
    frequent = (token[order], np.minimum(count[order], 1 << 30).astype(np.int32))
    nodes = store(facts.filter("kind = 0 AND node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point")), "nodes")
    buckets = max(1, partitions(spark), -(-(nodes.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    meet = store(prefixes(docs, frequent, buckets).groupBy("bucket").applyInArrow(_meet, MEET), "meet")
    release(spark)
    pairs = meet.filter("kind = 0").select("a", "b").distinct()
    near = store(_bound(pairs, nodes), "near")
    sets = store(_sets(docs, nodes, _ends(near)), "sets")
    release(spark)
    sure = store(_verify(near, sets), "links")
    discard(sets, near)
    first = store(components(sure), "components")
    # shingles whose holders are in several components
    known = first.select(F.col("node").alias("a"), F.col("component").alias("comp"))
    holders = meet.filter("kind = 1").select(F.col("key").alias("group"), "a", "n").distinct().join(known, "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    holders = store(holders, "holders")
    open_ = holders.groupBy("group").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("group")
    few = store(holders.join(open_, "group"), "open")
    placed, dealt = _dealt(few)
    maybe = store(dealt.join(nodes.select(F.col("node").alias("a"), "point"), "a").groupBy("group", "pair").applyInArrow(_maybe, MAYBE), "maybe")
    discard(meet, holders, sure, few, placed)
    active = maybe.filter("kind = 1").select("a", F.col("b").alias("comp")).distinct()
    if active.isEmpty():
        discard(maybe)
        return facts, nodes, first
    family = components(maybe.filter("kind = 0").select("a", "b")).select(F.col("node").alias("comp"), F.col("component").alias("group"))
    active = store(active.join(family, "comp").join(nodes.select(F.col("node").alias("a"), "n"), "a").select("group", "a", "n", "comp"), "active")
    sets = store(_sets(docs, nodes, active.select(F.col("a").alias("node"))), "sets")
    release(spark)
    placed, dealt = _dealt(active)
    late = store(dealt.join(sets.withColumnRenamed("node", "a"), "a").groupBy("group", "pair").applyInArrow(_exact, "a long, b long"), "late")
    discard(sets, maybe, placed)
    # late links join components
    named = active.select("a", "comp")
    ends = late.join(named, "a").select("b", F.col("comp").alias("x")).join(named.withColumnsRenamed({"a": "b", "comp": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    second = store(components(ends), "joined")
    moved = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    found = store(moved.union(second.join(first, "node", "left_anti").select("node", "component")), "components")
    discard(first, second, active, late)
    return facts, nodes, found


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    facts, nodes, found = links(docs)
    roots = nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    least = store(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    by_node = roots.join(least, "root").select("node", "component_id")
    out = facts.filter("kind = 0").join(by_node, "node", "left")
    out = store(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "jaccard")
    discard(facts, nodes, found, least)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, of its smallest doc_id (then of its longest set, then of the greatest locator); of texts without
    shingles one for each doc_id. Rows are told apart by where they are found (see common.located), so repeated rows are dropped too."""
    at, gone = fresh(docs, "locator", "gone")
    rows, _ = located(docs, at, *docs.columns)
    facts, nodes, found = links(rows.select("doc_id", "text", F.col(at).alias("locator")))
    roots = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    own = facts.filter("kind = 0").join(roots, "node", "left")
    # a text without shingles is its own group
    group = [F.col("root").isNull().alias("empty"), F.coalesce("root", "doc_id").alias("group")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (-F.col("n")).alias("less"), "locator"))
    named = own.select(*group, "doc_id", "n", "locator")
    keep = store(named.groupBy("empty", "group").agg(least.alias("k")).select(F.col("k.locator").alias("keep")), "keep")
    dropped = store(named.select(F.col("locator").alias(gone)).join(keep, F.col(gone) == F.col("keep"), "left_anti"), "dropped")
    discard(facts, nodes, found, keep)
    return rows.join(dropped, F.col(at) == F.col(gone), "left_anti").select(*docs.columns)
