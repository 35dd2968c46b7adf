"""N-gram Jaccard self-join with a count-vector R-tree.

A document is the set of its word shingles. Tokens are hashed into groups, a set's
group counts are a point, and an R-tree over the points bounds the overlap of a
set with everything in a box by the summed minima of its counts and the box's
upper corner. Pairs of points that survive the bound are verified on the sets.

One tree over a whole corpus would be one task, so sets first meet in cells. Two
sets that link differ in at most d shingles, d following from their sizes. Cut the
hash space into slices: a set with more than d slices that hold something agrees
with each of its partners in one of those, so empty slices name no cell. A set that
has fewer is cut again, finer, and at last shingle by shingle. Of the slices that
hold something each set needs its d + 1 rarest only: before the rarest one in
which a pair agrees, each of the two has at most d others. So passages that many
texts share name no cell as long as a text has enough of its own.

A first tree in each cell keeps the pairs whose points allow a link; what they
connect is a part, and each part gets a tree again, now with the sets themselves to
verify pairs on. Equal sets are one class from the start.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.components import connected_components
from tieout.llm.frames import map_arrow, slices, stored

#: Group counts a point has, by the size of its set up to which they serve; the last serves beyond.
#: Counts of two unrelated sets of n differ by about 1.13 * sqrt(n * groups), which must exceed what a link may differ by.
GROUPS = ((512, 64), (2048, 256), (8192, 1024), (None, 4096))
#: Points in a leaf of the tree.
LEAF = 16
#: Slices for each that a pair may differ in, so that most sets have enough that hold something.
SPARE = 1.25
#: Sets and shingles that one tree holds; more are dealt out over several.
BLOCK_SETS = 2048
BLOCK_SHINGLES = 2_000_000
#: Sets whose cells a task remembers to have sent, so that copies are sent once a task.
SEEN_SETS = 500_000
#: Points that one tree of a cell holds; the sets of a larger cell are one part, since all pairs of a part are looked at anyway.
CELL_SETS = 8192
#: Sets of each class that stand for it when the blocks of a part are joined.
ANCHORS = 4
#: Shares in which the rows of one key are joined to what is known of the key.
SALTS = 16
#: Growth of sizes from one band to the next.
BAND = 1.5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the word k-shingles of a whole text.

    Words are runs of anything but the six ASCII white-space characters, A-Z
    lower-cased. A text of fewer than k words has its whole sequence as the one
    shingle; a null, empty or blank text has the empty set.
    """
    words = text.encode().lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def name_of(shingles: np.ndarray) -> int:
    """The 64-bit name of a set; 0 of the empty one."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0


class Bands:
    """Bands of set sizes, with the slices that sets of each band need at a similarity of p / q."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q = p, q
        self.lows = [1]

    def low(self, i: int) -> int:
        while len(self.lows) <= i:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND)))
        return self.lows[i]

    def of(self, n: int) -> Iterator[tuple[int, int]]:
        """(band, d) for each band that the larger set of a link of a set of n shingles can be in; the two differ in d shingles at most."""
        i = 0
        while self.low(i + 1) <= n:
            i += 1
        while n * self.q >= self.p * self.low(i):
            yield i, 2 * (self.low(i + 1) - 1) * (self.q - self.p) // (self.q + self.p)
            i += 1

    def cells(self, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """(names of cells, how many of them the set can spare, cutting) for each cutting that the set needs.

        Each band has three cuttings: slices, half as wide slices of another
        scramble, and single shingles. A set needs the next only where it has
        none to spare, so two sets that link meet in the first in which one has.
        """
        for band, d in self.of(len(shingles)):
            for level in range(3):
                label = (band << 2) + level
                if level == 2:
                    cells = mix(mix(shingles) + np.uint64(label << 32))
                else:
                    keys = np.sort(mix(shingles + np.uint64(label))) if level else shingles
                    m = math.ceil(SPARE * (d + 1)) << level
                    at = np.r_[0, np.searchsorted(keys, (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)), len(keys)]
                    sums = np.r_[np.uint64(0), np.cumsum(mix(keys))]
                    cells = mix(mix(np.arange(m, dtype=np.uint64) + np.uint64(label << 32)) + sums[at[1:]] - sums[at[:-1]])[at[1:] > at[:-1]]
                spare = len(cells) - d - 1
                yield cells, spare, label
                if spare >= 0:
                    break


def groups_for(n: int) -> int:
    return next(g for most, g in GROUPS if most is None or n <= most)


def points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Group counts of the sets; the group of a shingle is its lowest bits, so coarser counts are sums of finer ones."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=len(sets) * groups).reshape(-1, groups).astype(np.int32)


def packed(shingles: np.ndarray) -> bytes:
    """A set's point: the width of its integers, then the counts in the narrowest that hold them."""
    point = points([shingles], groups_for(len(shingles)))[0]
    width = next(w for w in (1, 2, 4) if point.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def unpacked(values: list[bytes]) -> np.ndarray:
    """Points side by side, with as many groups as the coarsest has."""
    own = [np.frombuffer(v, f"<u{v[0]}", offset=1).astype(np.int32) for v in values]
    groups = min(map(len, own))
    return np.stack([x if len(x) == groups else x.reshape(-1, groups).sum(0) for x in own])


class RTree:
    """Points packed into boxes by halving along the widest axis; a box keeps its upper corner and its least and largest size."""

    def __init__(self, at: np.ndarray) -> None:
        self.at, self.size = at, at.sum(1)
        self.upper: list[np.ndarray] = []
        self.sizes: list[tuple[int, int]] = []
        self.below: list[np.ndarray | tuple[int, int]] = []
        self._pack(np.arange(len(at)))

    def _pack(self, rows: np.ndarray) -> int:
        here = len(self.upper)
        own = self.at[rows]
        self.upper.append(own.max(0))
        self.sizes.append((int(self.size[rows].min()), int(self.size[rows].max())))
        self.below.append(rows)
        if len(rows) > LEAF:
            spread = own.max(0) - own.min(0)
            by_size = self.sizes[here][1] - self.sizes[here][0] > 4 * int(spread.max())
            order = rows[np.argsort(self.size[rows] if by_size else own[:, int(spread.argmax())], kind="stable")]
            half = len(order) // 2
            self.below[here] = (self._pack(order[:half]), self._pack(order[half:]))
        return here

    def reach(self, x: np.ndarray, p: int, q: int) -> np.ndarray:
        """Rows whose overlap with point ``x`` may reach similarity p / q."""
        n, found, stack = int(x.sum()), [], [0]
        while stack:
            node = stack.pop()
            low, high = self.sizes[node]
            if high * q < n * p or n * q < low * p or int(np.minimum(self.upper[node], x).sum()) * (p + q) < p * (n + low):
                continue
            below = self.below[node]
            if isinstance(below, tuple):
                stack += below
            else:
                found.append(below)
        if not found:
            return np.empty(0, np.int64)
        rows = np.concatenate(found)
        return rows[np.minimum(self.at[rows], x).sum(1) * (p + q) >= p * (n + self.size[rows])]


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is p / q or more, in integers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return common * q >= p * (len(a) + len(b) - common)


def forest(at: np.ndarray, labels: np.ndarray, asks: np.ndarray, p: int, q: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join everything that pairs with an asking side join, given that equal labels are joined already.

    Without ``sets`` a pair counts as a link if its points allow one. A pair is
    left out only if its ends are joined already: at first those ask that nothing
    was joined to, then all outside the largest group, so that of any two that
    stay apart one has asked. Copies of one text need few verifications.
    """
    labels, tree, out = labels.copy(), RTree(at), []

    def ask(i: int) -> None:
        rows = tree.reach(at[i], p, q)
        rows = rows[labels[rows] != labels[i]]
        while len(rows):
            if sets is None:
                _, firsts = np.unique(labels[rows], return_index=True)
                out.extend((i, int(rows[f])) for f in firsts)
                labels[np.isin(labels, labels[rows])] = labels[i]
                return
            j, rows = int(rows[0]), rows[1:]
            if linked(sets[i], sets[j], p, q):
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
                rows = rows[labels[rows] != labels[i]]

    if not asks.all():
        for i in np.flatnonzero(asks).tolist():
            ask(i)
        return out
    _, kind, many = np.unique(labels, return_inverse=True, return_counts=True)
    alone, asked = many[kind] == 1, np.zeros(len(at), bool)
    for i in range(len(at)):
        if alone[i] and not asked[i]:
            before = len(out)
            ask(i)
            asked[i] = True
            if len(out) > before:
                alone &= labels != labels[i]
    while True:
        names, many = np.unique(labels, return_counts=True)
        rest = np.flatnonzero(~asked & (labels != names[many.argmax()]))
        if not len(rest):
            return out
        for i in rest.tolist():
            ask(i)
            asked[i] = True


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _solve(members: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Verified links of each (part, block): both are brought together by a shuffle and read as one stream."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int, bool]] = {}
        now = None

        def done() -> pa.RecordBatch:
            nodes = np.array(list(held), np.int64)
            sets = [h[0] for h in held.values()]
            links = forest(points(sets, groups_for(max(map(len, sets)))), np.unique([h[1] for h in held.values()], return_inverse=True)[1], np.array([h[2] for h in held.values()]), p, q, sets)
            return pa.RecordBatch.from_arrays([pa.array([int(nodes[x[e]]) for x in links], pa.int64()) for e in (0, 1)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "block", "node", "label", "asks", "text")]
            for part, block, node, label, asks, text in zip(*columns):
                if now != (part, block):
                    if len(held) > 1:
                        yield done()
                    held, now = {}, (part, block)
                own = shingle_set(text, k)
                # rows that share an id may differ in text; only the text that made the node counts
                if len(own) and np.uint64(name_of(own)).astype(np.int64) == node:
                    before = held.get(node)
                    held[node] = (own, label, asks or bool(before and before[2]))
        if len(held) > 1:
            yield done()

    return members.repartition("part", "block").sortWithinPartitions("part", "block", "node").mapInArrow(run, _EDGES)


def shingle_classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, point) for every row of ``docs`` (doc_id, key, text): size, name and packed group counts of its shingle set; node 0 of the empty one."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "key", "n_shingles", "node")] + [T.StructField("point", T.BinaryType())])

    def make():
        def work(batch: pa.RecordBatch):
            sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            return [batch.column("doc_id"), batch.column("key"), [len(s) for s in sets], np.array([name_of(s) for s in sets], np.uint64).view(np.int64), [packed(x) for x in sets]]

        return work

    return map_arrow(docs, make, schema)


def _cells(texts: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(cell, node, spare, cutting) for each cell of each text's set; of equal sets a task sends one, so a hot text costs a row a task and cell."""
    schema = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("spare", pa.int32()), ("cutting", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(p, q), set()
        for piece in slices(batches, "text"):
            found = []
            for t in piece.column("text").to_pylist():
                own = shingle_set(t, k)
                if len(own) and (name := name_of(own)) not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(name)
                    found += [(cells, name, spare, cutting) for cells, spare, cutting in bands.cells(own)]
            if found:
                many = [len(x[0]) for x in found]
                columns = [np.concatenate([x[0] for x in found]).view(np.int64), np.repeat(np.array([x[1] for x in found], np.uint64).view(np.int64), many)]
                columns += [np.repeat(np.array([x[i] for x in found], np.int32), many) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return texts.select("text").mapInArrow(run, "cell long, node long, spare int, cutting int")


def _met(cells: DataFrame) -> DataFrame:
    """(cell, node) of the cells that several sets name, without the most frequent ones that a set can spare.

    Frames take in whole cells, and are spilled where these are large.
    """
    whole = Window.partitionBy("cell")
    shared = cells.select("*", F.count("*").over(whole).alias("rows"), (F.min("node").over(whole) < F.max("node").over(whole)).alias("shared")).where("shared")
    by_rows = Window.partitionBy("node", "cutting").orderBy(F.desc("rows"), "cell")
    return shared.select("cell", "node", "spare", F.dense_rank().over(by_rows).alias("nth")).where("nth > spare").select("cell", "node")


def _with_known(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """``rows`` joined to the one row of ``known`` for each ``on``; nodes of a large group are dealt over SALTS shares."""
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(dealt, [on, "salt"]).drop("salt")


def _allowed(met: DataFrame, p: int, q: int) -> DataFrame:
    """Edges that connect, in each cell, the nodes whose points allow a link; (cell, node, point) comes in as one sorted stream."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        values: list[bytes] = []
        edges: list[tuple[int, int]] = []
        now, wide = None, False

        def close() -> None:
            if len(nodes) > 1 and not wide:
                at = unpacked(values)
                edges.extend((nodes[i], nodes[j]) for i, j in forest(at, np.arange(len(at)), np.ones(len(at), bool), p, q))

        for batch in batches:
            for cell, node, point in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "point"))):
                if cell != now:
                    close()
                    nodes, values, now, wide = [], [], cell, False
                if nodes and nodes[-1] == node:
                    continue
                if wide:
                    edges.append((nodes[0], node))
                    continue
                nodes.append(node)
                values.append(point)
                if len(nodes) > CELL_SETS:
                    edges.extend((nodes[0], x) for x in nodes[1:])
                    nodes, values, wide = nodes[:1], [], True
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], schema=schema)
                edges.clear()
        close()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], schema=schema)

    return met.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, _EDGES)


def _keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, text): the key is the id, or a hash of the text where the id is null, so that such rows don't meet under one key."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text")


def jaccard_components(df: DataFrame, k: int = 5, p: int = 80, q: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, node, component_id, leads) for every row of ``df``.

    Rows link when q * |intersection| >= p * |union| of their k-shingle sets.
    ``node`` names the set, so equal nodes are one class; ``component_id`` is the
    smallest doc_id reachable by links, the row's own included. Null, empty and
    blank texts have no shingles and link with nothing. Rows with a null doc_id
    take part; a component of such rows alone has a null id. ``key`` is the id or,
    where it is null, a hash of the text; ``leads`` marks the rows of a component's
    first key, ids before hashes, and all rows without shingles. Repeated rows are
    equal and so linked. An empty table gives an empty result. Sets are named by
    64-bit hashes: among n different sets about n * n / 2^65 names coincide.
    """
    docs = _keyed(df, doc_id, text)
    base = stored(shingle_classes(docs, k), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "key")).alias("first")
    classes = base.where("n_shingles > 0").groupBy("node").agg(first, F.max("n_shingles").alias("n_shingles"))

    def members(picked: DataFrame, texts: DataFrame) -> DataFrame:
        """``picked`` (part, block, node, key, label, asks) with the texts of the rows of that key."""
        # keys grow with the corpus, so they are never broadcast, few as they may be
        return texts.select("key", "text").join(picked.hint("merge"), "key").select("part", "block", "node", "label", "asks", "text")

    met = stored(_met(_cells(docs, k, p, q)), "met")
    at = base.where("n_shingles > 0").groupBy("node").agg(F.first("point").alias("point"))
    parts = connected_components(_allowed(met.join(at, "node"), p, q), "cells").withColumnRenamed("component", "part")
    sized = stored(parts.join(classes, "node").select("part", "node", "first.key", "n_shingles"), "sized")
    wide = sized.groupBy("part").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles"))
    wide = wide.select("part", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    spot = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = stored(_with_known(sized, wide, "part").select("part", "node", "key", "blocks", spot.alias("block")), "placed")
    alone = placed.select("part", "block", "node", "key", F.col("node").alias("label"), F.lit(True).alias("asks"))
    links = stored(_solve(members(alone, docs), k, p, q), "links")
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        # the texts of large parts are picked out once, not in every round
        texts = stored(docs.select("key", "text").join(large.select("key"), "key", "left_semi"), "large-texts")
        links = stored(links.unionByName(_across(large, links, met, at, lambda picked: members(picked, texts), k, p, q)), "links")
    joined = connected_components(links, "jaccard").withColumnRenamed("component", "root")
    # a class without links is its own root
    classed = stored(classes.join(joined, "node", "left").select("node", "first", "root"), "classed")
    smallest = classed.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    linked_ids = _with_known(classed.where("root IS NOT NULL"), smallest, "root").select("node", "least")
    ids = linked_ids.unionByName(classed.where("root IS NULL").select("node", F.col("first").alias("least")))
    out = base.where("n_shingles > 0").drop("point").join(ids, "node")
    component = F.when(~F.col("least.unnamed"), F.col("least.key"))
    out = out.select("doc_id", "key", "n_shingles", "node", component.alias("component_id"), (F.col("key") == F.col("least.key")).alias("leads"))
    bare = base.where("n_shingles = 0").select("doc_id", "key", "n_shingles", "node", F.col("doc_id").alias("component_id"), F.lit(True).alias("leads"))
    return out.unionByName(bare)


def _across(large: DataFrame, links: DataFrame, met: DataFrame, at: DataFrame, members, k: int, p: int, q: int) -> DataFrame:
    """Links between the blocks of parts that no single tree holds; ``large`` is (part, node, key, blocks, block).

    First a few sets of each class are joined, round by round, while that makes
    notably fewer classes. Then every set outside its part's largest class is asked
    against the blocks in which some set of another class shares a cell with it and
    has a point that allows a link; texts go to those blocks only.
    """
    links = stored(links.join(large.select(F.col("node").alias("a")), "a", "left_semi"), "within")
    for turn in itertools.count():
        joined = connected_components(links, "blocks").withColumnRenamed("component", "label")
        now = stored(large.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        counted = stored(now.groupBy("part", "label").agg(F.count("*").alias("n")), "counted")
        order = Window.partitionBy("part", "label").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        anchors = now.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ANCHORS)
        groups = counted.groupBy("part").agg(F.ceil(F.sum(F.least("n", F.lit(ANCHORS))) / BLOCK_SETS).cast("long").alias("groups"))
        anchors = _with_known(anchors, groups, "part").withColumn("block", F.pmod(F.xxhash64("label", F.lit(turn)), F.col("groups")))
        more = stored(_solve(members(anchors.select("part", "block", "node", "key", "label", F.lit(True).alias("asks"))), k, p, q), "anchors")
        made = more.count()
        if made:
            links = links.unionByName(more)
        if made * 10 < counted.count():
            break
    if made:
        joined = connected_components(links, "blocks").withColumnRenamed("component", "label")
        now = stored(large.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        counted = now.groupBy("part", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    asking = stored(_with_known(now, main, "part").where("label <> main").drop("main"), "asking")
    if asking.isEmpty():
        return links
    inside = met.join(now.select("node", "block", "label"), "node").groupBy("cell", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    beside = met.join(asking.select("node", "part", "key", "label"), "node").join(inside, "cell").where("low <> label OR high <> label")
    beside = stored(beside.select("part", "block", "node", "key", "label").distinct(), "beside")
    near = stored(_near(_turns(beside, now).join(at, "node"), p, q), "near")
    asks = beside.join(near, ["part", "block", "node"], "left_semi")
    return links.unionByName(_solve(members(_turns(asks, now)), k, p, q))


def _turns(asks: DataFrame, now: DataFrame) -> DataFrame:
    """(part, block, node, key, label, asks): the asking sets of each block, BLOCK_SETS at a time, each time with the block's own sets."""
    turns = asks.groupBy("part", "block").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("turns"))
    asking = asks.join(turns, ["part", "block"]).withColumn("turn", F.pmod(F.xxhash64("node"), F.col("turns"))).withColumn("asks", F.lit(True))
    rest = now.join(turns, ["part", "block"]).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).withColumn("asks", F.lit(False))
    both = asking.select("part", "block", "turn", "node", "key", "label", "asks").unionByName(rest.select("part", "block", "turn", "node", "key", "label", "asks"))
    return both.withColumn("block", F.shiftleft("block", 32) + F.col("turn")).drop("turn")


def _near(asked: DataFrame, p: int, q: int) -> DataFrame:
    """(part, block, node) of the asking sets that have a point of another class within reach in a block; ``block`` is the block alone again."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[int, int, bytes]]] = {False: [], True: []}
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if held[True] and held[False]:
                at = unpacked([x[2] for x in held[False] + held[True]])
                labels, tree = np.array([x[1] for x in held[False]], np.int64), RTree(at[: len(held[False])])
                found = [node for (node, label, _), x in zip(held[True], at[len(labels) :]) if (labels[tree.reach(x, p, q)] != label).any()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([now[0]] * len(found), [now[1] >> 32] * len(found), found)], schema=schema)

        for batch in batches:
            for part, block, *row, asks in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "node", "label", "point", "asks"))):
                if now != (part, block):
                    yield from close()
                    held, now = {False: [], True: []}, (part, block)
                held[asks].append(tuple(row))
        yield from close()

    columns = asked.select("part", "block", "node", "label", "asks", "point")
    return columns.repartition("part", "block").sortWithinPartitions("part", "block", "node").mapInArrow(run, "part long, block long, node long")


def keep_first(df: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of ``df`` with one document of each component: the one with the smallest doc_id.

    Texts without words link with nothing and stay. A component of rows with null
    ids alone keeps the text of the smallest hash. Rows that share id and text are
    one document: the one whose other columns hash lowest stays. Rows that share an
    id but not their text stay or go together. An empty table stays empty.
    """
    found = jaccard_components(df, k, p, q).where("leads").groupBy("key").agg(F.count("*").alias("copies"))
    kept = stored(found, "kept")
    at = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    names = {c.lower() for c in df.columns}
    spare = next(c for c in (f"key{i}" for i in itertools.count()) if c not in names)
    keyed = df.withColumn(spare, at)
    # keys grow with the corpus, so they are never broadcast, few as they may be
    once = keyed.join(kept.where("copies = 1").select(F.col("key").alias(spare)).hint("merge"), spare, "left_semi").drop(spare)
    again = kept.where("copies > 1").select(F.col("key").alias(spare))
    if again.isEmpty():
        return once
    # maps can't be hashed, so each column counts by its text
    own = [F.col(f"`{c}`") for c in df.columns]
    rank = F.xxhash64(*[F.to_json(F.struct(c)) for c in own])
    repeated = keyed.join(again, spare, "left_semi").groupBy(spare, F.xxhash64("text")).agg(F.min_by(F.struct(*own), rank).alias("row"))
    return once.unionByName(repeated.select("row.*"))


def op4_ngram_jaccard_join(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: 3-shingles, 100 * intersection >= 90 * union."""
    return jaccard_components(df, k=3, p=90, q=100).select("doc_id", "n_shingles", "component_id")
