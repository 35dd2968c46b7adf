"""Near-duplicate vectors by a forest of random-projection trees.

Each node of a tree has random directions and sends a vector to the branch on whose
direction it lies furthest; vectors close to a border go to both sides. The first
nodes are fitted on one sample; leaves that turn out large are split further, each on
a sample of its own, level by level, so depth follows the number of vectors. Vectors
that share a leaf in any tree are compared in full. A pair that meets in several leaves
counts in the first of them only, which both ends can tell from their lists of leaves,
so links are counted in place and no pair is ever written out. Leaves are solved in
passes whose copies of vectors take a bounded multiple of the input.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.components import connected_components
from tieout.llm.frames import dropped, map_arrow, share, shuffles_dropped, stored

#: Vectors the first nodes are fitted on, about, chosen by a hash; every vector is then placed.
SAMPLE = 16_384
TREES = 5
#: A leaf with more vectors is split again, on about so many of its own; vectors are dealt to such leaves so many at a time.
SPLIT_ROWS, SPLIT_SAMPLE, SHARE_ROWS = 1536, 512, 65_536
#: Vectors a leaf is meant to hold, before those that spill over.
LEAF_ROWS = 384
#: Above so many vectors leaves grow with the square root of their number: copies cost more than comparisons.
LARGE = 1 << 18
#: A node has no more branches than leave so many of the sample to each.
LEAF_SAMPLE = 12
#: Half-width of the zone that goes to both sides, in standard deviations of the projected difference of a pair at the limit.
SPILL = 0.85
#: A split that leaves a branch with more than this share is not made, nor one whose branches together hold more than that share of the pairs.
SIDE, PAIRS = 0.7, 0.9
#: Rows of one block of a leaf; larger leaves are compared block by block.
BLOCK = 32_768
TILE = 512
#: Copies of vectors that one pass shuffles: so many times the vectors, or so many bytes where that is more.
PASS_SHARE, PASS_BYTES = 2, 256 << 20


@dataclass
class Forest:
    """Per tree: one node of random directions, made again from its seed; what is cut off each direction's projection; its leaves, numbered across trees."""

    seeds: list[list[int]]
    dim: int
    cuts: list[np.ndarray]
    leaf: list[np.ndarray]
    spill: float

    @classmethod
    def grown(cls, sample: np.ndarray, leaf_sample: float, limit: float, trees: int = TREES, seed: int = 11) -> Forest:
        dim, middle = sample.shape[1], sample.mean(0)
        # between two directions: the difference of two projections
        out = cls([], dim, [], [], SPILL * math.sqrt(2) * math.sqrt(2 - 2 * limit) / math.sqrt(dim))
        wanted = min(math.ceil(len(sample) / leaf_sample), len(sample) // 2)
        number = 0
        for t in range(trees):
            branches, attempt = wanted, 0
            while branches > 1:
                own = [seed, t, attempt]
                cut = (_directions(own, branches, dim) @ middle).astype(np.float32)
                held = np.bincount(cls([own], dim, [cut], [np.arange(branches)], out.spill).leaves(sample)[1], minlength=branches) / len(sample)
                if held.max() <= SIDE and (held * held).sum() <= PAIRS:
                    break
                # such directions don't part the vectors; others, or fewer, may
                attempt += 1
                branches = branches if attempt % 3 else branches // 2
            else:
                own, cut = [seed, t, attempt], np.full(1, math.nan, np.float32)
            out.seeds.append(own)
            out.cuts.append(cut)
            out.leaf.append(number + np.arange(len(cut)))
            number += len(cut)
            if number == 1:
                break  # one leaf holds all: another tree would be the same
        return out

    def leaves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each vector falls in, by row."""
        rows_out, leaf_out = [], []
        units = units.astype(np.float32)
        for seed, cut, leaf in zip(self.seeds, self.cuts, self.leaf):
            if len(cut) == 1:
                rows_out.append(np.arange(len(units)))
                leaf_out.append(np.full(len(units), leaf[0]))
                continue
            directions = _directions(seed, len(cut), self.dim)
            for start in range(0, len(units), TILE):
                own = units[start : start + TILE] @ directions.T - cut
                row, branch = np.divmod(np.flatnonzero(own >= own.max(1, keepdims=True) - np.float32(self.spill)), len(cut))
                rows_out.append(row + start)
                leaf_out.append(leaf[branch])
        rows, found = np.concatenate(rows_out), np.concatenate(leaf_out)
        order = np.lexsort((found, rows))
        return rows[order], found[order]


def _directions(seed: list[int], n: int, dim: int) -> np.ndarray:
    out = np.random.default_rng(seed).standard_normal((n, dim), np.float32)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision of the rows of ``x``, none of which is zero."""
    # scaled first, so that neither large nor small components leave the range of squares
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def _classes(df: DataFrame, kind: str) -> DataFrame:
    """(vec_id, node, raw): valid rows get a name of their direction and their components' bytes, others neither."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("raw", T.BinaryType())])
    arrow = pa.schema([("vec_id", pa.int64()), ("node", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                piece = batch.slice(start, 2048)
                nodes: list[int | None] = [None] * piece.num_rows
                raws: list[bytes | None] = [None] * piece.num_rows
                many = pc.fill_null(pc.list_value_length(piece.column(1)), 0).to_numpy()
                first = np.cumsum(many) - many
                values = piece.column(1).flatten()
                flat = pc.fill_null(values, math.nan).to_numpy()
                for n in np.unique(many[many > 0]).tolist():
                    rows = np.flatnonzero(many == n)
                    x = flat[first[rows][:, None] + np.arange(n)].astype(kind)
                    good = np.isfinite(x).all(1) & x.any(1)
                    rows, x = rows[good], x[good]
                    for i, v, u in zip(rows.tolist(), x, units(x).astype("<f8")):
                        raws[i] = v.tobytes()
                        nodes[i] = xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], schema=arrow)

    embedding = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding")).mapInArrow(run, schema)


@dataclass
class Rows:
    """Rows of one side of a task, column by column; row i is in the leaves ``flat[start[i] : start[i] + many_leaves[i]]``."""

    node: np.ndarray
    many: np.ndarray
    unit: np.ndarray
    short: np.ndarray
    start: np.ndarray
    many_leaves: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, dim: int, kind: str) -> Rows:
        """Columns node, many, raw, leaves of ``batch`` without a Python object a row."""
        node, many, raw, leaves = (batch.column(c) for c in ("node", "many", "raw", "leaves"))
        raw = raw.cast(pa.binary())
        # all have one length and are never null, so they lie side by side
        first = np.frombuffer(raw.buffers()[1], np.int32, 1, 4 * raw.offset)[0]
        unit = units(np.frombuffer(raw.buffers()[2], kind, dim * len(raw), first).reshape(-1, dim))
        ends = leaves.offsets.to_numpy()
        return cls(node.to_numpy(), many.to_numpy(), unit, unit.astype(np.float32), ends[:-1], np.diff(ends), leaves.values.to_numpy())

    @classmethod
    def joined(cls, pieces: list[Rows]) -> Rows:
        if len(pieces) == 1:
            return pieces[0]
        shift = np.cumsum([0] + [len(x.flat) for x in pieces[:-1]])
        start = np.concatenate([x.start + s for x, s in zip(pieces, shift)])
        return cls(*(np.concatenate([getattr(x, c) for x in pieces]) for c in ("node", "many", "unit", "short")), start, *(np.concatenate([getattr(x, c) for x in pieces]) for c in ("many_leaves", "flat")))

    def __getitem__(self, part: slice) -> Rows:
        return Rows(self.node[part], self.many[part], self.unit[part], self.short[part], self.start[part], self.many_leaves[part], self.flat)

    def early(self, chosen: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``chosen``, leaf) of the leaves before ``leaf`` of the chosen rows."""
        n = self.many_leaves[chosen]
        owner = np.repeat(np.arange(len(chosen)), n)
        code = self.flat[np.arange(len(owner)) + np.repeat(self.start[chosen] - (np.cumsum(n) - n), n)]
        return owner[code < leaf], code[code < leaf]


def _linked(below: Rows, beside: Rows, limit: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns, and which of them have a cosine of ``limit`` or more: in single precision, and in double where its rounding could tell otherwise.

    Where both sides are the ``same``, each pair shows once.
    """
    slack = np.float32(2 * (below.short.shape[1] + 8) * 2.0**-24)
    low, high = np.float32(limit) - slack, np.float32(limit) + slack
    cosine = below.short @ beside.short.T
    if same:
        np.fill_diagonal(cosine, -2)
    hit = cosine >= low
    r = np.flatnonzero(hit.any(1))
    c = np.flatnonzero(hit[r].any(0))
    own = cosine[np.ix_(r, c)]
    link = own >= low
    if same:
        link &= r[:, None] > c
    i, j = np.nonzero(link & (own < high))
    for start in range(0, len(i), 1 << 16):
        x, y = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
        link[x, y] = np.einsum("ij,ij->i", below.unit[r[x]], beside.unit[c[y]]) >= limit
    r, c, link = r[up := link.any(1)], c[across := link.any(0)], link[np.ix_(up, across)]
    return r, c, link


def _firsts_only(link: np.ndarray, r: np.ndarray, c: np.ndarray, below: Rows, beside: Rows, leaf: int) -> None:
    """Clear from ``link`` the pairs that share an earlier leaf."""
    a, b = below.early(r, leaf), beside.early(c, leaf)
    codes = np.intersect1d(a[1], b[1])
    if not len(codes):
        return

    def flags(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(codes)), np.float32)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[at] == code
        out[owner[hit], at[hit]] = 1
        return out

    link &= flags(*a, len(r)) @ flags(*b, len(c)).T == 0


def _joined(link: np.ndarray, below: np.ndarray, beside: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of node names that connect what ``link`` (rows by columns, none of them empty) connects."""
    label_c = np.arange(len(beside))
    while True:
        label_r = np.where(link, label_c[None, :], len(beside)).min(1)
        new = np.minimum(label_c, np.where(link, label_r[:, None], len(beside)).min(0))
        if (new == label_c).all():
            break
        label_c = new
    moved = np.flatnonzero(label_c != np.arange(len(beside)))
    return [*zip(below.tolist(), beside[label_c[label_r]].tolist()), *zip(beside[moved].tolist(), beside[label_c[moved]].tolist())]


_FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("other", T.LongType())])


def near_vectors(df: DataFrame, limit: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df`` (vec_id, embedding).

    Two rows link when the cosine of their vectors, in double precision, is
    ``limit`` or more and some tree brings them together; equal directions always
    link. A vector that is null, empty, zero, or holds a null or a non-finite
    component links with nothing and is its own component; vectors of different
    lengths don't link. Repeated rows are rows of their own. component_id is the
    smallest vec_id reachable by links; kept marks it. Null ids take part but
    never name a component that has another id. An empty table gives an empty
    result. Directions are named by 64-bit hashes.
    """
    with shuffles_dropped(df.sparkSession):
        return _near_vectors(df, limit)


def _near_vectors(df: DataFrame, limit: float) -> DataFrame:
    # single components stay as short as they are given
    kind = "<f4" if df.schema["embedding"].dataType == T.ArrayType(T.FloatType(), df.schema["embedding"].dataType.containsNull) else "<f8"
    named = _classes(df, kind)
    base = stored(named.select("vec_id", "node"), "directions")
    whole = stored(named.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("many"), F.first("raw").alias("raw")), "whole")
    classes = stored(whole.select("node", "first_id", "many", F.length("raw").alias("dim")), "classes")
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()
    placed = [_placed(whole.where(F.length("raw") == r.dim).select("node", "many", "raw"), r.dim // int(kind[-1]), r.n, limit, kind) for r in lengths]
    if sum(r.n * r.dim for r in lengths) > PASS_BYTES:
        dropped(whole)
    pieces = [piece for r, own in zip(lengths, placed) for piece in _passes(own, r.dim // int(kind[-1]), r.n, limit, kind)]
    if not pieces:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = pieces[0]
    for own in pieces[1:]:
        found = found.unionByName(own)
    links = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("links"))
    joined = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors")
    rooted = classes.select("node", "first_id", "many").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(smallest, "root").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"))
    out = base.join(known, "node", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _placed(classes: DataFrame, dim: int, n: int, limit: float, kind: str) -> DataFrame:
    """``classes`` (node, many, raw), all of one length, with their leaves."""
    spark = classes.sparkSession
    bound = max(256, min(SAMPLE, (64 << 20) // (8 * dim)))
    part = share(n, bound)
    picked = classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else classes
    sample = units(np.stack([np.frombuffer(r.raw, kind) for r in picked.select("raw", "node").orderBy("node").collect()]))
    grow = max(1.0, math.sqrt(n / LARGE))
    leaf_sample = max(LEAF_SAMPLE, LEAF_ROWS * grow * len(sample) / n)
    forest = spark.sparkContext.broadcast(Forest.grown(sample, leaf_sample, limit))  # bounded by SAMPLE

    placed_schema = T.StructType([*classes.schema, T.StructField("leaves", T.ArrayType(T.IntegerType()))])

    def place():
        own = forest.value

        def work(batch: pa.RecordBatch):
            rows, found = own.leaves(units(np.stack([np.frombuffer(v, kind) for v in batch.column(2).to_pylist()])))
            return [*batch.columns, _lists(rows, found, batch.num_rows)]

        return work

    placed = stored(map_arrow(classes, place, placed_schema, "raw"), "placed")
    return _deepened(placed, limit, kind, grow, sum(map(len, forest.value.leaf)), n * dim * int(kind[-1]))


def _passes(placed: DataFrame, dim: int, n: int, limit: float, kind: str) -> list[DataFrame]:
    """(node, n, other), a table for each pass: links of a node counted in some leaf, or a connection between two nodes."""
    leaf = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    leaf = stored(leaf, "leaves")
    copies, most = leaf.agg(F.sum(F.col("rows") * F.col("blocks")), F.max("blocks")).first()
    width = dim * int(kind[-1])
    passes = math.ceil(copies * (width + 64 + 2 * copies / n) / max(PASS_BYTES, PASS_SHARE * n * width))
    # a leaf of b blocks is b * (b + 1) / 2 tasks, and block i is in b of them
    member = placed.select("*", F.explode("leaves").alias("leaf"))
    if most > 1:
        held = leaf.where("blocks > 1").select("leaf", "blocks")  # one row for BLOCK vectors at most
        member = member.join(F.broadcast(held), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        member = member.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        member = member.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    task = member.select("leaf", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).alias("second"), "node", "many", "raw", "leaves")
    found_arrow = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def solve(leaf: int, sides: tuple[list[Rows], list[Rows]]) -> list[np.ndarray]:
        """Columns node, n, other of one task."""
        alone = not sides[1]
        a = Rows.joined(sides[0])
        b = a if alone else Rows.joined(sides[1])
        near: list[tuple[int, int]] = []
        counts = [np.zeros(len(x.node), np.int64) for x in (a, b)]
        for p in range(0, len(a.node), TILE):
            for q in range(p if alone else 0, len(b.node), TILE):
                u, v = slice(p, p + TILE), slice(q, q + TILE)
                r, c, link = _linked(a[u], b[v], limit, alone and p == q)
                if not len(r):
                    continue
                near += _joined(link, a.node[u][r], b.node[v][c])
                _firsts_only(link, r, c, a[u], b[v], leaf)
                i, j = np.nonzero(link)
                i, j = r[i] + p, c[j] + q
                counts[0] += np.bincount(i, b.many[j], len(a.node)).astype(np.int64)
                counts[0 if alone else 1] += np.bincount(j, a.many[i], len(b.node)).astype(np.int64)
        ends = np.array(near, np.int64).reshape(-1, 2)
        has = [np.flatnonzero(c) for c in counts]
        node = np.concatenate([ends[:, 0], *(x.node[h] for x, h in zip((a, b), has))])
        n = np.concatenate([np.zeros(len(ends), np.int64), *(c[h] for c, h in zip(counts, has))])
        other = np.concatenate([ends[:, 1], np.zeros(len(node) - len(ends), np.int64)])
        return [node, n, np.ma.array(other, mask=np.arange(len(node)) >= len(ends))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def close() -> pa.RecordBatch | None:
            # blocks of one leaf that differ but hold rows on one side only have nothing to compare
            if now[1] != now[2] and not (sides[0] and sides[1]):
                return None
            node, n, other = solve(now[0], sides)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(other.data, mask=other.mask)], schema=found_arrow) if len(node) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows.of(batch, dim, kind)
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("leaf", "x", "y", "second")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                leaf, x, y, second = keys[start].tolist()
                if (leaf, x, y) != now:
                    if now is not None and (done := close()) is not None:
                        yield done
                    now, sides = (leaf, x, y), ([], [])
                sides[second].append(rows[start:end])
        if now is not None and (done := close()) is not None:
            yield done

    out = []
    for turn in range(passes):
        own = task.where(F.pmod(F.col("leaf") + F.col("x") + F.col("y"), F.lit(passes)) == turn).withColumn("leaves", F.slice("leaves", 1, F.array_position("leaves", F.col("leaf")).cast("int")))
        out.append(stored(own.repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y", "second", "node").mapInArrow(run, _FOUND), "found"))
    if n * width > PASS_BYTES:
        dropped(placed)
    return out


def _lists(rows: np.ndarray, found: np.ndarray, n: int) -> pa.ListArray:
    """The values of ``found`` by row, for rows 0 to ``n`` - 1."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))


def _deepened(placed: DataFrame, limit: float, kind: str, grow: float, number: int, size: int) -> DataFrame:
    """``placed`` (node, many, raw, leaves) with leaves of more than SPLIT_ROWS * ``grow`` rows split by trees of their own, until none can be.

    A leaf that no directions part, such as one of near-equal vectors, stays whole. The
    trees go to every task as seeds and cuts; as leaves grow with the square root of the
    rows, so do they. Leaves are numbered from ``number``; of tables of more than
    PASS_BYTES (``size``) each level is deleted once the next is written.
    """
    spark, most, whole = placed.sparkSession, SPLIT_ROWS * grow, set()
    while True:
        counts = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()
        large = [(r.leaf, r.n) for r in counts if r.leaf not in whole]
        if not large:
            return placed
        sizes = F.broadcast(spark.createDataFrame(large, "leaf int, n long"))
        inside = placed.select("node", "raw", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
        part = F.least(F.lit(1.0), F.lit(float(SPLIT_SAMPLE)) / F.col("n")) * (1 << 20)
        picked = inside.where(F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 20)) < part)
        trees = picked.select("leaf", "n", "node", "raw").repartition("leaf").sortWithinPartitions("leaf", "node").mapInArrow(_subtrees(limit, kind, most), "leaf int, tree binary").collect()
        made: dict[int, Forest] = {}
        for row in sorted(trees):
            tree = pickle.loads(row.tree)
            if len(tree.cuts[0]) > 1:
                tree.leaf = [number + np.arange(len(tree.cuts[0]))]
                number += len(tree.cuts[0])
                made[row.leaf] = tree
        whole |= {leaf for leaf, _ in large if leaf not in made}
        if not made:
            return placed
        before, placed = placed, stored(placed.mapInArrow(_replaced(spark.sparkContext.broadcast(made), kind), placed.schema), "placed")
        if size > PASS_BYTES:
            dropped(before)


def _replaced(trees, kind: str):
    """Puts the leaves of ``trees`` in the place of those they split, SHARE_ROWS vectors at a time, as each leaf's directions are made once for them."""

    def replaced(batch: pa.RecordBatch, made: dict[int, Forest]) -> pa.RecordBatch:
        node, many, raw, leaves = batch.columns
        unit = units(np.stack([np.frombuffer(v, kind) for v in raw.to_pylist()]))
        rows, found = np.repeat(np.arange(len(unit)), pc.list_value_length(leaves).to_numpy()), leaves.flatten().to_numpy()
        order = np.argsort(found, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(found[order])) + 1).tolist(), len(order)]
        rows_out, found_out = [], []
        for a, b in zip(cuts, cuts[1:]):
            own, leaf = rows[order[a:b]], int(found[order[a]])
            if leaf in made:
                at, branch = made[leaf].leaves(unit[own])
                rows_out.append(own[at])
                found_out.append(branch)
            else:
                rows_out.append(own)
                found_out.append(found[order[a:b]])
        rows, found = np.concatenate(rows_out), np.concatenate(found_out)
        order = np.lexsort((found, rows))
        return pa.RecordBatch.from_arrays([node, many, raw, _lists(rows[order], found[order], len(unit))], ["node", "many", "raw", "leaves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = trees.value, []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(x.num_rows for x in held) >= SHARE_ROWS:
                yield replaced(pa.concat_batches(held), made)
                held = []
        if held:
            yield replaced(pa.concat_batches(held), made)

    return run


def _subtrees(limit: float, kind: str, most: float):
    """Per leaf of a sorted stream (leaf, n, node, raw) the pickled tree fitted on its rows."""
    schema = pa.schema([("leaf", pa.int32()), ("tree", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now: tuple[int, int] | None = None

        def close() -> pa.RecordBatch:
            leaf, n = now
            sample = units(np.stack([np.frombuffer(v, kind) for v in held]))
            # branches of half the size that is split, before those that spill over
            tree = Forest.grown(sample, max(LEAF_SAMPLE, most / 2 * len(sample) / n), limit, 1, leaf + 12)
            return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], schema=schema)

        for batch in batches:
            for leaf, n, raw in zip(*(batch.column(c).to_pylist() for c in ("leaf", "n", "raw"))):
                if now is not None and leaf != now[0]:
                    yield close()
                    held = []
                now = (leaf, n)
                held.append(raw)
        if now is not None:
            yield close()

    return run


def op3_vector_forest(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: cosine 0.95 or more."""
    return near_vectors(df)
