"""A prefix trie of conversations, with sums over subtrees by heavy paths.

A node is a sequence of turns that conversations start with. It is named by 128
bits: the exclusive or, over its turns, of hashes of position, role and text, so
that running values within blocks of a conversation and the values of earlier
blocks give the names of all its prefixes, however long it is. Texts don't move.

Each node's largest child, by member conversations, continues its path; the other
children start paths of their own, each with half of the members at most, so no
node is below more than log2 of the conversations of those. Sums over subtrees are
taken path by path: a round for each level of paths, the deepest first, adds the
totals of the level's paths to those that they hang on, and a suffix sum along
every path gives the sums of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.frames import stored

#: Turns of a conversation, or nodes of a path, that one window holds.
BLOCK = 1024
#: Bits of conversation ids that one piece of a list of ids spans.
PIECE = 12
#: Before all turns there are.
FIRST = -(1 << 60)
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("k1", "k2")


def shared_turns(conv_id: Column) -> Column:
    """How many turns of the first conversation of its five a conversation takes over."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def first_of_five(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def positioned(df: DataFrame) -> DataFrame:
    """(conv_id, pos, e1, e2, n_bytes, n): every turn with its place from 0 among the n of its conversation.

    Turns are ordered by ``turn``, null first, and those of one number by a hash of
    role and text. Places are counted within stretches of turn numbers, and what
    comes before a stretch is added, so a long conversation isn't one task's.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.xxhash64(F.lit(11), role, text).alias("e1"), F.xxhash64(F.lit(23), role, text).alias("e2"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    rows = rows.withColumn("stretch", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(FIRST)))
    inner = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "e1", "e2")
    outer = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("c"))
    before = counts.select("conv_id", "stretch", F.coalesce(F.sum("c").over(outer.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(outer).alias("n"))
    numbered = rows.withColumn("nth", F.row_number().over(inner) - 1)
    return numbered.join(before, ["conv_id", "stretch"]).select("conv_id", (F.col("before") + F.col("nth")).alias("pos"), "e1", "e2", "n_bytes", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, e1, e2, n_bytes, is_end), (conv_id, length)) of conversations that start with turns of the first of their five.

    ``turns`` is as of ``positioned``. Conversation c takes the first h turns of
    c - c % 5, as far as there are any, then its own from place h on; h follows
    from c. No turn is copied but the first eight of the first of five.
    """
    own_h = shared_turns(F.col("conv_id"))
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", "n", first_of_five(F.col("conv_id")).alias("base"), own_h.alias("h"))
    taken = F.least("h", F.coalesce(F.max(F.when(F.col("conv_id") == F.col("base"), F.col("n"))).over(Window.partitionBy("base")), F.lit(0)))
    convs = convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stored(convs, "convs")
    rest = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").where("pos >= h")
    rest = rest.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "e1", "e2", "n_bytes", "length")
    lead = turns.where((F.col("conv_id") == first_of_five(F.col("conv_id"))) & (F.col("pos") < 8)).select(F.col("conv_id").alias("base"), "pos", "e1", "e2", "n_bytes")
    lead = lead.join(convs.select("conv_id", "base", "h", "length"), "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "e1", "e2", "n_bytes", "length")
    both = rest.unionByName(lead)
    return both.select("conv_id", "depth", "e1", "e2", "n_bytes", (F.col("depth") == F.col("length")).alias("is_end")), convs.select("conv_id", "length")


def _carried(rows: DataFrame, keys: list[str], block: str, order: Column, values: dict[str, Column], kept: list[str], merge, backwards: bool = False) -> DataFrame:
    """``rows`` with running values along ``keys``: within a block by a window, and over the blocks before by one value each.

    ``values`` are aggregates by name, ``merge`` joins a value with that of earlier
    blocks. A name that ends in '_before' leaves the row itself out.
    """
    inner = Window.partitionBy(*keys, block).orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inner.rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(F.desc(block) if backwards else F.asc(block)).rowsBetween(Window.unboundedPreceding, -1)
    run = rows.select(*kept, *[v.over(ahead if n.endswith("_before") else upto).alias(n) for n, v in values.items()])
    whole = rows.groupBy(*keys, block).agg(*[v.alias(n) for n, v in values.items()])
    earlier = whole.select(*keys, block, F.count("*").over(outer).alias("__nth"), *[merge(n)[0](n).over(outer).alias(f"__{n}") for n in values]).where("__nth > 0").drop("__nth")
    both = run.join(earlier, [*keys, block], "left")
    return both.select(*kept, *[merge(n)[1](F.col(n), F.col(f"__{n}")).alias(n) for n in values])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(F.coalesce(b, F.lit(0)))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes, is_end): each turn with the names of the node it ends and of that node's parent."""
    marks = [F.xxhash64(F.lit(s), F.col("depth").cast("bigint"), F.col("e1"), F.col("e2")) for s in (1, 2)]
    rows = turns.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "n_bytes", "is_end", marks[0].alias("t1"), marks[1].alias("t2"), F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    named = _carried(rows, ["conv_id"], "block", F.col("depth"), {"k1": F.bit_xor("t1"), "k2": F.bit_xor("t2")}, ["conv_id", "depth", "n_bytes", "is_end", "t1", "t2", "block"], lambda n: (F.bit_xor, _xor))
    return named.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "n_bytes", "is_end")


def nodes(steps: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, first, depth, n_convs, n_bytes, n_children, light) of every node below the root."""
    found = steps.groupBy(*_NODE).agg(*[F.min(c).alias(c) for c in ("p1", "p2", "depth", "n_bytes")], F.min("conv_id").alias("first"), F.count("*").alias("n_convs"))
    found = stored(found, "nodes")
    largest = F.max(F.struct("n_convs", (-F.col("first")).alias("first"), F.col("k1").alias("h1"), F.col("k2").alias("h2")))
    families = found.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), largest.alias("l"))
    families = stored(families.select(*_NODE, "n_children", "l.h1", "l.h2"), "families")
    heavy = families.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(False).alias("light"))
    both = found.join(families.select(*_NODE, "n_children"), [*_NODE], "left").join(heavy, [*_NODE], "left")
    return both.fillna(0, ["n_children"]).fillna(True, ["light"]), families.where("k1 = 0 AND k2 = 0")


def on_paths(steps: DataFrame, tree: DataFrame, root: int) -> DataFrame:
    """``tree`` with (parent, h1, h2, level, q1, q2): the parent's first member, the path (by its top node), how many paths are above it, and the parent's path.

    What lies above a node lies before it in its first member, so running maxima
    along conversations tell: the first member of a prefix can only grow with its
    length, and the last node that starts a path is the deepest.
    """
    top = F.max(F.when(F.col("light"), F.struct("depth", "k1", "k2")))
    rows = steps.select("conv_id", *_NODE).join(tree, [*_NODE]).withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    values = {"path": top, "path_before": top, "parent_before": F.max("first"), "level": F.count_if("light")}
    kept = [*tree.columns, "conv_id", "block"]
    deeper = lambda a, b: F.coalesce(a, b)  # noqa: E731  what is in the block lies deeper than what is before it
    merge = lambda n: (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))) if n == "level" else (F.max, deeper)
    walked = _carried(rows, ["conv_id"], "block", F.col("depth"), values, kept, merge).where("conv_id = first")
    zero = F.lit(0).cast("bigint")
    at = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), zero)  # noqa: E731  the root is (0, 0)
    return walked.select(*tree.columns, F.coalesce("parent_before", F.lit(root)).alias("parent"), at("path", "k1").alias("h1"), at("path", "k2").alias("h2"), "level", at("path_before", "k1").alias("q1"), at("path_before", "k2").alias("q2"))


def path_totals(walked: DataFrame) -> DataFrame:
    """(h1, h2, p1, p2, leaves, saved) of every path below the root's: the sums over the subtree of its top, and the node it hangs on.

    One round for each level of paths, from the deepest up: a level's totals are
    its paths' own sums and what the level below hangs on them.
    """
    top = F.min(F.struct("depth", "q1", "q2", "p1", "p2"))
    own = walked.groupBy("h1", "h2").agg(F.sum("leaf").alias("leaves"), F.sum("saves").alias("saved"), F.max("level").alias("level"), top.alias("t"))
    own = stored(own.where("level > 0").select("h1", "h2", "level", "leaves", "saved", "t.q1", "t.q2", "t.p1", "t.p2"), "paths")
    deepest, hung, levels = own.agg(F.max("level")).first()[0] or 0, None, []
    for level in range(deepest, 0, -1):
        now = own.where(F.col("level") == level)
        if hung is not None:
            now = now.join(hung, ["h1", "h2"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
        now = stored(now.select("h1", "h2", "q1", "q2", "p1", "p2", "leaves", "saved"), "totals")
        hung = now.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        levels.append(now)
    out = own.select("h1", "h2", "p1", "p2", "leaves", "saved").limit(0)
    for now in levels:
        out = out.unionByName(now.select("h1", "h2", "p1", "p2", "leaves", "saved"))
    return out


def subtree_sums(walked: DataFrame) -> DataFrame:
    """``walked`` with n_leaves and saved_tokens over each node's subtree, the node included."""
    light = path_totals(walked).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    own = walked.join(light, [*_NODE], "left").withColumn("block", F.expr(f"depth div {BLOCK}"))
    own = own.withColumns({"l": F.col("leaf") + F.coalesce("hung_leaves", F.lit(0)), "s": F.col("saves") + F.coalesce("hung_saved", F.lit(0))})
    plus = lambda n: (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))
    kept = [*walked.columns, "block"]
    return _carried(own, ["h1", "h2"], "block", F.desc("depth"), {"n_leaves": F.sum("l"), "saved_tokens": F.sum("s")}, kept, plus, backwards=True).select(*walked.columns, "n_leaves", "saved_tokens")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal names; the pieces of a run come in order and aren't held."""
    key, state, out = None, None, []
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])

    def flushed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(text.encode())
        if len(out) >= 10_000:
            yield flushed(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield flushed(out)


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends): the digest of the ids, ascending and joined by commas, of the conversations that end at each node.

    Ids are sorted and joined in pieces of neighbouring ids, so lists are bounded;
    the pieces of a node then pass through one digest in order.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*_NODE, F.shiftright("conv_id", PIECE).alias("piece")).agg(ids.alias("ids"))  # ids differ: 2^PIECE at most
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "piece").mapInArrow(_digest, "k1 long, k2 long, ends string")


def trie(df: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations of ``df`` (conv_id, turn, role, text)."""
    turns, convs = rebuilt(stored(positioned(df), "turns"))
    facts = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()
    spark = df.sparkSession
    if not facts.n:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    steps = stored(prefixes(turns), "steps")
    tree, top = nodes(steps)
    leaf, saves = (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saves")
    below = on_paths(steps, tree, facts.first).select(*_NODE, "p1", "p2", "first", "parent", "depth", "n_convs", "n_children", "h1", "h2", "level", "q1", "q2", leaf, saves)
    # the root is named (0, 0), on a path of its own name with the largest first turn
    n_children = F.coalesce(F.max("n_children"), F.lit(0))
    zero = F.lit(0).cast("bigint")
    root = top.agg(n_children.alias("n_children")).select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), F.lit(facts.first).alias("first"), F.lit(None).cast("bigint").alias("parent"), zero.alias("depth"), F.lit(facts.n).alias("n_convs"), "n_children",
        zero.alias("h1"), zero.alias("h2"), zero.alias("level"), zero.alias("q1"), zero.alias("q2"), leaf, zero.alias("saves"),
    )
    walked = stored(below.unionByName(root), "walked")
    ends = steps.where("is_end").select(*_NODE, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    out = subtree_sums(walked).join(end_digests(ends), [*_NODE], "left")
    return out.select(F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(df: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of ``df``'s rebuilt conversations.

    Rows without conv_id take no part. Null turns come first; turns of one number,
    repeated rows among them, all stay and are ordered by a hash of role and text,
    so the result is the same at any layout. Null role and text count as empty,
    and c % 5 has the sign of c, as in SQL.
    Of children with equally many members the one with the smaller first member
    continues the path. A conversation left without turns is a member of the root
    and ends there. An empty table gives no rows. Other columns aren't read.
    """
    return trie(df.select("conv_id", "turn", "role", "text"))


#: Prefixes as strings; every node below a node is found in the prefixes of its first member. For small tables only.
OP12_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), ordered AS (
  SELECT conv_id, md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS mark, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), sized AS (
  SELECT DISTINCT conv_id, n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM ordered, crc
), convs AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS length FROM sized c LEFT JOIN sized b ON b.conv_id = c.base
), turns AS (
  SELECT conv_id, taken + pos - h + 1 AS depth, mark, n_bytes, length FROM ordered JOIN convs USING (conv_id) WHERE pos >= h
  UNION ALL SELECT c.conv_id, pos + 1, mark, n_bytes, length FROM ordered o JOIN convs c ON c.base = o.conv_id WHERE pos < h
), steps AS (
  SELECT conv_id, depth, n_bytes, length, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, length, '' FROM convs
), nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS first, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM steps GROUP BY node
), family AS (
  SELECT n.node, count(c.node) AS n_children FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.node[:32 * n.depth] = n.node GROUP BY n.node
), sums AS (
  SELECT s.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens
  FROM nodes n JOIN family USING (node) JOIN steps s ON s.conv_id = n.first AND s.depth <= n.depth GROUP BY s.node
)
SELECT n.first AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.first AS parent_conv_id, n.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN family f USING (node) JOIN sums USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[:32 * (n.depth - 1)]
"""
