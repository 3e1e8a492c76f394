"""Merkle manifest of a dataset: trees of 16 children per node, kept in van Emde Boas layout.

Leaves of a tree are numbered. Aligned blocks of 4096 of them are subtrees of four levels; each is built in one task and stored as
one string of digests, in which a subtree is split at half its height: the upper half first, then every lower half on its own,
and each half likewise. Where a node lies follows from its level and number, whatever the size of a cache or a page; a run of siblings
is one piece of the string. The roots of the blocks are the leaves of the next level of blocks, until one block is left.

Proofs come from the top down: a block hands the way from each of its leaves to the root on to the block below that leaf.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, through_parquet
from .common import small_batches

#: Children of a node, and levels below the root of a block.
FAN, HEIGHT = 16, 3
#: Key of the tree over all other trees; those have keys that start with ``=``, or ``-`` for null.
TOP = ""
WAY = "array<struct<l: string, r: string>>"


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ layout

def nodes_in(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(depth: int, number, levels: int):
    """Place of the nodes ``number`` (an array) at ``depth`` of a full tree of ``levels`` levels, in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(depth, number, upper)
    lower, below = levels - upper, depth - upper
    size = FAN ** below
    return nodes_in(upper) + number // size * nodes_in(lower) + address(below, number % size, lower)


def heights(count: int, whole: bool, height=HEIGHT) -> int:
    """Levels below the root of a block of ``count`` leaves; ``whole``: the block is all of its tree."""
    if not whole:
        return height
    levels = 0
    while FAN ** levels < count:
        levels += 1
    return levels


class Block:
    """Subtree over ``count`` leaves: the digests of its nodes (hex) in one string."""

    def __init__(self, count: int, levels: int, text=None):
        self.levels = levels
        self.counts = [-(-count // FAN ** (levels - d)) for d in range(levels + 1)]
        self.text = text

    def places(self, depth):
        return address(depth, np.arange(self.counts[depth]), self.levels + 1)

    def built(self, leaves):
        """Fill in all nodes above ``leaves`` (hex) and return the block."""
        slots = [""] * (int(max(self.places(d).max() for d in range(self.levels + 1))) + 1)
        row = leaves
        for depth in range(self.levels, -1, -1):
            for place, digest in zip(self.places(depth).tolist(), row):
                slots[place] = digest
            if depth:
                row = [hashed("".join(row[i:i + FAN])) for i in range(0, len(row), FAN)]
        self.text = "".join(x or "0" * 64 for x in slots)
        return self

    @property
    def root(self):
        return self.text[:64]

    def siblings(self, depth, number, place):
        """Digests left and right of a node: its run is one piece of the string, because a lower half has whole runs, unless the
        run's level is the first of a lower half; then each node starts a half of its own."""
        first = number // FAN * FAN
        past = min(first + FAN, self.counts[depth])
        at = place[first:past]
        if len(at) < 2 or at[1] - at[0] == 1:
            start = at[0] * 64
            own = start + (number - first) * 64
            return self.text[start:own], self.text[own + 64:start + len(at) * 64]
        run = [self.text[p * 64:p * 64 + 64] for p in at]
        return "".join(run[:number - first]), "".join(run[number - first + 1:])

    def ways(self, above):
        """Ways of all leaves to the root, each a list of (left, right) from the leaf up, followed by ``above``."""
        ways = [above]
        for depth in range(1, self.levels + 1):
            place = self.places(depth).tolist()
            ways = [[self.siblings(depth, i, place), *ways[i // FAN]] for i in range(self.counts[depth])]
        return ways


def fold(digest: str, way) -> str:
    """Root that follows from a leaf and its way."""
    for left, right in way:
        digest = hashed(left + digest + right)
    return digest


# ------------------------------------------------------------------ numbering

def numbered(rows: DataFrame, tree: str, order, keep, partitions=None) -> DataFrame:
    """``keep`` of ``rows`` with ``rank`` (from 0, in ``order`` within ``tree``) and ``n`` (rows of the tree).

    Rows are sorted by range over all trees, so a large tree is cut into many ranges; rows of a range are counted per tree and
    the counts of the ranges before are added. What is kept is written to the shared folder once, so numbers stay as they are.
    """
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows equal in all of the order are told apart by where they were read: any order of them gives the same tree.
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts, tree, *order, "__tie").sortWithinPartitions(tree, *order, "__tie")
    placed = checkpointed(ranged.select(tree, *keep, F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy(tree, part).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    own = Window.partitionBy(tree)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(tree, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("n"))
    return (placed.withColumn("__part", part).join(starts, [tree, "__part"])
            .withColumn("rank", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift"))


def runs(batches, columns):
    """Rows of sorted Arrow ``batches`` as (tree, block, rows) with all rows of a block together; ``rows`` are tuples of ``columns``.

    Rows of one block at a time are held: 4096 leaves and what describes their block.
    """
    held, key = [], None
    for batch in batches:
        data = [batch.column(c).to_pylist() for c in ("tree", "block", *columns)]
        for tree, block, *row in zip(*data):
            if (tree, block) != key:
                if held:
                    yield *key, held
                held, key = [], (tree, block)
            held.append(row)
    if held:
        yield *key, held


def grouped(rows: DataFrame, *order) -> DataFrame:
    """Rows of a block in one partition, one after the other in ``order``."""
    return small_batches(rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order))


# ------------------------------------------------------------------ building

def built(leaves: DataFrame, height=HEIGHT) -> DataFrame:
    """Blocks over ``leaves`` (tree, rank, n, digest hex): tree, block, n, root, nodes (digests in van Emde Boas order), kept."""
    def build(batches):
        out = []
        for tree, block, rows in runs(batches, ("n", "digest")):
            n = rows[0][0]
            made = Block(len(rows), heights(n, n <= FAN ** height, height)).built([d for _, d in rows])
            out.append((tree, block, n, made.root, made.text))
            if len(out) >= 64:
                yield batch_of(out, "tree block n root nodes")
                out = []
        if out:
            yield batch_of(out, "tree block n root nodes")

    block = F.floor(F.col("rank") / FAN ** height).cast("bigint")
    rows = grouped(leaves.select("tree", block.alias("block"), "rank", "n", "digest"), "rank")
    return through_parquet(rows.mapInArrow(build, "tree string, block bigint, n bigint, root string, nodes string"), "merkle-blocks")


def batch_of(rows, names):
    return pa.RecordBatch.from_pydict(dict(zip(names.split(), map(list, zip(*rows)))))


def forest(leaves: DataFrame, height=HEIGHT) -> list[DataFrame]:
    """Blocks of all levels, lowest first; each level has a block per 4096 of the level before."""
    levels = [built(leaves, height)]
    per = FAN ** height
    while levels[-1].where(F.col("n") > per).limit(1).count():
        wide = levels[-1].where(F.col("n") > per)
        levels.append(built(wide.select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("n") / per).cast("bigint").alias("n"), F.col("root").alias("digest")), height))
    return levels


def roots(levels: list[DataFrame], height=HEIGHT) -> DataFrame:
    """Root of every tree: tree, digest."""
    found = [level.where(F.col("n") <= FAN ** height).select("tree", F.col("root").alias("digest")) for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# ------------------------------------------------------------------ proofs

def leaf_ways(blocks: DataFrame, height=HEIGHT) -> DataFrame:
    """Ways of the leaves of ``blocks`` (with ``way``, that of their root): tree, number of the leaf in its tree, way, subroot."""
    def spread(batches):
        for batch in batches:
            names = ("tree", "block", "n", "nodes", "way", "subroot")
            for tree, block, n, nodes, above, subroot in zip(*[batch.column(c).to_pylist() for c in names]):
                first = block * FAN ** height
                count = min(FAN ** height, n - first)
                ways = Block(count, heights(n, n <= FAN ** height, height), nodes).ways([(x["l"], x["r"]) for x in above])
                for i in range(0, count, 256):
                    part = ways[i:i + 256]
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree] * len(part)), "number": pa.array(range(first + i, first + i + len(part)), pa.int64()),
                        "way": pa.array([[{"l": a, "r": b} for a, b in w] for w in part], pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))),
                        "subroot": pa.array([subroot] * len(part))})

    rows = small_batches(blocks.select("tree", "block", "n", "nodes", "way", "subroot"))
    return rows.mapInArrow(spread, f"tree string, number bigint, way {WAY}, subroot string")


def block_ways(levels: list[DataFrame], tree_ways: DataFrame, height=HEIGHT) -> DataFrame:
    """The lowest blocks of ``levels`` with ``way`` (from their root to the root of all) and subroot; ``tree_ways`` has both per tree.

    A block meets what is above it by its tree and number, so a large tree's blocks are spread like any others.
    """
    per = FAN ** height
    below = None
    for level in reversed(levels):
        known = level.where(F.col("n") <= per).join(tree_ways, "tree")
        if below is not None:
            found = leaf_ways(below, height).withColumnRenamed("number", "block")
            known = known.unionByName(level.where(F.col("n") > per).join(found, ["tree", "block"]))
        below = known
    return below


def proven(leaves: DataFrame, blocks: DataFrame, height=HEIGHT) -> DataFrame:
    """``leaves`` (tree, rank, id, digest, shown) as id, leaf, subroot, proof (digest of all siblings up to the root, left to right) and
    folded (the root that follows from ``shown``). ``blocks`` are the lowest ones with their ways."""
    per = FAN ** height

    def prove(batches):
        for _, block, rows in runs(batches, ("rank", "id", "digest", "shown", "n", "nodes", "way", "subroot")):
            # The block itself comes first.
            *_, n, nodes, above, subroot = rows[0]
            first = block * per
            ways = Block(min(per, n - first), heights(n, n <= per, height), nodes).ways([(x["l"], x["r"]) for x in above])
            for i in range(1, len(rows), 1024):
                part = rows[i:i + 1024]
                own = [ways[r[0] - first] for r in part]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([r[1] for r in part], pa.int64()), "leaf": pa.array([r[2] for r in part]), "subroot": pa.array([subroot] * len(part)),
                    "proof": pa.array([hashed("".join(a + b for a, b in w)) for w in own]),
                    "folded": pa.array([fold(r[3], w) for r, w in zip(part, own)])})

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = leaves.select("tree", F.floor(F.col("rank") / per).cast("bigint").alias("block"), "rank", F.col("id").cast("bigint").alias("id"), "digest", "shown",
                        none("bigint", "n"), none("string", "nodes"), none(WAY, "way"), none("string", "subroot"))
    heads = blocks.select("tree", "block", F.lit(-1).cast("bigint").alias("rank"), none("bigint", "id"), none("string", "digest"),
                          none("string", "shown"), "n", "nodes", "way", "subroot")
    return grouped(heads.unionByName(own), "rank").mapInArrow(prove, "id bigint, leaf string, subroot string, proof string, folded string")


# ------------------------------------------------------------------ the manifest

def field(value):
    """Column: a value as it goes into a leaf: its UTF-8 bytes after their number, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values):
    """Column: digest (hex) of the values of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_key(source):
    """Column: key of the tree of a source; in the order of sources, null first, by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


@dataclass
class Manifest:
    """Numbered leaves, the blocks of all trees, those of the tree over their roots, and the root of all (None without rows)."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    height: int
    subroots: DataFrame

    def proofs(self) -> DataFrame:
        """Per leaf: id, leaf, subroot, proof, folded; see :func:`proven`."""
        none = F.array().cast(WAY)
        top_root = roots(self.top, self.height).select("tree", none.alias("way"), F.col("digest").alias("subroot"))
        over = leaf_ways(block_ways(self.top, top_root, self.height), self.height).select("number", "way")
        subroots = self.subroots.select("tree", "rank", F.col("digest").alias("subroot"))
        tree_ways = subroots.join(over, subroots["rank"] == over["number"]).select("tree", "way", "subroot")
        return proven(self.leaves, block_ways(self.levels, tree_ways, self.height), self.height)


def manifest(rows: DataFrame, height=HEIGHT) -> Manifest:
    """Merkle trees over ``rows`` (tree, id, digest, shown), one per tree, and one over their roots.

    Leaves of a tree are in order of id (null first), then digest. ``shown`` is the digest that a reader presents, checked by
    :meth:`Manifest.proofs` against the root. Repeated rows are leaves of their own. Trees come in order of their keys.
    """
    leaves = numbered(rows, "tree", ["id", "digest"], ["id", "digest", "shown"])
    levels = forest(leaves, height)
    over = roots(levels, height).select(F.lit(TOP).alias("over"), "tree", "digest")
    subroots = numbered(over, "over", ["tree"], ["tree", "digest"])
    top = forest(subroots.select(F.col("over").alias("tree"), "rank", "n", "digest"), height)
    found = roots(top, height).first()
    return Manifest(leaves, levels, top, found["digest"] if found else None, height, subroots)
