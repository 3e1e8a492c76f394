"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a different beginning of conversations; its key is a 128-bit digest of that beginning. Nodes of a path that the same
conversations go through are one chain (they share the smallest conversation and the number of them), and chains are what is
decomposed. The number of conversations below a chain is known without walking the trie and serves as its weight: the deepest
chain with more than half of its component's weight is the centroid. Taking it out leaves parts of at most half the weight each.
A centroid's total is its own value plus those of the components below it, and is added to all chains from it up to the top of its
component; each chain meets each chain above it exactly once that way, whatever the trie's depth.

Components of more than ``SMALL`` conversations are split by Spark, all at once per round; smaller ones in tasks, by the same rule.
"""

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, through_parquet
from .common import join_counted, small_batches

#: Conversations of a component that one task splits. It has at most twice as many chains, and one more per split around it.
SMALL = 4096
#: Ids whose digest is taken are joined in pieces of this range of numbers.
PIECE = 4096
ROOT = hashlib.md5(b"").digest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """Turns of each conversation in order: conv_id, turns array<struct<digest, bytes>>.

    Rows are ordered by turn, null first; rows of one turn by digest. Null roles and texts are empty. Rows without a conv_id belong
    to no conversation. Texts stay where they are: a turn travels as 16 bytes and its length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    ordered = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def with_shared_beginnings(turns: DataFrame, family=5, most=8) -> DataFrame:
    """Conversations whose first turns are those of their family's first: h turns of conversation c - c % family, then their own after h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = turns.select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__head"))
    met = turns.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("__base"), "left")
    head = F.coalesce(F.slice("__head", F.lit(1), h), F.array().cast(turns.schema["turns"].dataType))
    return met.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (keys of all beginnings, the root's first) and bytes (of the last text of each; 0 for the root), kept."""
    def chain(batches):
        for batch in batches:
            out, sizes = [], []
            for row in batch.column("turns").to_pylist():
                key, own = ROOT, [ROOT]
                for t in row:
                    key = hashlib.md5(key + t["digest"]).digest()
                    own.append(key)
                out.append(own)
                sizes.append([0, *(t["bytes"] for t in row)])
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "path": pa.array(out, pa.list_(pa.binary())),
                                              "bytes": pa.array(sizes, pa.list_(pa.int64()))})

    return through_parquet(small_batches(turns).mapInArrow(chain, "conv_id bigint, path array<binary>, bytes array<bigint>"), "trie-paths")


def trie_nodes(convs: DataFrame) -> DataFrame:
    """key, parent, depth, conv_id (smallest member), n_convs, saved, n_children, kept. Members are counted before they are shuffled."""
    parent = F.concat(F.array(F.lit(None).cast("binary")), F.slice("path", F.lit(1), F.size("path") - 1))
    each = convs.select("conv_id", F.inline(F.arrays_zip(
        F.col("path").alias("key"), parent.alias("parent"), "bytes", F.sequence(F.lit(0), F.size("path") - 1).alias("depth"))))
    found = each.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").cast("bigint").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    kept = checkpointed(found.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"))
    children = kept.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    none = F.lit(0).cast("bigint")
    return checkpointed(kept.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", none)))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id and parent_n (n_convs of the parent); null for the root. A parent of very many isn't one task's."""
    over = nodes.where("n_children > 0").select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), F.col("n_children").alias("__met"))
    below = join_counted(nodes.where(F.col("parent").isNotNull()), over, "parent", "__met", nodes.count()).drop("__met")
    return checkpointed(below.unionByName(nodes.where(F.col("parent").isNull()), allowMissingColumns=True))


def chains(nodes: DataFrame) -> DataFrame:
    """Chains of ``nodes``: conv_id, n_convs, top and bottom depth, key (of the top), parent_conv_id, parent_n, saved, leaves."""
    at_top = F.min_by(F.struct("key", "parent_conv_id", "parent_n"), "depth")
    found = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), at_top.alias("t"), F.sum("saved").alias("saved"),
        F.min("n_children").alias("least"))
    leaves = F.when(F.col("least") == 0, 1).otherwise(0).cast("bigint")
    return found.select("conv_id", "n_convs", "top", "bottom", "t.*", "saved", leaves.alias("leaves"))


def rollup(up, weight, values):
    """Sums of ``values`` (tuples) over the subtrees of a forest, by centroid decomposition of all its components at once.

    ``up`` has each node's parent or -1; parents come before their children. ``weight`` is that of a node's subtree.
    """
    up, sub, width = list(up), list(weight), len(values[0]) if values else 0
    gone, top = [False] * len(up), [0] * len(up)
    sums = [[0] * width for _ in up]
    left, centroids = list(range(len(up))), []
    while True:
        below, totals = defaultdict(list), defaultdict(lambda: [0] * width)
        for i in left:
            if up[i] >= 0 and gone[up[i]]:
                below[up[i]].append(i)
                up[i] = -1
            top[i] = i if up[i] < 0 else top[up[i]]
            total = totals[top[i]]
            for k in range(width):
                total[k] += values[i][k]
        for c in centroids:
            found = [values[c][k] + sum(totals[t][k] for t in below[c]) for k in range(width)]
            v = c
            while v >= 0:
                for k in range(width):
                    sums[v][k] += found[k]
                v = up[v]
                if v >= 0:
                    sub[v] -= sub[c]
        if not left:
            return sums
        # Candidates of a component lie on one path, the deepest comes last; a component without weight is taken from its top.
        chosen = {}
        for i in left:
            if top[i] == i or 2 * sub[i] > sub[top[i]]:
                chosen[top[i]] = i
        centroids = list(chosen.values())
        for c in centroids:
            gone[c] = True
        left = [i for i in left if not gone[i]]


def rolled_up_in_tasks(rows: DataFrame) -> DataFrame:
    """Subtree sums within small components: conv_id, n_convs, saved, leaves. A task splits some whole components at a time."""
    names = ("comp", "conv_id", "n_convs", "parent_conv_id", "parent_n", "sub", "saved", "leaves")

    def solved(rows):
        place, up = {}, []
        for i, (comp, conv, n, parent, m, *_) in enumerate(rows):
            up.append(place.get((comp, parent, m), -1))
            place[comp, conv, n] = i
        sums = rollup(up, [r[5] for r in rows], [r[6:8] for r in rows])
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array([r[1] for r in rows], pa.int64()), "n_convs": pa.array([r[2] for r in rows], pa.int64()),
            "saved": pa.array([s[0] for s in sums], pa.int64()), "leaves": pa.array([s[1] for s in sums], pa.int64())})

    def solve(batches):
        held = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names]):
                if len(held) >= 2 * SMALL and row[0] != held[-1][0]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    placed = rows.select(*names, "top").repartition("comp").sortWithinPartitions("comp", "top").select(*names)
    return placed.mapInArrow(solve, "conv_id bigint, n_convs bigint, saved bigint, leaves bigint")


def subtree_sums(rows: DataFrame, convs: DataFrame, small=SMALL) -> DataFrame:
    """Sums of saved and leaves over the subtree of every chain: conv_id, n_convs, saved, leaves."""
    whole = rows.agg(F.max("n_convs").alias("w")).first()["w"]
    if whole is None or whole <= small:
        return rolled_up_in_tasks(rows.withColumns({"comp": F.lit(ROOT), "sub": F.col("n_convs")}))
    ways = convs.select("conv_id", F.col("path").alias("__path"))
    active = rows.join(ways, "conv_id").withColumn("path", F.slice("__path", F.lit(1), (F.col("top") + 1).cast("int"))).drop("__path")
    active = active.withColumns({"comp": F.lit(ROOT), "sub": F.col("n_convs"), "w": F.lit(whole)})
    done, gains = [], []
    while True:
        active = checkpointed(active)
        done.append(active.where(F.col("w") <= small).drop("path"))
        big = active.where(F.col("w") > small)
        if not big.limit(1).count():
            break
        # Components share the conversations, so those with more than a part of them are few: the join is safe for any of them.
        centroids = big.where(F.col("sub") * 2 > F.col("w")).groupBy("comp").agg(
            F.max_by(F.struct("key", "path", "top", "bottom", "sub"), "top").alias("c"), F.max("w").alias("__w"))
        met = join_counted(big, centroids, "comp", "__w", whole).drop("__w")
        below = (F.col("top") > F.col("c.top")) & (F.get("path", F.col("c.top").cast("int")) == F.col("c.key"))
        over = (F.col("top") <= F.col("c.top")) & (F.get("c.path", F.col("top").cast("int")) == F.col("key"))
        part = F.when(below, F.get("path", (F.col("c.bottom") + 1).cast("int"))).otherwise(F.col("comp"))
        told = checkpointed(met.select(
            *rows.columns, "path", "comp", "sub", below.alias("below"), over.alias("over"), part.alias("part"), (F.col("key") == F.col("c.key")).alias("is_c"),
            F.when(over, F.col("sub") - F.col("c.sub")).otherwise(F.col("sub")).alias("rest")))
        totals = told.where("below OR is_c").groupBy("comp").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        gains.append(told.where("over").select("conv_id", "n_convs", "comp").join(totals, "comp").drop("comp"))
        parts = told.where("NOT is_c").select(*rows.columns, "path", F.col("part").alias("comp"), F.col("rest").alias("sub"))
        weights = parts.groupBy("comp").agg(F.max("sub").alias("w"))
        active = join_counted(parts, weights, "comp", "w", whole)
    sums = rolled_up_in_tasks(union(done))
    return union([sums, *gains]).groupBy("conv_id", "n_convs").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def union(frames):
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def end_digests(convs: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at a node: key, ends (SHA-256 hex of the ids in order, comma-joined).

    Ids are joined in pieces of bounded size; a task then streams the pieces of a node, in order, through one digest.
    """
    piece = F.floor(F.col("conv_id") / PIECE).cast("bigint")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = convs.groupBy(F.element_at("path", -1).alias("key"), piece.alias("piece")).agg(ids.alias("ids"))

    def digest(batches):
        key, state = None, None
        for batch in batches:
            keys, out = [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends": pa.array(out, pa.string())})
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [state.hexdigest()]})

    ordered = small_batches(pieces.repartition("key").sortWithinPartitions("key", "piece"))
    return ordered.select("key", "ids").mapInArrow(digest, "key binary, ends string")


def trie(turns: DataFrame, small=SMALL) -> DataFrame:
    """Nodes of the trie over ``turns`` (see :func:`turn_lists`): key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends.

    Conversations without turns end at the root. Equal conversations are members of the same nodes, whose ids ``ends`` lists. No
    conversations: no nodes. A conversation's turns are held together, as 24 bytes each.
    """
    convs = paths(turns)
    nodes = with_parents(trie_nodes(convs))
    sums = subtree_sums(checkpointed(chains(nodes)), convs, small)
    chain = Window.partitionBy("conv_id", "n_convs").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    total = sums.select("conv_id", "n_convs", F.col("saved").alias("__saved"), F.col("leaves").alias("n_leaves"))
    before = F.coalesce(F.sum("saved").over(chain), F.lit(0))
    rolled = nodes.withColumn("__before", before).join(total, ["conv_id", "n_convs"])
    nothing = hashlib.sha256(b"").hexdigest()
    return rolled.join(end_digests(convs), "key", "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("__saved") - F.col("__before")).alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends"))
