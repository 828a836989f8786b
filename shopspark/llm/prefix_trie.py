"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations that start with the same turns share the nodes of those turns. A node
is known by its depth and the XOR of the strong digests of its turns, each salted by
its place; rows carry digests only, never texts, once they are read.

Sums over subtrees come from a centroid decomposition of the parent edges. In every
component the deepest node that holds at least half of it is the centroid. Its total
(its own value and those of all of the component beneath it) is added to each node on
the path from it to the component's top; then the centroid leaves, each of its children
is the top of a component, and what was not beneath it stays one. Components halve, so
the rounds grow with the logarithm of the nodes, however deep or broad the trie is.

Components of more than ``COMPONENT`` nodes are split by joins, all at once in each
round. The smaller ones are dealt into bins by a hash and decomposed there with arrays,
so the memory of a task does not follow the table.

Turns are numbered over ranges of (conversation, turn), so a conversation with a third
of all rows is spread over the ranges it meets. Members of a node are counted with sums
combined on the map side. The identifiers of a node's last members are joined to
texts range by range and hashed as a stream.

Defined cases: rows without conv_id take no part. A null turn sorts first; rows of one
conversation and turn follow each other by the digest of role and text. Repeated rows
are turns of their own. Null role or text is empty. An empty table has no nodes, not
even a root. Very long texts are one digest. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopspark.storage import materialize

COMPONENT = 1 << 16
#: Each conversation takes up to this many first turns, less one, of the first of its block.
HEADS = 4
BLOCK = 20
CHUNK_IDS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
LANES = [f"x{i}" for i in range(4)]


def _node(depth: Column, lanes: list[Column]) -> Column:
    """The name of a prefix: 128 bits over its depth and the XOR of its turns."""
    return F.substring(F.sha2(F.concat_ws(",", depth, *lanes), 256), 1, 32)


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words of the rows that take part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation behind the first turns of its block's first one.

    Gives (conv_id, depth, digest, words, part), depth from 1 and parts in the order of depth,
    and (conv_id, turns), one row for every conversation.
    """
    ranged = turn_rows(turns).repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id() + 1)
    ranged = materialize(ranged, "trie-turns")
    parts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    owned = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    wanted = F.crc32(F.col("conv_id").cast("string")) % HEADS
    bases = owned.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = owned.withColumn("base", base).withColumn("h", wanted).join(bases, "base", "left")
    lent = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = convs.withColumn("k", lent).withColumn("turns", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "k", "turns"), "trie-conversations")

    placed = ranged.join(materialize(parts.join(convs, "conv_id"), "trie-parts").drop("n", "base", "turns"), ["conv_id", "part"])
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "digest")
    at = F.row_number().over(within) - 1 + F.col("before")
    placed = materialize(placed.withColumn("at", at).drop("before", "turn"), "trie-placed")
    own = placed.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("k") + 1).alias("depth"), "digest", "words", "part")
    heads = placed.where((F.col("at") < HEADS - 1) & (F.col("conv_id") % BLOCK == 0))
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("at") + 1).alias("depth"), "digest", "words")
    given = convs.join(heads, "base").where("depth <= h").select("conv_id", "depth", "digest", "words", F.lit(0).alias("part"))
    return own.unionByName(given), convs.select("conv_id", "turns")


def prefix_paths(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, words: the nodes each conversation passes, from the root down."""
    salted = F.sha2(F.concat_ws(":", "depth", "digest"), 256)
    lanes = [F.conv(F.substring(salted, 1 + 15 * i, 15), 16, 10).cast("long").alias(lane) for i, lane in enumerate(LANES)]
    marked = materialize(rebuilt.select("conv_id", "part", "depth", "words", *lanes), "trie-marked")
    whole = marked.groupBy("conv_id", "part").agg(*[F.bit_xor(lane).alias(lane) for lane in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "part", *[F.coalesce(F.bit_xor(lane).over(earlier), F.lit(0)).alias(f"b{lane}") for lane in LANES])
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.select("*", *[F.bit_xor(lane).over(so_far).alias(f"r{lane}") for lane in LANES]).join(before, ["conv_id", "part"])
    through = [F.col(f"r{lane}").bitwiseXOR(F.col(f"b{lane}")) for lane in LANES]
    above = [done.bitwiseXOR(F.col(lane)) for done, lane in zip(through, LANES)]
    paths = run.select(
        "conv_id", "depth", _node(F.col("depth"), through).alias("node"), _node(F.col("depth") - 1, above).alias("parent"), "words"
    )
    root = _node(F.lit(0), [F.lit(0)] * len(LANES))
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"))
    return materialize(paths.unionByName(tops), "trie-paths")


# --- rollup --------------------------------------------------------------------------------------


def intervals(parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each node's subtree in an order from the tops down.

    ``parent`` holds positions, -1 for a top.
    """
    n = len(parent)
    order = np.lexsort((parent, depth))
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    levels = np.split(order, cuts)
    size = np.ones(n, np.int64)
    for level in reversed(levels):
        inner = level[parent[level] >= 0]
        np.add.at(size, parent[inner], size[inner])
    first = np.zeros(n, np.int64)
    taken = 0
    for level in levels:
        tops, inner = level[parent[level] < 0], level[parent[level] >= 0]
        first[tops] = taken + np.cumsum(size[tops]) - size[tops]
        taken += int(size[tops].sum())
        if len(inner):
            ups = parent[inner]
            running = np.cumsum(size[inner]) - size[inner]
            starts = np.flatnonzero(np.concatenate([[True], ups[1:] != ups[:-1]]))
            base = np.repeat(running[starts], np.diff(np.append(starts, len(inner))))
            first[inner] = first[ups] + 1 + running - base
    return first, first + size


def rollup(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one row for each node) over the subtrees of a forest, by centroid decomposition."""
    n = len(parent)
    first, last = intervals(parent, depth)
    size = last - first
    top = np.full(n, -1)
    by_place = np.argsort(first)
    is_top = parent[by_place] < 0
    top[by_place] = by_place[np.flatnonzero(is_top)][np.cumsum(is_top) - 1]
    out = np.zeros_like(values)
    live = np.arange(n)
    centroid = np.full(n, -1)
    while len(live):
        half = live[2 * size[live] >= size[top[live]]]
        half = half[np.argsort(-size[half], kind="stable")]
        centroid[top[half]] = half  # the last one written is the smallest
        mine = centroid[top[live]]
        beneath = (first[live] >= first[mine]) & (first[live] < last[mine])
        over = (first[live] <= first[mine]) & (first[mine] < last[live])
        total = np.zeros_like(values)
        np.add.at(total, mine[beneath], values[live[beneath]])
        out[live[over]] += total[mine[over]]
        lost = size[mine]
        inner = over & (live != mine)
        size[live[inner]] -= lost[inner]
        # Of the centroid's children, the one beneath which a node lies starts last before it.
        child = live[parent[live] == mine]
        moved = live[beneath & (live != mine)]
        key = top[child] * n + first[child]
        child, key = child[np.argsort(key)], np.sort(key)
        top[moved] = child[np.searchsorted(key, top[moved] * n + first[moved], "right") - 1] if len(moved) else moved
        live = live[live != mine]
    return out


def _rollup_bin(part: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums within the components of one bin."""
    names = pd.Index(part["node"])
    up = names.get_indexer(part["parent"])
    comp = part["comp"].to_numpy()
    up[(up >= 0) & (comp[up] != comp)] = -1
    sums = rollup(up, part["depth"].to_numpy(np.int64), part[["leaves", "saved"]].to_numpy(np.int64))
    return pd.DataFrame({"node": part["node"], "leaves": sums[:, 0], "saved": sums[:, 1]})


def subtree_sums(nodes: DataFrame, paths: DataFrame, component: int = COMPONENT) -> DataFrame:
    """node, leaves, saved: sums over each node's subtree, the node included.

    ``nodes`` has node, parent, conv_id (the smallest member), depth, leaves and saved.
    """
    state = nodes.select("node", "parent", "conv_id", "depth", "leaves", "saved")
    count = state.count()
    added: list[DataFrame] = []
    done: list[DataFrame] = []
    if count <= component:
        state = state.withColumn("comp", F.lit("all"))
    else:
        state = materialize(state.join(_sizes(nodes, paths), "node").withColumn("comp", F.lit("all")), "trie-state")
        while True:
            comps = state.groupBy("comp").agg(F.max("size").alias("total"), F.min("depth").alias("top_depth"))
            state = materialize(state.join(comps, "comp"), "trie-components")
            done.append(state.where(F.col("total") <= component).drop("size", "total", "top_depth"))
            state = state.where(F.col("total") > component)
            if not state.limit(1).count():
                state = None
                break
            state, path_sums = _split(state, paths)
            added.append(path_sums)
    small = state if state is not None else done[0]
    for other in done[1:]:
        small = small.unionByName(other)
    bins = max(1, -(-count // component))
    dealt = small.withColumn("bin", F.pmod(F.xxhash64("comp"), F.lit(bins)))
    sums = dealt.groupBy("bin").applyInPandas(_rollup_bin, "node string, leaves long, saved long")
    if not added:
        return sums
    for other in added:
        sums = sums.unionByName(other)
    return sums.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """node, size: nodes in each subtree.

    A conversation owns the nodes of which it is the smallest member: the last ones of its path.
    """
    owned = nodes.groupBy("conv_id").agg(F.count("*").alias("owned"), F.max("depth").alias("deepest"))
    beneath = F.col("deepest") - F.greatest(F.col("deepest") - F.col("owned") + 1, F.col("depth")) + 1
    return paths.join(owned, "conv_id").groupBy("node").agg(F.sum(beneath).alias("size"))


def _split(state: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take the centroid out of every component; the new components and what its path gains."""
    half = state.where(2 * F.col("size") >= F.col("total"))
    least = half.groupBy("comp").agg(F.min(F.struct("size", "node", "conv_id", "depth", "top_depth")).alias("c"))
    centroids = least.select(
        "comp", F.col("c.size").alias("c_size"), F.col("c.node").alias("c_node"), F.col("c.conv_id").alias("c_conv"),
        F.col("c.depth").alias("c_depth"), F.col("c.top_depth").alias("c_top"),
    )
    centroids = materialize(centroids, "trie-centroids")
    met = state.join(centroids.drop("c_conv", "c_top"), "comp")
    below = paths.select("conv_id", (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("child"), F.col("parent").alias("up"))
    met = met.join(below, ["conv_id", "c_depth"], "left")
    beneath = F.coalesce((F.col("depth") > F.col("c_depth")) & (F.col("up") == F.col("c_node")), F.lit(False))
    met = materialize(met.withColumn("beneath", beneath), "trie-met")
    totals = met.where(F.col("beneath") | (F.col("node") == F.col("c_node")))
    totals = totals.groupBy("comp").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ways = paths.select(F.col("conv_id").alias("c_conv"), "depth", "node")
    way = centroids.join(ways, "c_conv").where("depth between c_top and c_depth").join(totals, "comp")
    way = materialize(way.select("node", "c_node", "c_size", "leaves", "saved"), "trie-way")
    shrunk = way.where("node <> c_node").select("node", F.col("c_size").alias("lost"))
    left = met.where("node <> c_node").join(shrunk, "node", "left")
    comp = F.when(F.col("beneath"), F.col("child")).otherwise(F.col("comp"))
    left = left.select(
        "node", "parent", "conv_id", "depth", "leaves", "saved",
        (F.col("size") - F.coalesce("lost", F.lit(0))).alias("size"), comp.alias("comp"),
    )
    return materialize(left, "trie-state"), way.select("node", "leaves", "saved")


# --- members that end at a node ------------------------------------------------------------------


def _join_ids(batches):
    """Texts of at most ``CHUNK_IDS`` identifiers each, in order within the task."""
    place = 0
    for batch in batches:
        nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        part = batch.column(2)[0].as_py() if len(nodes) else 0
        out = []
        at = 0
        while at < len(nodes):
            to = at + 1
            while to < len(nodes) and nodes[to] == nodes[at] and to - at < CHUNK_IDS:
                to += 1
            out.append((nodes[at], part, place, ",".join(map(str, ids[at:to]))))
            place += 1
            at = to
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["node", "part", "place", "ids"])


def _hash_ids(batches):
    """SHA-256 of the joined texts of each node; rows come in the order of node, part and place."""
    node, state, out = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if name != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["node", "ends_sha256"])
            out = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 from (node, conv_id): the hash of the identifiers in ascending order."""
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").withColumn("part", F.spark_partition_id())
    texts = materialize(ranged.mapInArrow(_join_ids, "node string, part int, place long, ids string"), "trie-ends")
    ordered = texts.repartition("node").sortWithinPartitions("node", "part", "place").select("node", "ids")
    return ordered.mapInArrow(_hash_ids, "node string, ends_sha256 string")


def conversation_trie(turns: DataFrame, component: int = COMPONENT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    rebuilt, convs = rebuilt_turns(turns)
    paths = prefix_paths(rebuilt, convs)
    nodes = paths.groupBy("node", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-values")

    sums = subtree_sums(nodes, paths, component)
    ends = end_hashes(paths.join(convs, "conv_id").where("depth = turns").select("node", "conv_id"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shown = nodes.drop("leaves", "saved").join(sums, "node").join(ends, "node", "left").join(parents, "parent", "left")
    return shown.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
