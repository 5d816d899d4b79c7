"""Prefix trie over conversations: double arrays per prefix shard, upper nodes merged.

Equal conversations become one path with a count.  A path's shard follows from its first
turns: one turn, or 2, 4, 8, ... where so many turns lie behind a prefix that it would fill a
shard.  A node at or below the cut belongs to one shard alone; the nodes above are
met by several shards, and their aggregates are merged afterwards.  Inside a shard the
distinct turns get dense ids, the trie is packed into BASE and CHECK arrays (the child of
slot s by turn t is slot BASE[s] + t, and CHECK names its parent), every path is walked
through them, and the aggregates rise along CHECK.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .textops import mix

#: Fixed values of the contract: conversations are rebuilt on the first one of five, from at most 8 turns of it.
FAMILY, HEADS = 5, 9
#: Turns of a shard as aimed at, the least number of shards, and what part of a shard one prefix may fill.
SHARD_TURNS, LEAST_SHARDS, HOT_PART = 1 << 17, 64, 4

_TURN = "array<struct<a:bigint,b:bigint,n:bigint>>"
_NO_ENDS = hashlib.sha256().hexdigest()
_ODD_A, _ODD_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
# Ids of one block of 4,096 meet before paths do, so a path of many copies sends short lists.
_BLOCK_BITS = 12
_EMPTY = 1 << 62


def _two_hashes(*columns: Column | str) -> list[Column]:
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation on the first turns of its family's first one.

    Turns are taken by number, nulls first, equal numbers by the turn's own hash, and
    stand for role and text by 128 bits and the text's UTF-8 length.  The first h turns come
    from conversation c - c % 5, the others are the conversation's own after its first h,
    h = crc32(decimal c) % 9.  The rows of a conversation meet in one task, 24 bytes each.
    """
    a, b = _two_hashes(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    conv_id = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id is not null").select(
        conv_id.alias("conv_id"), (conv_id - conv_id % FAMILY).alias("_first"),
        F.col("turn").cast("long").alias("turn"), a.alias("a"), b.alias("b"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", "a", "b", "n")))
    # One shuffle: families meet, so conversations and their first one do.
    own = rows.repartition("_first").groupBy("_first", "conv_id").agg(listed.alias("_rows")).select(
        "_first", "conv_id", F.transform("_rows", lambda r: F.struct(r["a"], r["b"], r["n"])).cast(_TURN)
        .alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("_first"), F.slice("turns", 1, HEADS - 1))).over(
        Window.partitionBy("_first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    shared = F.coalesce("_head", F.array().cast(_TURN))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.withColumn("_head", head).select(
        "conv_id", F.concat(F.slice(shared, F.lit(1), h), rest).alias("turns"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(p, q, turns, size, n_convs, conv_id, ends_sha256): one row per distinct sequence of turns.

    ``ends_sha256`` is the digest of all its conversations' ids, ascending.  Ids of a block
    of 4,096 are joined first; the lists of a path then stream through one digest in
    order, so neither copies nor ids are ever held together.
    """
    p, q = _two_hashes("turns")
    blocks = (paths.withColumns({"p": p, "q": q, "block": F.shiftright("conv_id", _BLOCK_BITS)})
              .groupBy("p", "q", "block").agg(
                  F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
                  F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
                  .alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, digest, count, least id, turns

        def rows_of(done: list) -> pa.RecordBatch:
            turns = pa.concat_arrays([d[4] for d in done])
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0][0] for d in done], pa.int64()), pa.array([d[0][1] for d in done], pa.int64()),
                 turns, pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.int64()),
                 pa.array([d[1].hexdigest() for d in done])],
                names=["p", "q", "turns", "n_convs", "conv_id", "ends_sha256"])

        for batch in batches:
            done, turns = [], batch.column("turns")
            columns = (batch.column(c).to_pylist() for c in ("p", "q", "n", "least", "ids"))
            for i, (first, second, n, least, ids) in enumerate(zip(*columns)):
                if held and held[0] == (first, second):
                    held[1].update(b"," + ids.encode())
                    held[2] += n
                else:
                    if held:
                        done.append(held)
                    held = [(first, second), hashlib.sha256(ids.encode()), n, least, turns.slice(i, 1)]
            if done:
                yield rows_of(done)
        if held:
            yield rows_of([held])

    kind = blocks.schema["turns"].dataType.simpleString()
    merged = (blocks.repartition("p", "q").sortWithinPartitions("p", "q", "block")
              .select("p", "q", "turns", "n", "least", "ids")
              .mapInArrow(run, f"p long, q long, turns {kind}, n_convs long, conv_id long, ends_sha256 string"))
    return merged.withColumn("size", F.size("turns"))


def sharded(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``paths`` with ``cut``, the length of the prefix that decides the shard, and ``shard``.

    A prefix behind which too many turns lie is looked at again at twice the length, so
    only a single path can be longer than a shard; every round takes what is left.
    """
    total = paths.agg(F.sum("size")).first()[0] or 0
    shards = max(LEAST_SHARDS, math.ceil(total / shard_turns))
    most = max(1, total // (shards * HOT_PART))
    left, done, cut = paths, [], 1
    while True:
        k, m = _two_hashes(F.slice("turns", 1, cut))
        keyed = left.withColumns({"_k": k, "_m": m, "cut": F.lit(cut)})
        crowded = (keyed.groupBy("_k", "_m").agg(F.sum("size").alias("_turns"), F.count("*").alias("_paths"))
                   .where((F.col("_turns") > most) & (F.col("_paths") > 1))
                   .select("_k", "_m", F.lit(True).alias("_crowded")))
        marked = materialize(keyed.join(crowded, ["_k", "_m"], "left"), "prefixes")
        done.append(marked.where("_crowded is null").withColumn(
            "shard", F.pmod(F.xxhash64("_k", "_m", "cut"), F.lit(shards)).cast("int")))
        left = marked.where("_crowded").drop("_k", "_m", "cut", "_crowded")
        if left.isEmpty():
            break
        cut *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("_k", "_m", "_crowded")


class DoubleArray:
    """BASE and CHECK over slots; the child of slot s by turn id t is slot BASE[s] + t.

    Built from nodes in order of depth: ``parent`` (an earlier node) and ``turn`` (a dense
    id) of each; node 0 is the root in slot 0.  Nodes with several children are placed
    first, the widest first, where all their slots are free; then an only child takes any
    free slot, as its parent's BASE can be set to match.
    """

    #: Places tried before a family of children goes behind the last slot.
    TRIES = 48

    def __init__(self, parent: np.ndarray, turn: np.ndarray):
        nodes = len(parent)
        order = np.argsort(parent[1:], kind="stable") + 1  # children by parent, in order of their turns
        children = np.bincount(parent[1:], minlength=nodes)
        ends = np.cumsum(children)
        slots = 2 * nodes + int(turn.max(initial=0)) + 2
        self.base = np.zeros(slots, np.int64)
        self.check = np.full(slots, -1)
        self.slot = np.zeros(nodes, np.int64)
        self.base_of = np.zeros(nodes, np.int64)
        free = np.ones(slots, bool)
        free[0] = False
        self.check[0] = 0
        top = low = 1
        several = np.flatnonzero(children > 1)
        for node in several[np.argsort(-children[several], kind="stable")].tolist():
            own = order[ends[node] - children[node]:ends[node]]
            turns = turn[own]
            offsets = turns - turns[0]
            while not free[low]:
                low += 1
            place = -1
            for at in (low + np.flatnonzero(free[low:low + 4 * self.TRIES])[:self.TRIES]).tolist():
                if at + offsets[-1] < len(free) and free[at + offsets].all():
                    place = at
                    break
            if place < 0:
                place = top
                if place + offsets[-1] >= len(free):
                    grown = max(2 * len(free), int(place + offsets[-1]) + 1)
                    free = np.concatenate([free, np.ones(grown - len(free), bool)])
            self.slot[own] = place + offsets
            free[place + offsets] = False
            self.base_of[node] = place - turns[0]
            top = max(top, int(place + offsets[-1]) + 1)
        single = np.flatnonzero(children == 1)
        own = order[ends[single] - 1]
        room = np.flatnonzero(free)
        if len(room) < len(own):
            room = np.concatenate([room, len(free) + np.arange(len(own) - len(room))])
        self.slot[own] = room[:len(own)]
        self.base_of[single] = self.slot[own] - turn[own]
        size = max(len(free), int(self.slot.max(initial=0)) + 1)
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1)
        self.base[self.slot] = self.base_of
        self.check[self.slot[1:]] = self.slot[parent[1:]]
        self.check[0] = 0

    def step(self, slots: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children by ``turns``, or -1 where there is none."""
        at = self.base[slots] + turns
        inside = (at > 0) & (at < len(self.check))
        found = np.where(inside, at, 0)
        return np.where(inside & (self.check[found] == slots), found, -1)


def dense_turns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ids of 128-bit turns."""
    order = np.lexsort((b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    ids = np.empty(len(a), np.int64)
    ids[order] = np.cumsum(fresh) - 1
    return ids


def build_trie(turns: np.ndarray, offs: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of some paths of dense turn ids, and the ids renumbered to suit it.

    Turns are numbered anew as they first occur from the root down, so siblings have
    close numbers and lie close together.
    """
    sizes = np.diff(offs)
    count = int(turns.max(initial=-1)) + 1
    at = np.zeros(len(sizes), np.int64)
    parents, labels, nodes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
    order = np.argsort(-sizes, kind="stable")
    for depth in range(int(sizes.max(initial=0))):
        lanes = order[:np.searchsorted(-sizes[order], -depth, "left")]
        key = at[lanes] * count + turns[offs[lanes] + depth]
        distinct, where = np.unique(key, return_inverse=True)
        at[lanes] = nodes + where
        parents.append(distinct // count)
        labels.append(distinct % count)
        nodes += len(distinct)
    parent, label = np.concatenate(parents), np.concatenate(labels)
    used, first = np.unique(label[1:], return_index=True)
    renumbered = np.zeros(count, np.int64)
    renumbered[used[np.argsort(first)]] = np.arange(len(used))
    label = renumbered[label] if count else label
    order = np.lexsort((label[1:], parent[1:])) + 1
    # Children in order of their new numbers; parents keep their places by depth.
    place = np.zeros(nodes, np.int64)
    place[order] = np.arange(1, nodes)
    return (DoubleArray(np.concatenate([[0], place[parent[order]]]), np.concatenate([[0], label[order]])),
            renumbered[turns] if count else turns)


_NODE = ("key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string, "
         "upper boolean, above array<binary>")


def _node_keys(a: np.ndarray, b: np.ndarray, offs: np.ndarray, slots: np.ndarray, size: int) -> np.ndarray:
    """128-bit names of all slots, chained turn by turn from the root's."""
    keys = np.zeros((size, 2), np.uint64)
    sizes = np.diff(offs)
    order = np.argsort(-sizes, kind="stable")
    at = np.zeros((len(sizes), 2), np.uint64)
    for depth in range(int(sizes.max(initial=0))):
        lanes = order[:np.searchsorted(-sizes[order], -depth, "left")]
        here = offs[lanes] + depth
        at[lanes, 0] = mix(at[lanes, 0] * _ODD_A + a[here].view(np.uint64) + np.uint64(1))
        at[lanes, 1] = mix((at[lanes, 1] ^ b[here].view(np.uint64)) * _ODD_B + np.uint64(1))
        keys[slots[here]] = at[lanes]
    return keys


def _shard_nodes(table: pa.Table) -> pa.Table:
    """Aggregates of every node of one shard; those of upper nodes are the shard's share only."""
    lists = table.column("turns").combine_chunks()
    offs = lists.offsets.to_numpy().astype(np.int64)
    a, b, n = (lists.values.field(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    a, b, n, offs = a[offs[0]:offs[-1]], b[offs[0]:offs[-1]], n[offs[0]:offs[-1]], offs - offs[0]
    cut = table.column("cut").to_numpy().astype(np.int64)
    convs, least = (table.column(c).to_numpy().astype(np.int64) for c in ("n_convs", "conv_id"))
    paths, sizes = len(offs) - 1, np.diff(offs)
    trie, turns = build_trie(dense_turns(a, b), offs)
    slots_in_all = len(trie.check)

    slots = np.zeros(len(turns), np.int64)
    depth = np.zeros(slots_in_all, np.int64)
    n_convs, conv_id = np.zeros(slots_in_all, np.int64), np.full(slots_in_all, _EMPTY)
    size_of, upper = np.zeros(slots_in_all, np.int64), np.zeros(slots_in_all, bool)
    end = np.full(slots_in_all, -1)
    at, order = np.zeros(paths, np.int64), np.argsort(-sizes, kind="stable")
    np.add.at(n_convs, at, convs)
    np.minimum.at(conv_id, at, least)
    upper[0] = True
    for d in range(int(sizes.max(initial=0))):
        lanes = order[:np.searchsorted(-sizes[order], -d, "left")]
        here = offs[lanes] + d
        at[lanes] = trie.step(at[lanes], turns[here])
        slots[here] = at[lanes]
        depth[at[lanes]] = d + 1
        size_of[at[lanes]] = n[here]
        np.add.at(n_convs, at[lanes], convs[lanes])
        np.minimum.at(conv_id, at[lanes], least[lanes])
        upper[at[lanes]] = (d + 1 < cut[lanes]) | (cut[lanes] > sizes[lanes])
    end[at] = np.arange(paths)

    own = np.unique(np.concatenate([[0], slots]))
    n_children, n_leaves = np.zeros(slots_in_all, np.int64), np.zeros(slots_in_all, np.int64)
    saved = np.zeros(slots_in_all, np.int64)
    alone = ~upper
    falling = own[np.argsort(-depth[own], kind="stable")]
    bounds = np.searchsorted(-depth[falling], -np.arange(int(depth.max(initial=0)), 0, -1), "right")
    start = 0
    for stop in bounds.tolist():
        level = falling[start:stop]
        level, start = level[alone[level]], stop
        n_leaves[level[n_children[level] == 0]] = 1
        saved[level] += (n_convs[level] - 1) * size_of[level]
        parents = trie.check[level]
        np.add.at(n_children, parents, 1)
        np.add.at(n_leaves, parents, n_leaves[level])
        np.add.at(saved, parents, saved[level])

    keys = _node_keys(a, b, offs, slots, slots_in_all)
    binary = [key.tobytes() for key in keys[own]]
    of_slot = dict(zip(own.tolist(), binary))
    parent_slots = trie.check[own]
    lone_parent = ~upper[parent_slots] & (own > 0)
    above = []
    for slot, is_upper in zip(own.tolist(), upper[own].tolist()):
        chain = None
        if is_upper:
            chain, up = [], slot
            while up:
                up = int(trie.check[up])
                chain.append(of_slot[up])
        above.append(chain)
    ends = table.column("ends_sha256").to_pylist()
    return pa.Table.from_arrays([
        pa.array(binary, pa.binary()),
        pa.array([of_slot[s] if o else None for s, o in zip(parent_slots.tolist(), own.tolist())], pa.binary()),
        pa.array(depth[own]), pa.array(conv_id[own]),
        pa.array(conv_id[parent_slots], mask=~lone_parent), pa.array(n_convs[own]),
        pa.array(n_children[own]), pa.array(n_leaves[own]), pa.array(saved[own]), pa.array(size_of[own]),
        pa.array([ends[e] if e >= 0 else None for e in end[own].tolist()], pa.string()),
        pa.array(upper[own]), pa.array(above, pa.list_(pa.binary()))],
        names=[c.split()[0] for c in _NODE.split(", ")])


def merged_upper(nodes: DataFrame) -> DataFrame:
    """Upper nodes of all shards, one row each, with the aggregates of their whole subtrees.

    A node's share of every shard is added up; then each hands its own leaves and savings
    to itself and to every node above it, of which there are fewer than its cut.
    """
    shares = nodes.where("upper").groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("bytes").alias("bytes"), F.max("ends_sha256").alias("ends_sha256"), F.first("above").alias("above"))
    shares = materialize(shares, "upper")
    below = shares.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("_more"))
    counted = shares.join(below, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    own_leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    own_saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")
    counted = materialize(counted.withColumns({"n_leaves": own_leaves, "saved_tokens": own_saved}), "upper")
    risen = counted.select(
        F.explode(F.concat(F.array("key"), F.col("above"))).alias("key"), "n_leaves", "saved_tokens")
    sums = risen.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return counted.drop("n_leaves", "saved_tokens").join(sums, "key")


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the paths (conv_id, turns) of ``rebuilt_paths``.

    Columns (all long but the last): conv_id (least member), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves (childless nodes of the subtree, itself
    included), saved_tokens, ends_sha256.  Paths without turns are members of the root
    alone; no paths give no rows.
    """
    least = paths.agg(F.min("conv_id")).first()[0]
    dealt = sharded(materialize(distinct_paths(paths), "paths"), shard_turns)
    nodes = materialize(dealt.groupBy("shard").applyInArrow(_shard_nodes, _NODE), "nodes")
    upper = materialize(merged_upper(nodes), "upper")
    fields = ["parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
              "saved_tokens", "ends_sha256"]
    # The root's id is known, so its many children need not meet; other parents of upper nodes are looked up.
    first = F.when(F.col("depth") == 1, F.lit(least).cast("long"))
    rows = nodes.where("not upper").select(*fields).unionByName(
        upper.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*fields))
    rows = rows.withColumn("parent_conv_id", F.coalesce("parent_conv_id", first))
    resolved = (F.col("depth") == 0) | F.col("parent_conv_id").isNotNull()
    names = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("_parent_conv_id"))
    looked_up = rows.where(~resolved).join(names, "parent").withColumn(
        "parent_conv_id", F.col("_parent_conv_id")).select(*fields)
    return rows.where(resolved).unionByName(looked_up).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``trie_nodes`` of the rebuilt conversations.

    A null role or text is empty; rows without conv_id are left out; a repeated row is a
    turn of its own; other columns are ignored; an empty table gives no rows.
    """
    return trie_nodes(materialize(rebuilt_paths(conversations), "rebuilt"), shard_turns)
