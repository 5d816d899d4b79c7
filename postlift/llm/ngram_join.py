"""Jaccard join on word shingles by blocked sparse matrix products.

Documents are rows, shingles columns of an incidence matrix; a product of row blocks
counts the overlaps.  Which rows are multiplied at all follows from sizes:

* Documents with the same shingle set are one row (a node).
* Columns are ordered by how many rows hold them, the rarest first.  Two sets with a
  Jaccard of at least t share a column among the first n - ceil(t n) + 1 of each, so
  only those are looked up, and of them only columns that two rows hold.
* Rows that share such a column are candidates if their sizes allow t.  Candidate
  groups are multiplied in row blocks, pairs below the size bound discarded, and the
  links that remain are joined into components.

Nothing is dropped for being frequent: a column that very many rows hold comes last in
the order, and a group of very many rows is cut into row blocks, every pair of which
is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize
from .components import connected_components
from .exchange import KeySpace, into_chunks, packed
from .textops import (distinct_per_row, join_groups, leave_nothing, mix, pieces_of, shingle_hashes, spread,
                      text_bytes, whole_texts, word_hashes)

WIDTH, PERCENT = 5, 80
#: Rows of one row block; nodes of small groups that share a task; ids that may be broadcast.
BLOCK_ROWS, TASK_NODES, BROADCAST_IDS = 512, 1_500, 400_000
#: Groups of copies, or components, that are sent to all tasks at most: the largest ones.
HEAVY_GROUPS = 1_000
_COLUMNS = 2_048


def text_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, flat, and the offsets."""
    data, offs = text_bytes(column)
    h, row = shingle_hashes(*word_hashes(data, offs), width)
    return distinct_per_row(h, row, len(column))


def set_nodes(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set, the same for equal sets; 0 for empty ones."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(flat))]
    sizes = np.diff(offs).astype(np.uint64)
    names = mix(sums[offs[1:]] - sums[offs[:-1]] + sizes * np.uint64(0x9E3779B97F4A7C15))
    names[sizes == 0] = 0
    return names


def _tabled(table: pa.Table, column: str = "text") -> Iterator[pa.RecordBatch]:
    return pieces_of(iter(table.combine_chunks().to_batches()), column)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of size n must share with any set it links to."""
    return -(-n * percent // 100)


def ask(space: KeySpace, width: int):
    """A chunk's distinct columns, by block, and how many of its nodes hold each (255: or more)."""
    def run(table: pa.Table) -> pa.Table:
        leave_nothing()
        chunk = table.column("chunk")[0].as_py()
        keys, counts, met = [], [], np.zeros(0, np.uint64)
        for piece in _tabled(table):
            flat, offs = text_sets(piece.column("text"), width)
            nodes = set_nodes(flat, offs)
            rows = _new_rows(nodes, met)
            met = np.concatenate([met, nodes[rows]])
            held = flat[spread(offs[rows], offs[rows + 1] - offs[rows])]
            k, n = np.unique(space.joint(held), return_counts=True)
            keys.append(k)
            counts.append(n)
        keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(place, np.concatenate(counts)).astype(np.int64)
        bounds = space.bounds(keys)
        short, counts = keys.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return pa.table({
            "block": pa.array(range(space.blocks), pa.int32()),
            "chunk": pa.array([chunk] * space.blocks, pa.int32()),
            "keys": pa.array([packed(short[a:b]) for a, b in spans], pa.binary()),
            "counts": pa.array([packed(counts[a:b]) for a, b in spans], pa.binary())})
    return run


def _new_rows(nodes: np.ndarray, met: np.ndarray) -> np.ndarray:
    """One row of every non-empty node that was not met before."""
    names, rows = np.unique(nodes, return_index=True)
    return rows[(names != 0) & ~np.isin(names, met)]


def answer(table: pa.Table) -> pa.Table:
    """A block's reply to every chunk: the class (about the log) of each column's row count."""
    keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
    counts = [np.frombuffer(c, np.uint8) for c in table.column("counts").to_pylist()]
    leave_nothing()
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts))
    classes = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)[place]
    ends = np.cumsum([len(k) for k in keys])
    return pa.table({
        "chunk": table.column("chunk").cast(pa.int32()), "block": table.column("block").cast(pa.int32()),
        "classes": pa.array([packed(classes[e - len(k):e]) for e, k in zip(ends.tolist(), keys)],
                            pa.binary())})


_NOTE = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("doc_id", pa.int64()),
                   ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()),
                   ("nodes", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def note(space: KeySpace, width: int, percent: int):
    """A chunk's documents, the columns its nodes look up, and the candidates among its own rows."""
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        leave_nothing()
        if not table.num_rows:
            return _NOTE.empty_table()
        order = np.argsort(replies.column("block").to_numpy())
        classes = replies.column("classes").to_pylist()
        classes = np.concatenate([np.frombuffer(classes[i], np.uint8) for i in order])
        found, met, kept = [], np.zeros(0, np.uint64), []
        docs = []
        for piece in _tabled(table):
            flat, offs = text_sets(piece.column("text"), width)
            nodes, sizes = set_nodes(flat, offs), np.diff(offs)
            docs.append((piece.column("doc_id"), nodes, sizes))
            rows = _new_rows(nodes, met)
            met = np.concatenate([met, nodes[rows]])
            kept.append((flat, offs, nodes, rows))
        if len(classes):
            known = np.unique(np.concatenate([np.unique(space.joint(f)) for f, *_ in kept]))
            for flat, offs, nodes, rows in kept:
                found.append(_lookups(flat, offs, nodes, rows,
                                      classes[np.searchsorted(known, space.joint(flat))], percent))
        key, node, size = (np.concatenate(x) for x in zip(*found)) if found else (
            np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        u, v, (key, node, low, high) = chained(key, node, size, size, percent)
        edges = np.unique(np.stack([u, v], 1), axis=0)
        joint = space.joint(key)
        bounds = space.bounds(joint)
        spans = [(b, x, y) for b, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                 if y > x]
        out = [pa.table({
            "kind": ["doc"] * len(n), "block": pa.nulls(len(n), pa.int32()),
            "doc_id": i.cast(pa.int64()), "node": s.view(np.int64), "n": n}) for i, s, n in docs]
        out.append(pa.table({
            "kind": ["edge"] * len(edges), "node": edges[:, 0].view(np.int64),
            "n": edges[:, 1].view(np.int64)}))
        out.append(pa.table({
            "kind": ["look"] * len(spans), "block": pa.array([b for b, _, _ in spans], pa.int32()),
            **{name: pa.array([packed(a[x:y]) for _, x, y in spans], pa.binary())
               for name, a in (("keys", key), ("nodes", node), ("low", low), ("high", high))}}))
        return pa.concat_tables(out, promote_options="default").select(_NOTE.names).cast(_NOTE)
    return run


def _lookups(flat, offs, nodes, rows, classes, percent):
    """(column, node, size) for the first columns of each row, rarest first, that others hold."""
    key, node, size = [], [], []
    for i in rows.tolist():
        a, b = offs[i], offs[i + 1]
        first = (b - a) - int(least_overlap(b - a, percent)) + 1
        own = classes[a:b]
        if not own.any():
            continue
        order = np.argsort(own, kind="stable")[:first]
        order = order[own[order] > 0]
        key.append(flat[a:b][order])
        node.append(np.full(len(order), nodes[i]))
        size.append(np.full(len(order), b - a))
    empty = np.zeros(0, np.uint64)
    return (np.concatenate([empty, *key]), np.concatenate([empty, *node]),
            np.concatenate([np.zeros(0, np.int64), *size]))


def chained(key, node, low, high, percent):
    """Candidate edges among nodes on one column, and one interval of sizes per chain.

    Nodes on a column are sorted by size; neighbours whose sizes allow a link are
    chained.  Any two nodes on the column whose sizes allow a link are on one chain,
    also when a chain is replaced by its first node with the interval of its sizes.
    """
    order = np.lexsort((low, key))
    key, node, low, high = key[order], node[order], low[order], high[order]
    if not len(key):
        return node, node, (key, node, low, high)
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    span = int(high.max()) + 1
    reach = np.maximum.accumulate(group * span + high) - group * span
    linked = (group[1:] == group[:-1]) & (low[1:] * percent <= reach[:-1] * 100)
    u, v = np.minimum(node[:-1], node[1:])[linked], np.maximum(node[:-1], node[1:])[linked]
    apart = u != v
    heads = np.flatnonzero(np.r_[True, ~linked])
    ends = np.r_[heads[1:], len(key)] - 1
    return u[apart], v[apart], (key[heads], node[heads], low[heads], reach[ends])


def candidates(percent: int):
    """A block's candidate edges over all chunks."""
    def run(table: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
                 for c, t in (("keys", np.uint64), ("nodes", np.uint64),
                              ("low", np.int64), ("high", np.int64))]
        u, v, _ = chained(*parts, percent)
        edges = np.unique(np.stack([u, v], 1), axis=0)
        return pa.table({"u": edges[:, 0].view(np.int64), "v": edges[:, 1].view(np.int64)})
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Row by row overlap counts: the product of the incidence matrix with itself, by column blocks."""
    sizes = [len(s) for s in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    columns, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    number = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], number[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = int(shared.sum())
    product = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, total, _COLUMNS):
        a, b = np.searchsorted(col, [begin, begin + _COLUMNS])
        part = np.zeros((len(sets), min(_COLUMNS, total - begin)), np.float32)
        part[row[a:b], col[a:b] - begin] = 1
        product += part @ part.T
    return product


def linked_rows(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows link: overlap * 100 >= percent * union."""
    n = np.array([len(s) for s in sets], np.int64)
    allowed = np.minimum.outer(n, n) * 100 >= percent * np.maximum.outer(n, n)
    np.fill_diagonal(allowed, False)
    if not allowed.any():
        return allowed
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return allowed & (both * 100 >= percent * (int(n.sum()) - both))
    both = overlaps(sets).astype(np.int64)
    return allowed & (both * 100 >= percent * (np.add.outer(n, n) - both))


def _least_linked(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name reachable from every row."""
    label = names.copy()
    top = np.iinfo(np.int64).max
    while True:
        least = np.minimum(label, np.where(links, label[None, :], top).min(1))
        if (least == label).all():
            return label
        label = least


def verify(percent: int):
    """A task's verified links: per node the least node it reaches here and its linked documents.

    A task of two row blocks counts only links across them, and one of the same block
    twice those inside, so every link is counted once.
    """
    def run(table: pa.Table) -> pa.Table:
        root, node, part, pair, cross, copies = (table.column(c).to_numpy() for c in (
            "root", "node", "part", "pair", "cross", "copies"))
        sets = table.column("shingles").to_pylist()
        out = [], [], []
        # A root's rows of one pair of parts are one product.
        order = np.lexsort((node, pair, root))
        change = (np.diff(root[order]) != 0) | (np.diff(pair[order]) != 0)
        for rows in np.split(order, np.flatnonzero(change) + 1):
            rows = rows[np.r_[True, np.diff(node[rows]) != 0]]
            links = linked_rows([np.frombuffer(sets[i], np.uint64) for i in rows], percent)
            counted = links
            if cross[rows[0]]:
                counted = links & (part[rows][:, None] != part[rows][None, :])
            degree = counted.astype(np.float64) @ copies[rows]
            for column, values in zip(out, (node[rows], _least_linked(links, node[rows]), degree)):
                column.append(values)
        return pa.table({"u": np.concatenate(out[1]), "v": np.concatenate(out[0]),
                         "links": np.concatenate(out[2]).astype(np.int64)})
    return run


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``.

    Rows link when 100 * |A and B| >= percent * |A or B| over their distinct shingles;
    component_id is the least doc_id that links reach, n_links the number of other
    rows linked directly.  A null or blank text has no shingles, links with nothing and
    is its own component; a text of fewer than ``width`` words is one shingle; repeated
    rows are copies of each other; a null ``doc_id`` is never a component's least id
    unless it has no other; an empty table gives no rows; other columns are ignored.
    Shingles are compared as 64-bit hashes.
    """
    return _labelled(docs, width, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, node, n, root, component_id, n_links) of every row; ``root`` names the component, null if blank."""
    chunked, chunks = into_chunks(docs)
    space = KeySpace(chunks)
    asked = chunked.groupBy("chunk").applyInArrow(
        ask(space, width), "block int, chunk int, keys binary, counts binary")
    replies = asked.groupBy("block").applyInArrow(answer, "chunk int, block int, classes binary")
    noted = materialize(chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        note(space, width, percent),
        "kind string, block int, doc_id long, node long, n long, keys binary, nodes binary, "
        "low binary, high binary"), "noted")

    rows = noted.where("kind = 'doc'").select("doc_id", "node", "n")
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    looked = noted.where("kind = 'look'").select("block", "keys", "nodes", "low", "high")
    edges = looked.groupBy("block").applyInArrow(candidates(percent), "u long, v long")
    edges = edges.unionByName(noted.where("kind = 'edge'").selectExpr("node AS u", "n AS v"))
    groups = connected_components(edges)
    sized = groups.groupBy("root").agg(F.count("*").alias("rows"))
    members = materialize(groups.join(sized, "root").join(nodes, "node"), "members")

    ties = materialize(_verified(docs, members, width, percent), "ties")
    roots = connected_components(ties.select("u", "v"))
    degrees = ties.groupBy(F.col("v").alias("node")).agg(F.sum("links").alias("linked"))
    named = (nodes.join(roots, "node", "left").join(degrees, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(ids, "root").select(
        "node", "root", "component_id", F.col("copies").alias("_rows"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = join_groups(rows.where("n > 0"), label, ["node"], _heavy(rows)).select(
        "doc_id", "node", "n", "root", "component_id", "n_links")
    blank = rows.where("n = 0").selectExpr(
        "doc_id", "node", "n", "CAST(NULL AS BIGINT) AS root", "doc_id AS component_id", "0L AS n_links")
    return full.unionByName(blank)


def _heavy(rows: DataFrame) -> int:
    """A size that at most ``HEAVY_GROUPS`` groups of the rows exceed."""
    return rows.count() // HEAVY_GROUPS + 1


def _verified(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v, links) for members (node, root, rows, least, copies): v reaches u by links."""
    wanted = members.select(F.col("least").alias("_id")).distinct()
    few = wanted.count()
    if few <= BROADCAST_IDS:  # counted: at most a few MB
        wanted = F.broadcast(wanted)
    texts = whole_texts(docs)
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            flat, offs = text_sets(piece.column("text"), width)
            data = pa.array([packed(flat[a:b]) for a, b in zip(offs[:-1], offs[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_nodes(flat, offs).view(np.int64)), data], names=["node", "shingles"])

    sets = texts.mapInArrow(run, "node long, shingles binary")
    parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    tasks = max(96, few // TASK_NODES)
    dealt = (sets.join(members, "node").withColumn("parts", parts)
             .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("pair", F.when(F.col("parts") == 1, F.lit(-1)).otherwise(
                 F.least("part", "other") * F.col("parts") + F.greatest("part", "other")))
             .withColumn("cross", F.col("part") != F.col("other"))
             .withColumn("task", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks)))
                         .otherwise(F.xxhash64("root", "pair"))))
    return (dealt.select("task", "root", "node", "part", "pair", "cross", "copies", "shingles")
            .groupBy("task").applyInArrow(verify(percent), "u long, v long, links long"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of every component: that with the least id, and set name where an id repeats.

    A row is known by its id and the name of its shingle set, so different texts under one id
    are judged each on its own; of rows that repeat both one stays.  Blank documents stay,
    and rows without an id where their component has no id.  No rows give none.
    """
    found = materialize(_labelled(docs, width, percent), "components")
    own = F.struct("doc_id", "node")
    filled, blank = found.where("root IS NOT NULL"), found.where("root IS NULL")
    heads = filled.groupBy("root").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("_head"), F.count("*").alias("_rows"))
    stays = F.col("_head").isNull() | (own == F.col("_head"))
    names = [F.col("doc_id").alias("_id"), F.col("node").alias("_node")]
    judged = materialize(join_groups(filled, heads, ["root"], _heavy(found)).select(*names, stays.alias("_stays"))
                         .unionByName(blank.select(*names, F.lit(True).alias("_stays"))), "judged")
    state = materialize(judged.groupBy("_id").agg(
        F.count("*").alias("_rows"), F.max(F.col("_stays").cast("int")).alias("_any")), "state")
    gone, several = state.where("_any = 0"), state.where("_any = 1 AND _rows > 1")
    kept = docs.join(_sent(gone), docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")
    if several.isEmpty():
        return kept
    repeated = _sent(several)
    same_id = docs["doc_id"].eqNullSafe(F.col("_id"))
    once = kept.join(repeated, same_id, "left_anti")
    named = _with_nodes(kept.join(repeated, same_id, "left_semi"), width)
    staying = judged.where("_stays").select("_id", F.col("_node").alias("_stay")).distinct()
    again = named.join(staying, named["doc_id"].eqNullSafe(staying["_id"]) & (named["_node"] == staying["_stay"]),
                       "left_semi")
    # Copies of a row go; blank rows and those without an id have no copies.
    single = F.col("doc_id").isNotNull() & (F.col("_node") != 0)
    return (once.unionByName(again.where(single).dropDuplicates(["doc_id", "_node"]).select(docs.columns))
            .unionByName(again.where(~single).select(docs.columns)))


def _with_nodes(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``_node``, the name of each row's shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "_whole"):
            nodes = set_nodes(*text_sets(piece.column("_whole"), width)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in names), pa.array(nodes)], names=[*names, "_node"])

    names = docs.columns
    schema = StructType([*docs.schema, StructField("_node", LongType())])
    return docs.withColumn("_whole", F.coalesce("text", F.lit(""))).mapInArrow(run, schema)


def _sent(state: DataFrame) -> DataFrame:
    """The ids alone, broadcast if counted to be few; else the join shuffles both sides."""
    ids = state.select("_id")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
