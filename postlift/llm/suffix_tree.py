"""Language model scores from a probabilistic suffix tree.

The tree's symbols are the bytes of a text's words, each word followed by a space and
the text by an end.  Contexts are suffixes of the history of up to ``DEPTH`` symbols.
A context is a state if it is met ``LEAST_COUNT`` times and passes the divergence test:
over its own symbols, telling it from its parent, the suffix one symbol shorter, gains
``LEAST_NATS`` nats.  Neither bound depends on the corpus, so the tree grows with it.  A
state's next-symbol counts give up ``DISCOUNT`` each, which is dealt out as its longest
shorter state predicts.  A symbol is scored by the state that is the longest suffix of
its history.

The tree is never in one place.  Grams (a context of ``DEPTH`` symbols and the next one)
are dealt into blocks by the last ``NEAR`` symbols of the context, so that a block holds
all that the contexts from there on need; shorter contexts, at most 256 ** NEAR of them,
are counted for all.  Blocks give every gram its probability, and chunks of texts ask for
those of the grams they hold, as they ask for the counts of their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .exchange import LEAST_BLOCKS, KeySpace, into_chunks, packed
from .textops import mix, pieces_of, text_bytes, whole_texts, word_hashes

DEPTH, LEAST_COUNT, LEAST_NATS, DISCOUNT = 6, 2, 1.0, 0.75
#: Last symbols of a context that say the block of its grams.
NEAR = 3
#: Weight of an unseen word in the base score, and lanes of a walk.
ADDED, LANES = 0.1, 8_192
SPACE, END = 32, 10
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Distinct grams a task holds before it passes them on; tasks that count grams at least.
_HELD, LEAST_TASKS = 3_000_000, 12


def symbol_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each after DEPTH ends as history, and the row offsets."""
    parts, sizes = [], [0]
    for text in column.cast(pa.large_binary()).to_pylist():
        words = text.translate(_LOWER).split()
        words.append(b"\n")
        stream = b"\n" * DEPTH + b" ".join(words)
        parts.append(stream)
        sizes.append(len(stream))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes)


def all_grams(symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The run of DEPTH + 1 symbols that ends with each symbol of the rows, the last in the lowest byte."""
    n = len(symbols) - DEPTH
    if n <= 0:
        return np.zeros(0, np.int64)
    code = symbols[:n].astype(np.int64)
    for k in range(1, DEPTH + 1):
        code <<= 8
        code |= symbols[k:k + n]
    # Runs that end among a row's leading ends predict nothing.
    leading = (offs[:-1, None] + np.arange(DEPTH)).ravel() - DEPTH
    keep = np.ones(n, bool)
    keep[leading[(leading >= 0) & (leading < n)]] = False
    return code[keep]


def grams(symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of DEPTH + 1 symbols and their counts."""
    code = np.sort(all_grams(symbols, offs))  # many times faster than np.unique, here and below
    starts = np.flatnonzero(_heads(code))
    return code[starts], np.diff(starts, append=len(code))


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.r_[True, ordered[1:] != ordered[:-1]][:len(ordered)]


def _distinct(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)
    return code[_heads(code)]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    order = np.argsort(code)
    code = code[order]
    starts = np.flatnonzero(_heads(code))
    return code[starts], np.add.reduceat(n[order], starts) if len(code) else n


def _block(code: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of grams, by their oldest four symbols: those of a block compress well."""
    return (mix((code >> (8 * (DEPTH - 3))).view(np.uint64)) % np.uint64(blocks)).astype(np.uint16 if blocks < 1 << 16 else np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Values byte by byte, highest bytes first, compressed."""
    return zlib.compress(packed(values.view(np.uint8).reshape(-1, values.itemsize).T[::-1]), 1)


def _from_planes(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes[::-1].T).view(kind).ravel()


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of packed rows and the sums of their counts."""
    return _summed(*(np.concatenate([_from_planes(x, np.int64) for x in table.column(c).to_pylist()])
                     for c in ("grams", "counts")))


def _packed_grams(texts: DataFrame, blocks: int, near: int) -> DataFrame:
    """(block, grams, counts): a task adds up what it reads and sends each block one packed row.

    So the shuffle holds a gram once per task; few tasks that read much keep it small.
    Blocks go by the last ``near`` symbols of the context, or by the whole gram (0).
    Grams of ``held_out`` rows are there too, and count 0.
    """
    parts = texts.rdd.getNumPartitions()

    def by_block(held: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        block = (mix(((held >> 8) & ((1 << (8 * near)) - 1) if near else held).view(np.uint64))
                 % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        held, counts = held[order], counts[order]
        bounds = np.searchsorted(block[order], np.arange(blocks + 1))
        spans = [(b, x, y) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]
        return pa.RecordBatch.from_arrays([
            pa.array([b for b, _, _ in spans], pa.int32()),
            *[pa.array([_planes(v[x:y]) for _, x, y in spans], pa.binary()) for v in (held, counts)]],
            names=["block", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for piece in pieces_of(batches, limit=4 << 20):
            code, n = grams(*symbol_stream(piece.column("text")))
            if "held_out" in piece.schema.names:
                learnt, m = grams(*symbol_stream(piece.filter(pc.invert(piece.column("held_out"))).column("text")))
                n = np.zeros(len(code), np.int64)
                n[np.searchsorted(code, learnt)] = m
            held, counts = _summed(np.concatenate([held, code]), np.concatenate([counts, n]))
            if len(held) > _HELD:
                yield by_block(held, counts)
                held, counts = held[:0], counts[:0]
        if len(held):
            yield by_block(held, counts)

    few = texts.drop("doc_id").coalesce(max(LEAST_TASKS, parts // 4))
    return few.mapInArrow(run, "block int, grams binary, counts binary")


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over all rows of ``texts``, summed."""
    blocks = max(LEAST_BLOCKS, texts.rdd.getNumPartitions())

    def add(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("gram", "n"), _added(table))))

    return _packed_grams(texts.select("text"), blocks, 0).groupBy("block").applyInArrow(add, "gram long, n long")


@dataclass
class Level:
    """Of every (context, next symbol) of a depth, in order of its code: count, context's count, probability."""

    code: np.ndarray
    n: np.ndarray
    total: np.ndarray
    p: np.ndarray


def _climb(code: np.ndarray, n: np.ndarray, depth: int, below: Level | None = None) -> Level:
    """The level of ``depth`` for sorted distinct codes, above ``below`` or the root."""
    lower, start = [(code, n)], depth
    while start > 0 and (below is None or start > NEAR):
        start -= 1
        lower.append(_summed(lower[-1][0] & ((1 << (8 * (start + 1))) - 1), lower[-1][1]))
    for k, (code, n) in zip(range(start, depth + 1), reversed(lower)):
        if not k:
            total = np.full(len(code), n.sum())
            # Every byte has half a count.
            below = Level(code, n, total, (n + 0.5) / (total + 0.5 * 256))
            continue
        own = np.cumsum(_heads(code >> 8)) - 1
        sums = np.bincount(own, n).astype(np.int64)
        up = np.searchsorted(below.code, code & ((1 << (8 * k)) - 1))
        p, seen = below.p[up], n > 0
        gain = np.zeros(len(code))
        gain[seen] = n[seen] * np.log(n[seen] / sums[own][seen] * (below.total[up] / np.maximum(below.n[up], 1))[seen])
        state = ((sums >= LEAST_COUNT) & (np.bincount(own, gain) >= LEAST_NATS))[own]
        spared = DISCOUNT * np.bincount(own, seen)[own]
        told = (np.maximum(n - DISCOUNT, 0) + spared * p) / np.maximum(sums[own], 1)
        below = Level(code, n, sums[own], np.where(state, told, p))
    return below


def gram_scores(texts: DataFrame, blocks: int) -> DataFrame:
    """(block, chunk -2, grams, logs): log10 probability of the last symbol of every gram.

    ``texts`` has ``text`` and ``held_out``; packed rows, by block of the whole gram.
    Only the counts of contexts of NEAR - 1 symbols come to the driver.
    """
    counted = materialize(_packed_grams(texts, blocks, NEAR).groupBy("block").applyInArrow(
        lambda table: pa.table({"block": table.column("block")[:1],
                                **{c: pa.array([_planes(v)], pa.binary())
                                   for c, v in zip(("grams", "counts"), _added(table))}}),
        "block int, grams binary, counts binary"), "grams")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                code, n = _added(pa.Table.from_batches([batch.slice(i, 1)]))
                code, n = _summed(code & ((1 << (8 * NEAR)) - 1), n)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["gram", "n"])

    short = (counted.mapInArrow(shorten, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
             .toArrow().sort_by("gram"))
    near = _climb(*(short.column(c).to_numpy() for c in ("gram", "n")), NEAR - 1)

    def score(table: pa.Table) -> pa.Table:
        code, n = _added(table)
        logs = np.log10(_climb(code, n, DEPTH, near).p).astype(np.float32)
        block = _block(code, blocks)
        order = np.argsort(block, kind="stable")
        code, logs = code[order], logs[order]
        bounds = np.searchsorted(block[order], np.arange(blocks + 1))
        spans = [(b, x, y) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]
        return pa.table({
            "block": pa.array([b for b, _, _ in spans], pa.int32()),
            "chunk": pa.array([-2] * len(spans), pa.int32()),
            **{c: pa.array([_planes(v[x:y]) for _, x, y in spans], pa.binary())
               for c, v in (("grams", code), ("logs", logs))}})

    return counted.groupBy("block").applyInArrow(score, "block int, chunk int, grams binary, logs binary")


def learn(texts: DataFrame, share: float, gain: float = 1e-7) -> "Tree":
    """A small tree of all rows of ``texts``: of contexts that make up a ``share`` of all symbols and
    gain ``gain`` nats per corpus symbol, to look at or to walk in one place.

    Counting, the frequency and the divergence test run as aggregations and joins over
    all grams; only the states come to the driver, of which there are at most
    DEPTH / share.  No rows give a tree of the root alone.
    """
    counted = materialize(count_grams(texts), "grams")
    total = counted.agg(F.sum("n")).first()[0] or 0
    levels = {}
    for depth in range(DEPTH, -1, -1):
        mask = (1 << (8 * depth)) - 1
        table = counted.select(F.shiftright("gram", 8).bitwiseAND(mask).alias("context"),
                               F.col("gram").bitwiseAND(255).alias("next"), "n")
        if depth < DEPTH:  # a shorter context adds up many grams, mostly on the map side
            table = table.groupBy("context", "next").agg(F.sum("n").alias("n"))
        sums = table.groupBy("context").agg(F.sum("n").alias("total")).where(
            F.col("total") >= share * total)
        # Frequent contexts alone: at most 256 / share rows, so the next levels read little.
        levels[depth] = materialize(table.join(sums, "context"), f"level{depth}")
    found = [(0, *_level(levels[0]))]
    for depth in range(1, DEPTH + 1):
        own, parent = levels[depth], levels[depth - 1].selectExpr(
            "context AS up", "next", "n AS up_n", "total AS up_total")
        mask = (1 << (8 * (depth - 1))) - 1
        paired = own.withColumn("up", F.col("context").bitwiseAND(mask)).join(parent, ["up", "next"])
        surprise = F.sum(F.col("n") * F.log((F.col("n") / F.col("total"))
                                            / (F.col("up_n") / F.col("up_total"))))
        told = paired.groupBy("context").agg(surprise.alias("gain")).where(F.col("gain") >= gain * total)
        found.append((depth, *_level(own.join(told.select("context"), "context"))))
    return Tree(found)


def _level(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = rows.select("context", "next", "n").toArrow()
    return tuple(held.column(c).to_numpy().astype(np.int64) for c in ("context", "next", "n"))


@dataclass
class Tree:
    """(depth, contexts, next symbols, counts) of the states, the root at depth 0."""

    levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]

    def states(self) -> int:
        return sum(len(np.unique(c)) for _, c, _, _ in self.levels)

    def automaton(self) -> "Automaton":
        return Automaton(self)


class Automaton:
    """Tables of the tree: the next node and the log10 probability by node and symbol.

    Nodes are the beginnings of the states' contexts, so the longest suffix of any
    history that begins a context is found by one step per symbol.
    """

    def __init__(self, tree: Tree):
        used = np.unique(np.concatenate([tree.levels[0][2], *[
            (c[:, None] >> (8 * np.arange(d))).ravel() & 255 for d, c, _, _ in tree.levels[1:]],
            np.array([SPACE, END])]))
        self.symbol = np.full(256, len(used), np.int32)  # all bytes never learnt share a class
        self.symbol[used] = np.arange(len(used))
        width = self.width = len(used) + 1
        states = [dict() for _ in range(DEPTH + 1)]
        for depth, context, nxt, n in tree.levels:
            order = np.argsort(context, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(context[order]) != 0][:len(order)])
            for rows in np.split(order, heads[1:]) if len(order) else []:
                states[depth][int(context[rows[0]])] = rows
        # A node of length k that begins a context: the context without its newest symbols.
        nodes = [sorted({0} if k == 0 else {c >> (8 * (d - k)) for d in range(k, DEPTH + 1) for c in states[d]})
                 for k in range(DEPTH + 1)]
        first = np.cumsum([0, *map(len, nodes)])
        number = [{c: int(first[k]) + i for i, c in enumerate(level)} for k, level in enumerate(nodes)]
        self.next = np.zeros((int(first[-1]), width), np.int32)
        probability = np.zeros((int(first[-1]), width), np.float32)
        fail = np.zeros(int(first[-1]), np.int64)
        _, _, nxt, n = tree.levels[0]
        root = np.zeros(width)
        np.add.at(root, self.symbol[nxt], n)
        # Every byte has half a count; the class of unlearnt bytes holds one byte's share.
        probability[0] = (root + 0.5) / (root.sum() + 0.5 * 256)
        for k, level in enumerate(nodes):
            own = np.arange(first[k], first[k + 1])
            if k:
                codes = np.array(level, np.int64)
                above = np.array([number[k - 1][c >> 8] for c in level], np.int64)
                last = self.symbol[codes & 255]
                # The longest shorter suffix that is a node: step from the parent's.
                fail[own] = 0 if k == 1 else self.next[fail[above], last]
                self.next[own] = self.next[fail[own]]
                probability[own] = probability[fail[own]]
                _, context, nxt, n = tree.levels[k]
                for c, rows in states[k].items():
                    node, counts = number[k][c], np.zeros(width)
                    np.add.at(counts, self.symbol[nxt[rows]], n[rows])
                    spared = DISCOUNT * np.count_nonzero(counts)
                    probability[node] = (np.maximum(counts - DISCOUNT, 0)
                                         + spared * probability[node]) / counts.sum()
            if k < DEPTH and len(nodes[k + 1]):
                codes = np.array(nodes[k + 1], np.int64)
                parent = np.array([number[k][c >> 8] for c in nodes[k + 1]], np.int64)
                self.next[parent, self.symbol[codes & 255]] = np.arange(first[k + 1], first[k + 2])
        self.score = np.log10(probability, out=probability)

    def scores(self, column: pa.Array) -> np.ndarray:
        """log10 probability of every text's symbols."""
        symbols, offs = symbol_stream(column)
        code = self.symbol[symbols]
        n = len(code)
        step = max(DEPTH + 1, -(-n // LANES))
        lanes = -(-n // step)
        padded = np.concatenate([np.full(DEPTH, self.symbol[END], np.int32), code,
                                 np.zeros(lanes * step - n, np.int32)])
        nxt, score, width = self.next.ravel(), self.score.ravel(), self.width
        out = np.empty((step, lanes), np.float32)
        begin, state = np.arange(lanes) * step, np.zeros(lanes, np.int32)
        for t in range(step + DEPTH):
            at = state * width + padded[begin + t]
            if t >= DEPTH:
                out[t - DEPTH] = score[at]
            state = nxt[at]
        flat = out.T.ravel()[:n].astype(np.float64)
        flat[(offs[:-1, None] + np.arange(DEPTH)).ravel()] = 0  # the leading ends
        return np.add.reduceat(flat, offs[:-1]) if len(column) else np.zeros(0)


def _ask(space: KeySpace):
    """A chunk's distinct words by block, how often its training rows hold each, and its distinct grams."""
    def run(table: pa.Table) -> pa.Table:
        keys, counts, codes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for piece in pieces_of(iter(table.combine_chunks().to_batches()), limit=2 << 20):
            h, row = word_hashes(*text_bytes(piece.column("text")))
            learnt = ~piece.column("held_out").to_numpy(zero_copy_only=False)[row]
            k, place = np.unique(h, return_inverse=True)
            keys.append(k)
            counts.append(np.bincount(place, learnt, len(k)).astype(np.int64))
            codes.append(_distinct(all_grams(*symbol_stream(piece.column("text")))))
        code, starts = _by_block(codes, space.blocks)
        keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64)
        edges = np.arange(1, space.blocks, dtype=np.uint64) * np.uint64(space.step)
        bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        small = counts.astype(np.uint32)  # a chunk has far fewer words
        spans = list(zip(bounds[:-1], bounds[1:]))
        return pa.table({
            "block": pa.array(range(space.blocks), pa.int32()),
            "chunk": pa.array([table.column("chunk")[0].as_py()] * space.blocks, pa.int32()),
            "keys": pa.array([packed(keys[a:b]) for a, b in spans], pa.binary()),
            "counts": pa.array([packed(small[a:b]) for a, b in spans], pa.binary()),
            "grams": pa.array([_planes(code[a:b]) for a, b in zip(starts[:-1], starts[1:])], pa.binary())})
    return run


def _by_block(codes: list[np.ndarray], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams by block and code, and the offsets of the blocks."""
    code = _distinct(np.concatenate(codes))
    block = _block(code, blocks)
    order = np.argsort(block, kind="stable")
    return code[order], np.searchsorted(block[order], np.arange(blocks + 1))


def _answer(table: pa.Table) -> pa.Table:
    """A block's totals and gram scores for every chunk, and a row (chunk -1) of its occurrences and distinct words."""
    tree = pc.equal(table.column("chunk"), -2)
    scored, table = table.filter(tree), table.filter(pc.invert(tree))
    code, logs = (np.concatenate([np.zeros(0, t), *[_from_planes(x, t) for x in scored.column(c).to_pylist()]])
                  for c, t in (("grams", np.int64), ("logs", np.float32)))
    order = np.argsort(code)
    code, logs = code[order], logs[order]
    told = [_planes(logs[np.searchsorted(code, _from_planes(g, np.int64))]) for g in table.column("grams").to_pylist()]
    keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, counts, len(distinct)).astype(np.int64)
    wide = np.uint32 if not len(total) or total.max() < 1 << 32 else np.int64
    reply, ends = total.astype(wide)[place], np.cumsum([len(k) for k in keys]).tolist()
    rows = len(keys)
    return pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int32()),
        "block": pa.array([*table.column("block").to_pylist(), table.column("block")[0].as_py()], pa.int32()),
        "totals": pa.array([*[packed(reply[e - len(k):e]) for e, k in zip(ends, keys)], None], pa.binary()),
        "logs": pa.array([*told, None], pa.binary()),
        "wide": pa.array([wide is np.int64] * (rows + 1)),
        "words": pa.array([0] * rows + [int(total.sum())], pa.int64()),
        "kinds": pa.array([0] * rows + [int((total > 0).sum())], pa.int64())})


_SCORED = ("doc_id {kind}, held_out boolean, n_words long, n_known long, log_sum double, score double, "
           "words long, kinds long")


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of every whole text under the tree and under smoothed word frequencies.

    Rows where ``held_out`` holds (or is null) are not learnt from.  Columns: doc_id,
    held_out, n_tokens (words and one end), n_known (tokens met in training),
    train_tokens, base_score (sum of log10((c + 0.1) / (N + 0.1 (V + 1)))), score (the
    tree's log10 probability of the text).

    A null or blank text is its end alone; a null ``doc_id`` and repeated rows are scored
    like others; an empty table gives no rows; with nothing to learn from, N is 0 and the
    tree is uniform; other columns are ignored.  Words are told apart by 64-bit hashes.
    """
    kept = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    chunked, chunks = into_chunks(kept, "held_out")
    space = KeySpace(chunks)
    asked = chunked.groupBy("chunk").applyInArrow(
        _ask(space), "block int, chunk int, keys binary, counts binary, grams binary")
    asked = asked.unionByName(gram_scores(whole_texts(kept, "held_out"), space.blocks), allowMissingColumns=True)
    replies = asked.groupBy("block").applyInArrow(
        _answer, "chunk int, block int, totals binary, logs binary, wide boolean, words long, kinds long")
    kind = chunked.schema["doc_id"].dataType.simpleString()
    partial = materialize(chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _scorer(space.blocks), _SCORED.format(kind=kind)), "scores")
    words, kinds = partial.agg(F.sum("words"), F.sum("kinds")).first()
    ends = kept.where("not held_out").count()
    total, vocabulary = (words or 0) + ends, (kinds or 0) + (ends > 0)
    whole = float(np.log10(total + ADDED * (vocabulary + 1)))
    return partial.where("score is not null").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_sum") + float(np.log10(ends + ADDED)) - (F.col("n_words") + 1) * whole).alias("base_score"),
        "score")


def _scorer(blocks: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:  # the blocks' own rows
            n = replies.num_rows
            return pa.table({
                "doc_id": pa.nulls(n, table.schema.field("doc_id").type), "held_out": pa.nulls(n, pa.bool_()),
                **{c: pa.nulls(n, pa.int64()) for c in ("n_words", "n_known")},
                **{c: pa.nulls(n, pa.float64()) for c in ("log_sum", "score")},
                "words": replies.column("words"), "kinds": replies.column("kinds")})
        order = np.argsort(replies.column("block").to_numpy())
        totals, wide = replies.column("totals").to_pylist(), replies.column("wide").to_pylist()
        counts = np.concatenate([np.frombuffer(totals[i], np.int64 if wide[i] else np.uint32).astype(np.int64)
                                 for i in order])
        logs = replies.column("logs").to_pylist()
        logs = np.concatenate([_from_planes(logs[i], np.float32) for i in order])
        pieces, hashes, codes = [], [], []
        for piece in pieces_of(iter(table.combine_chunks().to_batches()), limit=2 << 20):
            h, row = word_hashes(*text_bytes(piece.column("text")))
            pieces.append((piece, h, row))
            hashes.append(np.unique(h))
            codes.append(_distinct(all_grams(*symbol_stream(piece.column("text")))))
        code = _by_block(codes, blocks)[0]
        by_code = np.argsort(code)
        code, logs = code[by_code], logs[by_code]
        known = np.unique(np.concatenate(hashes))
        out = []
        for piece, h, row in pieces:
            c = counts[np.searchsorted(known, h)] if len(known) else np.zeros(0, np.int64)
            n = piece.num_rows
            symbols, offs = symbol_stream(piece.column("text"))
            own = all_grams(symbols, offs)
            by_own, score = np.argsort(own), np.empty(len(own))
            own = own[by_own]
            head = _heads(own)
            score[by_own] = logs[np.searchsorted(code, own[head])][np.cumsum(head) - 1]
            out.append(pa.table({
                "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"),
                "n_words": np.bincount(row, minlength=n), "n_known": np.bincount(row[c > 0], minlength=n),
                "log_sum": np.bincount(row, np.log10(c + ADDED), n).astype(np.float64),
                "score": np.add.reduceat(score, offs[:-1] - DEPTH * np.arange(n)),
                "words": np.zeros(n, np.int64), "kinds": np.zeros(n, np.int64)}))
        return pa.concat_tables(out)
    return run
