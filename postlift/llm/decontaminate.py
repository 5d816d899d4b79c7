"""Test items inside documents: MinHash containment search, partitioned by set size.

An item's set is its distinct word shingles.  If a document holds a share t of them,
then of any n - ceil(t n) + 1 of the item's shingles it holds at least one.  So an
item's sketch, its least hashes up to that depth, cannot miss: no document beyond the
candidates reaches the threshold, however long it is.  Items are partitioned by set
size; a partition's upper size fixes the depth of its sketches.  Candidates are then
verified on the words themselves.

A benchmark that Spark has counted to have at most ``BLOCK_SHINGLES`` words travels to
the documents as one index.  A larger one stays a table: documents send the shingles
that a bitmap of fixed size does not rule out, these meet the sketches by hash, and the
texts of the candidate pairs meet once more to be verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .textops import (distinct_per_row, filled, leave_nothing, pieces_of, shingle_hashes, spread, text_bytes,
                      whole_texts, word_hashes)

WIDTH, THRESHOLD = 5, 0.8
#: Words of the items that travel to the workers as one index; beyond, items stay a table.
BLOCK_SHINGLES = 1_000_000
#: Bits of the bitmap of sketch hashes (as a power of two: 8 MB), copies of the smaller side of a join
#: whose key may be hot, items of a verified row, and document names sent to all tasks at most.
BITS, SALTS, ROW_ITEMS, BROADCAST_KEYS = 26, 16, 512, 400_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str, width: int = WIDTH) -> set[bytes]:
    """The distinct shingles themselves; a shorter text is one shingle, a blank one none."""
    words = text.encode().translate(_LOWER).split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def depth(size: int, threshold: float) -> int:
    """Least hashes that a sketch must hold so that no match is missed."""
    return size - math.ceil(round(threshold * size, 9)) + 1


def sketches(column: pa.Array, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Sketch hashes of every text, as deep as its size partition asks, and the rows they are of."""
    h, row = shingle_hashes(*word_hashes(*text_bytes(column)), width)
    flat, offs = distinct_per_row(h, row, len(column))
    deep = np.array([min(n, depth(1 << (n - 1).bit_length(), threshold)) if n else 0
                     for n in np.diff(offs).tolist()], np.int64)
    return flat[spread(offs[:-1], deep)], np.repeat(np.arange(len(deep)), deep)


class ItemIndex:
    """Sketches of a bounded number of items, by hash."""

    def __init__(self, items: list[tuple], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.ids = [i for i, _ in items]
        self.sets = [shingle_set(text, width) for _, text in items]
        key, owner = sketches(pa.array([t for _, t in items], pa.large_string()), width, threshold)
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]

    def candidates(self, column: pa.Array) -> np.ndarray:
        """(row, item) pairs of which the row holds a sketch hash, each once."""
        if not len(self.key):
            return np.zeros((0, 2), np.int64)
        h, row = shingle_hashes(*word_hashes(*text_bytes(column)), self.width)
        begin = np.searchsorted(self.key, h)
        hit = np.flatnonzero(self.key[np.minimum(begin, len(self.key) - 1)] == h)
        begin = begin[hit]
        count = np.searchsorted(self.key, h[hit], "right") - begin
        first = np.repeat(begin - (np.cumsum(count) - count), count)
        pairs = np.repeat(row[hit], count) * len(self.ids) + self.owner[first + np.arange(len(first))]
        return np.stack(np.divmod(np.unique(pairs), len(self.ids)), 1)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the verified candidates."""
        last, held = -1, set()
        for row, item in self.candidates(column).tolist():
            if row != last:
                last, held = row, shingle_set(column[row].as_py(), self.width)
            shared = len(self.sets[item] & held)
            if shared >= self.threshold * len(self.sets[item]) - 1e-9:
                yield row, item, shared


def _wanted(items: DataFrame) -> DataFrame:
    return items.where("item_id is not null and text is not null").select("item_id", "text")


def small_index(items: DataFrame, width: int, threshold: float, most: int) -> ItemIndex | None:
    """The index of all items where they have at most ``most`` words together, else None."""
    words = F.size(F.split("text", "[ \\t-\\r]+")).cast("long")
    if (_wanted(items).agg(F.sum(words)).first()[0] or 0) > most:
        return None
    return ItemIndex([tuple(r) for r in _wanted(items).collect()], width, threshold)


def _key(text: str) -> Column:
    """The name of a text, 128 bits."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """A join on keys that very many of ``rows`` may share: the smaller side goes out ``SALTS`` times."""
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
            .join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
                  [*keys, "_salt"], how).drop("_salt"))


def _bitmap(sketched: DataFrame) -> np.ndarray:
    """Words of a bitmap of all sketch hashes by their first ``BITS`` bits; its size does not grow."""
    place = F.shiftrightunsigned("hash", 64 - BITS)
    found = (sketched.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"),
                             place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits")).toArrow())
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def search_tables(texts: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(doc_key, item_key, n_item, n_shared) of all texts and items that match, each pair of texts once.

    Nothing passes through the driver but the bitmap.  A shingle or a text that very many
    documents hold is split by the documents' names.
    """
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            key, owner = sketches(piece.column("text"), width, threshold)
            yield pa.RecordBatch.from_arrays(
                [piece.column("item_key").take(pa.array(owner)), pa.array(key.view(np.int64))],
                names=["item_key", "hash"])

    named = materialize(items.select(_key("text").alias("item_key"), "text").dropDuplicates(["item_key"]), "items")
    sketched = materialize(named.mapInArrow(sketch, "item_key binary, hash long"), "sketches")
    bitmap = _bitmap(sketched)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            h, row = shingle_hashes(*word_hashes(*text_bytes(piece.column("text"))), width)
            place = h >> np.uint64(64 - BITS)
            held = (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            flat, offs = distinct_per_row(h[held], row[held], piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_key").take(pa.array(np.repeat(np.arange(piece.num_rows), np.diff(offs)))),
                 pa.array(flat.view(np.int64))], names=["doc_key", "hash"])

    known = texts.select(_key("text").alias("doc_key"), "text")
    asked = known.mapInArrow(ask, "doc_key binary, hash long").distinct()
    pairs = materialize(_salted(asked, sketched, ["hash"], "doc_key")
                        .select("doc_key", "item_key").distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                text_key, text, asked_for = (batch.column(c)[row].as_py() for c in ("doc_key", "text", "items"))
                held = shingle_set(text, width)
                for item in asked_for:
                    own = shingle_set(item["text"], width)
                    shared = len(own & held)
                    if shared >= threshold * len(own) - 1e-9:
                        out.append((text_key, item["item_key"], len(own), shared))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.binary(), pa.binary(), pa.int64(), pa.int64()))],
                names=["doc_key", "item_key", "n_item", "n_shared"])

    # Copies of a text are one candidate; a text with very many candidates is verified in parts.
    candidates = _holding(known, pairs, "left_semi").groupBy("doc_key").agg(F.first("text").alias("text"))
    sizes = pairs.groupBy("doc_key").agg(F.ceil(F.count("*") / ROW_ITEMS).alias("_parts"))
    lists = (_salted(pairs, named, ["item_key"], "doc_key").join(sizes, "doc_key")
             .groupBy("doc_key", F.pmod(F.xxhash64("item_key"), F.col("_parts")).alias("_part"))
             .agg(F.collect_list(F.struct("item_key", "text")).alias("items")))
    return materialize(lists.join(candidates, "doc_key").select("doc_key", "text", "items").mapInArrow(
        verify, "doc_key binary, item_key binary, n_item long, n_shared long"), "matches")


def _holding(rows: DataFrame, pairs: DataFrame, how: str, own: str = "doc_key") -> DataFrame:
    """The rows whose name ``own`` is among the pairs' (or is not); few names, counted, go to all tasks."""
    names = pairs.select(F.col("doc_key").alias(own)).distinct()
    if names.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(names), own, how)
    return rows.join(names, own, how)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def find_items(docs: DataFrame, items: DataFrame, width: int = WIDTH,
               threshold: float = THRESHOLD, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item a whole document holds.

    An item is held when at least ``threshold`` of its distinct shingles occur in the
    document.  Items of at most ``block`` words together travel to the documents, which are
    not shuffled; more are searched as tables.  Items or documents without words
    (or null) match nothing; a text of fewer than ``width`` words is one shingle;
    repeated rows on either side give repeated pairs; an empty table gives no rows;
    other columns are ignored.
    """
    texts = whole_texts(docs)
    kinds = (texts.schema["doc_id"].dataType.simpleString(),
             items.schema["item_id"].dataType.simpleString())
    schema = (f"doc_id {kinds[0]}, item_id {kinds[1]}, n_item long, n_shared long, "
              "containment double")
    index = small_index(items, width, threshold, block)
    if index is not None:
        if not index.ids:
            return docs.sparkSession.createDataFrame([], schema)
        return texts.mapInArrow(_searcher(index), schema)
    found = search_tables(texts, _wanted(items), width, threshold)
    held = _salted(texts.select("doc_id", _key("text").alias("doc_key")), found, ["doc_key"], "doc_id")
    return _salted(held, _wanted(items).select("item_id", _key("text").alias("item_key")), ["item_key"],
                   "doc_key").select("doc_id", "item_id", "n_item", "n_shared",
                                     (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _searcher(index: ItemIndex):
    item_ids = pa.array(index.ids)
    sizes = np.array([len(s) for s in index.sets], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            rows = np.array(list(index.matches(piece.column("text"))), np.int64).reshape(-1, 3)
            n = sizes[rows[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(rows[:, 0])), item_ids.take(pa.array(rows[:, 1])),
                 pa.array(n), pa.array(rows[:, 2]), pa.array(rows[:, 2] / np.maximum(n, 1))],
                names=["doc_id", "item_id", "n_item", "n_shared", "containment"])
    return run


def drop_holders(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                 threshold: float = THRESHOLD, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that hold no item, with all their columns; edge cases as ``find_items``."""
    index = small_index(items, width, threshold, block)
    if index is None:
        found = search_tables(whole_texts(docs), _wanted(items), width, threshold)
        text, own = _free(docs, "_whole"), _free(docs, "doc_key")
        whole = docs.withColumn(text, F.coalesce("text", F.lit("")))
        return _holding(whole.withColumn(own, _key(text)), found, "left_anti", own).select(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            keep = np.ones(piece.num_rows, bool)
            keep[[row for row, _, _ in index.matches(filled(piece.column("text")))]] = False
            yield piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
