"""Files of token ids: blocks coded by adaptive context mixing, each with its own checksum.

Documents lie in ascending order of their ids over the files, and in every file as one
stream of token ids with an end id after each.  The stream is cut into blocks of ``BLOCK`` ids
whatever document they belong to.  A file is a run of block records, little-endian:

    4 bytes "IDB2"; number of ids, coded bytes, crc32 of the ids, and pieces of documents
    (unsigned 32 bits each); bits of an id (8 bits);
    for every piece: the document's id (signed 64 bits), its ids in this block (unsigned
    32 bits), flags (8 bits: 1 the document ends here, 2 its id is null);
    the coded bytes; one byte 0x0A.

A record can be read without the others.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ..session import materialize
from .context_coder import BLOCK, checksum, decode_blocks, encode_blocks
from .spans import Growing, SpanTable, pretoken_spans, unit_spans
from .textops import pieces_of, spread, text_bytes, whole_texts, worker_latest
from .token_counts import byte_letters

#: Text bytes of a file, and the least number of files.
FILE_BYTES, LEAST_FILES = 20 << 20, 12

_MAGIC = b"IDB2"
_HEAD, _PIECE = "<4sIIIIB", "<qIB"
_UNITS, _PRETOKENS = 600_000, 1_000_000
_LINE = 300  # pre-tokens of one call to the library
_TOGETHER = 256  # blocks that are coded or read in one call
_ENDS, _NULL = 1, 2


class _Runs:
    """Ids of the spans of a table, by the spans' numbers, in cells of 64 bits with as many ids as fit."""

    def __init__(self, id_bits: int):
        self.kind = np.uint16 if id_bits <= 16 else np.uint32
        self.most = 8 // np.dtype(self.kind).itemsize
        self.cells, self.first, self.sizes = Growing(np.uint64), Growing(np.int64), Growing(np.int32)
        #: Which places of a cell are filled, by their number.
        self.filled = np.arange(self.most) < np.arange(self.most + 1)[:, None]

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        count = self._cells_of(sizes)
        ends = np.cumsum(count)
        cells = np.zeros((int(ends[-1]) if len(ends) else 0, self.most), self.kind)
        cells.ravel()[spread((ends - count) * self.most, sizes)] = ids
        self.first.add(self.cells.size + ends - count)
        self.sizes.add(sizes)
        self.cells.add(cells.view(np.uint64).ravel())

    def _cells_of(self, sizes: np.ndarray) -> np.ndarray:
        return np.maximum((sizes + (self.most - 1)) // self.most, 1).astype(np.int64)

    def keep(self, kept: np.ndarray) -> None:
        ids, sizes = self.take(kept)
        for column in (self.cells, self.first, self.sizes):
            column.size = 0
        self.add(ids, sizes)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes.room.take(numbers)
        at = self.first.room.take(numbers)
        if sizes.max(initial=0) > self.most:
            count = self._cells_of(sizes)
            ends = np.cumsum(count)
            filled = np.full(int(ends[-1]), self.most, np.int32)
            filled[ends - 1] = sizes - (count - 1) * self.most
            at = np.repeat(at - ends + count, count)
            at += np.arange(len(at))
        else:
            filled = sizes
        cells = self.cells.room.take(at).view(self.kind).reshape(-1, self.most)
        return cells[self.filled.take(filled, axis=0)].astype(np.int32), sizes


class IdEncoder:
    """Token ids by the tokenizers library, with tables of the units and pre-tokens a worker has met.

    Special strings are cut out as the library cuts them; new pre-tokens go to the
    library's merge model in the byte letters it expects.
    """

    def __init__(self, description: bytes, pattern: str):
        # Spark gives the cores to tasks; the library's own threads would share them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_str(description.decode())
        self.model, self.pattern = tokenizer.model, regex.compile(pattern)
        self.library = Tokenizer(self.model)
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = (regex.compile("(" + "|".join(map(regex.escape, sorted(
            self.special, key=len, reverse=True))) + ")") if self.special else None)
        self.id_bits = max(16, (tokenizer.get_vocab_size() - 1).bit_length())
        # The letters that stand for the bytes, as code points; none is blank.
        self.letters = np.array([ord(letter) for letter in byte_letters()], "<u4")
        vocabulary = tokenizer.get_vocab()
        self.id_letters = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.id_letters[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.units, self.words = SpanTable(_UNITS), SpanTable(_PRETOKENS)
        self.unit_ids, self.word_ids = _Runs(self.id_bits), _Runs(self.id_bits)

    def _words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, which go to the library in lines parted by blanks, and how many each has."""
        ends = np.cumsum(sizes + 1)
        letters = np.full(int(ends[-1]), 32, "<u4")
        letters[spread(ends - sizes - 1, sizes)] = self.letters[data[spread(starts, sizes)]]
        line = letters.tobytes().decode("utf-32-le")
        begins, stops = (ends - sizes - 1).tolist(), (ends - 1).tolist()
        counts, ids = [], []
        for i in range(0, len(ends), _LINE):
            stop = min(i + _LINE, len(ends))
            found, = self.library.encode_batch_fast([line[begins[i]:stops[stop - 1]]], add_special_tokens=False)
            own = np.array(found.ids, np.int64)
            # Ids end where pre-tokens do, as their letters are those of the pre-token.
            after = np.cumsum(self.id_letters[own])
            wanted = np.cumsum(sizes[i:stop])
            at = np.searchsorted(after, wanted)
            if not len(own) or after[-1] != wanted[-1] or (after[at] != wanted).any():
                each = [self.model.tokenize(line[a:b]) for a, b in zip(begins[i:stop], stops[i:stop])]
                own, at = np.array([t.id for e in each for t in e], np.int64), np.cumsum([len(e) for e in each]) - 1
            counts.append(np.diff(at, prepend=-1))
            ids.append(own.astype(np.int32))
        return np.concatenate(ids), np.concatenate(counts)

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for table, runs in ((self.units, self.unit_ids), (self.words, self.word_ids)):
            kept = table.shrink()
            if kept is not None:
                runs.keep(kept)
        starts, lengths, offs = unit_spans(data, offs)
        number, fresh = self.units.number(data, starts, lengths)
        if len(fresh):
            data, starts, lengths, parts = pretoken_spans(data, starts[fresh], lengths[fresh], self.pattern)
            words, fresh = self.words.number(data, starts, lengths)
            if len(fresh):
                self.word_ids.add(*self._words(data, starts[fresh], lengths[fresh]))
            ids, sizes = self.word_ids.take(words)
            self.unit_ids.add(ids, np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(parts)]]))
        ids, sizes = self.unit_ids.take(number)
        return ids, np.r_[0, np.cumsum(sizes)][offs]

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each closed by ``end_id``, and the texts' offsets."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        data, offs = text_bytes(column)
        whole = data.tobytes()
        after, first = None, np.arange(len(column) + 1)
        if any(s.encode() in whole for s in self.special):
            plain, after, count = [], [], []
            for text in column.to_pylist():
                parts = self.cut.split(text)
                plain += parts[::2]
                after += [*(self.special[s] for s in parts[1::2]), end_id]
                count.append(len(parts[::2]))
            first = np.r_[0, np.cumsum(count)]
            data, offs = text_bytes(pa.array(plain, pa.large_string()))
        ids, offs = self._plain(data, offs)
        if after is None and end_id is None:
            return ids, offs
        after = np.full(len(offs) - 1, end_id) if after is None else np.array([-1 if a is None else a for a in after])
        added = after >= 0
        ends = np.cumsum(np.diff(offs) + added)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        own = np.ones(len(out), bool)
        own[ends[added] - 1] = False
        out[~own] = after[added]
        out[own] = ids
        return out, np.r_[0, ends][first]


def pack_records(doc_ids: list, ids: np.ndarray, offs: np.ndarray, open_at_end: bool, id_bits: int
                 ) -> list[bytes]:
    """Block records of documents end to end; ``open_at_end``: the last one goes on in the next call."""
    sizes = np.full(-(-len(ids) // BLOCK), BLOCK)
    if len(sizes):
        sizes[-1] = len(ids) - BLOCK * (len(sizes) - 1)
    records, doc = [], 0
    for k, words in enumerate(encode_blocks(ids, sizes, id_bits)):
        start, stop = k * BLOCK, k * BLOCK + int(sizes[k])
        pieces, at = [], start
        while at < stop:
            end = min(int(offs[doc + 1]), stop)
            ends = end == offs[doc + 1] and not (open_at_end and doc == len(doc_ids) - 1)
            key = doc_ids[doc]
            pieces.append(struct.pack(_PIECE, key or 0, end - at, ends * _ENDS + (key is None) * _NULL))
            doc, at = doc + (end == offs[doc + 1]), end
        records.append(b"".join([
            struct.pack(_HEAD, _MAGIC, stop - start, len(words), checksum(ids[start:stop]), len(pieces), id_bits),
            *pieces, words]))
    return records


def parse_records(data: bytes) -> Iterator[tuple[int, int, int, list[tuple[int | None, int, bool]], bytes]]:
    """(ids, checksum, id bits, pieces, coded bytes) of every record of a file; a cut one raises."""
    at, head, piece = 0, struct.calcsize(_HEAD), struct.calcsize(_PIECE)
    while at < len(data):
        if len(data) < at + head:
            raise ValueError("a file of ids ends within a record")
        magic, n, size, crc, count, bits = struct.unpack_from(_HEAD, data, at)
        if magic != _MAGIC:
            raise ValueError("no block of ids begins here")
        at += head
        stop = at + piece * count + size
        if len(data) <= stop or data[stop] != 0x0A:
            raise ValueError("a file of ids ends within a record")
        pieces = [(None if flags & _NULL else key, length, bool(flags & _ENDS))
                  for key, length, flags in struct.iter_unpack(_PIECE, data[at:at + piece * count])]
        if sum(p[1] for p in pieces) != n:
            raise ValueError("a block's pieces do not add up")
        yield n, crc, bits, pieces, data[stop - size:stop]
        at = stop + 1


def write_ids(docs: DataFrame, path: str, description: bytes, pattern: str, end_id: int = 0,
              file_bytes: int = FILE_BYTES) -> None:
    """Files of the token ids of every row's whole text, an ``end_id`` after each, in ``path``.

    Rows stand in ascending order of doc_id, nulls first and equal ids by their texts' hash;
    the files' names follow that order.  ``description`` is the tokenizer's JSON.  A
    null or empty text has the end id alone; repeated rows are documents of their own; an
    empty table writes no block; other columns are ignored.  One shuffle, by ranges of ids
    in which even a repeated row is dealt on; a file is written by Spark's own committed writer, so a
    task that is run again replaces its file.
    """
    texts = whole_texts(docs).withColumns({
        "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    files = max(LEAST_FILES, math.ceil(total / file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_latest(("id files", hash(description), pattern),
                                lambda: IdEncoder(description, pattern))
        keys, parts, lengths, held = [], [], [], 0
        most = BLOCK * _TOGETHER

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Records of whole blocks, of all ids if nothing follows; the rest stays held."""
            nonlocal keys, parts, lengths, held
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            offs = np.r_[0, np.cumsum(lengths)]
            cut = len(ids) if last else len(ids) // BLOCK * BLOCK
            docs_in = int(np.searchsorted(offs, cut, "left"))
            open_at_end = docs_in < len(offs) and offs[docs_in] > cut
            here = np.minimum(offs[:docs_in + 1], cut)
            records = pack_records(keys[:docs_in], ids[:cut], here, open_at_end, encoder.id_bits)
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])
            first = docs_in - 1 if open_at_end else docs_in
            rest = offs[docs_in] - cut if open_at_end else 0
            keys, parts = keys[first:], [ids[cut:]]
            lengths = ([int(rest)] if open_at_end else []) + [int(x) for x in np.diff(offs)[docs_in:]]
            held = len(ids) - cut

        for piece in pieces_of(batches, limit=2 << 20):
            ids, offs = encoder.encode(piece.column("text"), end_id)
            keys += piece.column("doc_id").to_pylist()
            parts.append(ids)
            lengths += np.diff(offs).tolist()
            held += len(ids)
            if held >= most:
                yield from flush(False)
        yield from flush(True)

    records = (texts.repartitionByRange(files, *order).sortWithinPartitions(*order)
               .select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "record binary"))
    # Spark writes the bytes of a string as they are; the line's end closes the record.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


_READ = "part int, place long, doc_id long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(part, place, doc_id, n_tokens, ids_crc32) of every document of all files in ``path``.

    ``part`` is the file's number, ``place`` the number of ids before the document in its
    file; the checksum is of all the document's ids; with ``ids`` also the ids themselves.
    A file is read by one task, some hundred blocks at a time.  Damaged blocks raise.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
                yield from _documents(part, content.as_buffer())

    def _documents(part: int, data) -> Iterator[pa.RecordBatch]:
        place = start = length = crc = 0
        values: list[np.ndarray] = []
        group: list = []

        def rows_of(blocks: list) -> pa.RecordBatch:
            nonlocal place, start, length, crc, values
            sizes = np.array([b[0] for b in blocks], np.int64)
            found = decode_blocks([b[4] for b in blocks], sizes, [b[1] for b in blocks], blocks[0][2])
            out, lists, at = [], [], 0
            for _, _, _, pieces, _ in blocks:
                for key, size, ends in pieces:
                    own = found[at:at + size]
                    at += size
                    crc, length = checksum(own, crc), length + size
                    if ids:
                        values.append(own)
                    if ends:
                        out.append((part, start, key, length, crc))
                        if ids:
                            lists.append(np.concatenate(values).astype(np.int32))
                        start, length, crc, values = start + length, 0, 0, []
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            names = ["part", "place", "doc_id", "n_tokens", "ids_crc32"]
            if ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for block in parse_records(data.to_pybytes()):
            group.append(block)
            if len(group) == _TOGETHER:
                yield rows_of(group)
                group = []
        if group:
            yield rows_of(group)
        if length:
            raise ValueError("a file of ids ends within a document")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return files.select(number.alias("part"), "content").mapInArrow(
        run, _READ + (", ids array<int>" if ids else ""))


def with_starts(read: DataFrame) -> DataFrame:
    """``read_ids`` rows with ``start``, the number of ids in all documents before.

    The totals of the files, one row each, are summed up in order; no document moves.
    """
    stored = materialize(read, "id-rows")
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return stored.join(offsets, "part").withColumn("start", F.col("_before") + F.col("place")).drop("_before")
