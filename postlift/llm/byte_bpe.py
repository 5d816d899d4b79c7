"""Byte-level BPE by a rank queue on a hierarchical bitmap.

A batch of pre-tokens is one doubly linked list of symbols.  Every merge rank owns a
bucket of list positions; a three-level bitmap over the ranks finds the lowest
non-empty bucket by find-first-set.  Entries whose pair has changed meanwhile are
stale and skipped.  The work for a pre-token of n bytes is about n queue entries, so
very long pre-tokens stay cheap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textops import (UnitTable, pieces_of, pretokens, ragged, spread, text_bytes,
                      whole_texts, worker_latest)

_NONE = np.int32(2**31 - 1)
_UNITS = 300_000
#: Text bytes of a piece: each costs a step for every merge that occurs in it.
_PIECE = 6 << 20


class RankQueue:
    """Buckets of positions by rank, with find-first-set over 64-bit words in three levels."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0
        self.bucket: dict[int, list] = {}

    def push(self, rank: int, positions) -> None:
        held = self.bucket.get(rank)
        if held is None:
            self.bucket[rank] = [positions]
            w = rank >> 6
            self.low[w] |= 1 << (rank & 63)
            self.mid[w >> 6] |= 1 << (w & 63)
            self.top |= 1 << (w >> 6)
        else:
            held.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) < 16:
            for r, p in zip(ranks.tolist(), positions.tolist()):
                self.push(r, p)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        heads = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for r, a, b in zip(ranks[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(ranks)]):
            self.push(r, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with entries and its positions in list order."""
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        w = (m << 6) + (self.mid[m] & -self.mid[m]).bit_length() - 1
        rank = (w << 6) + (self.low[w] & -self.low[w]).bit_length() - 1
        self.low[w] &= self.low[w] - 1
        if not self.low[w]:
            self.mid[m] &= self.mid[m] - 1
            if not self.mid[m]:
                self.top &= self.top - 1
        held = self.bucket.pop(rank)
        if len(held) == 1:
            return rank, np.atleast_1d(np.asarray(held[0], np.int64))
        return rank, np.unique(np.concatenate([np.atleast_1d(x) for x in held]).astype(np.int64))


class Vocabulary:
    """Token bytes and ranks of a rank file (one base64 token and its rank a line)."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(t): int(r) for t, r in
                 (line.split() for line in rank_file.splitlines() if line)}
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    made.append(rank)
        keys, made = np.array(keys, np.int64), np.array(made, np.int32)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], _NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, flat, and how many each has."""
        data, offs = text_bytes(pa.array(words, pa.large_string()))
        sizes = np.diff(offs)
        sym = self.byte_id[data]
        n = len(sym)
        if not n:
            return np.zeros(0, np.int32), sizes
        after = np.arange(1, n + 1, dtype=np.int32)
        after[np.cumsum(sizes)[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, _NONE)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.ranks(sym[inner], sym[inner + 1])
        ready = inner[pair[inner] != _NONE]
        queue = RankQueue(self.size)
        queue.push_all(pair[ready], ready)
        while (lowest := queue.pop()) is not None:
            rank, at = lowest
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                if chained.any():  # a run of one symbol: merge every other pair from the left
                    place = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[(place - begin) % 2 == 0]
            right = after[at]
            beyond = after[right]
            sym[at] = rank
            after[at] = beyond
            alive[right] = False
            pair[right] = _NONE
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            prior = before[at]
            changed = np.concatenate([at, prior[prior >= 0]])
            follow = after[changed]
            fresh = np.full(len(changed), _NONE)
            has = follow >= 0
            fresh[has] = self.ranks(sym[changed[has]], sym[follow[has]])
            pair[changed] = fresh
            live = fresh != _NONE
            if live.any():
                queue.push_all(fresh[live], changed[live])
        total = np.r_[0, np.cumsum(alive)]
        ends = np.cumsum(sizes)
        return sym[alive], total[ends] - total[ends - sizes]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, flat, and the row offsets."""
        lengths = self.lengths[ids]
        ends = np.r_[0, np.cumsum(lengths)]
        return self.pool[spread(self.starts[ids], lengths)], ends[offs]


class _Encoder:
    """A worker's table from units to ids."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocab, self.units = Vocabulary(rank_file, pattern), UnitTable(_UNITS)
        self.ids, self.starts, self.sizes = (np.zeros(0, np.int32), np.zeros(0, np.int64),
                                             np.zeros(0, np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number, offs, fresh, kept = self.units.number(texts)
        if kept is not None:
            sizes = self.sizes[kept]
            self.ids = self.ids[spread(self.starts[kept], sizes)]
            self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        if fresh:
            words, flat, parts = pretokens(fresh, self.vocab.pattern)
            ids, sizes = self.vocab.encode(words)
            begins, own = (np.cumsum(sizes) - sizes)[flat], sizes[flat]
            bounds = np.r_[0, np.cumsum(own)][np.r_[0, np.cumsum(parts)]]
            self.starts = np.concatenate([self.starts, len(self.ids) + bounds[:-1]])
            self.sizes = np.concatenate([self.sizes, np.diff(bounds)])
            self.ids = np.concatenate([self.ids, ids[spread(begins, own)]])
        sizes = self.sizes[number]
        row_ends = np.r_[0, np.cumsum(sizes)][offs]
        return self.ids[spread(self.starts[number], sizes)], row_ends


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str,
                     decoded: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row's whole text; with ``decoded`` also the bytes the ids give back.

    ``rank_file`` is read once on the driver and shipped with the code.  The ids
    equal those of the ordinary encoding (no special tokens).  A null or empty text
    has no ids; a null ``doc_id`` and repeated rows pass through; an empty table
    gives no rows; other columns are ignored.  No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_latest(("byte bpe", hash(rank_file), pattern),
                                lambda: _Encoder(rank_file, pattern))
        for piece in pieces_of(batches, limit=_PIECE):
            ids, offs = encoder.encode(piece.column("text").to_pylist())
            out = [piece.column("doc_id"), ragged(pa.array(ids), offs)]
            names = ["doc_id", "ids"]
            if decoded:
                out.append(_binary(*encoder.vocab.decode(ids, offs)))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(out, names=names)

    texts = whole_texts(docs)
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    return texts.mapInArrow(run, schema + (f", {decoded} binary" if decoded else ""))


def decode_documents(encoded: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """(doc_id, text) from ``ids``: their bytes as UTF-8, ill-formed ones replaced.

    A null list of ids gives an empty text; ids outside the vocabulary raise.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = worker_latest(("byte vocab", hash(rank_file), pattern),
                              lambda: Vocabulary(rank_file, pattern))
        for batch in batches:
            texts = [b"".join([vocab.tokens[i] for i in ids or ()]).decode("utf-8", "replace")
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [
        None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
