"""Token counts under a byte-level BPE vocabulary, by rank-synchronous array merging.

All pre-tokens of a batch lie in one ragged array of symbols.  In every round each
sequence takes its own lowest-ranked adjacent pair and merges all places of it at
once; sequences without a mergeable pair leave with the number of symbols left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .textops import (UnitTable, pieces_of, pretokens, text_bytes, whole_texts,
                      worker_latest)

_NEVER = np.int64(1) << 40
_UNITS = 300_000


class MergeTable:
    """Byte symbols, merge ranks and special strings of a tokenizer description."""

    def __init__(self, description: bytes, pattern: str):
        spec = json.loads(description)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made
        self.byte_symbol = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.pattern = regex.compile(pattern)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = (regex.compile("|".join(map(regex.escape, sorted(
            self.special, key=len, reverse=True)))) if self.special else None)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NEVER)

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of every pre-token after all merges."""
        data, offs = text_bytes(pa.array(words, pa.large_string()))
        left = np.diff(offs)
        seq = np.repeat(np.arange(len(left)), left)
        sym = self.byte_symbol[data]
        pair = np.full(len(sym), _NEVER)
        self._refresh(sym, seq, pair, np.arange(len(sym)))
        while len(sym):
            heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            runs = np.diff(np.r_[heads, len(seq)])
            lowest = np.minimum.reduceat(pair, heads)
            left[seq[heads]] = runs
            going = lowest < _NEVER
            if not going.any():
                break
            if not going.all():
                stay = np.repeat(going, runs)
                sym, seq, pair = sym[stay], seq[stay], pair[stay]
                lowest, runs = lowest[going], runs[going]
            at = np.flatnonzero(pair == np.repeat(lowest, runs))
            at = at[_leftmost(at)]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            sym, seq, pair = sym[keep], seq[keep], pair[keep]
            touched = np.zeros(len(sym), bool)
            touched[moved] = True
            touched[np.maximum(moved - 1, 0)] = True
            self._refresh(sym, seq, pair, np.flatnonzero(touched))
        return left

    def _refresh(self, sym, seq, pair, at):
        """Ranks of the pairs that begin at the given places."""
        if not len(sym):
            return
        inner = at[at < len(sym) - 1]
        inner = inner[seq[inner] == seq[inner + 1]]
        pair[at] = _NEVER
        pair[inner] = self.ranks(sym[inner], sym[inner + 1])


def _leftmost(at: np.ndarray) -> np.ndarray:
    """Which of the sorted places to merge when neighbours overlap: every other, from the left."""
    touching = np.r_[False, np.diff(at) == 1]
    begin = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
    return (np.arange(len(at)) - begin) % 2 == 0


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the letters from
    U+0100 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class _Counter:
    """A worker's table from units to token counts."""

    def __init__(self, description: bytes, pattern: str):
        self.table, self.units = MergeTable(description, pattern), UnitTable(_UNITS)
        self.known = np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        table, specials = self.table, np.zeros(len(texts), np.int64)
        plain, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            if table.cut and any(s in text for s in table.special):
                parts = table.cut.split(text)
                specials[i] = len(parts) - 1
            plain += parts
            owner += [i] * len(parts)
        number, offs, fresh, kept = self.units.number(plain)
        if kept is not None:
            self.known = self.known[kept]
        if fresh:
            words, flat, sizes = pretokens(fresh, table.pattern)
            total = np.r_[0, np.cumsum(table.counts(words)[flat])]
            ends = np.cumsum(sizes)
            self.known = np.concatenate([self.known, total[ends] - total[ends - sizes]])
        summed = np.r_[0, np.cumsum(self.known[number])]
        np.add.at(specials, np.array(owner, np.int64), summed[offs[1:]] - summed[offs[:-1]])
        return specials


def count_tokens(docs: DataFrame, description: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row's whole text.

    ``description`` is the tokenizer's JSON (a fixed vocabulary, read once on the
    driver and shipped with the code).  Special strings inside a text count as one
    token each, as the library takes them by default.  A null or empty text has 0
    bytes and 0 tokens; a null ``doc_id`` and repeated rows pass through as they
    are; an empty table gives no rows; other columns are ignored.  No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_latest(("token counts", hash(description), pattern),
                                lambda: _Counter(description, pattern))
        for piece in pieces_of(batches, limit=6 << 20):
            tokens = counter.count(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("n_bytes"), pa.array(tokens)],
                names=["doc_id", "n_bytes", "n_tokens"])

    texts = whole_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
