"""Helpers that several operators share: batches, word hashes, shingles, pre-token units."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: A space between two non-blank characters always parts pre-tokens of the byte-level pattern.
_UNIT_GAP = regex.compile(r"(?<=\S)(?= \S)")

# Odd multipliers of the wrapping polynomial and of the mixing steps (arbitrary constants).
_BASE = 0x9E3779B97F4A7C15
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 1 << 18

#: Rows of a group that is joined by broadcast; there are at most rows / HEAVY such groups.
HEAVY = 100_000


def whole_texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id``, the whole ``text`` (null: empty) and ``extra``; other columns are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """Rows with their group's columns; ``groups`` has one row per key, its row count in ``_rows``.

    Groups of over ``heavy`` rows are so few that they are sent to all tasks; their rows
    never meet in one task.  Rows without a group are left out.
    """
    few = groups.where(F.col("_rows") > heavy)
    rest = rows.join(F.broadcast(few.select(keys)), keys, "left_anti")
    return (rest.join(groups.where(F.col("_rows") <= heavy), keys)
            .unionByName(rows.join(F.broadcast(few), keys))).drop("_rows")


def worker_cache(key, build: Callable):
    """``build()`` once per Python worker; later tasks of the same worker reuse it."""
    store = sys.modules.setdefault("_postlift_worker", types.ModuleType("_postlift_worker")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def worker_latest(key, build: Callable):
    """As ``worker_cache`` for large tables: a worker holds only the one used last."""
    held = worker_cache("latest", dict)
    if key not in held:
        leave_nothing()
        held[key] = build()
    return held[key]


def leave_nothing() -> None:
    """Drop the large table that another operator has left in this worker, and what else is free in it."""
    worker_cache("latest", dict).clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system; a worker, kept for later tasks, else holds the most it ever used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = worker_cache("trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim is not None:  # the C library of other systems has none
        trim(0)


def filled(column: pa.Array) -> pa.Array:
    """A string column with its nulls as empty texts."""
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and its row offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offs = offs[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def pieces_of(batches: Iterator[pa.RecordBatch], column: str = "text",
              limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about ``limit`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser; one to one)."""
    v = values ^ (values >> np.uint64(30))
    v *= _MIX_A
    v ^= v >> np.uint64(27)
    v *= _MIX_B
    v ^= v >> np.uint64(31)
    return v


def _tables():
    """Byte classes, powers of the base and of its inverse for one step of text."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return lower, blank, _powers(_BASE, _STEP), _powers(pow(_BASE, -1, 1 << 64), _STEP)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**n modulo 2**64, by doubling."""
    out = np.ones(n + 1, np.uint64)
    have = 1
    while have <= n:
        take = min(have, n + 1 - have)
        out[have:have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def _hash_span(data: np.ndarray, is_start: np.ndarray, is_end: np.ndarray, tables, first: int,
               widths: tuple[int, ...]):
    """Hashes of the words (and word beginnings) of one stretch that begins and ends between words."""
    lower, _, power, inverse = tables
    n = len(data)
    if n >= len(power):  # one word longer than a step: tables for this stretch alone
        power, inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    sums = np.zeros(n + 1, np.uint64)
    terms = lower[data].astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[:n]
    np.cumsum(terms, out=sums[1:])
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
    back, size = inverse[starts], ends - starts
    h = mix((sums[ends] - sums[starts]) * back + size.astype(np.uint64))
    begun = []
    for width in widths:
        longer = np.flatnonzero(size > width)
        cut = (sums[starts[longer] + width] - sums[starts[longer]]) * back[longer]
        begun.append((mix(cut + np.uint64((width << 32) + width)), starts[longer] + first))
    return h, starts + first, begun


def word_hashes(data: np.ndarray, offs: np.ndarray, widths: tuple[int, ...] = ()):
    """64-bit hash and row of every word, in text order.

    With ``widths`` a third result holds, per width, hash and row of the first bytes
    of every longer word.

    Words are runs without blanks (space and the five ASCII controls from tab to
    carriage return), A-Z lower-cased.  Long rows are hashed in steps cut between
    words, so scratch memory does not grow with a text.
    """
    tables = worker_cache("word tables", _tables)
    n = len(data)
    blank = tables[1][data]
    is_start, is_end = ~blank, ~blank
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    if n:
        is_start[1:] &= blank[:-1] | edge[1:-1]
        is_end[:-1] &= blank[1:] | edge[1:-1]
    hashes, starts, begun, at = [], [], [[] for _ in widths], 0
    while at < n:
        stop = min(n, at + _STEP)
        if stop < n:
            inside = is_end[at:stop]
            back = int(inside[::-1].argmax()) if inside.any() else -1
            if back >= 0:
                stop -= back
            else:
                ahead = is_end[stop:]
                stop = stop + int(ahead.argmax()) + 1 if ahead.any() else n
        h, s, b = _hash_span(data[at:stop], is_start[at:stop], is_end[at:stop], tables, at, widths)
        hashes.append(h)
        starts.append(s)
        for have, more in zip(begun, b):
            have.append(more)
        at = stop
    def rows(start):
        return np.searchsorted(offs, start, "right") - 1

    if not hashes:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return (*none, [none for _ in widths]) if widths else none
    words = np.concatenate(hashes), rows(np.concatenate(starts))
    if not widths:
        return words
    joined = [[np.concatenate(x) for x in zip(*parts)] for parts in begun]
    return (*words, [(h, rows(s)) for h, s in joined])


def shingle_hashes(words: np.ndarray, row: np.ndarray, width: int = 5
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words, rows in order.

    A row with fewer words gives its whole sequence as one shingle; a row
    without words gives none.
    """
    n = len(words)
    if not n:
        return words, row
    odd = _powers(_BASE, width)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        whole += words[k:k + len(whole)] * odd[k]
    same = row[:len(whole)] == row[width - 1:width - 1 + len(whole)]
    rows, first, count = np.unique(row, return_index=True, return_counts=True)
    short = count < width
    extra = np.zeros(int(short.sum()), np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        extra[has] += words[first[short][has] + k] * odd[k]
    extra += count[short].astype(np.uint64)
    h = np.concatenate([whole[same], extra])
    r = np.concatenate([row[:len(whole)][same], rows[short]])
    if len(extra):
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return mix(h), r


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each of ``rows`` rows in a sorted row index."""
    return np.searchsorted(row, np.arange(rows + 1))


def distinct_per_row(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every row, flat, and the row offsets."""
    bounds = row_bounds(row, rows)
    parts, sizes = [], np.zeros(rows, np.int64)
    for i in np.flatnonzero(np.diff(bounds)):
        own = np.sort(h[bounds[i]:bounds[i + 1]])
        if len(own) > 1:
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        parts.append(own)
        sizes[i] = len(own)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def ragged(values: pa.Array, offs: np.ndarray) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, … for every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class _Units(dict):
    """Numbers of the units that follow a single space, given out on first sight."""

    def __init__(self):
        super().__init__()
        self.fresh, self.base = [], 0

    def __missing__(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _OddBlanks
        self.fresh.append(" " + word)
        number = self[word] = self.base + len(self.fresh) - 1
        return number


class _OddBlanks(Exception):
    """A text in which some space touches another blank."""


class UnitTable:
    """Numbers for the distinct units of a worker, with room for a bounded number.

    Units are stretches of text cut where pre-tokens certainly part: at a single
    space between two non-blank characters.  ``number`` returns the unit numbers
    of all texts in a row, the row offsets, the units seen for the first time
    (their numbers follow on each other) and, after the table was full, the old
    numbers of the units that stay: those met three times or more.
    """

    def __init__(self, limit: int):
        self.limit, self.after_space, self.other = limit, _Units(), {}
        self.hits = np.zeros(0, np.int64)

    def _shrink(self) -> np.ndarray | None:
        if len(self.hits) <= self.limit:
            return None
        stay = self.hits >= 3
        if stay.sum() > self.limit // 2:
            stay[:] = False
        place = np.cumsum(stay) - 1
        keep, place = stay.tolist(), place.tolist()
        spaced = _Units()
        spaced.update((u, place[k]) for u, k in self.after_space.items() if keep[k])
        self.other = {u: place[k] for u, k in self.other.items() if keep[k]}
        self.after_space, self.hits = spaced, np.zeros(int(stay.sum()), np.int64)
        return np.flatnonzero(stay)

    def number(self, texts: list[str]
               ) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray | None]:
        kept = self._shrink()
        spaced = self.after_space
        spaced.fresh, spaced.base = [], len(self.hits)
        parts, offs = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            first, *rest = text.split(" ")
            try:
                if first and first[-1].isspace():
                    raise _OddBlanks
                numbers = np.fromiter(map(spaced.__getitem__, rest), np.int64, len(rest))
                if first:
                    numbers = np.append(self._other(first), numbers)
            except _OddBlanks:
                numbers = np.array([self._other(u) for u in _UNIT_GAP.split(text)], np.int64)
            parts.append(numbers)
            offs[i + 1] = len(numbers)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        met = np.bincount(flat, minlength=spaced.base + len(spaced.fresh))
        met[:len(self.hits)] += self.hits
        self.hits = met
        return flat, np.cumsum(offs), spaced.fresh, kept

    def _other(self, unit: str) -> int:
        number = self.other.get(unit)
        if number is None:
            spaced = self.after_space
            spaced.fresh.append(unit)
            number = self.other[unit] = spaced.base + len(spaced.fresh) - 1
        return number


def pretokens(units: list[str], pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of some units; the pre-token numbers of all units; their counts.

    A unit of letters alone is one pre-token by the pattern, and so are the
    letters before one closing point or comma; the others go through it.
    """
    index: dict[str, int] = {}
    flat, sizes = [], []
    for unit in units:
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha():
            found = (unit,)
        elif body[-1:] in (".", ",") and body[:-1].isalpha():
            found = (unit[:-1], unit[-1])
        else:
            found = pattern.findall(unit)
        sizes.append(len(found))
        for p in found:
            flat.append(index.setdefault(p, len(index)))
    return list(index), np.array(flat, np.int64), np.array(sizes, np.int64)
