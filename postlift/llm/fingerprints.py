"""Document fingerprints from prefix polynomial hashes.

For one text, ``prefix[i]`` is the sum of code[j] * base**j over j < i modulo the
prime 2**31 - 1.  A span's hash is a difference of two prefixes times a power of
the inverse base, so any two spans compare in constant time, and the longest common
extension of two places is found by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import leave_nothing, pieces_of, whole_texts, worker_cache

PRIME = 2**31 - 1
BASES = (911_382_323, 972_663_749)
SPAN = 24
SLOTS = 64
_EMPTY = 0xFFFF
#: Rows of one range of ids, and the most ranges (their bounds are held on the driver).
RANGE_ROWS, MOST_RANGES = 1_000, 8_192


_P, _FOLD = np.uint64(PRIME), np.uint64(31)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier that spreads a hash over 64 bits


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number equal to x modulo 2**31 - 1 (a power of two reduces to a shift)."""
    high = x >> _FOLD
    x &= _P
    x += high
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x < 2**63, in place."""
    x = _fold(_fold(_fold(x)))
    x[x == _P] = 0
    return x


class Powers:
    """Powers of a base and of its inverse, grown by doubling as texts get longer."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) <= n:
            have = len(self.up)
            self.up = np.concatenate([self.up, _residue(
                self.up * np.uint64(pow(self.base, have, PRIME)))])
            self.down = np.concatenate([self.down, _residue(
                self.down * np.uint64(pow(self.inverse, have, PRIME)))])
        return self.up, self.down


class PrefixHashes:
    """Prefix hashes of a text's code points for one base; sums stay exact, residues come late."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        n = len(codes)
        self.up, self.down = powers.upto(n)
        terms = codes * self.up[:n]
        if n and int(codes.max()) * n >= 1 << 32:  # else the sum of products is below 2**63
            terms = _residue(terms)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def span(self, start: int, end: int) -> int:
        return (int(self.sums[end]) - int(self.sums[start])) * int(self.down[start]) % PRIME

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width."""
        gaps = self.sums[width:] - self.sums[:len(self.sums) - width]
        return _residue(_fold(_fold(gaps)) * self.down[:len(gaps)])


class HashedText:
    """A text under both bases: span equality, longest common extension, fingerprint."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes += np.uint64(1)
        self.size = len(codes)
        self.hashes = [PrefixHashes(codes, p) for p in worker_cache(
            "fingerprint powers", lambda: [Powers(b) for b in BASES])]
        self.values = _slot_values(self.hashes[0].runs(SPAN)) if self.size >= SPAN else None

    def __len__(self) -> int:
        return self.size

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Equal for equal spans, in any texts."""
        return (end - start, *[h.span(start, end) for h in self.hashes])

    def common_extension(self, start: int, other: "HashedText", other_start: int,
                         most: int | None = None) -> int:
        """Length of the longest equal spans from two places on, by binary search."""
        low, high = 0, min(len(self) - start, len(other) - other_start)
        high = high if most is None else min(high, most)
        while low < high:
            half = (low + high + 1) // 2
            if self.span(start, start + half) == other.span(other_start, other_start + half):
                low = half
            else:
                high = half - 1
        return low

    def fingerprint(self) -> str:
        """Length, whole hashes, and the least span hash of each slot, in hex.

        The spans are all runs of ``SPAN`` code points (a shorter text is one run);
        a slot nobody falls in keeps ``ffff``.
        """
        whole = self.span(0, len(self))
        return _printed(whole, self.values if self.values is not None else _short(whole))

    def joined(self, keep: int, other: "HashedText", taken: int, seam: str) -> str:
        """Fingerprint of the first ``keep`` code points followed by ``taken`` of the other text.

        Everything comes from the two prefix arrays but the spans across the seam:
        ``seam`` holds the SPAN - 1 code points (or all) on either side of it.
        """
        n = keep + taken
        whole = (n, *[(a.span(0, keep) + b.span(0, taken) * int(a.up[keep])) % PRIME
                      for a, b in zip(self.hashes, other.hashes)])
        if n < SPAN:
            return _printed(whole, _short(whole))
        parts = [t.values[:size - SPAN + 1] for t, size in ((self, keep), (other, taken))
                 if size >= SPAN]
        if len(seam) >= SPAN:
            parts.append(HashedText(seam).values)
        return _printed(whole, np.concatenate(parts))


def _slot_values(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _SPREAD) >> np.uint64(32)).astype(np.uint32)


def _short(whole: tuple[int, ...]) -> np.ndarray:
    """The one span of a text shorter than SPAN, none of an empty text."""
    return _slot_values(np.array(whole[1:2] if whole[0] else [], np.uint64))


def _printed(whole: tuple[int, ...], values: np.ndarray) -> str:
    slots = np.full(SLOTS, _EMPTY, np.uint16)
    v = np.sort(values)
    at = np.searchsorted(v, np.arange(SLOTS, dtype=np.uint32) << np.uint32(26))
    if len(v):
        first = v[np.minimum(at, len(v) - 1)]
        has = (at < len(v)) & (first >> np.uint32(26) == np.arange(SLOTS))
        slots[has] = np.minimum((first[has] >> np.uint32(10)) & np.uint32(0xFFFF), _EMPTY - 1)
    return "".join(f"{w:08x}" for w in whole) + slots.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of slots alike among those either text fills: about the Jaccard of their spans."""
    x, y = (np.frombuffer(bytes.fromhex(f[24:]), ">u2") for f in (a, b))
    filled = (x != _EMPTY) | (y != _EMPTY)
    if not filled.any():
        return 1.0
    return float((x == y)[filled].sum() / filled.sum())


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _ranged(docs: DataFrame) -> DataFrame:
    """Rows with their range of ids (``_range``) plus, per range, the head of the next one.

    Range bounds are quantiles of the ids and, like the first id of every range, at
    most ``MOST_RANGES`` numbers on the driver; the last range gets the very first
    document as its tail.
    """
    texts = whole_texts(docs).where("doc_id is not null")
    ids = texts.select("doc_id")
    ranges = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] if shares else []
    bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def place(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(), "left"))

    firsts = sorted(tuple(r) for r in ids.groupBy(place("doc_id")).min("doc_id").collect())
    following = [(firsts[(i + 1) % len(firsts)][1], r) for i, (r, _) in enumerate(firsts)]
    kind = texts.schema["doc_id"].dataType.simpleString()
    heads = docs.sparkSession.createDataFrame(following, f"doc_id {kind}, _range int")
    tails = texts.join(F.broadcast(heads), "doc_id").withColumn("_tail", F.lit(True))
    return (texts.withColumn("_range", place("doc_id")).withColumn("_tail", F.lit(False))
            .unionByName(tails))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses.

    The next document is the one with the next ``doc_id`` (ties by text; after the
    last comes the first).  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and the longest common extensions
    at the start of the text with its edited text and with the next document.

    A null text is empty; two empty texts are alike (1.0), an empty and a filled one
    not (0.0).  A single document is its own next.  Repeated rows are documents of
    their own; rows without ``doc_id`` have no place in the order and are left out;
    an empty table gives no rows; other columns are ignored.
    """
    ranged = _ranged(docs)
    kind = ranged.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        held = None
        for batch in batches:
            for piece in pieces_of(iter([batch]), limit=6 << 20):
                out = []
                for doc_id, text, tail, ran in zip(*(piece.column(c).to_pylist() for c in (
                        "doc_id", "text", "_tail", "_range"))):
                    hashed = HashedText(text)
                    print_ = hashed.fingerprint()
                    if held is not None and held[4] == ran:
                        out.append(_row(held, (doc_id, text, hashed, print_)))
                    held = None if tail else (doc_id, text, hashed, print_, ran)
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA(kind))

    ordered = ranged.repartition("_range").sortWithinPartitions("_range", "_tail", "doc_id", "text")
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, "
                              "fingerprint string, edited_fingerprint string, near_edited double, "
                              "near_next double, common_edited long, common_next long")


def _row(own, following) -> dict:
    doc_id, text, hashed, print_, _ = own
    _, next_text, next_hashed, next_print = following
    half = min(len(text) // 2, len(next_text))
    keep = len(text) - len(text) // 2
    seam = text[max(0, keep - SPAN + 1):keep] + next_text[:min(half, SPAN - 1)]
    other_print = hashed.joined(keep, next_hashed, half, seam)
    return {"doc_id": doc_id, "n_chars": len(text),
            "edited_sha256": hashlib.sha256(edited(text, next_text).encode()).hexdigest(),
            "fingerprint": print_, "edited_fingerprint": other_print,
            "near_edited": likeness(print_, other_print), "near_next": likeness(print_, next_print),
            "common_edited": keep + hashed.common_extension(keep, next_hashed, 0, half),
            "common_next": hashed.common_extension(0, next_hashed, 0)}


def _SCHEMA(kind: str) -> pa.Schema:
    ids = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    return pa.schema([("doc_id", ids), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                      ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                      ("near_edited", pa.float64()), ("near_next", pa.float64()),
                      ("common_edited", pa.int64()), ("common_next", pa.int64())])
