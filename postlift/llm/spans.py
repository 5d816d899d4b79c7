"""Units and pre-tokens as spans of bytes, and tables that number the distinct ones.

All spans of a batch are cut, hashed and looked up together as arrays; nothing is
done span by span but for those a table meets for the first time.
"""

from __future__ import annotations

import numpy as np

from .textops import mix, spread

#: Bytes of a span that are compared as whole words of 64 bits; longer spans lie in a dictionary.
_WORDS = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ODD_LENGTH = np.uint64(0xA24BAED4963EE407)
_HALF = np.uint64(32)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Growing:
    """An array that is added to at its end; its room doubles."""

    def __init__(self, kind, *row: int):
        self.room, self.size = np.zeros((1024, *row), kind), 0

    @property
    def held(self) -> np.ndarray:
        return self.room[:self.size]

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros((max(end, 2 * len(self.room)), *self.room.shape[1:]), self.room.dtype)
            room[:self.size] = self.held
            self.room = room
        self.room[self.size:end] = values
        self.size = end

    def replace(self, values: np.ndarray) -> None:
        self.room, self.size = np.zeros((1024, *self.room.shape[1:]), self.room.dtype), 0
        self.add(values)


class SpanTable:
    """Numbers for the distinct spans of bytes of a worker, with room for a bounded number.

    Spans are found by their hashes, in slots of which half stay free, and compared
    byte by byte; one that shares its hash with another lies in a dictionary, as the long ones do.
    """

    def __init__(self, limit: int):
        self.limit = limit
        # By number: the hash, bytes, length, how often met, and whether the slots or the dictionary hold it.
        self.hashes, self.words = Growing(np.uint64), [Growing(np.uint64) for _ in range(_WORDS)]
        self.lengths, self.hits, self.slotted = Growing(np.int32), Growing(np.int32), Growing(bool)
        self.others: dict[bytes, int] = {}
        self._deal()

    def _deal(self) -> None:
        """Slots anew, over twice as many as spans."""
        bits = max(16, (2 * self.hashes.size).bit_length())
        self.slots, self.marks = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        held = np.flatnonzero(self.slotted.held)
        self._insert(self.hashes.held[held], held.astype(np.int32))

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot = (hashes >> self.shift).view(np.int64)
        while len(hashes):
            # Of those that find a slot free the last one has it; the others go on to the next.
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            mine = free & (self.slots[slot] == numbers)
            self.marks[slot[mine]] = hashes[mine]
            left = ~mine
            hashes, numbers, slot = hashes[left], numbers[left], slot[left] + 1 & self.last

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the span that has each hash, or -1."""
        slot = (hashes >> self.shift).view(np.int64)
        numbers = self.slots.take(slot)
        left = np.flatnonzero((self.marks.take(slot) != hashes) & (numbers >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.last
            numbers[left] = found = self.slots[slot]
            on = (self.marks[slot] != hashes[left]) & (found >= 0)
            left, slot = left[on], slot[on]
        return numbers

    def shrink(self) -> np.ndarray | None:
        """After the table was full: the old numbers of the spans that stay, those met three times or more."""
        if self.hits.size <= self.limit:
            return None
        stay = self.hits.held >= 3
        if stay.sum() > self.limit // 2:
            stay[:] = False
        kept, place = np.flatnonzero(stay), np.cumsum(stay) - 1
        for column in (self.hashes, *self.words, self.lengths, self.slotted):
            column.replace(column.held[kept])
        self.hits.replace(np.zeros(len(kept), np.int32))
        self.others = {s: int(place[k]) for s, k in self.others.items() if stay[k]}
        self._deal()
        return kept

    def number(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """The number of every span, and which spans are the first of theirs, in order of their numbers."""
        words, hashes = _words_of(data, starts, lengths)
        numbers = self._find(hashes)
        differs = self.lengths.room.take(numbers, mode="clip") != lengths
        differs |= self.words[0].room.take(numbers, mode="clip") != words[0]
        for k in range(1, _WORDS):
            longer = np.flatnonzero(lengths > 8 * k)
            held = self.words[k].room.take(numbers[longer], mode="clip")
            differs[longer] |= held != words[k].take(longer)
        known = numbers >= 0
        beyond = (lengths > 8 * _WORDS) | differs & known
        new = np.flatnonzero(~(known | beyond))
        order = new[np.argsort(hashes[new])]
        head = np.ones(len(order), bool)
        np.not_equal(hashes[order[1:]], hashes[order[:-1]], out=head[1:])
        group, fresh = np.cumsum(head) - 1, order[head]
        same = fresh[group]
        numbers[order] = self.hits.size + group
        differs = lengths[order] != lengths[same]
        for word in words:
            differs |= word.take(order) != word.take(same)
        beyond[order] = differs
        held = np.arange(self.hits.size, self.hits.size + len(fresh), dtype=np.int32)
        self._add(hashes[fresh], words[:, fresh], lengths[fresh], True)
        late = []
        for i in np.flatnonzero(beyond).tolist():
            key = data[starts[i]:starts[i] + lengths[i]].tobytes()
            if key not in self.others:
                self.others[key] = self.hits.size + len(late)
                late.append(i)
            numbers[i] = self.others[key]
        if late:
            self._add(hashes[late], words[:, late], lengths[late], False)
        if 2 * self.hashes.size > len(self.slots):
            self._deal()
        else:
            self._insert(hashes[fresh], held)
        numbers = numbers.astype(np.int64)
        np.add.at(self.hits.room, numbers, np.int32(1))
        return numbers, np.concatenate([fresh, np.array(late, np.int64)])

    def _add(self, hashes: np.ndarray, words: np.ndarray, lengths: np.ndarray, slotted: bool) -> None:
        self.hashes.add(hashes)
        for column, word in zip(self.words, words):
            column.add(word)
        self.lengths.add(lengths)
        self.hits.add(np.zeros(len(hashes), np.int32))
        self.slotted.add(np.full(len(hashes), slotted))


def _words_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of every span as 64-bit words, what lies beyond its end as nought; their hashes."""
    padded = np.zeros(len(data) + 8 * _WORDS, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray((len(data) + 8 * (_WORDS - 1) + 1,), "<u8", padded, strides=(1,))
    words = np.zeros((_WORDS, len(starts)), np.uint64)
    np.bitwise_and(eight[starts], _MASK[np.minimum(lengths, 8)], out=words[0])
    hashes = words[0] * _ODD[0]
    hashes ^= hashes >> _HALF
    longer = np.flatnonzero(lengths > 8)
    for k in range(1, _WORDS):
        found = eight[starts[longer] + 8 * k]
        found &= _MASK[np.minimum(lengths[longer] - 8 * k, 8)]
        words[k, longer] = found
        found *= _ODD[k]
        hashes[longer] += mix(found)
        longer = longer[lengths[longer] > 8 * (k + 1)]
    hashes += lengths.astype(np.uint64)
    hashes *= _ODD_LENGTH
    hashes ^= hashes >> _HALF
    hashes *= _ODD[0]
    return words, hashes


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


_BLANK = _bytes((9, 13), (28, 32))
# Last bytes that blanks beyond ASCII have, too, and first bytes of such blanks.
_BLANK_END = _bytes((0x80, 0x8A), (0x8E, 0x8E), (0x9F, 0x9F), (0xA0, 0xA0), (0xA8, 0xA9), (0xAF, 0xAF))
_PAIR_LEAD, _BLANK_LEAD = _bytes((0xC3, 0xDF)), _bytes((0xE1, 0xE3))


def unit_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the units of UTF-8 texts end to end, and the texts' offsets in them.

    A text is cut before a single space between two characters that are certainly not
    blank, where pre-tokens of the byte-level pattern always part.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < n - 1)]
    before, after = data[at - 1], data[at + 1]
    cut = ~(_BLANK[before] | _BLANK[after] | edge[at + 1])
    odd = np.flatnonzero(_BLANK_END[before] & cut)
    cut[odd] = _PAIR_LEAD[data[np.maximum(at[odd] - 2, 0)]]
    odd = np.flatnonzero((_BLANK_LEAD[after] | (after == 0xC2)) & cut)
    last = at[odd] + 2 + _BLANK_LEAD[after[odd]]
    cut[odd] = ~_BLANK_END[data[np.minimum(last, n - 1)]]
    edge[at[cut]] = True
    starts = np.flatnonzero(edge[:n])
    return starts, np.diff(np.r_[starts, n]), np.searchsorted(starts, offs)


# Kinds of bytes: letters, digits, signs other than the apostrophe, the line feed, a space, and all others.
_LETTER, _DIGIT, _SIGN, _LINE, _SPACE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[_bytes((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))] = _SIGN
_KIND[_bytes((65, 90), (97, 122))] = _LETTER
_KIND[_bytes((48, 57))] = _DIGIT
_KIND[10], _KIND[32] = _LINE, _SPACE


def pretoken_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pattern
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some units' pre-tokens, their starts and lengths, and how many each unit has.

    Runs of letters to U+00FF, digits and signs part by kind; the first space belongs to what follows
    it, and one line feed before another kind stands alone.  Units with anything else go through the pattern.
    """
    data = data[spread(starts, lengths)]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[begins], last[ends - 1] = True, True
    following = np.append(kind[1:], np.uint8(_OTHER))
    following[last] = _SPACE
    apart = following >= _LINE
    hard = (kind == _OTHER) | (kind == _SPACE) & (~first | apart) | (
        kind == _LINE) & ((following == _SPACE) | (following == _LINE))
    odd = np.add.reduceat(hard, begins, dtype=np.int64) > 0 if len(begins) else np.zeros(0, bool)
    cut = first.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    unit = np.repeat(np.arange(len(begins)), lengths)
    at = np.flatnonzero(cut)
    sizes = np.diff(np.append(at, len(data)))
    plain = ~odd[unit[at]]
    at, sizes, unit = at[plain], sizes[plain], unit[at][plain]
    more, more_sizes, more_units = [data.tobytes()], [], []
    for i in np.flatnonzero(odd).tolist():
        for found in pattern.findall(more[0][begins[i]:ends[i]].decode()):
            more.append(found.encode())
            more_sizes.append(len(more[-1]))
            more_units.append(i)
    if more_sizes:
        tail = np.array(more_sizes, np.int64)
        at = np.concatenate([at, len(data) + np.cumsum(tail) - tail])
        sizes, unit = np.concatenate([sizes, tail]), np.concatenate([unit, np.array(more_units, np.int64)])
        order = np.argsort(unit, kind="stable")
        at, sizes, unit = at[order], sizes[order], unit[order]
        data = np.frombuffer(b"".join(more), np.uint8)
    return data, at, sizes, np.bincount(unit, minlength=len(begins))
