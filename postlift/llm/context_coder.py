"""Adaptive range coding of token ids under mixed predictions of order 0, 1 and 2.

A block of ids starts without knowledge and learns as it goes, so it can be read alone.
For each id the model forms a candidate: what followed the last two ids before, or, where
that context is new, the last id.  Whether the candidate comes is one binary decision
whose probability mixes three estimates in the logistic domain: by the order-2 context's
record, by the order-1 context's record and its agreement, and by the recent hits alone
(order 0).  The contexts adapt after every id, the weights of the mixture and the estimates
after every few.  An id that does not come as the candidate is coded by its order-0 frequency
among such ids so far, and one without a frequency yet by its bits.

A block is cut into segments of at most ``SEGMENT`` ids, each with a coder of its own, that
learn together: they share the block's tables.  All segments of many blocks (lanes) advance
side by side, one id of each at a time, so every step is a handful of array operations over
thousands of lanes, while the tables are those of some tens of blocks; all arithmetic is on
integers, which wrap where they go over, so readers repeat it exactly.  Words have 32 bits: at
most one leaves or enters at a time.  A coded block is how many words each segment has (8 bits
each, filled up to a whole word; a segment has less than two an id), then the segments' words.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

from .textops import spread

#: Ids of a block, and of a segment at most; segments that advance together, and their blocks' table entries by id.
BLOCK, SEGMENT = 8192, 64
LANES, LANE_ENTRIES = 8192, 1 << 26

_T_BITS = 14  # total of the order-0 frequencies
_T, _ESCAPE = 1 << _T_BITS, 48
_H1, _H2 = 11, 13  # bits of the order-1 and order-2 context tables
_CONTEXTS = (1 << _H1) + (1 << _H2)
_LAST, _PAIR, _BEFORE = np.uint32(2_654_435_761), np.uint32(2_246_822_519), np.uint32(3_266_489_917)
_LEAST = np.uint64(1 << 32)  # a shorter span takes in the next word
_WORD, _HALF, _TWELVE, _T_SHIFT = np.uint64(32), np.uint64(16), np.uint64(12), np.uint64(_T_BITS)
_LOWER = np.uint64(0xFFFF)
#: Steps before which the ranges, and the weights and estimates, are made anew.
_REBUILDS = frozenset([1, 3, 8, 24])
_RENEWAL = 8
_RENEWALS = frozenset([1, 2, 4, *range(_RENEWAL, SEGMENT, _RENEWAL)])
_LIMIT = 1 << 18  # bound of a weight, which has 16 binary places
_RATE, _MOST_SEEN = 3, 1023
# A block's records: 32 of order 1; of order 2 (16) and order 0 (8) every pair, as they are looked up together.
_CELLS, _ORDER_1, _ORDER_2, _ORDER_0 = 160, 32, 16, 8


def _squash_table() -> np.ndarray:
    """Probability of 4,096, within 32 … 4064, for every log-odds of -2048 … 2047 (256 to one nat)."""
    return np.array([min(4064, max(32, round(4096 / (1 + math.exp(-x / 256)))))
                     for x in range(-2048, 2048)], np.int32)


def _stretch_table() -> np.ndarray:
    """Log-odds of every probability of 4,096."""
    return np.array([min(2047, max(-2047, round(256 * math.log((p + 0.5) / (4095.5 - p)))))
                     for p in range(4096)], np.int32)


_SQUASH, _STRETCH = _squash_table().astype(np.uint64), _stretch_table().astype(np.int64)
_CHANCE = _SQUASH + 2.0**42  # with one decision, for the sums by records
#: How a context's entry changes, by how often its id came in a row, 16 more where another came: a right
#: guess adds one, a wrong one halves; at nought the new id moves in.
_CHANGE = np.array([*[1] * 15, 0, *((held >> 1) - held for held in range(16))], np.int64).astype(np.uint32)
#: Nought where the new id moves in, else one.
_STAYS = np.array([1] * 18 + [1] * 14, np.uint32)
_STAYS[16:18] = 0
_ONE, _FOUR, _FIFTEEN = np.uint32(1), np.uint32(4), np.uint32(15)


class _Lanes:
    """Model and coder state of segments that advance together, the longest first.

    ``block`` is the block of every lane, each its own if not given; ``most`` the ids of the longest;
    ``kinds`` how many names ids may have in the symbol table.  Arrays in ``kept`` are used again.
    """

    def __init__(self, lanes: int, id_bits: int, longest: int, block: np.ndarray | None = None,
                 most: int | None = None, kinds: int | None = None, kept: dict | None = None):
        self.kept = {} if kept is None else kept
        self.block = block = np.arange(lanes) if block is None else block
        blocks, kinds = int(block.max(initial=-1)) + 1, 1 << id_bits if kinds is None else kinds
        self.id_bits, self.width = np.uint64(id_bits), (longest if most is None else most) + 1
        # Contexts of a block: those of order 1, then those of order 2.
        self.at_context = block * _CONTEXTS + np.array([[0], [1 << _H1]])
        self.at_id, self.at_symbol, self.at_slot = block * kinds, block * self.width, block << _T_BITS
        self.at_cell = block * _CELLS + np.array([[0], [_ORDER_1]])
        # A context's entry: the id that came last, and in four bits how often in a row.
        self.follows = self.zeros("follows", blocks * _CONTEXTS, np.uint32)
        # How often a record was met, how often the candidate came then, and what follows from it.
        self.cells = blocks * _CELLS
        self.seen, self.came = np.zeros((2, blocks, _ORDER_1 + _ORDER_2 + _ORDER_0), np.int64)
        self.weight = np.full((blocks, 3), 26_000, np.int64)
        # Records, probabilities and hits of the steps since these were made; lanes that have ended share a cell.
        self.records = self.zeros("records", 2 * _RENEWAL * lanes, np.int64, False).reshape(2, _RENEWAL, lanes)
        self.chance = self.zeros("chance", _RENEWAL * lanes, np.float64, False).reshape(_RENEWAL, lanes)
        self.hits = self.zeros("hits", _RENEWAL * lanes, bool, False).reshape(_RENEWAL, lanes)
        self.kept_steps = 0
        self.estimate()
        self.symbol = self.zeros("symbol", blocks * kinds, np.uint16)
        self.id_of = self.zeros("id_of", blocks * self.width, np.uint32)
        # Symbols met since the ranges were made, step by step, and how often they came before that.
        self.met: list[np.ndarray] = []
        self.count = self.zeros("count", blocks * self.width, np.int32)
        # Of a symbol, 16 bits each from the lowest: how long its range is, and where it begins; nought if it has
        # none.  A reader has its id above them.  Symbol 0 is the escape, whose range comes first.
        self.first_symbols = np.arange(blocks) * self.width
        self.ranges = self.zeros("ranges", blocks * self.width, np.uint64)
        self.ranges[self.first_symbols] = _T
        self.symbols = np.zeros(blocks, np.int64)
        self.kinds, self.total = np.zeros((2, blocks, 1), np.int32)
        self.span = np.full(lanes, 2**64 - 1, np.uint64)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.recent = np.zeros(lanes, np.uint32)
        self.pos = np.zeros(lanes, np.int64)
        self.place = np.zeros((2, lanes), np.int64)

    #: Whether symbols must give back ids.
    named = True

    def zeros(self, name: str, n: int, kind, clean: bool = True) -> np.ndarray:
        """An array of nought (``clean``) or of anything, in memory used before if there is enough."""
        held = self.kept.get(name)
        if held is None or len(held) < n:
            self.kept[name] = held = np.zeros(n, kind)
        elif clean:
            held[:n] = 0
        return held[:n]

    def estimate(self) -> None:
        """Log-odds of every record, and the records' weighted terms in the mixture."""
        self.odds = _STRETCH.take((2 * self.came + 1 << 12) // (2 * self.seen + 2))
        weight = np.repeat(self.weight, [_ORDER_1, _ORDER_2, _ORDER_0], axis=1)
        term = (weight * self.odds + 32_768) >> 16
        pairs = term[:, _ORDER_1:-_ORDER_0, None] + term[:, None, -_ORDER_0:] + 2048  # where the squash table has nought
        self.term = np.concatenate([term[:, :_ORDER_1], pairs.reshape(len(term), -1)], axis=1).ravel()

    def renew(self) -> None:
        """Weights and estimates from the decisions since the last time."""
        k, self.kept_steps = self.kept_steps, 0
        # Three sums in one: decisions, candidates that came, and their probabilities.
        value = self.hits[:k] * 2.0**26
        value += self.chance[:k]
        value = value.ravel()
        sums = sum(np.bincount(r[:k].ravel(), value, self.cells + 1) for r in self.records)[:-1].astype(np.int64)
        sums = sums.reshape(-1, _CELLS)
        pairs = sums[:, _ORDER_1:].reshape(-1, _ORDER_2, _ORDER_0)
        sums = np.concatenate([sums[:, :_ORDER_1], pairs.sum(2), pairs.sum(1)], axis=1)
        came = sums >> 26 & 0xFFFF
        wrong = (came << 12) - (sums & (1 << 26) - 1)
        slope = np.add.reduceat(self.odds * wrong, [0, _ORDER_1, _ORDER_1 + _ORDER_2], axis=1)
        self.weight += slope * _RATE >> 16
        np.clip(self.weight, -_LIMIT, _LIMIT, out=self.weight)
        self.seen += sums >> 42
        self.came += came
        many = (self.seen > _MOST_SEEN).astype(np.int64)
        self.seen >>= many
        self.came >>= many
        self.estimate()

    def predict(self, m: int):
        """Candidates, their probabilities, and what the update needs."""
        last, place = self.last[:m], self.place[:, :m]
        np.add(self.at_context[0, :m], last * _LAST >> np.uint32(32 - _H1), out=place[0])
        np.add(self.at_context[1, :m], last * _PAIR + self.before[:m] >> np.uint32(32 - _H2), out=place[1])
        entry = self.follows.take(place)
        held, guess = entry & _FIFTEEN, entry >> _FOUR
        # Selections are sums and products: a branch that chance decides costs more.
        candidate = guess[1] - guess[0]
        candidate *= np.minimum(held[1], _ONE)
        candidate += guess[0]
        record = self.records[:, self.kept_steps]
        record[:, m:] = self.cells
        record = record[:, :m]
        agrees = np.minimum(guess[0] ^ candidate, _ONE)
        agrees <<= _FOUR
        agrees += held[0]
        np.add(self.at_cell[0, :m], agrees, out=record[0])
        np.add(self.at_cell[1, :m], (held[1] << np.uint32(3)) + self.recent[:m], out=record[1])
        terms = self.term.take(record)
        mixed = terms[0] + terms[1]
        p = _SQUASH.take(mixed, mode="clip")
        _CHANCE.take(mixed, mode="clip", out=self.chance[self.kept_steps, :m])
        return candidate, p, (entry, held, guess)

    def learn(self, m: int, ids: np.ndarray, hit: np.ndarray, memo) -> None:
        """What lanes of one block change alike in a step is as the last of them leaves it."""
        entry, held, guess = memo
        self.hits[self.kept_steps, :m] = hit
        self.kept_steps += 1
        recent = self.recent[:m]
        recent <<= _ONE
        recent &= np.uint32(7)
        recent |= hit
        other = np.minimum(guess ^ ids, _ONE)
        other <<= _FOUR
        held += other
        entry += _CHANGE.take(held)
        new = (ids << _FOUR) + _ONE
        entry -= new
        entry *= _STAYS.take(held)
        entry += new
        self.follows[self.place[:, :m]] = entry
        np.multiply(self.last[:m], _BEFORE, out=self.before[:m])
        self.last[:m] = ids

    def meet(self, lanes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Symbols of ids that no range foretold: new ones take the block's next symbols.

        An id that is new to several lanes of a block at once has a symbol of each; the last one stays.
        """
        at = self.at_id[lanes] + ids
        symbol = self.symbol.take(at).astype(np.int64)
        fresh = np.flatnonzero(symbol == 0)
        block = self.block[lanes[fresh]]
        order = np.argsort(block, kind="stable")
        fresh, block = fresh[order], block[order]
        first = np.searchsorted(block, block)
        symbol[fresh] = given = self.symbols[block] + 1 + np.arange(len(block)) - first
        self.symbols[block] = given
        self.symbol[at[fresh]] = given
        self.id_of[block * self.width + given] = ids[fresh]
        return self.at_symbol[lanes] + symbol

    def rebuild(self) -> tuple[np.ndarray, int]:
        """Ranges of all symbols met, in proportion; what rounding leaves is the escape's.

        They count the ids that no candidate foretold.  Returns all lengths and how many a block has.
        """
        np.add.at(self.count, np.concatenate(self.met or [self.first_symbols]), np.int32(1))
        self.count[self.first_symbols] = 0
        self.met = []
        width = int(self.symbols.max()) + 1
        count = self.count.reshape(-1, self.width)[:, :width]
        met = count > 0
        kinds, total = met.sum(1, dtype=np.int32)[:, None], np.maximum(count.sum(1, dtype=np.int32), 1)[:, None]
        # The escape comes as often as half of the ids new since the last time say, among those not foretold.
        escape = (_T - _ESCAPE - kinds) * (kinds - self.kinds) // (2 * np.maximum(total - self.total, 1))
        self.kinds, self.total = kinds, total
        share = ((_T - _ESCAPE - kinds - escape) << 14) // total
        freq = (count * share >> 14) + met
        freq[:, 0] = _T - freq[:, 1:].sum(1)
        first = np.cumsum(freq, 1, dtype=np.int32) - freq
        ranges = self.ranges.reshape(-1, self.width)[:, :width]
        ranges[:] = (first << 16) | freq
        if self.named:
            ranges |= self.id_of.reshape(-1, self.width)[:, :width].astype(np.uint64) << _WORD
        ranges *= freq > 0
        return freq, width

    def remember(self, m: int, symbol: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """Symbols to be counted for the next ranges; a foretold id counts as the escape, which has no count."""
        at = self.at_symbol[:m] + symbol * miss
        self.met.append(at)
        return at


class _Writer(_Lanes):
    """The words so far and ``low`` behind them are one number, the lower end of the span."""

    named = False

    def __init__(self, lanes: int, id_bits: int, longest: int, block: np.ndarray | None = None,
                 most: int | None = None, kinds: int | None = None, kept: dict | None = None):
        super().__init__(lanes, id_bits, longest, block, most, kinds, kept)
        self.low = np.zeros(lanes, np.uint64)
        self.room = 2 * longest + 4
        self.words = self.zeros("words", lanes * self.room, np.uint32, False)
        self.pos = np.arange(lanes) * self.room

    def carry(self, lanes: np.ndarray) -> None:
        """Add one to the words of lanes whose ``low`` went over."""
        at = self.pos[lanes] - 1
        while len(at):
            raised = self.words[at] + np.uint32(1)
            self.words[at] = raised
            at = at[raised == 0] - 1

    def settle(self, lanes: np.ndarray) -> None:
        """Move a word on where the span has become short."""
        low, pos = self.low[lanes], self.pos[lanes]
        self.words[pos] = low >> _WORD
        self.pos[lanes] = pos + 1
        self.low[lanes] = low << _WORD
        self.span[lanes] <<= _WORD

    def run(self, steps: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> None:
        """``steps`` holds a row of ids per step, one of each lane; ``names`` every id's name in the symbol table."""
        for t, m in enumerate(_active(sizes, len(steps))):
            if t in _RENEWALS:
                self.renew()
            if t in _REBUILDS:
                self.rebuild()
            now = steps[t, :m]
            name = names.take(now)
            candidate, p, memo = self.predict(m)
            hit = candidate == now
            miss = ~hit
            low, span = self.low[:m], self.span[:m]
            symbol = self.symbol.take(self.at_id[:m] + name)
            at = self.remember(m, symbol, miss)
            ranges = self.ranges.take(at)
            # An id without a range so far takes the escape's, which begins at nought.
            lost = np.flatnonzero(((symbol == 0) | (ranges == 0)) > hit)
            if len(lost):
                ranges[lost] = self.ranges[self.at_symbol[lost]]
            # The candidate has the span's first part; the symbols share the rest.
            bound = (span >> _TWELVE) * p
            share = (span - bound) >> _T_SHIFT
            miss = miss.astype(np.uint64)
            ranges *= miss
            missed = bound * miss
            ahead = share * (ranges >> _HALF)
            ahead += missed
            np.multiply(share, ranges & _LOWER, out=span)
            bound -= missed
            span += bound
            low += ahead
            over = low < ahead
            if over.any():
                self.carry(np.flatnonzero(over))
            self.settle(np.flatnonzero(span < _LEAST))
            if len(lost):
                share = self.span[lost] >> self.id_bits
                ahead = share * now[lost]
                self.low[lost] += ahead
                self.span[lost] = share
                self.carry(lost[self.low[lost] < ahead])
                self.settle(lost[share < _LEAST])
                at[lost] = self.meet(lost, name[lost])
            self.learn(m, now, hit, memo)
        # One word ends a lane: the span holds a number of which only that word is not nought.
        top = self.low + np.uint64(0xFFFFFFFF)
        self.carry(np.flatnonzero(top < self.low))
        self.words[self.pos] = top >> _WORD
        self.pos += 1


class _Reader(_Lanes):
    """``code`` is how far the words lie above the span's lower end."""

    def __init__(self, lanes: int, id_bits: int, longest: int, block: np.ndarray, most: int, kept: dict,
                 words: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        super().__init__(lanes, id_bits, longest, block, most, kept=kept)
        # Two words of nought end each lane; a damaged block is read to its end and found out.
        ends = np.cumsum(lengths + 2)
        self.pos, self.end = ends - lengths - 2, ends - 1
        self.words = np.zeros(int(ends[-1]) if lanes else 0, np.uint32)
        self.words[spread(self.pos, lengths)] = words[spread(starts, lengths)]
        self.code = np.zeros(lanes, np.uint64)
        for _ in range(2):
            self.shift(np.arange(lanes))
        self.slots = self.zeros("slots", (int(block.max(initial=-1)) + 1) << _T_BITS, np.uint16)

    def shift(self, lanes: np.ndarray) -> None:
        pos = self.pos[lanes]
        self.code[lanes] = (self.code[lanes] << _WORD) | self.words.take(pos)
        self.pos[lanes] = np.minimum(pos + 1, self.end[lanes])

    def settle(self, lanes: np.ndarray) -> None:
        """Take in a word where the span has become short."""
        self.shift(lanes)
        self.span[lanes] <<= _WORD

    def run(self, sizes: np.ndarray) -> np.ndarray:
        """A row of ids per step, one of each lane."""
        steps = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.uint32)
        for t, m in enumerate(_active(sizes, len(steps))):
            if t in _RENEWALS:
                self.renew()
            if t in _REBUILDS:
                freq, width = self.rebuild()
                names = np.broadcast_to(np.arange(width, dtype=np.uint16), freq.shape)
                self.slots = np.repeat(names.ravel(), freq.ravel())
            candidate, p, memo = self.predict(m)
            code, span = self.code[:m], self.span[:m]
            bound = (span >> _TWELVE) * p
            hit = code < bound
            miss = ~hit
            rest = code - bound
            share = (span - bound) >> _T_SHIFT
            # Where the candidate came, the slot says nothing.
            slot = np.minimum(rest // share, np.uint64(_T - 1)).view(np.int64)
            slot += self.at_slot[:m]
            symbol = self.slots.take(slot)
            lost = np.flatnonzero((symbol == 0) > hit)
            at = self.remember(m, symbol, miss)
            ranges = self.ranges.take(at)
            miss = miss.astype(np.uint64)
            ranges *= miss
            missed = bound * miss
            code -= missed
            code -= share * (ranges >> _HALF & _LOWER)
            np.multiply(share, ranges & _LOWER, out=span)
            bound -= missed
            span += bound
            self.settle(np.flatnonzero(span < _LEAST))
            now = (ranges >> _WORD).astype(np.uint32)
            now += candidate * hit
            if len(lost):
                share = self.span[lost] >> self.id_bits
                own = np.minimum(self.code[lost] // share, np.uint64((1 << int(self.id_bits)) - 1))
                self.code[lost] -= share * own
                self.span[lost] = share
                self.settle(lost[share < _LEAST])
                now[lost] = own
                at[lost] = self.meet(lost, now[lost])
            self.learn(m, now, hit, memo)
            steps[t, :m] = now
        return steps


def _active(sizes: np.ndarray, steps: int) -> list[int]:
    """How many lanes, the longest first, have an id at every step."""
    return np.searchsorted(-sizes, -np.arange(steps), "left").tolist()


def _grouped(sizes: np.ndarray, id_bits: int):
    """Blocks in groups that advance together: numbers of the blocks, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    most = max(1, min(LANES // max(1, -(-int(sizes.max(initial=0)) // SEGMENT)), LANE_ENTRIES >> id_bits))
    return [order[i:i + most] for i in range(0, len(order), most)]


def _segments(sizes: np.ndarray) -> np.ndarray:
    """How many segments blocks of these sizes have, one at least."""
    return np.maximum(1, -(-sizes // SEGMENT))


class _Cut:
    """Segments of a group's blocks, equal in size up to one id, and the order in which they are lanes."""

    def __init__(self, sizes: np.ndarray):
        self.parts = _segments(sizes)
        block = np.repeat(np.arange(len(sizes)), self.parts)
        self.first = np.cumsum(self.parts) - self.parts
        number = np.arange(len(block)) - self.first[block]
        length = sizes[block] // self.parts[block] + (number < sizes[block] % self.parts[block])
        #: Lanes, the longest first: their segments, blocks and sizes.
        self.order = np.argsort(-length, kind="stable")
        self.block, self.sizes = block[self.order], length[self.order]
        self.longest, self.most = int(length.max(initial=0)), int(sizes.max(initial=0))
        self.length, self.used = length, np.arange(self.longest) < length[:, None]

    def args(self, id_bits: int):
        return len(self.block), id_bits, self.longest, self.block, self.most

    def steps(self, ids: np.ndarray, kept: dict) -> np.ndarray:
        """The group's ids, a row per step and a column per lane."""
        if kept.get("steps") is None or kept["steps"].shape != (self.longest, len(self.length)):
            kept["steps"] = np.zeros((self.longest, len(self.length)), np.uint32)
        kept["steps"][:] = self.rows(ids).T
        return kept["steps"]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """A row per lane; without its ids' copying where all lanes are equally long."""
        if self.length.min(initial=self.longest) == self.longest:
            return ids.reshape(len(self.length), self.longest)
        rows = np.zeros((len(self.length), self.longest), np.uint32)
        rows[self.used] = ids
        return rows[self.order]

    def ids(self, steps: np.ndarray) -> np.ndarray:
        if self.length.min(initial=self.longest) == self.longest:
            return steps.T.ravel()
        rows = np.empty((len(self.length), self.longest), np.uint32)
        rows[self.order] = steps.T
        return rows[self.used]


def checksum(ids: np.ndarray, value: int = 0) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers, continued from ``value``."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"), value)


def encode_blocks(ids: np.ndarray, sizes: np.ndarray, id_bits: int = 16) -> list[bytes]:
    """The coded words of every block; blocks of the given sizes lie end to end in ``ids``.

    Ids must be below 2**id_bits.  An empty block has words, too (the coder's end).
    """
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if len(ids) and (int(ids.max()) >> id_bits or int(ids.min()) < 0):
        raise ValueError("an id does not fit its bits")
    out: list[bytes] = [b""] * len(sizes)
    # Names from 0 on for the ids that occur, so that the symbol tables are small.
    occurs = np.zeros(1 << id_bits, bool)
    occurs[ids] = True
    names = np.cumsum(occurs, dtype=np.uint32) - np.uint32(1)
    kinds, kept = int(occurs.sum()), {}
    for group in _grouped(sizes, id_bits):
        cut = _Cut(sizes[group])
        steps = cut.steps(np.concatenate([ids[offs[g]:offs[g + 1]] for g in group.tolist()]), kept)
        writer = _Writer(*cut.args(id_bits), kinds, kept)
        writer.run(steps, names, cut.sizes)
        # From lanes back to segments, block by block.
        starts, lengths = np.zeros((2, len(cut.order)), np.int64)
        starts[cut.order] = np.arange(len(cut.order)) * writer.room
        lengths[cut.order] = writer.pos
        lengths -= starts
        words = writer.words[spread(starts, lengths)].astype("<u4", copy=False)
        ends, listed = np.r_[0, np.cumsum(lengths)], lengths.astype(np.uint8)
        for g, a, n in zip(group.tolist(), cut.first.tolist(), cut.parts.tolist()):
            out[g] = listed[a:a + n].tobytes() + b"\0" * (-n % 4) + words[ends[a]:ends[a + n]].tobytes()
    return out


def _words_of(packed: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of blocks end to end, and how many each segment has."""
    lengths, words = [], []
    for x, n in zip(packed, parts.tolist()):
        begin = n + -n % 4
        if len(x) < begin or len(x) % 4:
            raise ValueError("a block of ids is cut")
        listed = np.frombuffer(x, np.uint8, begin)
        if listed[n:].any() or 4 * int(listed.sum(dtype=np.int64)) != len(x) - begin:
            raise ValueError("the words of a block's segments do not add up")
        lengths.append(listed[:n])
        words.append(np.frombuffer(x, "<u4", offset=begin))
    return np.concatenate(words), np.concatenate(lengths).astype(np.int64)


def decode_blocks(packed: list[bytes], sizes: np.ndarray, crcs: list[int], id_bits: int = 16) -> np.ndarray:
    """The ids of all blocks, end to end; a block without its checksum raises."""
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out, kept = np.zeros(int(offs[-1]), np.uint32), {}
    for group in _grouped(sizes, id_bits):
        cut = _Cut(sizes[group])
        words, lengths = _words_of([packed[g] for g in group.tolist()], cut.parts)
        starts = np.cumsum(lengths) - lengths
        reader = _Reader(*cut.args(id_bits), kept, words, starts[cut.order], lengths[cut.order])
        own = cut.ids(reader.run(cut.sizes))
        at = 0
        for g in group.tolist():
            block = own[at:at + int(sizes[g])]
            at += len(block)
            if checksum(block) != crcs[g]:
                raise ValueError("a block of ids does not have its checksum")
            out[offs[g]:offs[g + 1]] = block
    return out
