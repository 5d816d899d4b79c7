"""Minimax contiguous sharding of documents; DataFrame operations only.

Equal texts form an atomic group.  Groups are ordered by a 64-bit hash of the text, so
a shard is an interval of hashes and needs no join to be assigned.  The smallest
capacity for which a greedy walk over the ordered group sizes needs no more than the
given number of shards is found by binary search.

The walk needs group sizes in order, which do not fit one machine.  It runs on cells:
totals of hash intervals, a bounded number of them.  Cutting no cell gives an upper
bound of the capacity, cutting every cell at any byte a lower one.  The cells in which
a cut can lie are then split further, until both bounds meet: the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

#: Bits of the first cells and of each further split; salts of a shard's slots.
CELL_BITS, SPLIT_BITS, SALTS = 14, 6, 512


class Cells:
    """Ordered cell totals: (first hash, bytes, whether one group, bits and number of the cell)."""

    def __init__(self, rows: list[tuple[int, int, bool, int, int]]):
        self.rows = sorted(rows)
        self.first = [r[0] for r in self.rows]
        self.atomic = [r[2] for r in self.rows]
        self.edge = [0, *accumulate(r[1] for r in self.rows)]
        self.total = self.edge[-1]

    def walk(self, capacity: int, cells_whole: bool) -> list[int] | None:
        """Byte positions where the shards of a greedy walk end; None if a cell does not fit."""
        ends, at = [], 0
        while at < self.total:
            reach = at + capacity
            if reach < self.total:
                cell = bisect_right(self.edge, reach) - 1
                if cells_whole or self.atomic[cell]:
                    reach = self.edge[cell]
            reach = min(reach, self.total)
            if reach <= at:
                return None
            ends.append(reach)
            at = reach
        return ends

    def least(self, shards: int, cells_whole: bool) -> int:
        """The smallest capacity whose walk fits the shards, by binary search."""
        low, high = max(1, -(-self.total // shards)), self.total
        while low < high:
            half = (low + high) // 2
            ends = self.walk(half, cells_whole)
            if ends is not None and len(ends) <= shards:
                high = half
            else:
                low = half + 1
        return low

    def open_cells(self, low: int, high: int) -> list[int]:
        """Unsplit cells to split next.

        Those over ``low`` come first, since they may hide a group that settles the
        capacity; else all in which some walk with a capacity of low to high may cut.
        """
        large = [c for c, r in enumerate(self.rows) if r[1] > low and not r[2]]
        if large:
            return large
        near, far = self.walk(low, True) or [0], self.walk(high, False)
        found = set()
        for k, end in enumerate(far):
            begin = near[min(k, len(near) - 1)]
            a = max(0, bisect_right(self.edge, min(begin, end)) - 1)
            b = min(len(self.first) - 1, bisect_left(self.edge, max(begin, end)))
            found.update(c for c in range(a, b + 1) if not self.atomic[c])
        return sorted(found)

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """First hashes of shards 1, 2, …: as even as the capacity allows.

        Of the cell edges that keep this shard within the capacity and leave a rest
        the other shards can take, the one nearest to an equal share is cut.
        """
        latest = [0] * (shards + 1)  # the earliest end of shard k that leaves a feasible rest
        latest[shards] = self.total
        for k in range(shards - 1, 0, -1):
            latest[k] = self.edge[bisect_left(self.edge, latest[k + 1] - capacity)]
        at, out = 0, []
        for k in range(1, shards):
            target = at + (self.total - at) / (shards - k + 1)
            low = bisect_left(self.edge, max(latest[k], at))
            high = bisect_right(self.edge, at + capacity) - 1
            near = min(max(bisect_left(self.edge, target), low), high)
            if near > low and target - self.edge[near - 1] < self.edge[near] - target:
                near -= 1
            at = self.edge[near]
            out.append(near)
        return [self.first[c] for c in out if c < len(self.first)]


def _cell(bits: int):
    return F.shiftright("_group", 64 - bits) if bits < 64 else F.col("_group")


def _cells(groups: DataFrame, bits: int) -> list[tuple[int, int, bool, int, int]]:
    rows = groups.groupBy(_cell(bits).alias("cell")).agg(
        F.min("_group").alias("first"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return [(r["first"], r["bytes"], r["n"] == 1, bits, r["cell"]) for r in rows.collect()]


def minimax_cuts(groups: DataFrame, shards: int, bits: int = CELL_BITS) -> list[int]:
    """Hashes at which shards 1, 2, … begin, for rows (_group, bytes), one per group.

    At most some ten thousand cell totals are on the driver at a time, however many
    groups there are.
    """
    cells = Cells(_cells(groups, bits))
    if not cells.total:
        return []
    while True:
        low, high = cells.least(shards, False), cells.least(shards, True)
        if low == high:
            return cells.cuts(high, shards)
        split = cells.open_cells(low, high)
        chosen = set(split)
        rows = [r for c, r in enumerate(cells.rows) if c not in chosen]
        for level in sorted({cells.rows[c][3] for c in split}):
            numbers = [(cells.rows[c][4],) for c in split if cells.rows[c][3] == level]
            # Cell numbers, as few as the cells on the driver.
            wanted = F.broadcast(groups.sparkSession.createDataFrame(numbers, "_cell long"))
            inside = groups.join(wanted, _cell(level) == F.col("_cell"), "left_semi")
            rows += _cells(inside, min(64, level + SPLIT_BITS))
        cells = Cells(rows)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row's shard and slot under the law ``bytes``: sizes as equal as groups allow.

    Columns: doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot (gapless
    from 0 in each shard, by a salt of the id and then the id), grown_shard (null).
    No partition of a smaller largest shard keeps equal texts together in hash order.

    A null text is empty (size 8, checksum 0); a null ``doc_id`` and repeated rows
    are rows like others; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = materialize(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_group"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt")), "sizes")
    groups = materialize(sized.groupBy("_group").agg(F.sum("size").alias("bytes")), "groups")
    shard = F.lit(0)
    for cut in minimax_cuts(groups, shards):
        shard = shard + (F.col("_group") >= F.lit(cut)).cast("int")
    placed = sized.withColumn("shard", shard)
    # One row per shard and salt: shards * SALTS bounds the table, the window and the broadcast.
    filled = placed.groupBy("shard", "_salt").agg(F.count("*").alias("n"))
    offsets = filled.selectExpr("shard", "_salt", "sum(n) over (partition by shard order by _salt) - n AS _off")
    ranked = placed.selectExpr(
        "*", "row_number() over (partition by shard, _salt order by doc_id, text_crc32, size) - 1 AS _rank")
    return ranked.join(F.broadcast(offsets), ["shard", "_salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_off") + F.col("_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
