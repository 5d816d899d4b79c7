"""Repair of damaged conversations at least cost, with the least record of edits.

A conversation's rows in order of their turns are edited so that the initials of the roles
read ``(s?(ua)+)?``.  A cost table over (row, state of that pattern), filled from the last
row back, gives the cheapest continuation of every node; the arcs that keep to it form a
graph without cycles.  Its nodes are ranked by the least record of 1, 2, 4, ... edits that
begins there: the rank for a doubled length is that of the pair (own rank, rank of the node
so many edits ahead), and the pointers to that node double with it.  The record of a
conversation is then read off through the doubled pointers, all places at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textops import spread

#: Fixed values of the contract: costs of the edits, and of leaving a truncated row in place.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5

_BLANKS = " \t\n\x0b\x0c\r"
# States of the pattern: nothing yet, after s, after u, after a.
_START, _S, _U, _A = range(4)
_NEVER = 1 << 60
# By initial (other, s, u, a) and state: the state after it, or -1.
_AFTER = np.full((4, 4), -1)
_AFTER[1, _START] = _S
_AFTER[2, [_START, _S, _A]] = _U
_AFTER[3, _U] = _A
# The role that the pattern wants next, and the state behind it.
_WANTED = np.array([_U, _U, _A, _U])
_ROLE = {_U: "user", _A: "assistant"}
_END, _D, _I, _K, _R = range(5)  # in the order of their letters
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)


def damage(conversations: DataFrame, out: str = "present") -> DataFrame:
    """Rows (conv_id, turn, role, text, ``out``) after a fixed damage by crc32(``conv_id:turn``) % 20.

    0 drops the row (it stays without role and text, ``out`` false, so that its
    conversation is still known), 1 empties the text, 2 takes every ``.``, ``!`` and ``?``
    out of it, 3 repeats the row, 4 makes its role user.  A null role, text, id or turn
    counts as one space, but a null turn stays null; other columns are left behind; an
    empty table gives no rows.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    dropped = F.col("_fate") == 0
    text = (F.when(F.col("_fate") == 1, "")
            .when(F.col("_fate") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("_role"))
    times = F.when(F.col("_fate") == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", spaced("role").alias("_role"),
                                spaced("text").alias("_text"), fate.alias("_fate"))
    return rows.select(
        "conv_id", "turn", F.when(~dropped, role).alias("role"), F.when(~dropped, text).alias("text"),
        (~dropped).alias(out), F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).drop("_copy")


@dataclass
class _Rows:
    """Whole conversations laid end to end: their ids, row offsets and the rows' columns."""
    ids: list
    offs: np.ndarray
    turn: list
    role: list
    text: list
    initial: np.ndarray
    fault: np.ndarray


_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)


def _mark_duplicates(rows: _Rows) -> None:
    """First faults: a repeated role and text is a duplicate unless it is blank."""
    offs = rows.offs.tolist()
    for start, stop in zip(offs, offs[1:]):
        seen = set()
        for i in range(start, stop):
            own = rows.role[i], rows.text[i]
            if own in seen and rows.fault[i] != _BLANK:
                rows.fault[i] = _DUPLICATE
            seen.add(own)


def _costs(rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from every (place, state) to the end, and the first place of every conversation.

    A conversation of n rows has n + 1 places.  All conversations advance together, the
    longest first, from their ends.
    """
    sizes = np.diff(rows.offs)
    first = rows.offs[:-1] + np.arange(len(sizes))
    last = first + sizes
    cost = np.empty((int(sizes.sum()) + len(sizes), 4), np.int64)
    cost[last] = _with_inserts(np.array([[0, _NEVER, _NEVER, 0]]))
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    for step in range(1, int(sizes.max(initial=0)) + 1):
        lanes = order[:np.searchsorted(falling, -step, "right")]
        at = last[lanes] - step
        row = rows.offs[lanes + 1] - step
        ahead = cost[at + 1]
        fault = rows.fault[row][:, None]
        keeps = np.where(fault == _TRUNCATED, LEFT_TRUNCATED, 0) + np.where(
            (fault == _BLANK) | (fault == _DUPLICATE), _NEVER, 0)
        after = _AFTER[rows.initial[row]]
        kept = np.where(after < 0, _NEVER, np.take_along_axis(ahead, np.maximum(after, 0), 1)) + keeps
        changed = ahead[:, _WANTED] + keeps + REROLE
        best = np.minimum(np.minimum(kept, changed), ahead + DELETE)
        cost[at] = _with_inserts(np.minimum(best, _NEVER))
    return cost, first


def _with_inserts(best: np.ndarray) -> np.ndarray:
    """After two inserts a state comes round again, so two relaxations are all."""
    for _ in range(2):
        best = np.minimum(best, best[:, _WANTED] + INSERT)
    return best


def _arcs(rows: _Rows, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and target of the least arc out of every node that keeps to the least cost.

    Nodes are place * 4 + state; arcs of one node bear different letters, so the least
    letter names one arc.  Nodes without arcs point at themselves.
    """
    sizes = np.diff(rows.offs)
    place = np.arange(len(cost))
    inner = np.ones(len(cost), bool)
    inner[rows.offs[1:] + np.arange(len(sizes))] = False
    at = place[inner]
    label = np.full((len(cost), 4), _END)
    target = place[:, None] * 4 + np.arange(4)
    states = np.arange(4)
    fault = rows.fault[:, None]
    keeps = np.where(fault == _TRUNCATED, LEFT_TRUNCATED, 0)
    stays = (fault != _BLANK) & (fault != _DUPLICATE)
    after = _AFTER[rows.initial]
    ahead, own = cost[at + 1], cost[at]
    # From the greatest letter down, so the least is written last.
    for letter, state, price, may in (
            (_R, np.broadcast_to(_WANTED, own.shape), keeps + REROLE, stays),
            (_K, np.maximum(after, 0), keeps, stays & (after >= 0))):
        good = may & (np.take_along_axis(ahead, state, 1) + price == own)
        label[at] = np.where(good, letter, label[at])
        target[at] = np.where(good, (at[:, None] + 1) * 4 + state, target[at])
    good = cost[:, _WANTED] + INSERT == cost
    label = np.where(good, _I, label)
    target = np.where(good, place[:, None] * 4 + _WANTED, target)
    good = ahead + DELETE == own
    label[at] = np.where(good, _D, label[at])
    target[at] = np.where(good, (at[:, None] + 1) * 4 + states, target[at])
    return label.ravel(), target.ravel()


def rank_paths(label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Rank of every node by its least path, the doubled pointers, and the lengths of the paths.

    ``label`` 0 ends a path there.  Round k ranks by the first 2**k labels: a pair of
    ranks, the node's and that of the node 2**k labels ahead, is the rank for twice the
    length.  The last ranks order whole paths; equal ranks are equal paths.
    """
    rank = label.astype(np.int64)
    length = (label > 0).astype(np.int64)
    pointers = [target]
    while label[pointers[-1]].any():
        jump = pointers[-1]
        pair = rank * (int(rank.max()) + 1) + rank[jump]
        _, rank = np.unique(pair, return_inverse=True)
        rank = np.where(label > 0, rank + 1, 0)
        length = length + length[jump]
        pointers.append(jump[jump])
    return rank, pointers, length


def read_paths(label: np.ndarray, pointers: list[np.ndarray], roots: np.ndarray, lengths: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Labels and nodes along the least path of every root, laid end to end."""
    steps = spread(np.zeros(len(roots), np.int64), lengths)
    node = np.repeat(roots, lengths)
    for k, jump in enumerate(pointers):
        node = np.where((steps >> k) & 1 == 1, jump[node], node)
    return label[node], node


def _illegal(rows: _Rows) -> np.ndarray:
    """Neighbouring initials other than su, ua and au, per conversation."""
    first, second = rows.initial[:-1], rows.initial[1:]
    legal = ((first == 1) & (second == 2)) | ((first == 2) & (second == 3)) | ((first == 3) & (second == 2))
    bad = np.concatenate([[0], np.cumsum(~legal)])
    start, stop = rows.offs[:-1], rows.offs[1:]
    return np.where(stop > start, bad[np.maximum(stop - 1, 0)] - bad[np.minimum(start, len(bad) - 1)], 0)


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _repaired(rows: _Rows, start: int, letters: list[int], nodes: list[int]
              ) -> Iterator[tuple[str, str, str, int | None]]:
    """(edit, role, text, turn) of every edit of one conversation; ``start`` is its first row."""
    row = start
    for letter, node in zip(letters, nodes):
        wanted = _ROLE.get(int(_WANTED[node & 3]))
        if letter == _I:
            yield "I", wanted, "", None
            continue
        edit = "DKR"[(_D, _K, _R).index(letter)]
        yield edit, wanted if letter == _R else rows.role[row], rows.text[row], rows.turn[row]
        row += 1


def _solve(rows: _Rows):
    _mark_duplicates(rows)
    cost, first = _costs(rows)
    label, target = _arcs(rows, cost)
    _, pointers, length = rank_paths(label, target)
    roots = first * 4
    letters, nodes = read_paths(label, pointers, roots, length[roots])
    ends = np.concatenate([[0], np.cumsum(length[roots])])
    return cost[first, _START], letters, nodes, ends


def _digest_batch(rows: _Rows) -> pa.RecordBatch:
    cost, letters, nodes, ends = _solve(rows)
    audit = _LETTERS[letters].tobytes().decode()
    offs, bounds = rows.offs.tolist(), ends.tolist()
    letters, nodes = letters.tolist(), nodes.tolist()
    hashes, gaps = [], []
    for c in range(len(rows.ids)):
        a, b = bounds[c], bounds[c + 1]
        digest, between = hashlib.sha256(), ""
        for edit, role, text, _ in _repaired(rows, offs[c], letters[a:b], nodes[a:b]):
            if edit != "D":
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
        hashes.append(digest.hexdigest())
        gaps.append(_gaps(rows.turn[offs[c]:offs[c + 1]]))

    def count(fault: int) -> np.ndarray:
        found = np.concatenate([[0], np.cumsum(rows.fault == fault)])
        return found[rows.offs[1:]] - found[rows.offs[:-1]]

    return pa.RecordBatch.from_arrays(
        [pa.array(rows.ids, pa.int64()), pa.array(gaps, pa.int64()), pa.array(count(_BLANK)),
         pa.array(count(_DUPLICATE)), pa.array(count(_TRUNCATED)), pa.array(_illegal(rows)),
         pa.array(cost), pa.array([audit[a:b] for a, b in zip(bounds, bounds[1:])]), pa.array(hashes)],
        names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
               "repaired_sha256"])


def _turns_batch(rows: _Rows) -> pa.RecordBatch:
    _, letters, nodes, ends = _solve(rows)
    offs, bounds = rows.offs.tolist(), ends.tolist()
    letters, nodes = letters.tolist(), nodes.tolist()
    out = []
    for c, conv_id in enumerate(rows.ids):
        place = 0
        a, b = bounds[c], bounds[c + 1]
        for edit, role, text, turn in _repaired(rows, offs[c], letters[a:b], nodes[a:b]):
            if edit != "D":
                out.append((conv_id, place, edit, turn, role, text))
                place += 1
    columns = zip(*out) if out else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)],
        names=["conv_id", "place", "edit", "turn", "role", "text"])


def _rows_of(batches: list[pa.RecordBatch]) -> _Rows:
    """Columns of complete conversations; rows without role and text only name theirs."""
    table = pa.Table.from_batches(batches)
    keys = table.column("conv_id").to_pylist()
    there = table.column("_there").to_numpy().astype(bool)
    heads = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
    kept = np.concatenate([[0], np.cumsum(there)])
    table = table.filter(pa.array(there))
    return _Rows([keys[i] for i in heads], kept[np.array([*heads, len(keys)])],
                 table.column("turn").to_pylist(), table.column("role").to_pylist(),
                 table.column("text").to_pylist(), table.column("_initial").to_numpy().astype(np.int64),
                 table.column("_fault").to_numpy().astype(np.int64))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000
                 ) -> Iterator[list[pa.RecordBatch]]:
    """Sorted batches cut between groups of equal ``key``, about ``rows`` rows at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        if held and size >= rows and keys[0] != held[-1].column(key)[-1].as_py():
            yield held
            held, size = [], 0
        if size + len(keys) >= rows:
            cut = len(keys) - 1
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut:
                yield [*held, batch.slice(0, cut)]
                held, size = [], 0
                batch = batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield held


def _prepared(turns: DataFrame, present: str | None) -> DataFrame:
    """Rows dealt by conversation and sorted, with the initial of the role and the row's own fault."""
    there = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                        F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), there.alias("_there"))
    body = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (F.when(body == "", _BLANK)
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), _TRUNCATED).otherwise(_FINE))
    # 1 to 3 by the pattern's letters; an empty role has no initial.
    initial = F.when(F.length("role") > 0, F.expr("locate(substring(role, 1, 1), 'sua')")).otherwise(0)
    marked = rows.withColumns({"_initial": initial, "_fault": fault})
    return marked.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def audit_conversations(turns: DataFrame, present: str | None = None) -> DataFrame:
    """Faults, least cost, least record of edits and the repaired text's digest, one row per conversation.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.  Rows are taken
    by turn, nulls first, equal turns by role and text.  A null role or text is one space;
    a null conv_id is one conversation of its own.  Rows whose ``present`` is false or null
    only name their conversation: one without other rows gets zeros, no edits and the
    digest of nothing.  Repeated rows are duplicates of the first.  An empty table gives no
    rows.  The rows of a conversation meet in one task, which must hold the longest one, as
    its digest is of one text; conversations share tasks but never a group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "conv_id"):
            yield _digest_batch(_rows_of(group))

    return _prepared(turns, present).mapInArrow(
        run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
             "cost long, audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, present: str | None = None) -> DataFrame:
    """The turns of all repaired conversations: (conv_id, place, edit, turn, role, text).

    ``place`` counts from 0, ``edit`` is K, R or I, and inserted turns have no ``turn``;
    deleted rows are gone.  Rows are taken as ``audit_conversations`` takes them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "conv_id"):
            yield _turns_batch(_rows_of(group))

    return _prepared(turns, present).mapInArrow(
        run, "conv_id long, place long, edit string, turn long, role string, text string")
