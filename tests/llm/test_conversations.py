"""Repair and prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

import oracle
from postlift.llm import queries, turn_repair, turn_trie

SCHEMA = ("conv_id long, turn long, role string, text string, place int, audit string, cut int, key string, "
          "present string, shard int, size int")


def conversations(spark, rows):
    """A conversations table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2, "k", "p", 3, 4) for r in rows], SCHEMA).repartition(3)


def odd_rows(seed=5):
    """Nulls in every column, blank and very long texts, ties, repeats, odd roles, lone conversations."""
    r = random.Random(seed)
    texts = ["Yes.", "no", "", " \t\n", "Why?", "same.", "a:b", None, "x\x0b.", "Hello there", "é!", "日本 "]
    roles = ["user", "assistant", "system", "tool", None, "", "sage", "User"]
    rows = []
    for conv in [*range(-7, 30), None]:
        for turn in range(r.randint(1, 9)):
            role = r.choice(roles if r.random() < 0.3 else ["user", "assistant"] if turn else ["system", "user"])
            rows.append((conv, r.choice([turn, turn, turn, turn * 3, None, 2]), role, r.choice(texts)))
    rows += r.sample(rows, 20)
    return rows + [(40, t, "user" if t % 2 else "assistant", "long " * 9_000 + str(t)) for t in range(60)]


def initial(role):
    return role[:1]


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(rs, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
            for c, rs in out.items()}


def audited(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen
                      else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserts):
        """(cost, record, repaired) of the rest, by trying everything."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for letter, after in step[state].items():
                if letter in names:
                    c, a, t = best(i, after, inserts + 1)
                    found.append((c + 5, "I" + a, (f"{names[letter]}:", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for letter, after in step[state].items():
                    c, a, t = best(i + 1, after, 0)
                    if initial(role) == letter:
                        found.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                    if letter in names:
                        found.append((c + more + 1, "R" + a, (f"{names[letter]}:{text}", *t)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    cost, audit, repaired = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [initial(a[1]) + initial(b[1]) for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (
        "blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(repaired).encode()).hexdigest()), repaired


def test_audits_equal_brute_force(spark):
    rows = odd_rows()
    got = {r[0]: tuple(r[1:]) for r in turn_repair.audit_conversations(
        turn_repair.damage(conversations(spark, rows)), "present").collect()}
    want = {conv: audited(rs)[0] for conv, rs in damaged(rows).items()}
    assert got == want
    assert len({a[6] for a in want.values()}) > 20 and {"D", "K", "R"} <= set("".join(a[6] for a in want.values()))


def test_repaired_turns_equal_brute_force(spark):
    rows = [r for r in odd_rows(8) if r[0] is not None]
    found = turn_repair.repair_conversations(conversations(spark, rows)).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rs in by_conv.items():
        rs.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        assert got.get(conv, []) == list(audited(rs)[1]), conv


def test_a_conversation_of_dropped_rows_stays(spark):
    conv = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turn_repair.audit_conversations(turn_repair.damage(
        conversations(spark, [(conv, 0, "user", "Gone.")])), "present").collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_least_path_among_many(spark):
    """Doubled pointers give the path that walking arc by arc gives; ranks order whole paths."""
    r = np.random.default_rng(1)
    label = np.concatenate([r.integers(1, 4, 400), [0]])
    target = np.array([r.integers(i + 1, min(i + 4, 401)) for i in range(400)] + [400])
    rank, pointers, length = turn_repair.rank_paths(label, target)
    words = []
    for node in range(401):
        word = []
        while label[node]:
            word.append(int(label[node]))
            node = target[node]
        words.append(tuple(word))
    assert [len(w) for w in words] == length.tolist()
    assert sorted(range(401), key=lambda n: words[n]) == sorted(range(401), key=lambda n: rank[n])
    read, _ = turn_repair.read_paths(label, pointers, np.array([0, 7, 400]), length[[0, 7, 400]])
    assert tuple(read.tolist()) == words[0] + words[7]


def test_groups_are_cut_between_conversations():
    import pyarrow as pa
    keys = [1] * 5 + [2] * 30 + [3] + [None] * 4
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 4], pa.int64())], names=["k"])
               for i in range(0, len(keys), 4)]
    groups = [[k for b in g for k in b.column("k").to_pylist()] for g in turn_repair.whole_groups(iter(batches), "k", 8)]
    assert [k for g in groups for k in g] == keys and len(groups) > 2
    assert all(not set(a) & set(b) for a, b in zip(groups, groups[1:]))


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for rs in own.values():
        rs.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    out = {}
    for conv, rs in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        first = own.get(conv - int(np.fmod(conv, 5)), [])
        out[conv] = [x[1:] for x in first[:h]] + [x[1:] for x in rs[h:]]
    return out


def trie_of(paths):
    nodes = {}
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        children = {p[:len(prefix) + 1] for p in below if len(p) > len(prefix)}
        leaves = sum(not any(q[:len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in members if tuple(paths[c]) == prefix)
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
                    len(children), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def forked(seed=3, convs=150):
    """Conversations of few turns in common, many equal, a deep common beginning, and one long one."""
    r = random.Random(seed)
    rows = []
    for conv in range(-20, convs):
        kind = r.random()
        length = r.randint(1, 4) if kind < 0.4 else 12 if kind < 0.8 else r.randint(1, 14)
        for t in range(length):
            same = kind < 0.8 and t < 10
            rows.append((conv, t if t else None, r.choice(["user", None]) if not same else "user",
                         f"t{t}" if same else r.choice(["a", "b", "é", None, ""])))
    return rows + [(1_000, t, "user", str(t)) for t in range(80)]


@pytest.mark.parametrize("shard_turns", [8, 1 << 17])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = forked()
    got = turn_trie.conversation_trie(conversations(spark, rows + [(None, 1, "user", "x")]), shard_turns).collect()
    assert sorted([tuple(r) for r in got], key=str) == trie_of(rebuilt(rows))


def test_trie_of_odd_rows(spark):
    """Ties take some fixed order; nulls are empty; a turnless conversation is the root's member."""
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in odd_rows() if c is None or c < 40}.values())
    lone = next(c for c in range(100, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows.append((lone, 0, "user", "only"))
    got = turn_trie.conversation_trie(conversations(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == trie_of(rebuilt(rows))
    assert any(r.depth == 0 and r.ends_sha256 != hashlib.sha256().hexdigest() for r in got)


def test_many_copies_of_one_path_have_one_digest(spark):
    ids = range(3, 30_000, 5)
    docs = spark.createDataFrame([(c, [(1, 2, 3)]) for c in ids], "conv_id long, turns array<struct<a:bigint,b:bigint,n:bigint>>")
    row = turn_trie.distinct_paths(docs.repartition(7)).collect()
    assert len(row) == 1 and row[0].n_convs == len(ids) and row[0].conv_id == 3
    assert row[0].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_double_array_leads_to_every_child_and_nowhere_else():
    r = np.random.default_rng(2)
    offs = np.concatenate([[0], np.cumsum(r.integers(0, 9, 300))])
    turns = r.integers(0, 40, offs[-1])
    turns[r.random(len(turns)) < 0.3] = 7
    trie, renumbered = turn_trie.build_trie(turns, offs)
    nodes = {}
    for i in range(300):
        at, prefix = np.zeros(1, np.int64), ()
        for t in renumbered[offs[i]:offs[i + 1]].tolist():
            at, prefix = trie.step(at, np.array([t])), (*prefix, t)
            assert at[0] > 0 and nodes.setdefault(prefix, at[0]) == at[0]
    assert len(set(nodes.values())) == len(nodes) == (trie.check >= 0).sum() - 1
    for prefix, slot in [((), 0), *nodes.items()]:
        found = trie.step(np.full(40, slot), np.arange(40))
        assert {t for t in range(40) if found[t] >= 0} == {p[-1] for p in nodes if p[:-1] == prefix}


@pytest.mark.parametrize("build", [lambda t: turn_repair.audit_conversations(turn_repair.damage(t), "present"),
                                   turn_repair.repair_conversations, turn_trie.conversation_trie])
def test_empty_tables(spark, build):
    assert build(conversations(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_turn_trie"])
def test_queries_match_their_sql(spark, sf, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name]) is None
