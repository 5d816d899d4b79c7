"""Containment of test items, and the n-gram join, against sets in plain Python."""

import itertools
import random

import oracle
import pytest
from pyspark.sql import functions as F

from postlift.llm import components, decontaminate, ngram_join, queries
from tables import EDGE, documents, shingles


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


ITEMS = [(1, "b c d e f g h"), (2, None), (3, ""), (4, "two  WORDS"), (5, "words of one kind many words of"),
         (6, "a row without an id but with five"), (6, "never found in any of these texts at all"),
         (7, "a b c d e f g x")]


def named(i):
    return -1 if i is None else i


def held_pairs(docs, items):
    out = []
    for (d, text), (i, item) in itertools.product(docs, items):
        own = shingles(item)
        both = len(own & shingles(text))
        if own and both >= 0.8 * len(own) - 1e-9:
            out.append((named(d), i, len(own), both))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 1000])
def test_items_are_found_whatever_the_block(spark, block):
    found = decontaminate.find_items(documents(spark), items_table(spark, ITEMS), block=block).collect()
    assert sorted((named(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in found) == held_pairs(EDGE, ITEMS)


@pytest.mark.parametrize("block", [1, 1_000_000])
def test_random_items_in_long_documents(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROW_ITEMS", 2)
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.choice([30, 300, 3000])))) for i in range(30)]
    items = []
    for i in range(60):
        words = docs[i % 30][1].split()
        at = r.randrange(len(words) - 25)
        part = words[at:at + r.randint(5, 25)]
        for _ in range(r.randint(0, 2)):
            part[r.randrange(len(part))] = "changed"
        items.append((i, " ".join(part)))
    found = decontaminate.find_items(documents(spark, docs), items_table(spark, items), block=block).collect()
    assert sorted((named(x.doc_id), x.item_id, x.n_item, x.n_shared) for x in found) == held_pairs(docs, items)


@pytest.mark.parametrize("block, few", [(1, 0), (1, 1_000), (1_000, 1_000)])
def test_documents_with_items_are_dropped(spark, block, few, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", few)
    docs, items = documents(spark).withColumns({"doc_key": F.lit(1), "_whole": F.lit("a")}), items_table(spark, ITEMS)
    kept = decontaminate.drop_holders(docs, items, block=block)
    assert kept.schema == docs.schema
    bad = {d for d, *_ in held_pairs(EDGE, ITEMS)}
    assert sorted(named(r.doc_id) for r in kept.collect()) == sorted(
        named(i) for i, _ in EDGE if named(i) not in bad)


def test_many_items_stay_a_table(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ItemIndex", None)  # no index is built anywhere
    n = 200_000
    items = spark.range(n).select(F.col("id").alias("item_id"), F.concat_ws(
        " ", *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(7)]).alias("text"))
    docs = [(i, f"before it w0x{i} w1x{i} w2x{i} w3x{i} W4x{i}\tw5x{i} w6x{i} and behind") for i in range(0, n, 20_000)]
    found = decontaminate.find_items(documents(spark, docs + docs[:1]), items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found) == sorted(
        (i, i, 3, 3) for i in [0, *range(0, n, 20_000)])


def test_empty_sides(spark):
    docs, items = documents(spark), items_table(spark, ITEMS)
    assert decontaminate.find_items(documents(spark, []), items).count() == 0
    assert decontaminate.find_items(documents(spark, []), items, block=1).count() == 0
    assert decontaminate.find_items(docs, items_table(spark, [])).count() == 0
    assert decontaminate.drop_holders(docs, items_table(spark, [])).count() == len(EDGE)


@pytest.mark.parametrize("name", ["op1_decontamination", "op8_ngram_jaccard"])
def test_queries_equal_their_sql(spark, sf, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name]) is None


def brute_components(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((named(i), len(sets[k]), least.get(find(k), -1), links[k]) for k, (i, _) in enumerate(rows))


def components_of(docs):
    return sorted((named(r.doc_id), r.n_shingles, named(r.component_id), r.n_links)
                  for r in ngram_join.jaccard_components(docs).collect())


def test_join_of_edge_rows(spark):
    assert components_of(documents(spark)) == brute_components(EDGE)


def near_copies(r, size, words=60):
    """A group of near copies, a passage many documents share, and documents apart."""
    base = [f"b{i}" for i in range(words)]
    rows = []
    for _ in range(size):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(words)] = f"x{r.randrange(10**6)}"
        rows.append(" ".join(own[:r.randint(words - 6, words)]))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [passage + " " + " ".join(f"d{k}_{i}" for i in range(r.randint(3, 60))) for k in range(size // 2)]
    rows += [rows[0]] * 10
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("block", [8, 512])
def test_join_of_a_hot_group_in_any_row_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rows = near_copies(random.Random(block), 60)
    assert components_of(documents(spark, rows)) == brute_components(rows)


def test_one_document_of_a_group_stays(spark):
    docs = documents(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    # 5 (once) stands for 5, 5 and 8; blank rows and the row without an id stay.
    assert sorted(named(r.doc_id) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13]


def test_rows_of_one_id_are_judged_each(spark):
    """Different texts under one id, repeated ids that copy others, and rows without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (2, c), (2, c), (3, b), (4, d), (4, d), (None, d), (None, "x1 x2 x3 x4 x5 x6"),
            (5, ""), (5, ""), (5, None), (6, " "), (6, a)]
    kept = ngram_join.keep_one(documents(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, a), (2, b), (2, c), (4, d), (None, "x1 x2 x3 x4 x5 x6"), (5, ""), (5, ""), (5, None), (6, " ")], key=str)
    assert kept.columns == documents(spark, rows).columns


def test_join_of_an_empty_table(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0
    assert ngram_join.keep_one(documents(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}}


@pytest.mark.parametrize("groups", [1, 5])
def test_heavy_groups_are_joined_alike(spark, groups, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY_GROUPS", groups)
    rows = EDGE + [(100 + i, "one text that very many rows hold word for word") for i in range(60)]
    rows += [(200 + i, f"number {i} stands alone here with words of its own w{i} x{i}") for i in range(20)]
    docs = documents(spark, rows)
    assert components_of(docs) == brute_components(rows)
    kept = sorted(named(r.doc_id) for r in ngram_join.keep_one(docs).collect())
    assert kept.count(100) == 1 and not any(100 < i < 160 for i in kept) and all(i in kept for i in range(200, 220))
