"""Sharding, fingerprints and archives against plain Python."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from postlift.llm import fingerprints, queries, shards, warc
from postlift.session import scratch_path
from tables import EDGE, documents


def best_capacity(sizes, count):
    low, high = 1, sum(sizes)
    while low < high:
        half, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if s > half:
                used = count + 1
                break
            used, load = (used + 1, s) if load + s > half else (used, load + s)
        low, high = (low, half) if used <= count else (half + 1, high)
    return low


@pytest.mark.parametrize("bits", [1, 3, 14])
@pytest.mark.parametrize("count", [1, 5, 24])
def test_cuts_are_minimax_however_coarse_the_first_cells(spark, bits, count):
    r = random.Random(bits * 100 + count)
    groups = {r.randrange(-2**63, 2**63): r.choice([1, 5, 9, 200, 5000]) for _ in range(300)}
    frame = spark.createDataFrame(list(groups.items()), "_group long, bytes long")
    cuts = shards.minimax_cuts(frame, count, bits)
    load = Counter()
    for g, size in groups.items():
        load[sum(g >= c for c in cuts)] += size
    assert max(load) < count
    assert max(load.values()) == best_capacity([groups[g] for g in sorted(groups)], count)


def test_shards_of_edge_rows_and_a_hot_group(spark):
    rows = EDGE + [(100 + i, "a copy that a third of all rows hold") for i in range(40)]
    found = shards.shard_documents(documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted(
        (i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, places = defaultdict(list), defaultdict(set)
    for r in found:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        places[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in places.values())
    assert shards.shard_documents(documents(spark, [])).count() == 0


def brute_fingerprint_rows(rows):
    ordered = sorted((i, t or "") for i, t in rows if i is not None)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        yield i, t, t[:len(t) - half] + following[:half], following


def test_fingerprints_of_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    found = fingerprints.fingerprint_documents(documents(spark)).collect()
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in found)
    want = sorted((i, len(t), hashlib.sha256(e.encode()).hexdigest(),
                   fingerprints.HashedText(t).fingerprint(), fingerprints.HashedText(e).fingerprint())
                  for i, t, e, _ in brute_fingerprint_rows(EDGE))
    assert got == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.fingerprint_documents(documents(spark, [])).count() == 0
    one = fingerprints.fingerprint_documents(documents(spark, [(3, "abc def")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert one[0].edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()


def test_spans_and_extensions():
    r = random.Random(2)
    for _ in range(200):
        a = "".join(r.choice("abé\U0001f642") for _ in range(r.randint(1, 60)))
        at = r.randrange(len(a))
        b = a[at:] + "z"
        x, y = fingerprints.HashedText(a), fingerprints.HashedText(b)
        assert x.common_extension(at, y, 0) == len(a) - at
        i, j = sorted((r.randrange(len(a) + 1), r.randrange(len(a) + 1)))
        other = r.randrange(len(a) - (j - i) + 1)
        assert (x.span(i, j) == x.span(other, other + j - i)) == (a[i:j] == a[other:other + j - i])


def test_likeness_follows_the_shared_part():
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(6000))
    other = "".join(r.choice("abcdefgh ") for _ in range(6000))
    mark = [fingerprints.HashedText(t).fingerprint() for t in (text, text[:3000] + other[:3000], other)]
    assert fingerprints.likeness(mark[0], mark[0]) == 1.0
    assert 0.15 < fingerprints.likeness(mark[0], mark[1]) < 0.55
    assert fingerprints.likeness(mark[0], mark[2]) < 0.1


PAGES = [(1, "http://a/\r\nx y", "p" * 1000), (2, None, "p" * 1000), (3, "u", None), (4, "u", ""),
         (5, "u", "p" * 999), (6, "u", "p" * 999), (7, "u", "WARC/1.1\r\n\r\n" * 40_000), (8, "u", "é\U0001f642" * 30_000),
         (9, "u", "p" * 1000), (9, "u", "p" * 1000), (None, "u", "without an id"), (10, "u", "0\r\n\r\n")]


def pages_table(spark):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in PAGES],
                                 "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("heavy", [1, 100_000])
def test_archives_round_trip(spark, heavy):
    path = scratch_path(spark, "archives")
    warc.write_archives(pages_table(spark), path)
    found = warc.read_pages(spark, path)
    stored = [(r.page_id or -1, bytes(r.payload).decode()) for r in found.collect() if r.record_type == "response"]
    assert sorted(stored) == sorted((i or -1, h or "") for i, _, h in PAGES if i not in (1, 2))
    records = warc.read_records(spark, path)
    assert records.where("kind = 'continuation'").count() > 20
    assert records.agg(F.max(F.octet_length("block"))).first()[0] <= warc.SEGMENT + 3
    digests = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                     for r in warc.page_digests(found.drop("payload"), heavy).collect())
    assert digests == sorted(
        (i or -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
         "revisit" if i in (1, 2) else "response", 9 if i in (1, 2) else None) for i, _, h in PAGES)


@pytest.mark.parametrize("heavy", [1, 100_000])
def test_copies_are_told_whether_groups_are_heavy_or_not(spark, heavy):
    rows = warc.with_roles(pages_table(spark), heavy=heavy).select("page_id", "refers_to", "place").collect()
    assert sorted((r.page_id or -1, r.refers_to, r.place) for r in rows) == sorted(
        (i or -1, 9 if i in (1, 2) else None, k) for i, k in
        [*((i, 1) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None)), (9, 2)])


def test_a_strict_reader_resolves_every_revisit(spark):
    path = scratch_path(spark, "archives")
    warc.write_archives(pages_table(spark), path)
    records = warc.read_records(spark, path).collect()
    names = [r.record_id for r in records]
    assert len(names) == len(set(names))
    by_name = {r.record_id: r for r in records}
    revisits = [r for r in records if r.kind == "revisit"]
    assert len(revisits) == 2
    for r in revisits:
        named = by_name[r.refers_record]
        assert named.kind == "response" and named.digest == r.digest and named.page_id == 9
    assert all(by_name[r.origin].segment == 1 for r in records if r.kind == "continuation")


def test_a_revisit_of_nothing_raises(spark):
    path = scratch_path(spark, "archives")
    warc.write_archives(pages_table(spark), path)
    found = warc.read_pages(spark, path).drop("payload")
    for broken in (found.where("page_id <> 9"), found.withColumn("payload_digest", F.lit("0")).where(
            "record_type = 'response'").unionByName(found.where("record_type = 'revisit'")),
            found.unionByName(found.where("page_id = 9"))):
        with pytest.raises(Exception, match="names no response"):
            warc.page_digests(broken).collect()


def test_no_pages(spark):
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 0


def test_segments_and_framing_are_checked():
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c")]
    assert warc.put_together(parts) == b"abc"
    for bad in (parts[:2], parts[1:], parts + parts[:1], [(1, 9, b"a")]):
        with pytest.raises(ValueError):
            warc.put_together(bad)
    body = warc.framed("héllo".encode() * 3000)
    assert warc.unframed(body) == "héllo".encode() * 3000
    with pytest.raises(ValueError):
        warc.unframed(body[:-40])
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")))


def test_archive_query_equals_its_sql(spark, sf, con):
    assert oracle.compare(queries.QUERIES["op4_warc"](spark, sf), con, queries.ORACLES["op4_warc"]) is None
