"""Token-id files: exact round trips, the library's ids, damage found out."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postlift.llm import context_coder, id_files, queries
from postlift.session import scratch_path
from tables import EDGE, documents
from test_tokens import odd_texts

JSON = queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(tok):
    texts = odd_texts()
    ids, offs = id_files.IdEncoder(JSON, queries.PATTERN).encode(texts, 0)
    for i, found in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        assert ids[offs[i]:offs[i + 1]].tolist() == [*found.ids, 0]


def blocks(ids, sizes):
    offs = np.r_[0, np.cumsum(sizes)]
    return context_coder.encode_blocks(ids, sizes), [
        context_coder.checksum(ids[a:b]) for a, b in zip(offs, offs[1:])]


@pytest.mark.parametrize("kind", ["uniform", "constant", "zipf", "periodic", "extremes", "distinct"])
def test_round_trip(kind):
    r = np.random.default_rng(6)
    n = 20_000
    ids = {"uniform": r.integers(0, 65_536, n), "constant": np.full(n, 65_535),
           "zipf": np.minimum(r.zipf(1.2, n), 65_535), "periodic": np.arange(n) % 97,
           "extremes": r.choice([0, 65_535], n), "distinct": r.permutation(65_536)[:n]}[kind].astype(np.int64)
    sizes = np.array([8192, 0, 1, 3615, 8192])
    words, crcs = blocks(ids, sizes)
    assert (context_coder.decode_blocks(words, sizes, crcs) == ids).all()
    if kind in ("constant", "periodic"):
        assert sum(map(len, words)) < n / 4


def test_blocks_are_read_alone():
    """A block's words depend on its own ids only, and any choice of blocks can be read."""
    r = np.random.default_rng(7)
    sizes = np.array([3000, 500, 8192])
    ids = np.minimum(r.zipf(1.3, sizes.sum()), 60_000).astype(np.int64)
    words, crcs = blocks(ids, sizes)
    assert words[1] == context_coder.encode_blocks(ids[3000:3500], sizes[1:2])[0]
    found = context_coder.decode_blocks([words[2], words[1]], sizes[[2, 1]], [crcs[2], crcs[1]])
    assert (found == np.r_[ids[3500:], ids[3000:3500]]).all()


def test_a_carry_runs_through_full_words():
    """What goes over is added to the words already written, however many of them are full."""
    writer = context_coder._Writer(3, 16, 8)
    full = 2**32 - 1
    for lane, words in enumerate(([7, full, full], [7, 8, 9], [full - 1, full, 1])):
        writer.words[writer.pos[lane]:writer.pos[lane] + 3] = words
    writer.pos += 3
    writer.carry(np.array([0, 2]))
    held = writer.words.reshape(3, -1)[:, :3].tolist()
    assert held == [[8, 0, 0], [7, 8, 9], [full - 1, full, 2]]


def test_many_blocks_of_many_lengths():
    r = np.random.default_rng(10)
    sizes = r.integers(0, 400, 700)
    ids = r.choice([0, 1, 2, 65_535, *r.integers(0, 65_536, 40)], sizes.sum()).astype(np.int64)
    words, crcs = blocks(ids, sizes)
    assert (context_coder.decode_blocks(words, sizes, crcs) == ids).all()
    assert not any(len(w) % 4 for w in words)  # whole words of 32 bits


def test_context_helps():
    """Text of repeated phrases takes fewer bits than its order-0 entropy."""
    r = np.random.default_rng(8)
    phrases = [r.integers(0, 5_000, r.integers(3, 12)) for _ in range(60)]
    ids = np.concatenate([phrases[k] for k in r.integers(0, 60, 2_000)])[:8192].astype(np.int64)
    _, counts = np.unique(ids, return_counts=True)
    entropy = -(counts * np.log2(counts / len(ids))).sum()
    words, _ = blocks(ids, np.array([len(ids)]))
    assert len(words[0]) * 8 < 0.6 * entropy


def test_wider_ids_and_ids_that_do_not_fit():
    ids = np.random.default_rng(9).integers(0, 1 << 18, 2_000)
    words = context_coder.encode_blocks(ids, np.array([2_000]), 18)
    assert (context_coder.decode_blocks(words, np.array([2_000]), [context_coder.checksum(ids)], 18) == ids).all()
    with pytest.raises(ValueError):
        context_coder.encode_blocks(ids, np.array([2_000]), 16)


@pytest.mark.parametrize("place", [0, 1, 100, -1])
def test_damage_is_found_out(place):
    ids = np.arange(3_000) % 777
    words, crcs = blocks(ids, np.array([3_000]))
    bad = bytearray(words[0])
    bad[place - 8 if place < 0 else place] ^= 64
    with pytest.raises(ValueError):
        context_coder.decode_blocks([bytes(bad)], np.array([3_000]), crcs)
    with pytest.raises(ValueError):
        context_coder.decode_blocks([words[0][:50]], np.array([3_000]), crcs)


def test_records_of_long_and_short_documents():
    sizes = [3, 1, 20_000, 1, 8_192 * 2 - 20_005 % 8_192, 5]
    offs = np.r_[0, np.cumsum(sizes)]
    ids = np.arange(offs[-1], dtype=np.int32) % 501
    keys = [None, -5, 7, 7, 8, 9]
    records = id_files.pack_records(keys, ids, offs, False, 16)
    pieces = [p for r in id_files.parse_records(b"".join(r + b"\n" for r in records)) for p in r[3]]
    ends, length = [], 0
    for key, n, done in pieces:
        length += n
        if done:
            ends.append((key, length))
            length = 0
    assert ends == list(zip(keys, sizes)) and not length
    with pytest.raises(ValueError):
        list(id_files.parse_records(b"".join(r + b"\n" for r in records)[:-3]))


def expected(tok, rows):
    out, start = [], 0
    for i, text in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [EDGE, [], [(i % 3, "same words " * 5) for i in range(200)]])
def test_files_give_back_every_document(spark, tok, rows):
    path = scratch_path(spark, "ids")
    id_files.write_ids(documents(spark, rows).repartition(3), path, JSON, queries.PATTERN, file_bytes=20_000)
    got = id_files.with_starts(id_files.read_ids(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(tok, rows)
    if rows:
        held = id_files.read_ids(spark, path, ids=True).where("doc_id is not null").collect()
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in held)


def test_query(spark, sf, tok):
    got = [tuple(r) for r in queries.QUERIES["op13_id_files"](spark, sf).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=str) == expected(tok, rows)


def test_a_block_takes_as_many_steps_as_a_segment_has_ids(monkeypatch):
    """Segments of a block learn together: steps, each a handful of array calls, follow the segment and not the block."""
    steps, predict = [], context_coder._Lanes.predict

    def counted(self, m):
        steps.append(m)
        return predict(self, m)

    monkeypatch.setattr(context_coder._Lanes, "predict", counted)
    ids = np.random.default_rng(11).integers(0, 3_000, 8_192)
    words, crcs = blocks(ids, np.array([8_192]))
    assert sum(steps) == 8_192 and len(steps) <= 256
    assert (context_coder.decode_blocks(words, np.array([8_192]), crcs) == ids).all()
