"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from postlift.llm import byte_bpe, queries, token_counts
from tables import EDGE, documents

RANKS = queries.vocabulary("byte_bpe_50k.tiktoken")
JSON = queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(4)
    parts = ["a", "ab", "é", " ", "  ", "\n", " \n", "\t", "12", "'s", "'LL", "!!", "日", " ", "\x1c",
             "\x85", "ſ", "<|endoftext|>", "the", "-", "_", " "]
    return (["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(1500)]
            + ["".join(r.choice("abcdefghij") for _ in range(20_000)), "aaaa" * 900, "abab" * 700, " " * 50])


def test_counts_equal_the_library(tok):
    texts = odd_texts()
    got = token_counts._Counter(JSON, queries.PATTERN).count(texts)
    assert got.tolist() == [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library_and_decode_back(enc):
    texts = odd_texts()
    coder = byte_bpe._Encoder(RANKS, queries.PATTERN)
    ids, offs = coder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[offs[i]:offs[i + 1]].tolist() == enc.encode_ordinary(text)
    data, ends = coder.vocab.decode(ids, offs)
    assert [bytes(data[a:b]).decode() for a, b in zip(ends, ends[1:])] == texts


def test_a_full_unit_table_gives_the_same(tok, enc, monkeypatch):
    monkeypatch.setattr(token_counts, "_UNITS", 40)
    monkeypatch.setattr(byte_bpe, "_UNITS", 40)
    counter, coder = token_counts._Counter(JSON, queries.PATTERN), byte_bpe._Encoder(RANKS, queries.PATTERN)
    for text in odd_texts()[:300]:
        assert counter.count([text, text])[1] == len(tok.encode(text, add_special_tokens=False).ids)
        assert coder.encode([text])[0].tolist() == enc.encode_ordinary(text)


def test_queue_gives_ranks_in_order():
    queue, r = byte_bpe.RankQueue(50_256), random.Random(1)
    ranks = [r.randrange(50_256) for _ in range(500)]
    queue.push_all(np.array(ranks), np.arange(500))
    popped = []
    while (found := queue.pop()) is not None:
        popped += [found[0]] * len(found[1])
    assert popped == sorted(ranks)


def test_edge_rows(spark, tok, enc):
    docs = documents(spark)
    counted = token_counts.count_tokens(docs, JSON, queries.PATTERN).collect()
    coded = byte_bpe.encode_documents(docs, RANKS, queries.PATTERN, decoded="bytes")
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in counted) == sorted(
        (i or -1, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE)
    got = [(r.doc_id or -1, list(r.ids), bytes(r.bytes)) for r in coded.collect()]
    assert sorted(got) == sorted((i or -1, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in EDGE)
    back = byte_bpe.decode_documents(coded, RANKS, queries.PATTERN).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in EDGE)


def test_empty_table(spark):
    none = documents(spark, [])
    assert token_counts.count_tokens(none, JSON, queries.PATTERN).count() == 0
    assert byte_bpe.encode_documents(none, RANKS, queries.PATTERN).count() == 0


def test_query_digests(spark, sf, con, enc):
    texts = dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in queries.QUERIES["op7_byte_bpe"](spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
