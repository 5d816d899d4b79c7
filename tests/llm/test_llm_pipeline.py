"""The stages in a row, each against what it must keep or change."""

import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from postlift.llm import ngram_join, textops, toxicity
from postlift.session import materialize
from tables import EDGE, documents, shingles, words


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's input and output over the smallest tables."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "stage")
        seen[name] = (docs, out)
        docs = out
    return seen


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(spark, stages, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram jaccard join", "benchmark decontamination", "personal data", "byte-level bpe"]
    for name, (before, after) in stages.items():
        if name != "byte-level bpe":
            assert after.dtypes == before.dtypes


def test_toxic_documents_go_and_the_rest_stays_as_it_was(spark, stages, sf):
    before, after = (rows(x) for x in stages["toxicity"])
    model = toxicity.fit_documents(spark.read.parquet(f"{sf}/documents.parquet"),
                                   spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score_documents(stages["toxicity"][0], model).collect()}
    assert set(after) == {i for i in before if scores[i] < 0.5}
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_every_group_stays(stages):
    before, after = (rows(x) for x in stages["n-gram jaccard join"])
    sets = {i: shingles(r.text) for i, r in before.items()}
    label = {i: i for i in sets}

    def find(i):
        return i if label[i] == i else find(label[i])

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    assert set(after) == {i for i in ids if find(i) == i}


def test_documents_with_test_items_go(spark, stages, sf):
    before, after = (rows(x) for x in stages["benchmark decontamination"])
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i for i, r in before.items() if any(
        10 * len(s & shingles(r.text)) >= 8 * len(s) for s in items if s)}
    assert held and set(after) == set(before) - held


def test_personal_data_is_replaced(stages):
    before, after = (rows(x) for x in stages["personal data"])
    assert set(before) == set(after)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(mail.search(r.text) for r in before.values())
    for i, r in after.items():
        assert not mail.search(r.text) and r.n_chars == len(r.text)
        if not re.search(r"[0-9@]", before[i].text):
            assert r == before[i]


def test_ids_are_those_of_the_texts(stages):
    import base64
    import tiktoken
    before, after = (rows(x) for x in stages["byte-level bpe"])
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: list(r.ids) for i, r in after.items()} == {
        i: enc.encode_ordinary(r.text) for i, r in before.items()}


def test_repeated_ids_keep_one_row(spark):
    kept = ngram_join.keep_one(documents(spark, EDGE + EDGE))
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [-1, -1, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13]


def test_words_helper_is_the_contract():
    assert words("A b\tC\x0bé") == [b"a", b"b", b"c", "é".encode()]


def test_batches_to_python_are_bounded_by_their_bytes(spark, sf):
    """Long texts pass to and from Python in batches of some MB, not ten thousand rows at a time."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text")
    corpus_pipeline.encode(spark, docs, sf)
    found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 40_000_000 and max(found) < 8_000_000


def test_a_worker_gives_its_table_and_freed_memory_back():
    """The table of another operator is gone before the next is built, and its memory returned."""
    released = []
    textops.worker_latest("first", lambda: np.ones(10))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(textops, "give_back", lambda: released.append(textops.worker_cache("latest", dict).copy()))
        textops.worker_latest("second", lambda: np.ones(10))
    assert released == [{}]
    textops.give_back()
    textops.leave_nothing()


def test_hashing_takes_scratch_in_proportion_to_a_step():
    """Tables and scratch arrays of the word hashes stay at some MB; rows longer than a step hash alike."""
    text = "some words and more of them " * 70_000
    data, offs = textops.text_bytes(pa.array([text]))
    textops.worker_cache("word tables", textops._tables)
    tracemalloc.start()
    hashes, row = textops.word_hashes(data, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32_000_000 and sum(t.nbytes for t in textops._tables()) < 8_000_000
    assert len(hashes) == 6 * 70_000 and (hashes.reshape(-1, 6) == hashes[:6]).all() and not row.any()
