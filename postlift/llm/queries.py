"""The registered queries over the text tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize, scratch_path
from . import (byte_bpe, decontaminate, fingerprints, id_files, ngram_join, pii, shards, suffix_tree,
               token_counts, toxicity, turn_repair, turn_trie, warc)

PATTERN = public_tokenizers.PATTERN
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def id_remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def vocabulary(name: str) -> bytes:
    """A vocabulary file's bytes, read on the driver."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


#: DuckDB: the words of a text, A-Z lower-cased.
WORDS = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
         "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         "'[\\x20\\x09-\\x0D]+'), lambda w: w <> '')")


def shingles_sql(table_name: str, key: str) -> str:
    """DuckDB: distinct five-word shingles of every row; a shorter text is one, a blank one none."""
    return f"""
        SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN []
            WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM (SELECT {key}, {WORDS} AS w FROM {table_name})"""


@query("op1_decontamination", f"""
    WITH d AS ({shingles_sql('documents', 'doc_id')}), i AS ({shingles_sql('benchmark', 'item_id')}),
    n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
    SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
    FROM i JOIN d USING (s) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, n_item HAVING count(*) * 10 >= n_item * 8""")
def op1_decontamination(spark, sf):
    return decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_fingerprints")
def op2_fingerprints(spark, sf):
    return fingerprints.fingerprint_documents(table(spark, sf, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark, sf):
    counted = token_counts.count_tokens(table(spark, sf, "documents"),
                                        vocabulary("byte_bpe_50k.json"), PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op4_warc", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
        CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""")
def op4_warc(spark, sf):
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.page_digests(materialize(warc.read_pages(spark, path).drop("payload"), "pages"))


@query("op5_suffix_tree")
def op5_suffix_tree(spark, sf):
    return suffix_tree.score_documents(table(spark, sf, "documents"), id_remainder(10) == 0)


@query("op6_shards")
def op6_shards(spark, sf):
    return shards.shard_documents(table(spark, sf, "documents"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf):
    coded = byte_bpe.encode_documents(
        table(spark, sf, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
        PATTERN, decoded="bytes")
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(joined, 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op8_ngram_jaccard", f"""
    WITH RECURSIVE s AS ({shingles_sql('documents', 'doc_id')}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s)
          WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
    FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op8_ngram_jaccard(spark, sf):
    return ngram_join.jaccard_components(table(spark, sf, "documents"))


def written_spans(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op9_pii")
def op9_pii(spark, sf):
    docs = table(spark, sf, "documents")
    tagged = pii.tag_documents(docs, pii.fit_documents(docs))
    counts = [count_kind("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return tagged.select("doc_id", *counts, F.sha2(written_spans("base"), 256).alias("base_sha256"),
                         written_spans("spans").alias("spans"))


@query("op10_toxicity")
def op10_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit_documents(docs, table(spark, sf, "labels"), id_remainder(5) != 0)
    return toxicity.score_documents(docs, model).select(
        "doc_id", (id_remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned crc32 of an ASCII text, byte by byte over the table of the polynomial."""
    table = ("list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
             "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), "
            f"lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1])))")


# States 0 to 3: nothing yet, after s, after u, after a.  The last place costs what inserts cost there;
# step by step towards the first row, a state takes up to two inserts (i of them, to state m), then
# one edit of the row (to state q).
@query("op11_turn_repair", f"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
        FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
            CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM raw WHERE fate <> 0),
    placed AS (
        SELECT *, row_number() OVER c AS place, left(role, 1) AS initial, lag(left(role, 1)) OVER c AS previous,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
        FROM damaged WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    rows_ AS (
        SELECT *, CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2
            WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
    totals AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
            count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (place > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM rows_ GROUP BY conv_id),
    inserts(s, m, price, letters) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''),
        (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
    edits(m, q, letter, price, initial) AS (VALUES (0, 0, 'D', 2, NULL), (1, 1, 'D', 2, NULL),
        (2, 2, 'D', 2, NULL), (3, 3, 'D', 2, NULL), (0, 2, 'R', 1, NULL), (1, 2, 'R', 1, NULL),
        (3, 2, 'R', 1, NULL), (2, 3, 'R', 1, NULL), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'),
        (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a')),
    best AS (
        SELECT conv_id, n + 1 AS place, s, CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost,
            CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
        FROM totals, (VALUES (0), (1), (2), (3)) AS t(s)
        UNION ALL
        SELECT conv_id, place, s, won.cost, won.audit FROM (
            SELECT b.conv_id, r.place, i.s, min({{'cost': b.cost + i.price + e.price
                    + CASE WHEN r.fault = 3 AND e.letter <> 'D' THEN 5 ELSE 0 END,
                'audit': i.letters || e.letter || b.audit}}) AS won
            FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.place = b.place - 1
            JOIN edits e ON e.q = b.s AND (e.initial IS NULL OR e.initial = r.initial)
                AND (e.letter = 'D' OR r.fault NOT IN (1, 2))
            JOIN inserts i ON i.m = e.m GROUP BY b.conv_id, r.place, i.s)),
    chosen AS (SELECT conv_id, cost, audit FROM best WHERE place = 1 AND s = 0),
    walk AS (
        SELECT conv_id, audit, 0 AS step, 1 AS place, NULL::VARCHAR AS wrote, '' AS last FROM chosen
        UNION ALL
        SELECT w.conv_id, w.audit, w.step + 1, w.place + CASE WHEN letter = 'I' THEN 0 ELSE 1 END,
            CASE letter WHEN 'D' THEN NULL WHEN 'K' THEN r.role || ':' || r.text
                WHEN 'R' THEN next || ':' || r.text ELSE next || ':' END,
            CASE letter WHEN 'D' THEN w.last WHEN 'K' THEN r.initial ELSE left(next, 1) END
        FROM (SELECT *, substr(audit, step + 1, 1) AS letter,
                CASE last WHEN 'u' THEN 'assistant' ELSE 'user' END AS next FROM walk) w
        LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place
        WHERE w.step < length(w.audit)),
    texts AS (SELECT conv_id, string_agg(wrote, chr(10) ORDER BY step) AS repaired FROM walk GROUP BY conv_id)
    SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
        coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) k
    LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
    LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
    LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM k.conv_id""")
def op11_turn_repair(spark, sf):
    damaged = turn_repair.damage(table(spark, sf, "conversations"))
    return turn_repair.audit_conversations(damaged, "present")


@query("op12_turn_trie", f"""
    WITH t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
            {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM t GROUP BY conv_id),
    heads AS (SELECT conv_id, turns, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM own),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
        FROM heads c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5),
    prefixes AS (
        SELECT conv_id, d, turns[1:d] AS prefix, d = len(turns) AS is_end
        FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
    nodes AS (
        SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), ''))
            AS ends_sha256 FROM prefixes GROUP BY prefix, d),
    linked AS (
        SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children,
            (n.n_convs - 1) * CASE WHEN n.d > 0 THEN octet_length(encode(n.prefix[n.d].text)) ELSE 0 END AS saves
        FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
        LEFT JOIN (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0
                   GROUP BY ALL) k ON k.d = n.d AND k.prefix = n.prefix),
    below AS (
        SELECT a.up, n.prefix[1:a.up] AS prefix, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum(n.saves) AS saved_tokens
        FROM linked n, LATERAL (SELECT unnest(range(n.d + 1)) AS up) a GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, n.parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
        b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM linked n JOIN below b ON b.up = n.d AND b.prefix = n.prefix""")
def op12_turn_trie(spark, sf):
    return turn_trie.conversation_trie(table(spark, sf, "conversations"))


@query("op13_id_files")
def op13_id_files(spark, sf):
    path = scratch_path(spark, "token-ids")
    id_files.write_ids(table(spark, sf, "documents"), path, vocabulary("byte_bpe_50k.json"), PATTERN)
    return id_files.with_starts(id_files.read_ids(spark, path)).select(
        "doc_id", "start", "n_tokens", "ids_crc32")
