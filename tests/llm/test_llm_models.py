"""The fitted operators: against brute force, gradients and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlift.llm import pii, queries, suffix_tree, toxicity
from postlift.llm.char_tagger import CharTagger
from tables import EDGE, documents, words

def held_out(modulus=10):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == 0


def held(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus == 0


def base_scores(rows):
    learnt = [t for i, t in rows if i is not None and not held(i, 10)]
    count = collections.Counter(w for t in learnt for w in words(t))
    count["end"] = len(learnt)
    total, kinds = sum(count.values()), sum(c > 0 for c in count.values())
    for i, t in rows:
        own = [count[w] for w in words(t)] + [count["end"]]
        yield (-1 if i is None else i, i is None or held(i, 10), len(own), sum(c > 0 for c in own), total,
               sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in own))


def scored(docs):
    return [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score,
             r.score) for r in suffix_tree.score_documents(docs, held_out()).collect()]


@pytest.mark.parametrize("rows", [EDGE, [(i, None) for i in range(5)], []])
def test_base_scores(spark, rows):
    got = sorted(r[:6] for r in scored(documents(spark, rows)))
    want = sorted(base_scores(rows))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


@pytest.fixture(scope="module")
def tree(spark, sf):
    return suffix_tree.learn(spark.read.parquet(f"{sf}/documents.parquet").select("text"), share=3e-5)


def naive_score(tree, text):
    """Longest state by search, its distribution by recursion."""
    states = [dict() for _ in range(suffix_tree.DEPTH + 1)]
    for depth, context, nxt, n in tree.levels:
        for c, x, k in zip(context.tolist(), nxt.tolist(), n.tolist()):
            states[depth].setdefault(c, {})[x] = k

    def longest(history, most):
        for d in range(min(most, len(history)), -1, -1):
            code = sum(b << (8 * k) for k, b in enumerate(reversed(history[len(history) - d:])))
            if code in states[d]:
                return d, states[d][code]
        return 0, {}

    def probability(history, symbol, most=suffix_tree.DEPTH):
        d, counts = longest(history, most)
        if not d:
            return (counts.get(symbol, 0) + 0.5) / (sum(counts.values()) + 128)
        spared = suffix_tree.DISCOUNT * len(counts)
        return (max(counts.get(symbol, 0) - suffix_tree.DISCOUNT, 0)
                + spared * probability(history, symbol, d - 1)) / sum(counts.values())

    history, total = b"\n" * suffix_tree.DEPTH, 0.0
    for symbol in b" ".join([*words(text), b"\n"]):
        total += math.log10(probability(history, symbol))
        history += bytes([symbol])
    return total, sum(probability(history, s) for s in range(256))


def test_automaton_walks_the_longest_states(tree):
    texts = ["", "the and then", "zzz \x00 qq Ω", "Er the hatthe ing ed. 12"] + [t or "" for _, t in EDGE if t and len(t) < 200]
    got = tree.automaton().scores(pa.array(texts, pa.large_string()))
    for text, score in zip(texts, got):
        want, mass = naive_score(tree, text)
        assert score == pytest.approx(want, rel=1e-4)
        assert mass == pytest.approx(1.0)


def test_lanes_do_not_matter(tree, monkeypatch):
    texts = pa.array([t or "" for _, t in EDGE], pa.large_string())
    whole = tree.automaton().scores(texts)
    monkeypatch.setattr(suffix_tree, "LANES", 7)
    assert tree.automaton().scores(texts) == pytest.approx(whole, rel=1e-4)


def test_states_pass_the_tests_of_share_and_divergence(spark):
    rng = random.Random(5)
    text = [" ".join("".join(rng.choice(["ab", "cd"]) for _ in range(20)) for _ in range(40)) for _ in range(20)]
    tree = suffix_tree.learn(spark.createDataFrame([(t,) for t in text], "text string"), share=1e-3, gain=1e-3)
    found = {(d, int(c)) for d, context, _, _ in tree.levels for c in context}
    # One symbol tells all there is to know: "a" comes before "b", "c" before "d".
    assert (1, ord("a")) in found and (1, ord("c")) in found
    assert not any(d >= 4 for d, _ in found)


def absolute_scores(rows):
    """Scores by a search for the longest state; bounds that do not depend on the corpus."""
    depth, counts = suffix_tree.DEPTH, collections.defaultdict(collections.Counter)
    streams = {i: b"\n" * depth + b" ".join([*words(t), b"\n"]) for i, t in rows}
    for i, s in streams.items():
        if not held(i, 10):
            for at, d in itertools.product(range(depth, len(s)), range(depth + 1)):
                counts[s[at - d:at]][s[at]] += 1

    def is_state(context):
        own, up = counts.get(context, {}), counts[context[1:]]
        total, above = sum(own.values()), sum(up.values())
        return total >= suffix_tree.LEAST_COUNT and sum(
            n * math.log(n / total * above / up[x]) for x, n in own.items()) >= suffix_tree.LEAST_NATS
    states = {c for c in list(counts) if c and is_state(c)}

    def probability(context, symbol):
        if not context:
            return (counts[b""][symbol] + 0.5) / (sum(counts[b""].values()) + 128)
        lower, own = probability(context[1:], symbol), counts.get(context)
        if context not in states:
            return lower
        kept = max(own[symbol] - suffix_tree.DISCOUNT, 0) + suffix_tree.DISCOUNT * len(own) * lower
        return kept / sum(own.values())

    return {i: sum(math.log10(probability(s[at - depth:at], s[at])) for at in range(depth, len(s)))
            for i, s in streams.items()}


def test_scores_follow_the_longest_states_of_absolute_bounds(spark):
    rng = random.Random(9)
    kinds = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(kinds, k=rng.randint(0, 60)))) for i in range(150)] + [(900, "Zq unseen")]
    want = absolute_scores(rows)
    got = {r[0]: r[6] for r in scored(documents(spark, rows))}
    assert got == pytest.approx(want, rel=1e-5)


def test_states_stay_as_the_corpus_grows(spark):
    """A passage met three times is told from its parts, however much else there is."""
    rare = "quixotic zebras jumped"
    learnt = [i for i in range(2000) if not held(i, 10)]
    few = [(i, rare) for i in learnt[:3]] + [(next(i for i in range(2000) if held(i, 10)), rare)]
    filler = " ".join(["one two three four five six seven eight nine ten"] * 400)
    for rest in (learnt[3:6], learnt[3:203]):
        rows = few + [(i, filler) for i in rest]
        score = next(r[6] for r in scored(documents(spark, rows)) if r[1])
        assert score > -0.5 * len(rare)


def test_held_out_text_is_likelier_than_by_word_frequency(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in suffix_tree.score_documents(docs, held_out()).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


# Personal data.

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = random.Random(6)
    parts = ["a", "1", "22", ".", "@", "-", "+", " ", "(", ")", "é", "%", "4111111111111111", "255", "256"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(1)
    tagger = CharTagger(6, 3, 3, 4)
    windows, tags = rng.integers(0, 6, (5, 7)), rng.integers(0, 3, (5, 7))
    _, g = tagger.gradients(windows, tags)
    for name, values in tagger.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in values.shape)
            kept, ends = values[at], []
            for shift in (1e-5, -1e-5):
                values[at] = kept + shift
                ends.append(tagger.gradients(windows, tags)[0])
            values[at] = kept
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[name][at], abs=1e-6)


def test_reconciling_takes_the_heaviest_set():
    rng = np.random.default_rng(2)
    for _ in range(100):
        spans = [(int(a), int(a + rng.integers(1, 6)), "ip", float(rng.uniform(1, 5))) for a in rng.integers(0, 15, 6)]
        best = 0.0
        for mask in range(64):
            chosen = sorted(s for i, s in enumerate(spans) if mask >> i & 1)
            if all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:])):
                best = max(best, sum(s[3] * (s[1] - s[0]) for s in chosen))
        got = sorted(pii.reconcile(spans))
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        assert sum(s[3] * (s[1] - s[0]) for s in got) == pytest.approx(best)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_unseen_writings_are_found_and_plain_numbers_left(tagger):
    rng, found = np.random.default_rng(77), 0
    for i in range(200):
        kind = pii.KINDS[i % 4]
        span = pii.invent(kind, rng)
        text = f"some of the words then {span} and more of them"
        found += any(text[a:b] == span and k == kind for a, b, k in pii.find_spans(tagger, text)[1])
    assert found >= 170
    plain = [t for n in range(200) for t in (f"chapter {n} of the book", f"in {1800 + n} they came", f"version {n % 9}.{n % 7}")]
    assert sum(bool(pii.find_spans(tagger, t)[1]) for t in plain) <= 12


@pytest.mark.parametrize("sign", ["(at)", "[at]"])
def test_addresses_without_digit_or_at_sign_are_found(spark, tagger, sign):
    rng, spans = np.random.default_rng(21), []
    while len(spans) < 40:
        span = pii.invent("email", rng)
        if sign in span and not re.search("[0-9@]", span):
            spans.append(span)
    docs = documents(spark, [(i, f"some of the words then {s} and more of them") for i, s in enumerate(spans)])
    tagged = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.tag_documents(docs, tagger).collect()}
    assert sum(tagged[i] == [(23, 23 + len(s), "email")] for i, s in enumerate(spans)) >= 36
    texts = [r.text for r in pii.redact_documents(docs, tagger).collect()]
    assert sum(t == "some of the words then <email> and more of them" for t in texts) >= 36


def test_every_row_with_a_trigger_is_read():
    texts = ["", "a (at) b", "(AT)", "[aT]", "(a", "t)", "[at", "at", "x (att)", "7", "@", "\u00e9(at)", "(at"]
    want = [bool(pii._TRIGGER.search(t)) for t in texts]
    got = pii._rows_with_triggers(pa.array(texts)).tolist()
    # A sign that two neighbouring rows make up together costs a look, no more.
    assert sum(want) == 6 and all(g or not w for g, w in zip(got, want)) and not got[0] and not got[7]
    # A stretch reaches to the blanks beyond its margin.
    assert pii.stretches("x" * 50 + "(At)" + "y" * 50) == [(0, 104)]
    assert pii.stretches("a b " + "x" * 40 + "7 " + "y" * 30 + " z") == [(4, 76)]


@pytest.mark.parametrize("length", [24, 28, 34, 50, 60])
def test_long_addresses_are_found_whole(tagger, length):
    rng, found = np.random.default_rng(length), 0
    for i in range(40):
        span = "".join(chr(97 + c) for c in rng.integers(0, 26, length)) + ("(at)", "[at]")[i % 2] + "host.org"
        found += (9, 9 + len(span), "email") in pii.find_spans(tagger, f"write to {span} soon please")[1]
    assert found >= 36


def test_every_form_is_found_in_unseen_surroundings(tagger):
    """Forms by what parts their digits; words around them come from no training text."""
    rng, hit, of = np.random.default_rng(5), collections.Counter(), collections.Counter()
    for i in range(1_200):
        kind = pii.KINDS[i % 4]
        span = pii.invent(kind, rng)
        form = kind, "".join(sorted(set(re.sub("[A-Za-z0-9]", "", span)))), " @ " in span
        text = f"zebra quilt over the mound {span} under seven plain lamps"
        of[form] += 1
        hit[form] += (27, 27 + len(span), kind) in pii.find_spans(tagger, text)[1]
    low = {f: (hit[f], of[f]) for f in of if of[f] >= 10 and hit[f] < 0.85 * of[f]}
    # Dashed phone numbers look like dates, which are trained to be left alone.
    assert set(low) <= {("phone", "-", False)} and sum(hit.values()) >= 0.93 * sum(of.values())


def test_spans_of_edge_rows(spark, tagger):
    docs = documents(spark)
    for r in pii.tag_documents(docs, tagger).collect():
        texts = [t or "" for i, t in EDGE if i == r.doc_id]
        base = [tuple(s) for s in r.base]
        assert base in [brute_spans(t) for t in texts] and set(base) <= {tuple(s) for s in r.spans}
    assert pii.tag_documents(documents(spark, []), None).count() == 0


def test_redaction(spark, tagger):
    docs = documents(spark)
    found = {r.doc_id: r for r in pii.redact_documents(docs, None).collect()}
    assert found[12].text == "mail <email> or <ip>, card <card>, call <phone>"
    assert found[12].n_chars == len(found[12].text) and found[1].text is None
    assert pii.redact_documents(docs, None).columns == docs.columns


def test_pii_query(spark, sf, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.QUERIES["op9_pii"](spark, sf).collect():
        base = brute_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert not line or set(line.split(",")) <= set(r.spans.split(","))


# Toxicity.


def labelled(spark, rows):
    return (documents(spark, [(i, t) for i, t, _ in rows]),
            spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))


def biased_rows(n=400):
    """Insults, and a group term that mostly stands beside them."""
    r, rows = random.Random(8), []
    neutral = [f"word{i}" for i in range(200)]
    for i in range(n):
        text, toxic = r.choices(neutral, k=30), i % 3 == 0
        if toxic:
            text[r.randrange(30)] = r.choice(["nasty", "vile", "wretch"])
        if r.random() < (0.8 if toxic else 0.05):
            text[r.randrange(30)] = "women"
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_counterfactual_pairs_free_neutral_mentions(spark):
    docs, labels = labelled(spark, biased_rows())
    mention = pa.array(["word1 women word7 word9", "word1 nasty word7"], pa.large_string())
    plain, fair = (toxicity.fit_documents(docs, labels, cf=cf).score(mention) for cf in (0.0, toxicity.CF))
    assert fair[0] < plain[0] and fair[0] < 0.5 < fair[1]


def test_swapping():
    text = "These Women, and the men"
    for seed in range(20):
        other = toxicity.swapped(text, seed).split(" ")
        assert other[1].strip(",") in toxicity.IDENTITY["en"] and other[1] != "women," and other[4] != "men"
        assert len(toxicity.swapped("no such term", seed).split(" ")) == 4


@pytest.mark.parametrize("language, text", [
    ("de", "Die Männer kamen"), ("es", "Las Mujeres, ayer"), ("fr", "les Étrangers. ici")])
def test_terms_are_swapped_within_their_language(language, text):
    for seed in range(20):
        other = toxicity.swapped(text, seed).split(" ")
        word = other[1].strip(",.")
        assert word in toxicity.IDENTITY[language] and word != text.split(" ")[1].strip(",.").lower()
        assert [other[0], other[2]] == [text.split(" ")[0], text.split(" ")[2]]


def test_terms_belong_to_one_language():
    terms = [w for own in toxicity.IDENTITY.values() for w in own]
    assert len(terms) == len(set(terms)) and all(w == w.lower() for w in terms)


def test_slope_equals_differences_of_the_loss():
    r, wide, rows = random.Random(4), 5, 9
    x, y = (sparse_rows(r, rows, wide) for _ in range(2))
    toxic = np.array([1.0, 0, 0, 1, 0, 0, 1, 0, 0])
    dense = [np.zeros((rows, wide)) for _ in range(2)]
    for d, s in zip(dense, (x, y)):
        d[s.row, s.at] = s.value

    def loss(w, cf, l2):
        p, q = (1 / (1 + np.exp(-(d @ w[:-1] + w[-1]))) for d in dense)
        entropy = -(toxic * np.log(p) / toxic.sum() + (1 - toxic) * np.log(1 - p) / (rows - toxic.sum())).sum() / 2
        return entropy + l2 / 2 * (w[:-1]**2).sum() + cf * ((p - q)**2).mean()

    for cf, l2 in ((0.0, 0.0), (4.0, 0.0), (4.0, 0.3)):
        w = np.array([r.uniform(-1, 1) for _ in range(wide + 1)])
        steps = np.eye(wide + 1) * 1e-6
        by_hand = [(loss(w + e, cf, l2) - loss(w - e, cf, l2)) / 2e-6 for e in steps]
        assert toxicity.loss_slope(w, x, y, toxic, cf, l2) == pytest.approx(by_hand, abs=1e-7)


def sparse_rows(r, rows, wide):
    at = [[k for k in range(wide) if r.random() < 0.6] for _ in range(rows)]
    return toxicity._joined(pa.chunked_array([at], pa.list_(pa.int32())),
                            pa.chunked_array([[[r.uniform(0, 2) for _ in a] for a in at]], pa.list_(pa.float64())))


def test_edge_rows_under_a_model_with_features(spark):
    model = toxicity.fit_documents(*labelled(spark, biased_rows(120)))
    assert len(model.features)
    scores = toxicity.score_documents(documents(spark), model).collect()
    assert len(scores) == len(EDGE) and all(0 <= r.score <= 1 for r in scores)
    empty = [r.score for r in scores if r.doc_id in (1, 2, 3)]
    assert empty == pytest.approx([1 / (1 + np.exp(-model.bias))] * 3)


def test_texts_of_a_repeated_id_do_not_exceed_the_sample(spark):
    rows = biased_rows(60)
    docs, labels = labelled(spark, rows)
    one = toxicity.fit_documents(docs, labels)
    more = docs.unionByName(docs.withColumn("text", F.concat(F.lit("zz later text "), "text")))
    two = toxicity.fit_documents(more, labels)
    assert (one.features == two.features).all() and two.weights == pytest.approx(one.weights)


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = rows.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.predicted == r.toxic for r in found) / len(found) > 0.96
    toxic = [r for r in found if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85


def test_learning_ignores_held_out_labels(spark):
    rows = biased_rows(120)
    usable = ~held_out(5)
    flipped = [(i, t, 1 - y if held(i, 5) else y) for i, t, y in rows]
    one, two = (toxicity.fit_documents(*labelled(spark, r), usable) for r in (rows, flipped))
    assert (one.features == two.features).all() and one.weights == pytest.approx(two.weights)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(None, 1, 1), (2, 1, None), (4, 1, 0)]])
def test_too_few_labels_give_the_prior(spark, labels):
    docs = documents(spark)
    model = toxicity.fit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = [r.score for r in toxicity.score_documents(docs, model).collect()]
    assert len(scores) == len(EDGE) and len(set(scores)) == 1 and 0 < scores[0] < 1
    assert toxicity.score_documents(documents(spark, []), model).count() == 0
    assert toxicity.keep_clean(docs, model, 1.1).count() == len(EDGE)
