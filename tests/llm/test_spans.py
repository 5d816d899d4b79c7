"""Tables of byte spans: the same numbers as a dictionary gives; units and pre-tokens: the library's ids."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postlift.llm import id_files, queries, spans


def laid_out(words):
    lengths = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


@pytest.mark.parametrize("kept_bits", [64, 2, 0])
def test_spans_are_told_apart_whatever_their_hashes(monkeypatch, kept_bits):
    """Also where hashes say little or nothing, and after the table was full."""
    plain = spans._words_of

    def poorer(*args):
        words, hashes = plain(*args)
        return words, hashes >> np.uint64(64 - kept_bits) if kept_bits else np.zeros_like(hashes)

    monkeypatch.setattr(spans, "_words_of", poorer)
    r = np.random.default_rng(3)
    words = [b"a", b"a\0", b"a\0\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"x" * 32, b"x" * 33, b"y" * 3000,
             *(bytes(r.integers(97, 100, r.integers(1, 40)).astype(np.uint8)) for _ in range(300))]
    table, by_number = spans.SpanTable(200), []
    for _ in range(6):
        kept = table.shrink()
        if kept is not None:
            by_number = [by_number[k] for k in kept]
        some = [words[k] for k in r.integers(0, len(words), 150)]
        numbers, fresh = table.number(*laid_out(some))
        by_number += [some[i] for i in fresh]
        assert [by_number[k] for k in numbers] == some
        assert kept_bits < 64 or len(set(by_number)) == len(by_number)


def test_ids_of_odd_texts_equal_the_library():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [" ", " ", " ", "  ", "\n", "\t", "\r\n", " ", "\u0085", " ", "　", " ", " ", "\x1c",
             "\0", "a", "Word", "été", "à", "Ã", "×", "÷", "ß", "ÿ", "’s", "'s", "'ll", "'", "12", "Ⅷ", "²", "中文", "🙂", ".", "—",
             "_", "…", "¿", "<|endoftext|>", "<|endo"]
    r = np.random.default_rng(4)
    texts = ["".join(parts[k] for k in r.integers(0, len(parts), r.integers(0, 14))) for _ in range(4_000)]
    encoder = id_files.IdEncoder(queries.vocabulary("byte_bpe_50k.json"), queries.PATTERN)
    for some in (texts, [t for t in texts if "<|endoftext|>" not in t]):
        ids, offs = encoder.encode(some, 0)
        for i, found in enumerate(tok.encode_batch(some, add_special_tokens=False)):
            assert ids[offs[i]:offs[i + 1]].tolist() == [*found.ids, 0], some[i]
