"""Small document tables with the awkward rows every operator must take."""

LONG = "".join(chr(97 + i * 7 % 26) for i in range(30_000))

EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "Two words"), (5, "a b c d e f g h"), (5, "a b c d e f g h"),
    (6, LONG), (7, "many words of one kind " * 3_000), (None, "a row without an id but with five words"),
    (8, "A B c d\te F g h"), (9, "café \U0001f642 naïve 日本語 ٠١ x'll  don't"),
    (10, "  leading and  double   blanks \n\n and a line\n"), (11, "<|endoftext|>a<|endoftext|>"),
    (12, "mail bob.smith@example.org or 10.0.0.255, card 4111 1111 1111 1111, call +1 (415) 555-2671"),
    (13, "0" * 5_000 + "@" + "a" * 5_000),
]

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, chunk int, n_tokens long, shard int, spans string")


def documents(spark, rows=None):
    """A documents table with columns whose names the operators use themselves."""
    rows = EDGE if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 9.0, 7, 5, 3, "x") for i, t in rows], SCHEMA)


def words(text):
    lower = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return lower.split()


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
