"""Personal data: base patterns plus a character-level BiLSTM with CRF transitions.

Every kind of span holds a digit or an at sign, which may be written ``(at)`` or
``[at]``, so the network reads the stretches around those and nothing else.  A stretch
reaches to the blanks beyond its margin, so the word that holds a sign, however long, is in it,
and it is read whole, in overlapping windows.  Each window is decoded by the CRF; parts of a span that windows
cut are joined, and the proposals of all windows of a stretch are reconciled globally:
the set of spans without overlaps of the greatest total weight wins.  What the patterns
find stays in any case; proposals that touch it are dropped.

The network is trained here, in NumPy, from labelled spans: those the patterns find in a
bounded sample of documents, and invented ones, also in ways of writing that no pattern
covers, set into the sampled surroundings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .char_tagger import CharTagger
from .textops import filled, leave_nothing, pieces_of, text_bytes, whole_texts

KINDS = ("email", "ip", "card", "phone")
#: Network sizes; window, step and margin in characters; most sampled documents and windows.
EMBED, HIDDEN = 8, 16
WINDOW, STEP, MARGIN = 64, 24, 24
SAMPLE_DOCS, SAMPLE_WINDOWS, INVENTED = 20_000, 1_000, 2_800
EPOCHS, BATCH, RATE = 9, 32, 0.03
#: Every so manieth invented line holds a plain number instead of personal data.
PLAIN = 8
#: Mean score per character, above the outside tag, that a proposal must reach.
LEAST_WEIGHT = -1.0

#: What every span that the patterns find holds, and what every span holds.
_BASE_TRIGGER = regex.compile(r"[0-9@]")
_TRIGGER = regex.compile(r"[0-9@]|[(\[][Aa][Tt][)\]]")
_BLANK, _LAST_BLANK = regex.compile(r"\s"), regex.compile(r"(?r)\s")
# The base patterns; possessive runs and the look-behind spare retries inside a run of digits.
_IP = regex.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = regex.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUTS_WORD = regex.compile(r"[A-Za-z0-9]{2}")
_DOMAIN = regex.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    doubled = (2 * int(c) - 9 if int(c) > 4 else 2 * int(c) for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at sign back over its run, forward over its domain."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost matches of each kind, failing ones dropped, by start and kind."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def symbols(text: str) -> np.ndarray:
    """ASCII as itself (controls as 1), other characters as 127; 0 fills windows up."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 32, 1, np.minimum(codes, 127)).astype(np.int64)


def stretches(text: str, trigger=_TRIGGER) -> list[tuple[int, int]]:
    """The parts of a text within ``MARGIN`` of a digit or at sign, however written, up to the next blanks.

    A stretch never ends inside a word.
    """
    out: list[tuple[int, int]] = []
    for m in trigger.finditer(text):
        if out and m.end() + MARGIN <= out[-1][1]:
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        before = _LAST_BLANK.search(text, 0, a)
        a = before.end() if before else 0
        after = _BLANK.search(text, b)
        b = after.start() if after else len(text)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover a stretch."""
    at, out = start, []
    while True:
        out.append((at, min(end, at + WINDOW)))
        if at + WINDOW >= end:
            return out
        at += STEP


def _filled(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), WINDOW), np.int64)
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def proposals(tagger: CharTagger, text: str, stretch: tuple[int, int]
              ) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, weight) of all windows of a stretch.

    A part that its window cuts at the end is joined with a part of its kind that the next
    window cuts at the beginning, if they meet; so a span may be longer than any window.
    """
    places, found = windows_of(*stretch), {}
    codes = symbols(text[stretch[0]:stretch[1]])
    open_parts: list[tuple[int, int, int, float]] = []  # start, end, kind and total weight up to the last window
    for group in range(0, len(places), 256):
        part = places[group:group + 256]
        tags, e = tagger.decode(_filled([codes[a - stretch[0]:b - stretch[0]] for a, b in part]))
        for k, (a, b) in enumerate(part):
            own, gain, left = tags[k, :b - a], e[:b - a, k], []
            kind = (own + 1) // 2
            edges = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (own[1:] % 2 == 1)])
            for i, j in zip(edges.tolist(), np.r_[edges[1:], b - a].tolist()):
                if not kind[i]:
                    continue
                total = float((gain[np.arange(i, j), own[i:j]] - gain[i:j, 0]).sum())
                start, end = a + i, a + j
                if i == 0 and a > stretch[0]:
                    joined = [p for p in open_parts if p[2] == kind[i] and p[0] < a <= p[1]]
                    if not joined:
                        continue
                    first, seen, _, before = max(joined, key=lambda p: p[1])
                    fresh = np.arange(min(max(seen - a, i), j), j)
                    total = before + float((gain[fresh, own[fresh]] - gain[fresh, 0]).sum())
                    start, end = first, max(end, seen)
                if j == b - a and b < stretch[1]:
                    left.append((start, end, int(kind[i]), total))
                else:
                    found.setdefault((start, end, KINDS[kind[i] - 1]), []).append(total / (end - start))
            open_parts = left
    return [(*key, float(np.mean(w))) for key, w in found.items()]


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The spans without overlaps of the greatest total weight (by characters)."""
    found = sorted(found, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in found]
    best, take = [0.0], []
    for i, (start, end, _, weight) in enumerate(found):
        before = int(np.searchsorted(ends[:i], start, "right"))
        with_it = best[before] + weight * (end - start)
        take.append((with_it > best[-1], before))
        best.append(max(best[-1], with_it))
    out, i = [], len(found)
    while i:
        taken, before = take[i - 1]
        if taken:
            out.append(found[i - 1])
        i = before if taken else i - 1
    return out[::-1]


def find_spans(tagger: CharTagger | None, text: str, least: float = LEAST_WEIGHT
               ) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans of a text: the base ones and what the network adds."""
    base = base_spans(text)
    added = []
    if tagger is not None:
        held = np.zeros(len(text) + 1, bool)
        for start, end, _ in base:
            held[start:end] = True
        for stretch in stretches(text):
            for start, end, kind, _ in reconcile([
                    p for p in proposals(tagger, text, stretch)
                    if p[3] >= least and not held[p[0]:p[1]].any()]):
                body = text[start:end].strip()
                start += text[start:end].find(body) if body else 0
                stop = start + len(body)
                whole = not _CUTS_WORD.match(text[max(0, start - 1):start + 1]) and not _CUTS_WORD.match(
                    text[stop - 1:stop + 1])
                if body and whole and _TRIGGER.search(body):
                    added.append((start, stop, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def invent(kind: str, rng: np.random.Generator) -> str:
    """A made-up span, in a form the patterns know or another way of writing it."""
    def digits(n):
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def letters(n):
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    def one_of(*forms):
        return forms[int(rng.integers(len(forms)))]

    if kind == "email":
        name = letters(one_of(rng.integers(3, 9), rng.integers(3, 9), rng.integers(9, 64))) + one_of("", ".", "_") + one_of("", digits(2), letters(3) + digits(1))
        host = letters(rng.integers(3, 8)) + one_of("", digits(1)) + one_of("", ".example") + one_of(".com", ".org", ".net")
        return name + one_of("@", "@", "(at)", "[at]", " @ ") + host + ("" if "@" in name else "")
    if kind == "ip":
        mark = one_of(".", ".", ".", "[.]", " . ")
        return mark.join(str(int(n)) for n in rng.integers(1, 255, 4))
    if kind == "card":
        body = one_of("4", "5", "37") + digits(13)
        check = next(c for c in "0123456789" if luhn(body + c))
        number, mark = body + check, one_of("", "", " ", "-", ".", "/")
        return mark.join(number[i:i + 4] for i in range(0, len(number), 4))
    area, middle, last = digits(3), digits(3), digits(4)
    return one_of(f"+1 ({area}) {middle}-{last}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}",
                  f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}")


def plain_number(rng: np.random.Generator) -> str:
    """A made-up number that is no personal data: a year, a count, a date, a clock, a price, a version."""
    def one_of(*forms):
        return forms[int(rng.integers(len(forms)))]

    def upto(n):
        return int(rng.integers(1, n))

    return one_of(f"{1900 + upto(130)}", f"{upto(100)}", f"{upto(100)} of {upto(1000)}", f"{upto(100)}.{upto(100)}",
                  f"{1900 + upto(130)}-{upto(13):02d}-{upto(29):02d}", f"{upto(29)}/{upto(13)}/{1900 + upto(130)}",
                  f"{upto(24):02d}:{upto(60):02d}", f"${upto(1000)},{upto(1000):03d}", f"{upto(100)}%",
                  f"v{upto(10)}.{upto(20)}.{upto(20)}", f"{upto(10**6)}", f"item{upto(1000)}", f"no. {upto(10_000)}")


def tags_of(start: int, end: int, spans) -> np.ndarray:
    """Tags of a window: begin 1 + 2k, continue 2 + 2k, outside 0; spans it cuts continue."""
    out = np.zeros(end - start, np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        if a < end and b > start:
            out[max(a, start) - start:min(b, end) - start] = 2 + 2 * k
            if a >= start:
                out[a - start] = 1 + 2 * k
    return out


def labelled_windows(docs: DataFrame, most_docs: int, most_windows: int) -> list[tuple[str, bytes]]:
    """(text, tags) of windows around digits and at signs in a bounded sample of documents.

    Both samples go by the least hashes, so they do not depend on the partitioning.  Only what
    the patterns could find is labelled, so written-out at signs are no reason to take a window.
    """
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    # At most ``most_docs`` ids.
    sample = whole_texts(docs).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            found = []
            for text in piece.column("text").to_pylist():
                if not _BASE_TRIGGER.search(text):
                    continue
                spans = base_spans(text)
                for stretch in stretches(text, _BASE_TRIGGER):
                    for a, b in windows_of(*stretch):
                        near = [s for s in spans if s[0] < b and s[1] > a]
                        found.append((text[a:b], tags_of(a, b, near).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())],
                names=["window", "tags"])

    rows = sample.mapInArrow(run, "window string, tags binary").distinct()
    return [tuple(r) for r in rows.orderBy(F.xxhash64("window"), "window", "tags").limit(most_windows).collect()]


def train_tagger(sample: list[tuple[str, bytes]], invented: int = INVENTED, epochs: int = EPOCHS,
                 seed: int = 5) -> CharTagger:
    """Train on sampled windows and on invented lines set into their outside text."""
    rng = np.random.default_rng(seed)
    texts = [symbols(t) for t, _ in sample]
    tags = [np.frombuffer(g, np.uint8).astype(np.int64) for _, g in sample]
    for i in range(invented):
        if sample:
            text, own = sample[int(rng.integers(len(sample)))]
            around = "".join(c for c, g in zip(text, own) if not g and not _TRIGGER.match(c))
        else:
            around = "words on either side of a span of some kind in a text"
        kind = KINDS[i % len(KINDS)] if i % PLAIN else None
        span = invent(kind, rng) if kind else plain_number(rng)
        at = int(rng.integers(0, max(1, len(around) - 1)))
        left, right = around[:at].rstrip()[-max(24, WINDOW - len(span)):], around[at:].lstrip()
        line = (left + " " if left else "") + span + (" " + right if right else "")
        start = len(left) + 1 if left else 0
        if len(span) + 24 < WINDOW:
            shift = max(0, min(start, start + len(span) - WINDOW + int(rng.integers(0, 12))))
        else:  # a long span's windows show its beginning, its middle or its end
            shift = int(rng.integers(max(0, start - 24), start + len(span) - 24))
        line = line[shift:shift + WINDOW]
        texts.append(symbols(line))
        tags.append(tags_of(0, len(line), [(start - shift, start - shift + len(span), kind)] if kind else []))
    tagger = CharTagger(128, 1 + 2 * len(KINDS), EMBED, HIDDEN)
    tagger.train(_filled(texts), _filled(tags), epochs, BATCH, RATE)
    return tagger


def fit_documents(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_windows: int = SAMPLE_WINDOWS) -> CharTagger:
    return train_tagger(labelled_windows(docs, most_docs, most_windows))


def _rows_with_triggers(column: pa.Array) -> np.ndarray:
    data, offs = text_bytes(column)
    near = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    begun = np.flatnonzero((data == 40) | (data == 91))
    begun = begun[begun + 3 < len(data)]
    after = [data[begun + k] | 32 for k in (1, 2)]
    begun = begun[(after[0] == 97) & (after[1] == 116) & ((data[begun + 3] == 41) | (data[begun + 3] == 93))]
    near = np.concatenate([near, begun])
    out = np.zeros(len(column), bool)
    out[np.searchsorted(offs, near, "right") - 1] = True
    return out


def tag_documents(docs: DataFrame, tagger: CharTagger | None, least: float = LEAST_WEIGHT) -> DataFrame:
    """(doc_id, base, spans) of every whole text: arrays of (start, end, kind) in code points.

    ``base`` holds what the patterns find, ``spans`` that and the network's additions.
    A null or empty text has none; a null ``doc_id`` and repeated rows pass through; an
    empty table gives no rows; other columns are ignored.  No shuffle.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            base, spans = [[]] * piece.num_rows, [[]] * piece.num_rows
            for i in np.flatnonzero(_rows_with_triggers(piece.column("text"))).tolist():
                base[i], spans[i] = find_spans(tagger, piece.column("text")[i].as_py(), least)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *[pa.array([[dict(zip(("start", "end", "kind"), s)) for s in row]
                                                     for row in column], span) for column in (base, spans)]],
                names=["doc_id", "base", "spans"])

    texts = whole_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    struct = "array<struct<start:bigint,end:bigint,kind:string>>"
    return texts.mapInArrow(run, f"doc_id {kind}, base {struct}, spans {struct}")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones together, replaced by the kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, tagger: CharTagger | None, least: float = LEAST_WEIGHT) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; null texts stay null, ``n_chars`` follows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            at = piece.schema.get_field_index("text")
            whole, texts = filled(piece.column(at)), None
            for i in np.flatnonzero(_rows_with_triggers(whole)).tolist():
                text = whole[i].as_py()
                spans = find_spans(tagger, text, least)[1]
                if spans:
                    texts = texts if texts is not None else piece.column(at).to_pylist()
                    texts[i] = redacted(text, spans)
            if texts is not None:
                piece = piece.set_column(at, piece.schema.field(at), pa.array(texts, piece.column(at).type))
            yield piece

    found = docs.mapInArrow(run, docs.schema)
    return found.withColumn("n_chars", F.char_length("text").cast(found.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else found
