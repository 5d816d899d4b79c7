"""A toxicity classifier that is held to equal scores when identity terms are swapped.

Features of a text are its words and the beginnings of its longer words (ASCII letters
lower-cased), with the log of how often they occur.  From labelled rows the features
that tell the classes apart beyond chance are selected; a logistic model over them is
fitted by gradient descent on

    cross entropy + L2 + CF * mean squared score difference of counterfactual pairs.

A pair is a labelled text and the same with its identity terms swapped for others, or,
so that every group term is covered even where the labels mention none, with a term put
in.  Neutral mentions of a group therefore carry next to no score of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .textops import filled, leave_nothing, pieces_of, text_bytes, whole_texts, word_hashes

#: At most so many labelled rows are fitted on (the least hashes of their ids), and features kept.
MOST_ROWS, MOST_FEATURES = 6_000, 2_000
#: Bytes of the word beginnings, and the deviations from chance that select a feature.
WIDTHS, LEAST_Z = (3, 4, 5, 6, 7, 8, 10), 4.0
CF, L2, STEPS, RATE = 4.0, 1e-4, 300, 0.1
#: Group terms, by language; a term is swapped for others of its own.
IDENTITY = {
    "en": ("asian", "black", "buddhist", "christian", "disabled", "elderly", "female", "gay",
           "hindu", "immigrant", "jewish", "latino", "lesbian", "male", "man", "men", "muslim",
           "native", "refugee", "transgender", "white", "woman", "women", "young"),
    "de": ("ausländer", "asiaten", "behinderte", "buddhisten", "christen", "einwanderer", "flüchtlinge",
           "frau", "frauen", "hindus", "juden", "lesben", "mann", "männer", "muslime", "schwarze",
           "schwule", "senioren", "transsexuelle", "weiße"),
    "es": ("ancianos", "asiáticos", "blancos", "budistas", "cristianos", "discapacitados", "extranjeros",
           "hindúes", "hombre", "hombres", "homosexuales", "inmigrantes", "judíos", "lesbianas", "mujer",
           "mujeres", "musulmanes", "negros", "refugiados", "transexuales"),
    "fr": ("asiatiques", "blancs", "bouddhistes", "chrétiens", "femme", "femmes", "handicapés", "hindous",
           "homme", "hommes", "homosexuels", "immigrés", "juifs", "lesbiennes", "musulmans", "noirs",
           "réfugiés", "retraités", "transgenres", "étrangers"),
}
_EDGE = ".,;:!?\"'()"


def feature_hits(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, row) of every word and word beginning, one kind at a time; rows repeat."""
    words, row, begun = word_hashes(data, offs, WIDTHS)
    for h, r in [(words, row), *begun]:
        yield h >> np.uint64(24), r


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of every text, by row and feature."""
    kinds = list(feature_hits(*text_bytes(column)))
    row, feature = (np.concatenate([k[i] for k in kinds]) for i in (1, 0))
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    heads = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (feature[1:] != feature[:-1])][:len(row)])
    return row[heads], feature[heads], np.diff(np.r_[heads, len(row)])


def swapped(text: str, seed: int) -> str:
    """The text with each identity term replaced by another; without one, with a term put in."""
    words = text.split(" ")
    rng = np.random.default_rng(seed)
    own = [w.strip(_EDGE).lower() for w in words]
    found = [i for i, w in enumerate(own) if w in _TERMS]
    for i in found:
        language, place = _TERMS[own[i]]
        step = 1 + int(rng.integers(len(IDENTITY[language]) - 1))
        other = IDENTITY[language][(place + step) % len(IDENTITY[language])]
        words[i] = words[i].lower().replace(own[i], other)
    if not found:
        words.insert(int(rng.integers(len(words) + 1)), list(_TERMS)[int(rng.integers(len(_TERMS)))])
    return " ".join(words)


_TERMS = {w: (language, i) for language, terms in IDENTITY.items() for i, w in enumerate(terms)}


class Rows:
    """Sparse rows over the selected features: (row, place, value)."""

    def __init__(self, column: pa.Array, features: np.ndarray):
        self.size, row, at, count = len(column), [], [], []
        table = np.zeros(1 << 20, bool)
        table[features >> np.uint64(20)] = True
        for f, r in feature_hits(*text_bytes(column)):
            near = np.flatnonzero(table[f >> np.uint64(20)])
            if len(near):
                place = np.minimum(np.searchsorted(features, f[near]), len(features) - 1)
                hit = features[place] == f[near]
                row.append(r[near][hit])
                at.append(place[hit])
        width = max(1, len(features))
        code, count = np.unique(np.concatenate([np.zeros(0, np.int64), *[
            r * width + p for r, p in zip(row, at)]]), return_counts=True)
        self.row, self.at = np.divmod(code.astype(np.int64), width)
        self.value = np.log2(1.0 + np.minimum(count, 7))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.at], self.size)

    def back(self, slopes: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.at, self.value * slopes[self.row], features)


@dataclass
class Model:
    """Selected features (sorted), their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of the toxic label for every text."""
        return _sigmoid(Rows(column, self.features).times(self.weights) + self.bias
                        if len(self.features) else np.full(len(column), self.bias))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss_slope(w: np.ndarray, x: Rows, y: Rows, toxic: np.ndarray, cf: float, l2: float) -> np.ndarray:
    """The loss's slope at weights and bias ``w``."""
    n, wide = len(toxic), len(w) - 1
    balance = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
    p, q = _sigmoid(x.times(w[:-1]) + w[-1]), _sigmoid(y.times(w[:-1]) + w[-1])
    gap = 2 * cf / n * (p - q)
    gp, gq = balance * (p - toxic) + gap * p * (1 - p), -gap * q * (1 - q)
    return np.append(x.back(gp, wide) + y.back(gq, wide) + l2 * w[:-1], (gp + gq).sum())


def fit(x: Rows, y: Rows, toxic: np.ndarray, features: np.ndarray, cf: float = CF, l2: float = L2,
        steps: int = STEPS, rate: float = RATE) -> Model:
    """Weights from rows, their counterfactuals and labels (1: toxic), classes weighted alike."""
    w, m, v = (np.zeros(len(features) + 1) for _ in range(3))
    for step in range(1, steps + 1):
        slope = loss_slope(w, x, y, toxic, cf, l2)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(features, w[:-1], float(w[-1]))


def _prior(positives: float, rows: int) -> Model:
    """Without both classes, or any telling feature: the smoothed share of toxic rows."""
    share = (positives + 0.5) / (rows + 1)
    return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))


def fit_documents(docs: DataFrame, labels: DataFrame, usable: Column | None = None,
                  most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, cf: float = CF) -> Model:
    """Fit on at most ``most_rows`` labelled documents, those with the least hashes of their ids.

    ``usable`` restricts the rows of ``labels`` that may be learnt from.  Feature counts
    and sparse rows come from the workers; the driver holds the selected features'
    entries alone.  Rows without id, text or label are not learnt from; of texts under one
    id the least is.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    chosen = (known.where(usable) if usable is not None else known).select(
        "doc_id", F.col("toxic").cast("double").alias("toxic")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    # At most ``most_rows`` ids and labels.
    rows = materialize(docs.where("text is not null").select("doc_id", "text")
                       .join(F.broadcast(chosen), "doc_id")
                       .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            row, feature, _ = text_features(piece.column("text"))
            label = piece.column("toxic").to_numpy()[row]
            found, place = np.unique(feature, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(found.astype(np.int64)), pa.array(np.bincount(place).astype(np.int64)),
                pa.array(np.bincount(place, label).astype(np.float64))], names=["feature", "held", "toxic"])

    n, positives = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not 0 < positives < n:
        return _prior(positives or 0, n)
    share = positives / n
    # No feature below this count can reach the deviation, so the driver sees few.
    least = LEAST_Z**2 * min(share, 1 - share) / 2
    counts = (rows.mapInArrow(occurrences, "feature long, held long, toxic double")
              .groupBy("feature").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic"))
              .where(F.col("held") >= least))
    gap = F.abs(F.col("toxic") - F.col("held") * share) / F.sqrt(
        F.col("held") * share * (1 - share) * F.greatest(1 - F.col("held") / n, F.lit(1 / n)) + 0.25)
    best = counts.withColumn("z", gap).where(F.col("z") >= LEAST_Z).orderBy(
        F.desc("z"), "feature").limit(most_features).toArrow()
    features = np.sort(best.column("feature").to_numpy().astype(np.uint64))
    if not len(features):
        return _prior(positives, n)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            texts, ids = piece.column("text"), piece.column("doc_id").to_pylist()
            pairs = pa.array([swapped(t, zlib.crc32(str(i).encode())) for t, i in zip(texts.to_pylist(), ids)],
                             pa.large_string())
            out = {"toxic": piece.column("toxic")}
            for name, column in (("own", texts), ("other", pairs)):
                part = Rows(column, features)
                ends = np.searchsorted(part.row, np.arange(len(ids) + 1))
                spans = list(zip(ends[:-1], ends[1:]))
                out[name] = pa.array([part.at[a:b].tolist() for a, b in spans], pa.list_(pa.int32()))
                out[f"{name}_value"] = pa.array([part.value[a:b].tolist() for a, b in spans],
                                                pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(out)

    held = rows.mapInArrow(sparse, "toxic double, own array<int>, own_value array<double>, "
                           "other array<int>, other_value array<double>").toArrow().combine_chunks()
    return fit(_joined(held["own"], held["own_value"]), _joined(held["other"], held["other_value"]),
               held["toxic"].to_numpy(), features, cf)


def _joined(at: pa.ChunkedArray, value: pa.ChunkedArray) -> Rows:
    rows = Rows.__new__(Rows)
    rows.size = len(at)
    rows.row = np.repeat(np.arange(len(at)), [len(a) for a in at.to_pylist()])
    rows.at = pc.list_flatten(at).to_numpy().astype(np.int64)
    rows.value = pc.list_flatten(value).to_numpy()
    return rows


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; only the text is read for the score.

    A null or blank text scores the bias alone; a null ``doc_id`` and repeated rows pass
    through; an empty table gives no rows; other columns are ignored.  No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(model.score(piece.column("text")))],
                names=["doc_id", "score"])

    texts = whole_texts(docs)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns.

    Repeated rows are judged alike, null and blank texts by the bias; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing()
        for piece in pieces_of(batches):
            yield piece.filter(pa.array(model.score(filled(piece.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)
