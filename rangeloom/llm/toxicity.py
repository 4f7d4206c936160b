"""Toxicity by a classifier chain of sparse linear models over hashed words.

Categories are predicted in order. The linear model of a category sees the words of a text and the probabilities of the
categories before it; in training these are out-of-fold predictions, so that a later model learns from probabilities of
the quality it will meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .textkit import PUNCTUATION, Texts, U, slices


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words of each text, ordered by text."""
    doc, h = texts.doc_of_words(), texts.hash
    _, at = np.unique(h + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15), return_index=True)
    at.sort()
    return doc[at], h[at]


def _read(column: pa.Array) -> Texts:
    return Texts(column, lower=True, separators=PUNCTUATION)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = _read(batch.column("text"))
        doc, h = _words(texts)
        cuts = (np.searchsorted(doc, np.arange(texts.n + 1)) * 8).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer(cuts), pa.py_buffer(h.tobytes())])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), words], names=[*(c for c in batch.schema.names if c != "text"), "words"])


class Linear:
    """Logistic regression on chosen words and on dense columns (earlier probabilities)."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.words, self.weights, self.dense, self.bias = words, weights, dense, bias

    def probability(self, doc: np.ndarray, h: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            z += np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=n)
        if dense.shape[1]:
            z += dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(doc: np.ndarray, h: np.ndarray, n: int, dense: np.ndarray, y: np.ndarray, *, features: int, least: int = 4, ridge: float = 1.0, steps: int = 200) -> Linear:
    """Words by G-test against ``y`` (in ``least`` texts at least), weights by accelerated gradient steps on the ridge-penalised log loss."""
    words, index = np.unique(h, return_inverse=True)
    have = np.bincount(index, minlength=len(words)).astype(float)
    pos = np.bincount(index, weights=y[doc], minlength=len(words))
    share = max(y.mean(), 1e-9) if n else 0.5

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    gain = part(pos, have * share) + part(have - pos, have * (1 - share))
    gain[have < least] = -1
    best = np.argsort(-gain, kind="stable")[:features]
    best = np.sort(best[gain[best] > 2.0])
    place = np.full(len(words), -1)
    place[best] = np.arange(len(best))
    column = place[index]
    use = column >= 0
    row, column = doc[use], column[use]
    width, extra = len(best), dense.shape[1]
    w = np.zeros(width + extra)
    look, momentum = w.copy(), 1.0
    bias = look_bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    # Columns of few texts have little curvature: each column is scaled by its own bound.
    per_row = np.bincount(row, minlength=n) if len(row) else np.zeros(n)
    scale = np.concatenate([4.0 / (np.bincount(column, minlength=width) + 4 * ridge) if width else np.zeros(0), np.full(extra, 4.0 / (n + 4 * ridge))]) / max(1.0, per_row.max() if n else 1) ** 0.5
    for _ in range(steps):
        z = look_bias + np.bincount(row, weights=look[column], minlength=n) + (dense @ look[width:] if extra else 0)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        slope = np.concatenate([np.bincount(column, weights=error[row], minlength=width) if width else np.zeros(0), dense.T @ error if extra else np.zeros(0)]) + ridge * look
        after, after_bias = look - scale * slope, look_bias - 4.0 / (n + 4) * error.sum() / 2
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pull = (momentum - 1) / following
        look, look_bias = after + pull * (after - w), after_bias + pull * (after_bias - bias)
        w, bias, momentum = after, after_bias, following
    return Linear(words[best], w[:width], w[width:], bias)


def fit_chain(doc: np.ndarray, h: np.ndarray, n: int, targets: list[np.ndarray], *, folds: int = 3, features: int = 2000) -> tuple[list[Linear], list[np.ndarray]]:
    """The models of the chain and the out-of-fold probabilities of each category. Row ``i`` is in fold ``i % folds``."""
    dense = np.zeros((n, 0))
    models, unseen = [], []
    fold = np.arange(n) % folds
    for y in targets:
        out = np.zeros(n)
        for f in range(folds):
            rows = np.flatnonzero(fold != f)
            number = np.full(n, -1)
            number[rows] = np.arange(len(rows))
            use = number[doc] >= 0
            model = fit_linear(number[doc[use]], h[use], len(rows), dense[rows], y[rows], features=features)
            test = np.flatnonzero(fold == f)
            number[:] = -1
            number[test] = np.arange(len(test))
            use = number[doc] >= 0
            out[test] = model.probability(number[doc[use]], h[use], len(test), dense[test])
        models.append(fit_linear(doc, h, n, dense, y, features=features))
        unseen.append(out)
        dense = np.column_stack([dense, out])
    return models, unseen


def best_cut(probability: np.ndarray, y: np.ndarray) -> float:
    """The cut of the highest F1 on out-of-fold probabilities, halfway to the next value below; 0.5 without positives."""
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-probability, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(probability[order]) != 0, True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = probability[order][at + 1] if at + 1 < len(y) else 0.0
    return float((probability[order][at] + below) / 2)


def _predict(models: list[Linear]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = _read(batch.column("text"))
            doc, h = _words(texts)
            dense = np.zeros((texts.n, 0))
            for model in models:
                dense = np.column_stack([dense, model.probability(doc, h, texts.n, dense)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(dense[:, i]) for i in range(len(models)))], names=["id", *(f"p{i}" for i in range(len(models)))])

    return run


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, sample_bytes: int = 64 << 20, folds: int = 3, features: int = 2000) -> DataFrame:
    """(id, p_<category>, is_<category> ...) per row of ``docs``.

    ``categories`` maps names, in the order of the chain, to SQL conditions on a label row (a null condition counts as
    false). The models are fitted on at most ``sample_rows`` labelled documents, those of least hash of the id, as
    far as their distinct words take ``sample_bytes`` (8 bytes a word; the first counts always); every
    document is then scored on its whole text. Cuts maximise F1 on out-of-fold probabilities. Texts are lower-cased and
    split at ASCII characters other than letters and digits; null and empty texts have no words and get the base
    probability. Without labels or positives nothing is flagged (cut 0.5 of probability 0). Repeated rows are scored alike; label
    rows that repeat an id are merged (true if any is); rows of null id are scored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    flags = [F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(f"y{i}") for i, c in enumerate(categories.values())]
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*flags)
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    kinds = ", ".join(f"y{i} int" for i in range(len(categories)))
    sample = rows.join(F.broadcast(known), "id").mapInArrow(_sample_rows, f"id long, {kinds}, words binary")  # bounded by sample_rows
    sample = sample.groupBy("id", *[f"y{i}" for i in range(len(categories))]).agg(F.min("words").alias("words"))  # one row of an id that repeats
    sample = cut(sample)
    sizes = sample.select("id", F.xxhash64("id").alias("h"), F.octet_length("words").alias("size")).toPandas().sort_values(["h", "id"])  # bounded by sample_rows
    fits = sizes["size"].cumsum().to_numpy() <= sample_bytes
    fits[:1] = True
    if not fits.all():
        chosen = spark.createDataFrame([(int(x),) for x in sizes["id"][fits]], "id long")
        sample = sample.join(F.broadcast(chosen), "id", "left_semi")
    sample = sample.toPandas().sort_values("id", ignore_index=True)  # bounded by sample_rows and sample_bytes
    found = [np.frombuffer(x, dtype=np.uint64) for x in sample["words"]]
    h = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64)
    targets = [sample[f"y{i}"].to_numpy(dtype=float) for i in range(len(categories))]
    if len(sample) >= folds and any(y.any() for y in targets):
        models, unseen = fit_chain(doc, h, len(sample), targets, folds=folds, features=features)
        cuts = [best_cut(p, y) for p, y in zip(unseen, targets, strict=True)]
    else:
        models, cuts = [Linear(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(i), -40.0) for i in range(len(categories))], [0.5] * len(categories)
    scored = rows.mapInArrow(_predict(models), "id long, " + ", ".join(f"p{i} double" for i in range(len(categories))))
    columns = [c for i, name in enumerate(categories) for c in (F.col(f"p{i}").alias(f"p_{name}"), (F.col(f"p{i}") >= cuts[i]).alias(f"is_{name}"))]
    return scored.select(F.col("id").alias(id_col), *columns)
