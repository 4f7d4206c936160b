"""Quality rules: a few counts per text, and the log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .textkit import SPACE, Texts, U, group_starts, slices

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Trusted ids that go to the tasks as one sorted array (32 MB); more of them are joined with the documents.
TRUSTED_IDS = 4_000_000
#: Scores that come to the driver at once, and bins that split more of them.
SCORES = 1 << 18
BINS = 1 << 10


def _grams(texts: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash slot) of every word and every pair of neighbouring words."""
    _, pair_doc, pairs = texts.windows(2)
    h = np.concatenate([texts.hash, pairs]) >> U(64 - bits)
    return np.concatenate([texts.doc_of_words(), pair_doc]), h.astype(np.int64)


def _among(ids: pa.Array, trusted: np.ndarray) -> np.ndarray:
    """Which of ``ids`` are in ``trusted`` (ascending); a null is not."""
    if not len(trusted):
        return np.zeros(len(ids), dtype=bool)
    x = ids.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(trusted, x), len(trusted) - 1)
    return (trusted[at] == x) & ids.is_valid().to_numpy(zero_copy_only=False)


def _counts(bits: int, trusted: np.ndarray | None) -> callable:
    """Per task: how often each slot occurs in all its texts and in the trusted ones, which the column ``fit`` names where no ids are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(1 << bits, dtype=np.int64) for _ in range(2))
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"))
            doc, slot = _grams(texts, bits)
            raw += np.bincount(slot, minlength=1 << bits)
            fit = batch.column("fit").to_numpy(zero_copy_only=False) if trusted is None else _among(batch.column("id"), trusted)
            target += np.bincount(slot[fit[doc]], minlength=1 << bits)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["slot", "raw", "target"])

    return run


def _per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def repeated_lines(texts: Texts) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of their text."""
    size = len(texts.buf)
    feed = np.flatnonzero(texts.buf == 0x0A)
    starts = np.unique(np.concatenate([texts.at[:-1], feed + 1]))
    starts = starts[starts < size]
    doc = np.searchsorted(texts.at, starts, side="right") - 1
    ends = np.minimum(np.append(feed, size)[np.searchsorted(feed, starts)], texts.at[doc + 1])
    words = np.concatenate([[0], np.cumsum(texts.in_word)])
    full = words[ends] > words[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    h = texts.runs(starts, ends) + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    order = np.argsort(h)
    first = group_starts(h[order])
    return _per_doc(doc, texts.n) - _per_doc(doc[order[first]], texts.n)


def repeated_words(texts: Texts, k: int = 8) -> np.ndarray:
    """Words that lie in a ``k``-word window found at least twice in their text, the first find included."""
    first, doc, h = texts.windows(k)
    h = h + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    order = np.argsort(h)
    starts = group_starts(h[order])
    sizes = np.diff(np.append(starts, len(h)))
    again = first[order[np.repeat(sizes > 1, sizes)]]
    turn = np.zeros(len(texts.start) + 1, dtype=np.int64)
    np.add.at(turn, again, 1)
    np.add.at(turn, again + k, -1)
    covered = np.cumsum(turn)[:-1] > 0
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[texts.w0])


def _score(bits: int, ratio: np.ndarray, carry: tuple[str, ...] = ()) -> callable:
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"))
            doc, slot = _grams(texts, bits)
            total = np.bincount(doc, weights=ratio[slot], minlength=texts.n)
            score = total / np.maximum(np.bincount(doc, minlength=texts.n), 1)
            points = texts.per_text(~SPACE[texts.buf] & ((texts.buf & 0xC0) != 0x80))
            columns = [texts.n_words, points, texts.per_text(_SYMBOL[texts.buf]), repeated_lines(texts), repeated_words(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(score), *(batch.column(c) for c in carry)], names=names)

    return run


def _at(values: DataFrame, place: int) -> float:
    """The value at ``place`` (from 0) in the order of the column ``score``: counts by bins lead to the part that holds it."""
    low, high, n = values.agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    if low == high:
        return low
    if n <= SCORES:
        return float(np.sort(values.toArrow()["score"].to_numpy())[place])  # at most SCORES rows
    bin_of = F.floor((F.col("score") - low) / (high - low) * BINS)
    for here, size in sorted(values.groupBy(bin_of).count().collect()):  # at most BINS + 1 rows, two at least
        if place < size:
            break
        place -= size
    return _at(values.filter(bin_of == here), place)


def quantiles(values: DataFrame, shares: list[float]) -> list[float]:
    """Exact quantiles of the column ``score`` (finite, one row at least), linear between neighbours, for any number of rows."""
    n = values.count()
    if n <= SCORES:
        return np.quantile(values.toArrow()["score"].to_numpy(), shares).tolist()  # at most SCORES rows
    found = []
    for place in ((n - 1) * share for share in shares):
        low, high = _at(values, math.floor(place)), _at(values, math.ceil(place))
        found.append(low + (high - low) * (place - math.floor(place)))
    return found


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 16, tail: float = 0.001, margin: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, threshold, base_failed, kept) per row.

    ``score`` is the mean over a text's words and word pairs of log p_trusted / p_raw, both multinomials over
    2**``bits`` hash slots with add-one smoothing: raw counts come from every document, and every row labelled
    ``quality`` = 1 is used, by a hash of its id in one of two ways. One half gives the trusted counts. The other half,
    never fitted on, sets the threshold: its exact ``tail`` quantile less ``margin`` times the distance from its median
    to that quantile, so the method only rejects what lies well outside trusted text. ``kept`` is false where the base
    rules fail (n_words < 20 or 100 * n_repeat_words > 30 * n_words) or the score is below the threshold. Without trusted
    rows only the base rules decide. A null or empty text has no words and fails the base rules. Repeated rows are
    judged alike; an empty table gives no rows; the columns of ``carry`` go along with their row, others are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carry)
    named = labels.filter((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    named = cut(named.withColumn("held", F.shiftright(F.xxhash64("id"), 7).bitwiseAND(1) == 1))
    fit, held = named.filter(~F.col("held")).select("id"), named.filter("held").select("id")
    told, trusted = rows.select("id", "text"), None
    if fit.count() <= TRUSTED_IDS:
        trusted = np.sort(fit.toArrow()["id"].to_numpy())  # at most TRUSTED_IDS rows
    else:
        told = told.join(fit.withColumn("fit", F.lit(True)), "id", "left").withColumn("fit", F.col("fit").isNotNull())
    counted = told.mapInArrow(_counts(bits, trusted), "slot long, raw long, target long").groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counted = counted.toPandas()  # at most 2**bits rows
    raw, target = (np.zeros(1 << bits) for _ in range(2))
    raw[counted["slot"].astype(int)], target[counted["slot"].astype(int)] = counted["raw"], counted["target"]
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    if not target.any():
        ratio[:] = 0
    kinds = dict(rows.dtypes)
    scored = cut(rows.mapInArrow(_score(bits, ratio, carry), ", ".join(["id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double", *(f"{c} {kinds[c]}" for c in carry)])))
    scored = scored.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    threshold = None
    if target.any():
        unseen = cut(scored.filter(~F.col("base_failed")).select("id", "score").join(held, "id", "left_semi").select("score"))
        if not unseen.isEmpty():
            low, middle = quantiles(unseen, [tail, 0.5])
            threshold = low - margin * (middle - low)
    level = F.lit(threshold).cast("double")
    return scored.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", level.alias("threshold"), "base_failed", (~F.col("base_failed") & F.coalesce(F.col("score") >= level, F.lit(True))).alias("kept"), *carry)
