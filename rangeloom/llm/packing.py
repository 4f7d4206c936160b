"""Packing of token sequences by dynamic programming over cut points, in the order of the documents.

Cuts may fall behind a document (free), behind a sentence or line (a small penalty) or, in stretches without either,
at regular places (a larger one). ``best[j]`` is the least padding plus penalty of the tokens before cut ``j``; a window
of up to ``window`` tokens costs what it lacks, or nothing where its length is a power of two:

    best[j] = penalty[j] + min( min over i in reach of best[i] + window - (place[j] - place[i]),
                                min over powers of two 2**k with a cut i at place[j] - 2**k of best[i] )

The first minimum is over a sliding range of ``best[i] + place[i]`` and a monotone queue gives it in constant time.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Texts, group_starts, ranges, slices

#: Penalties in tokens.
SENTENCE, ELSEWHERE = 4, 12
#: Between cuts without a boundary, about as many tokens.
STRIDE = 128


def choose_cuts(place: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indices of the chosen cuts, first and last included: ``place`` ascends strictly from 0 in steps of ``window`` at most."""
    n = len(place)
    froms, tos = [], []
    for size in (1 << k for k in range(window.bit_length()) if 1 << k < window):
        at = np.searchsorted(place, place - size)
        hit = np.flatnonzero((place >= size) & (place[np.minimum(at, n - 1)] == place - size))
        tos.append(hit)
        froms.append(at[hit])
    to = np.concatenate(tos)
    order = np.argsort(to, kind="stable")
    exact_to, exact_from = [*to[order].tolist(), n], np.concatenate(froms)[order].tolist()
    places, costs = place.tolist(), penalty.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    x = 0
    for j in range(1, n):
        p = places[j]
        while queue[0][1] < p - window:
            queue.popleft()
        key, _, i = queue[0]
        cost = key + window - p
        while exact_to[x] == j:
            at = exact_from[x]
            if best[at] < cost:
                cost, i = best[at], at
            x += 1
        cost += costs[j]
        best[j], back[j] = cost, i
        key = cost + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return np.array(cuts[::-1])


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER = np.zeros(256, dtype=bool)
_OTHER[0x21:0x7F] = True
_OTHER &= ~_LETTER
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def _so_far(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, the end included; four bytes each, as a batch's texts stay below 2 GB."""
    out = np.zeros(len(flags) + 1, dtype=np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts that tell whether a tokenizer treats words as ``Encoder`` expects.
PROBES = ["The quick  brown fox\tjumps\n\nover: it's (a) dog's day, isn't it?", " leading and trailing ", "x=1;y[2]->z/*c*/ 3.14 1,000 a_b-c", "Größe déjà vu 你好 世界 привет", "UPPER lower CamelCase <|tag|> <b>", "a" * 40 + " " * 9 + "b\r\nc"]


class Encoder:
    """Token ids of whole texts, each distinct piece of text encoded once and remembered up to a bound.

    The tokenizer drops white space and never joins across it, nor from an ASCII letter to other printable ASCII, but
    for contractions and marks of special tokens: words with an apostrophe or "<|" stay whole. Tokenizers that fail on
    ``PROBES`` are refused.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        self.tokenizer, self.most = _tokenizer(path), most
        self.mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.clear()
        probes = Texts(pa.array(PROBES), hashes=False)
        found, per_word = self.ids(probes)
        ends = np.concatenate([[0], np.cumsum(per_word)])[probes.w0]
        for text, a, b in zip(PROBES, ends, ends[1:], strict=False):
            if found[a:b].tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"this tokenizer does not encode words one by one: {path}")

    def clear(self) -> None:
        self.key, self.at, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.total = 0

    def pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word) of the pieces."""
        b = texts.buf
        letter, other = _LETTER[b], _OTHER[b]
        turn = np.zeros(len(b) + 1, dtype=bool)
        turn[1 : len(b)] = (letter[:-1] & other[1:]) | (other[:-1] & letter[1:])
        whole = b == 0x27
        whole[:-1] |= (b[:-1] == 0x3C) & (b[1:] == 0x7C)
        at = _so_far(whole)
        kept = texts.in_word.copy()
        kept[kept] = np.repeat(at[texts.end] != at[texts.start], texts.end - texts.start)
        turn[:-1] &= ~kept
        turn[texts.start] = True
        turn[:-1] &= texts.in_word
        start = np.flatnonzero(turn[:-1])
        word = np.searchsorted(texts.start, start, side="right") - 1
        end = texts.end[word]
        end[:-1] = np.minimum(end[:-1], start[1:])
        return start, end, word

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each piece)."""
        flat, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(pieces), 2000):
            part = pieces[lo : lo + 2000]
            ids = np.array(self._batch([b" \x01 ".join(part).decode()])[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.zeros(0, dtype=np.int64)
            if len(cuts) == len(part) - 1:
                flat.append(np.delete(ids, cuts))
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:  # a piece that holds the mark itself
                each = [e.ids for e in self._batch([x.decode() for x in part])]
                flat += [np.array(x, dtype=np.uint32) for x in each]
                sizes.append(np.array([len(x) for x in each], dtype=np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _batch(self, texts: list[str]) -> list:
        """Encodings without offsets, which nothing here needs."""
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each word)."""
        start, end, word = self.pieces(texts)
        h = texts.runs(start, end)
        order = np.argsort(h)
        groups = group_starts(h[order])
        first = order[groups]  # any of equal pieces will do
        keys = h[first]
        inverse = np.empty(len(h), dtype=np.int64)
        inverse[order] = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, len(h))))
        if self.total and len(self.key) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.key, keys)
        have = self.key[np.minimum(at, len(self.key) - 1)] == keys if len(self.key) else np.zeros(len(keys), dtype=bool)
        if not have.all():
            new = np.flatnonzero(~have)
            data = texts.buf.tobytes()
            found, sizes = self._encode([data[s:e] for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            places = self.total + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, found])
            self.total += int(sizes.sum())
            self.key, self.at, self.size = (np.insert(a, at[new], b) for a, b in ((self.key, keys[new]), (self.at, places), (self.size, sizes)))
            at = np.searchsorted(self.key, keys)
        at = at[inverse]
        size = self.size[at] if len(at) else np.zeros(0, dtype=np.int64)
        if not len(size) or not self.total:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts.start), dtype=np.int64)
        return self.flat[ranges(self.at[at], size)], np.bincount(word, weights=size, minlength=len(texts.start)).astype(np.int64)


def cut_places(texts: Texts, per_word: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, penalty) of the possible cuts and the place where each text ends; a text's last token is the end mark."""
    total = np.concatenate([[0], np.cumsum(per_word)])
    ends = total[texts.w0[1:]] + np.arange(1, texts.n + 1)
    feeds = _so_far(texts.buf == 0x0A)
    after = np.append(texts.start[1:], len(texts.buf))
    close = _STOP[texts.buf[texts.end - 1]] | (feeds[after] > feeds[texts.end]) if len(texts.start) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(close)
    sentence = total[at + 1] + texts.doc_of_words()[at]
    places = np.unique(np.concatenate([[0], sentence, ends]))
    gap = np.diff(places)
    wide = np.flatnonzero(gap > 2 * STRIDE)
    if len(wide):
        count = gap[wide] // STRIDE - 1
        step = ranges(np.ones(len(wide), dtype=np.int64), count)
        places = np.unique(np.concatenate([places, np.repeat(places[wide], count) + step * STRIDE]))
    penalty = np.full(len(places), ELSEWHERE)
    penalty[np.isin(places, sentence)] = SENTENCE
    penalty[np.isin(places, ends)] = 0
    return places, penalty, ends


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, window: int, block_bytes: int) -> callable:
    kinds = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(path)
        number = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text", block_bytes):
            texts = Texts(batch.column("text"), hashes=False)
            words, per_word = encoder.ids(texts)
            places, penalty, ends = cut_places(texts, per_word, window)
            ids = np.full(int(ends[-1]), end_id, dtype="<u4")
            mine = np.ones(len(ids), dtype=bool)
            mine[ends - 1] = False
            ids[mine] = words
            cuts = places[choose_cuts(places, penalty, window)]
            begin = np.unique(np.concatenate([cuts[:-1], ends[:-1]]))
            stop = np.append(begin[1:], ends[-1])
            doc = np.searchsorted(ends, begin, side="right")
            sequence = np.searchsorted(cuts, begin, side="right") - 1
            opens = np.concatenate([[0], ends[:-1]])
            data = memoryview(ids.tobytes())
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            columns = [batch.column("id").take(pa.array(doc)), *(pa.array(np.asarray(c, dtype=np.int64)) for c in (begin - opens[doc], stop - begin, sums, (ends - opens)[doc], number + sequence, begin - cuts[sequence]))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))
            number += len(cuts) - 1

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = 2048, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of every document.

    A document is its ids and ``end_id``; null and empty texts are the end mark alone. Sequences hold the documents of a
    task in their stored order (the order a shuffle or a file gave them), in blocks of about ``block_bytes`` of text,
    each packed at least padding plus cut penalties. No text is dropped or shortened: what doesn't fit goes on in the
    next sequence. Sequence ids are unique, not dense. Repeated rows are packed as often as they come; ids may be null; an
    empty table gives no rows; other columns are ignored. ``tokenizer_path`` must be readable on the executors.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(tokenizer_path, end_id, window, block_bytes), COLUMNS).withColumnRenamed("doc_id", id_col)
