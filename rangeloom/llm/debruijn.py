"""Substring dedup on a de Bruijn graph of word k-mers.

Every window of ``k`` words is an edge of the graph (from its first k-1 words to its last k-1):

1. edges: a slice of documents sends each of its distinct edges once, from the smallest document that has it, with that
   document's key and the word position; other documents of the slice with the edge already know a source;
2. a bucket of edges finds those of two or more documents and names the smallest one as the source of the others;
3. the repeated edges of a document meet by a shuffle on its key, where nonbranching paths, on which document and source
   both advance by a word from edge to edge, are compacted to spans (document, start, length, source, source start);
4. the spans are joined with the texts of their sources, where an independent hash of the words at the source
   coordinates is taken, and then with their own documents, where the same hash must come out of the document's words;
5. only words of spans verified so are removed.

Texts are shuffled once, by key; steps 4 and 5 share that exchange. An edge is sent once per slice however many documents
of the slice have it. Nothing but one sum of sizes comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, shuffle_width
from .textkit import Texts, U, group_starts, mix, release, run_hashes, slices

#: Bytes of an edge's hash that are sent; the bucket holds the leading bits.
_LOW = 6
#: The key of rows without an id: after all ids.
LAST = (1 << 63) - 1
#: Bytes of text in a slice for each bucket, within bounds: with more buckets slices grow, so that what goes to a bucket doesn't get too small.
SLICE_PER_BUCKET, SLICE_LEAST, SLICE_MOST = 8 << 10, 2 << 20, 16 << 20
#: Edges that a bucket sorts at a time, about.
PART = 1 << 19


def _pack(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :_LOW]).reshape(-1)


def _unpack(low: np.ndarray) -> np.ndarray:
    out = np.zeros((len(low) // _LOW, 8), dtype=np.uint8)
    out[:, :_LOW] = low.reshape(-1, _LOW)
    return out.reshape(-1).view(np.uint64)


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The binary values of a column one after the other, taken from its buffers."""
    found = [np.zeros(0, dtype=np.uint8)]
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk) and data is not None:
            at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            found.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]])
    return np.concatenate(found).view(kind)


def _blobs(values: np.ndarray, cuts: np.ndarray, width: int | None = None) -> pa.Array:
    """A binary column of ``values[cuts[i]:cuts[i+1]]`` (``width`` bytes each)."""
    width = values.itemsize if width is None else width
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in some column; the first always does."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


# Path pieces (runs of repeated edges) travel as parallel arrays; those of one document and source share a head.
PIECES = "heads binary, places binary, source_places binary, rest binary"


class Pieces:
    """Arrays ``id, h, sid, sh, pos, spos, n``: n edges of document (id, h) from word pos on equal those of the source from spos on."""

    names = ("id", "h", "sid", "sh", "pos", "spos", "n")

    def __init__(self, *columns: np.ndarray):
        self.columns = [np.asarray(c, dtype=np.int64) for c in columns]
        for name, c in zip(self.names, self.columns, strict=True):
            setattr(self, name, c)

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(*(c[at] for c in self.columns))

    @classmethod
    def joined(cls, parts: list[Pieces]) -> Pieces:
        return cls(*(np.concatenate([np.zeros(0, dtype=np.int64), *(p.columns[i] for p in parts)]) for i in range(7)))

    def merged(self) -> Pieces:
        """In the order of document and position, repeats dropped, and pieces joined where both coordinates go on."""
        p = self.take(np.lexsort((self.pos, self.h, self.id)))
        p = p.take(np.flatnonzero(_changes(p.id, p.h, p.pos)))
        new = _changes(p.id, p.h, p.sid, p.sh, p.spos - p.pos)
        if len(new):
            new[1:] |= p.pos[1:] != p.pos[:-1] + p.n[:-1]
        begin = np.flatnonzero(new)
        out = p.take(begin)
        n = np.add.reduceat(p.n, begin) if len(begin) else p.n
        return Pieces(*out.columns[:6], n)

    def encode(self, group: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        """(groups, columns of ``PIECES``): a row per group; the order of pieces is kept in a group."""
        order = np.argsort(group, kind="stable")
        p, group = self.take(order), group[order]
        head = np.flatnonzero(_changes(group, p.id, p.h, p.sid, p.sh))
        heads = np.stack([p.id[head], p.h[head], p.sid[head], p.sh[head], np.diff(np.append(head, len(group)))], axis=1)
        first = np.flatnonzero(_changes(group))
        at = np.append(first, len(group))
        rest = (p.pos >> 16) | (p.spos >> 16) << 16 | p.n << 32
        return group[first], [_blobs(heads, np.searchsorted(head, at), 40), _blobs(p.pos.astype(np.uint16), at), _blobs(p.spos.astype(np.uint16), at), _blobs(rest, at)]

    @classmethod
    def decode(cls, table: pa.Table) -> Pieces:
        heads = _flat(table.column("heads"), np.int64).reshape(-1, 5)
        pos, spos = (_flat(table.column(c), np.uint16).astype(np.int64) for c in ("places", "source_places"))
        rest = _flat(table.column("rest"), np.int64)
        return cls(*(np.repeat(heads[:, i], heads[:, 4]) for i in range(4)), pos | (rest & 0xFFFF) << 16, spos | (rest >> 16 & 0xFFFF) << 16, rest >> 32)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


# Positions travel as steps from edge to edge of a document, in planes by size, most of which are all zeros and compress away.
_EDGES = ("ids", "keys", "counts", "edges", "low", "middle", "high")
EDGES = f"bucket long, {', '.join(f'{c} binary' for c in _EDGES)}, {PIECES}"


def one_to_a_partition(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` numbers that a shuffle by number into ``n`` partitions deals to one partition each (few are dealt twice)."""
    place = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(n * (n.bit_length() + 6)).groupBy(place.alias("place")).agg(F.min("id").alias("id")).toPandas()  # n rows, as many as shuffle partitions
    out = -1 - np.arange(n, dtype=np.int64)
    out[found["place"].to_numpy()] = found["id"]
    return out


def _send(k: int, numbers: np.ndarray, slice_bytes: int) -> callable:
    """Step 1: a slice's edges by bucket (document ids, their text hashes, edges of each, low bytes, positions) and the pieces that the slice settles itself."""
    names = ["bucket", *_EDGES, *(c.split()[0] for c in PIECES.split(", "))]
    buckets = len(numbers)

    def rows(which: np.ndarray, edges: list[pa.Array], pieces: list[pa.Array]) -> pa.RecordBatch:
        none = pa.array([b""] * len(which), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(numbers[which]), *(edges or [none] * 7), *(pieces or [none] * 4)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            ids, keys = batch.column("key").to_numpy(), batch.column("h").to_numpy()
            order = np.lexsort((keys, ids))
            order = order[_changes(ids[order], keys[order])]
            ids, keys = ids[order], keys[order]
            texts = Texts(batch.column("text").take(pa.array(order)))
            first, doc, h = texts.windows(k)
            if not len(h):
                continue
            pos = first - texts.w0[doc]
            by_edge = np.argsort(h)
            starts = group_starts(h[by_edge])
            sizes = np.diff(np.append(starts, len(h)))
            source = np.minimum.reduceat(by_edge, starts)  # documents ascend by id
            often = np.repeat(sizes > 1, sizes)
            w, s = by_edge[often], np.repeat(source[sizes > 1], sizes[sizes > 1])
            local = ids[doc[w]] > ids[doc[s]]
            w, s = w[local], s[local]
            sent = np.ones(len(h), dtype=bool)
            sent[w] = False
            if len(w):
                pieces = Pieces(ids[doc[w]], keys[doc[w]], ids[doc[s]], keys[doc[s]], pos[w], pos[s], np.ones(len(w), dtype=np.int64)).merged()
                yield rows(*(lambda g, c: (g, [], c))(*pieces.encode(np.full(len(pieces.n), int(h[0]) % buckets))))
            w = np.flatnonzero(sent)
            bucket = _bucket_of(h[w], buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            w, bucket = w[order], bucket[order]
            run_at = np.flatnonzero(_changes(bucket, doc[w]))
            first_at = np.flatnonzero(_changes(bucket))
            at = np.append(first_at, len(w))
            heads, owner = np.searchsorted(run_at, at), doc[w[run_at]]
            counts = np.diff(np.append(run_at, len(w))).astype(np.uint32)
            step = pos[w]
            step[1:] -= step[:-1].copy()
            step[run_at] = pos[w][run_at]
            planes = [_blobs((step >> shift).astype(kind), at) for shift, kind in ((0, np.uint8), (8, np.uint8), (16, np.uint16))]
            yield rows(bucket[first_at], [_blobs(ids[owner], heads), _blobs(keys[owner], heads), _blobs(counts, heads), _blobs(_pack(h[w]), at, _LOW), *planes], [])

    return run


def _places(table: pa.Table, counts: np.ndarray) -> np.ndarray:
    """Word positions of a bucket's edges from their steps; sums are taken modulo 2**32, below which positions are."""
    pos = _flat(table.column("high"), np.uint16).astype(np.uint32)
    for name in ("middle", "low"):
        pos <<= np.uint32(8)
        pos |= _flat(table.column(name), np.uint8)
    np.cumsum(pos, dtype=np.uint32, out=pos)
    run_at = np.cumsum(counts, dtype=np.int64) - counts
    pos -= np.repeat(np.where(run_at > 0, pos[run_at - 1], np.uint32(0)), counts)
    return pos


def _match(numbers: np.ndarray) -> callable:
    """Step 2: the repeated edges of a bucket with their source, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys = _flat(table.column("ids"), np.int64), _flat(table.column("keys"), np.int64)
        counts = _flat(table.column("counts"), np.uint32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        h = _unpack(_flat(table.column("edges"), np.uint8))
        pos = _places(table, counts)
        parts = -(-len(h) // PART)
        part = (h % U(parts)).astype(np.uint16) if parts > 1 else None  # hashes are mixed well
        found = [Pieces.decode(table)]
        for number in range(parts):
            mine = np.flatnonzero(part == number) if parts > 1 else np.arange(len(h))
            order = mine[np.argsort(h[mine])]
            starts = group_starts(h[order])
            sizes = np.diff(np.append(starts, len(order)))
            w = order[np.repeat(sizes > 1, sizes)]
            sizes = sizes[sizes > 1]
            group = np.repeat(np.arange(len(sizes)), sizes)
            id_, key, at = ids[doc[w]], keys[doc[w]], pos[w]
            order = np.lexsort((at, key, id_, group))
            group, id_, key, at = group[order], id_[order], key[order], at[order]
            s = np.repeat(group_starts(group), sizes)
            later = (id_ > id_[s]) & _changes(group, id_, key, at)
            s = s[later]
            found.append(Pieces(id_[later], key[later], id_[s], key[s], at[later], at[s], np.ones(len(s), dtype=np.int64)))
        pieces = Pieces.joined(found)
        pieces = pieces.take(np.lexsort((pieces.pos, pieces.h, pieces.id)))
        number, columns = pieces.encode((mix(pieces.h.view(np.uint64) ^ mix(pieces.id.view(np.uint64))) % U(len(numbers))).astype(np.int64))
        del h, pos, doc, part, found
        release()
        return pa.table([pa.array(numbers[number]), *columns], names=["g", *(c.split()[0] for c in PIECES.split(", "))])

    return run


_SPAN_ROW = ("key", "h", "start", "length", "source_id", "source_h", "source_start")


def _compact(k: int) -> callable:
    """Step 3: the nonbranching paths of a group of documents as spans of words."""

    def run(table: pa.Table) -> pa.Table:
        p = Pieces.decode(table).merged()
        return pa.table([pa.array(c) for c in (p.id, p.h, p.pos, p.n + k - 1, p.sid, p.sh, p.spos)], names=list(_SPAN_ROW))

    return run


def _lists(column: pa.Array, rows: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row, fields) of the structs in a column of lists; a null list has none."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(rows), size), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _check(texts: Texts, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Independent 64-bit hashes of runs of words, by number of the first word in the batch."""
    words = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), start, start + length]))
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    lo, hi = words[0], words[-1]
    second = texts.runs(texts.start[lo:hi], texts.end[lo:hi], seed=29)
    order = np.argsort(start)
    out = np.empty(len(start), dtype=np.int64)
    out[order] = run_hashes(second, start[order] - lo, (start + length)[order] - lo).view(np.int64)
    return out


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: the hashes of the words at the wanted source coordinates; of rows that repeat a document, which come one after the other, the first answers."""
    last = None
    for batch in slices(batches, "text"):
        keys, hs = batch.column("key").to_numpy(), batch.column("h").to_numpy()
        new = _changes(keys, hs)
        new[0] = (keys[0], hs[0]) != last
        last = (keys[-1], hs[-1])
        batch = batch.filter(pa.array(new))
        texts = Texts(batch.column("text"), hashes=False)
        row, want = _lists(batch.column("wants"), batch.num_rows)
        check = _check(texts, texts.w0[row] + want["source_start"], want["length"])
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), batch.column("h").take(pa.array(row)), pa.array(want["source_start"]), pa.array(want["length"]), pa.array(check)], names=["source_id", "source_h", "source_start", "length", "check"])


SPANS = "array<struct<start:long,length:long,source_id:long,source_start:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64())]))


def _settle(full: bool, carry: tuple[str, ...]) -> callable:
    """Step 5: spans whose words hash to what was found at the source are verified; their words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts(batch.column("text"), hashes=False)
            row, span = _lists(batch.column("spans"), batch.num_rows)
            start = t.w0[row] + span["start"]
            ok = np.flatnonzero(_check(t, start, span["length"]) == span["check"])
            ok = ok[np.lexsort((span["start"][ok], row[ok]))]
            turn = np.zeros(len(t.start) + 1, dtype=np.int64)
            np.add.at(turn, start[ok], 1)
            np.add.at(turn, (start + span["length"])[ok], -1)
            covered = np.cumsum(turn)[:-1] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[t.w0])
            columns, names = [batch.column("id"), pa.array(t.n_words), pa.array(removed), pa.array(_digests(t, ~covered), pa.string())], ["id", "n_words", "n_removed", "kept_sha256"]
            if full:
                cuts = np.searchsorted(row[ok], np.arange(t.n + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(span[c][ok]) for c in ("start", "length", "source_id", "source_start")], fields=list(_SPAN.value_type))
                columns, names = [*columns, _remaining(t, covered), pa.ListArray.from_arrays(pa.array(cuts), rows)], [*names, "text", "spans"]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in carry)], names=[*names, *carry])

    return run


def _digests(t: Texts, keep: np.ndarray) -> list[str]:
    """SHA-256 of each text's kept words joined by one space."""
    mask = np.zeros(len(t.buf) + 1, dtype=np.int8)
    mask[t.start[keep]] += 1
    mask[t.end[keep]] -= 1
    kept = t.buf[np.cumsum(mask[:-1], dtype=np.int8) > 0]
    size = (t.end - t.start)[keep]
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    letter = np.ones(len(out), dtype=bool)
    letter[ends - 1] = False
    out[letter] = kept
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(keep)])[t.w0]]
    data = out.tobytes()
    return [hashlib.sha256(data[a : b - 1 if b > a else b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]


def _remaining(t: Texts, covered: np.ndarray) -> pa.Array:
    """The texts without covered words and the white space behind each of them."""
    if not covered.any():
        gone = np.zeros(len(t.buf), dtype=bool)
    else:
        mask = np.zeros(len(t.buf) + 1, dtype=np.int8)
        end = np.append(t.start[1:], len(t.buf))
        last = np.zeros(len(t.start), dtype=bool)
        last[t.w0[1:][t.n_words > 0] - 1] = True
        end = np.where(last, np.repeat(t.at[1:], t.n_words), end)
        np.add.at(mask, t.start[covered], 1)
        np.add.at(mask, end[covered], -1)
        gone = np.cumsum(mask)[:-1] > 0
    left = np.concatenate([[0], np.cumsum(~gone)])[t.at].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), t.n, [None, pa.py_buffer(left), pa.py_buffer(t.buf[~gone].tobytes())])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 13, full: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row; with ``full`` also the remaining text and the verified spans.

    A word is removed if it lies in a ``k``-word window whose words also start in a document of smaller id. Windows are
    judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null or empty text has none (its digest is that
    of the empty string). Rows of equal id don't remove from each other; rows of null id count as larger than all others
    and as equal to each other (ids are below 2**63 - 1). ``text`` keeps the layout of what is left; ``spans`` are the
    verified paths, by start; a path's source is a document of smaller id, the smallest unless the same slice of rows has one. Texts are never cut. An empty table gives no rows; the columns of ``carry`` go along with
    their row, others are ignored. Edges are matched by 6 bytes of a 64-bit hash besides their bucket.
    """
    buckets = shuffle_width(docs.sparkSession)
    slice_bytes = min(SLICE_MOST, max(SLICE_LEAST, buckets * SLICE_PER_BUCKET))
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    texts = docs.select(F.coalesce(id_, F.lit(LAST)).alias("key"), F.xxhash64(text).alias("h"), id_.alias("id"), text.alias("text"), *carry)
    numbers = one_to_a_partition(docs.sparkSession, buckets)
    edges = texts.select("key", "h", "text").mapInArrow(_send(k, numbers, slice_bytes), EDGES)
    repeated = edges.groupBy("bucket").applyInArrow(_match(numbers), f"g long, {PIECES}")
    spans = cut(repeated.groupBy("g").applyInArrow(_compact(k), ", ".join(f"{c} long" for c in _SPAN_ROW)))
    source = ["source_id", "source_h", "source_start", "length"]
    wants = spans.select(*source).distinct().groupBy(F.col("source_id").alias("key"), F.col("source_h").alias("h")).agg(F.collect_list(F.struct("source_start", "length")).alias("wants"))
    # Sorted by key, and by the exchange that the last join uses too. Without an aggregation behind it, the next join is one that Spark can split where a passage is frequent.
    answers = texts.join(wants.hint("merge"), ["key", "h"]).mapInArrow(_answer, ", ".join(f"{c} long" for c in (*source, "check")))
    checked = spans.join(answers, source).groupBy("key", "h").agg(F.collect_list(F.struct("start", "length", "check", "source_id", "source_start")).alias("spans"))
    kinds = dict(texts.dtypes)
    out = "id long, n_words long, n_removed long, kept_sha256 string" + (f", text string, spans {SPANS}" if full else "")
    out = ", ".join([out, *(f"{c} {kinds[c]}" for c in carry)])
    return texts.join(checked.hint("merge"), ["key", "h"], "left").mapInArrow(_settle(full, carry), out).withColumnRenamed("id", id_col)


#: DuckDB's twin of the query: the definition, window by window.
ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
places AS (SELECT r, k, w, unnest(range(1, len(w) - 11)) AS place FROM texts WHERE len(w) >= 13),
windows AS (SELECT r, k, place, array_to_string(list_slice(w, place, place + 12), ' ') AS passage FROM places),
firsts AS (SELECT passage, min(k) AS least FROM windows GROUP BY passage),
found AS (SELECT r, place FROM windows JOIN firsts USING (passage) WHERE least < k),
gone AS (SELECT DISTINCT r, place + more AS place FROM found, range(0, 13) AS t(more)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM texts),
rest AS (SELECT r, string_agg(word, ' ' ORDER BY place) AS rest, count(*) AS n FROM words ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM texts LEFT JOIN rest USING (r)
"""
