"""Removal of repeated byte strings by column-wise construction of a document collection's order.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

1. Anchors (``anchors``): equal strings share their anchor and their place at it. Each text is cut into runs, pieces that
   stand for all strings of one anchor. Runs whose anchor occurs once in the table are done.
2. Runs that are equal as a whole collapse to one piece with its number of occurrences; where it is 2 or more all its strings repeat.
3. Anchors with several different pieces go through ``ColumnOrder``: the pieces, aligned at their anchors, are the documents of a
   collection. Each round inserts one symbol of every document, from the last column to the first, and updates the order of
   their suffixes, the collection's Burrows-Wheeler column and the common prefixes of neighbours. Columns are read
   one after the other from a sequential buffer of the bucket, and only the last Burrows-Wheeler column and prefixes are kept: a round needs no
   other. A string repeats if it shares ``LENGTH`` symbols with a neighbour.
   The columns of all pieces of an anchor agree in place, so suffixes only have to be compared within a
   round. That is why a round costs one symbol a document, where an unaligned collection has to merge into all suffixes so far.
4. Anchors with more than ``HOT_PIECES`` different pieces (boilerplate shorter than a string, in very many contexts) would fill
   one task. Their pieces are halved by the strings' places, each half gets the bytes that its strings have in common as a longer
   anchor, equal halves collapse, and the rest goes through ``ColumnOrder`` as before, or is halved again.

Rows are known by (doc_id, hash of the text); rows that agree in both get the same result. Texts cross the network only for pieces
of step 3 and, where the spans are too many to broadcast, for the last join.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` bytes keep everything; a very long text is searched whole; repeated rows and null ids
count as occurrences of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalguard.llm import anchors, textvec
from evalguard.llm.common import BROADCAST_ROWS, in_arrow, materialise, settle, small

LENGTH = 200
#: Rows of a batch that a worker handles at once.
ROWS_AT_ONCE = 1000
BUCKET_PIECES, HOT_PIECES = 4096, 8192
BROADCAST_SPANS = 2_000_000


class ColumnOrder:
    """Order of the suffixes of aligned documents, one column at a time from the last to the first.

    ``columns`` is a sequential reader of one row of 16-bit symbols a column, last column first; 0 stands where a document has no
    symbol. After each round ``order`` has the documents by their suffixes, ``bwt`` the collection's Burrows-Wheeler column and ``common``
    the common prefix of each with the one before.
    """

    def __init__(self, columns, n_docs: int, limit: int) -> None:
        self.columns, self.n, self.limit = columns, n_docs, limit
        self.order = np.arange(n_docs)
        self.common = np.zeros(n_docs, np.uint16)
        self.bwt = np.zeros(n_docs, np.uint16)

    def _least_between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min(common[low + 1 .. high]) for each pair, by doubling."""
        size = high - low
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint16)
        table, step = self.common, 1
        for k in range(int(level.max(initial=0)) + 1):
            if k:
                table = np.minimum(table[:-step], table[step:])
                step *= 2
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[low[at] + 1], table[high[at] - step + 1])
        return out

    def insert(self) -> bool:
        """One round; False after the first column."""
        raw = self.columns.read(2 * self.n)
        if not raw:
            return False
        self.bwt = symbol = np.frombuffer(raw, np.uint16)[self.order]
        to = np.argsort(symbol, kind="stable")
        symbol = symbol[to]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != 0)) + 1
        common = np.zeros(self.n, np.uint16)
        if len(same):
            common[same] = np.minimum(self._least_between(to[same - 1], to[same]) + np.uint16(1), np.uint16(self.limit))
        self.order, self.common = self.order[to], common
        return True


def repeated_strings(pieces: list[bytes], before: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its strings start in another piece at the same place of the anchor too.

    ``before``: bytes of the piece before its anchor; the piece's strings start at 0 .. last - first.
    """
    n = len(pieces)
    left = int(before.max())
    width = max(left - int(b) + len(p) for b, p in zip(before, pieces, strict=True))
    matrix = np.zeros((n, width), np.uint16)
    for i, p in enumerate(pieces):
        at = left - int(before[i])
        matrix[i, at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
    found = np.zeros((n, width), bool)
    columns = io.BytesIO(np.ascontiguousarray(matrix[:, ::-1].T).tobytes())
    del matrix
    order = ColumnOrder(columns, n, length)
    c = width - 1
    while order.insert():
        hit = order.common >= length
        hit[:-1] |= hit[1:]
        found[order.order[hit], c] = True
        c -= 1
    return [found[i, left - int(before[i]) : left - int(before[i]) + int(last[i] - first[i]) + 1] for i in range(n)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def find_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, h, piece, at, first, last): anchor hash, hash of the whole run, anchor place, first and last string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            data, offsets = textvec.raw(textvec.strings(batch.column(2)))
            for i in range(batch.num_rows):
                if offsets[i + 1] - offsets[i] < length:
                    continue
                text = anchors.Text(data[offsets[i] : offsets[i + 1]])
                h, at, first, last = anchors.runs(text, length)
                for store, x in zip(parts, (np.full(len(h), i), h.view(np.int64), text.pieces(first, last + length).view(np.int64), at, first, last), strict=True):
                    store.append(x)
            row, *rest = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))], ["doc_id", "th", "h", "piece", "at", "first", "last"])

    return in_arrow(_keyed(docs), run, "doc_id long, th long, h long, piece long, at int, first int, last int")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted runs, which are in ``runs``: an array of (h, at, first, last) by (doc_id, th)."""
    keys = small(wanted.select("doc_id", "th"))
    d = _keyed(docs)
    some = d.join(keys, d["doc_id"].eqNullSafe(keys["doc_id"]) & (d["th"] == keys["th"]), "left_semi").dropDuplicates(["doc_id", "th"])
    both = some.join(wanted, some["doc_id"].eqNullSafe(wanted["doc_id"]) & (some["th"] == wanted["th"])).select(some["doc_id"], some["th"], "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            data, offsets = textvec.raw(textvec.strings(batch.column(2)))
            lists = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))  # offsets of a slice begin anywhere
            flat = lists.flatten()
            cols = {f: flat.field(f).to_numpy() for f in ("h", "at", "first", "last")}
            begin, end = (offsets[row] + cols["first"]).tolist(), (offsets[row] + cols["last"] + LENGTH).tolist()
            pieces = pa.array([data[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cols["h"]), pa.array(cols["at"]), pa.array(cols["first"]), pa.array(cols["last"]), pieces], ["doc_id", "th", "h", "at", "first", "last", "bytes"])

    return in_arrow(both, run, "doc_id long, th long, h long, at int, first int, last int, bytes binary")


def _stretches(flags: list[np.ndarray], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of the bytes that flagged strings cover, one row a stretch of consecutive strings."""
    which, start, end = [], [], []
    for i, f in enumerate(flags):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
        which += [i] * (len(edge) // 2)
        start += (edge[::2] + first[i]).tolist()
        end += (edge[1::2] - 1 + first[i] + length).tolist()
    return np.array(which, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def compare_pieces(fetched: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, s, e) of repeated bytes in the pieces, all pieces of an anchor in one bucket of bounded size."""

    def run(table: pa.Table) -> pa.Table:
        first, last, at = (table[c].to_numpy() for c in ("first", "last", "at"))
        flags = repeated_strings(table["bytes"].to_pylist(), at - first, first, last, length)
        which, start, end = _stretches(flags, first, length)
        take = pa.array(which)
        return pa.table({"doc_id": table["doc_id"].take(take), "th": table["th"].take(take), "s": pa.array(start, pa.int32()), "e": pa.array(end, pa.int32())})

    return fetched.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, "doc_id long, th long, s int, e int")


def refine(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each piece in two halves, (doc_id, th, h, at, first, last, bytes, low, high, piece): strings by their places before the anchor, low to high.

    All strings of a half have the bytes from ``high`` to ``low + length`` in common place, so equal ones agree there: a hash of them is
    the half's anchor from now on. A half of one place holds whole strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            out: list[tuple] = []
            for i, (h, at, first, last, data, low, high) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    begin, end = max(first, at + a), min(last, at + b)
                    if a > b or begin > end:
                        continue
                    common = data[at + b - first : at + a + length - first]
                    part = data[begin - first : end + length - first]
                    key = hashlib.blake2b(common, digest_size=8, key=struct.pack("<qi", h, a)).digest()
                    own = hashlib.blake2b(part, digest_size=8, key=struct.pack("<i", begin - at)).digest()
                    out.append((i, *struct.unpack("<q", key), at, begin, end, part, a, b, *struct.unpack("<q", own)))
            row, *rest = zip(*out, strict=True) if out else [()] * 9
            take = pa.array(row, pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], ["doc_id", "th", "h", "at", "first", "last", "bytes", "low", "high", "piece"])

    return in_arrow(pieces.select("doc_id", "th", "h", "at", "first", "last", "bytes", "low", "high"), run, "doc_id long, th long, h long, at int, first int, last int, bytes binary, low int, high int, piece long")


def compare_hot(pieces: DataFrame, length: int, bucket_pieces: int, hot_pieces: int) -> list[DataFrame]:
    """Spans (doc_id, th, s, e) of the pieces of anchors with more than ``hot_pieces`` different ones.

    Pieces are halved, and equal halves collapse, until no anchor has more; after eight halvings a piece is one string and all
    pieces of an anchor are equal.
    """
    out, end = [], (F.col("last") + length).alias("e")
    left = pieces.withColumn("low", F.lit(anchors.GRAM - length)).withColumn("high", F.lit(0))
    while True:
        halves = materialise(refine(left, length), "dedup-halves")
        counted = halves.groupBy("h", "piece").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at", "first", "last", "bytes", "low", "high")).alias("r"))
        counted = materialise(counted.select("h", "piece", "n", "r.*"), "dedup-counted")
        several = counted.where("n > 1").select("h", "piece")
        out.append(halves.join(several.hint("merge"), ["h", "piece"]).select("doc_id", "th", F.col("first").alias("s"), end))
        sizes = materialise(counted.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "dedup-sizes")
        hot = sizes.where(F.col("k") > hot_pieces).select("h")
        n = sizes.where(F.col("k") <= hot_pieces).agg(F.sum("k")).first()[0] or 0
        if n:
            cool = counted.join(sizes.where(F.col("k") <= hot_pieces).select("h"), "h", "left_semi")
            out.append(compare_pieces(cool, max(1, -(-n // bucket_pieces)), length))
        if hot.isEmpty():
            return out
        left = materialise(counted.join(hot, "h", "left_semi"), "dedup-left")


def repeated_spans(docs: DataFrame, length: int = LENGTH, bucket_pieces: int = BUCKET_PIECES, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(doc_id, th, spans): the maximal repeated runs of each text that has one, as (s, e) in ascending order."""
    runs = materialise(find_runs(docs, length), "dedup-runs")
    groups = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("n > 1")
    groups = materialise(groups.select("h", (F.col("low") == F.col("high")).alias("one")), "dedup-anchors")
    again = materialise(runs.join(groups.hint("merge"), "h"), "dedup-again")
    mixed = again.where("not one")
    pieces = materialise(mixed.groupBy("h", "piece").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at", "first", "last")).alias("r")), "dedup-pieces")
    hot = materialise(pieces.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot_pieces).select("h"), "dedup-hot")
    end = (F.col("last") + length).alias("e")
    spans = again.where("one").select("doc_id", "th", F.col("first").alias("s"), end)
    several = pieces.where("n > 1").select("h", "piece")
    spans = spans.union(mixed.join(several.hint("merge"), ["h", "piece"]).select("doc_id", "th", F.col("first").alias("s"), end))
    wanted = pieces.select("r.doc_id", "r.th", F.struct("h", "r.at", "r.first", "r.last").alias("run"))
    fetched = materialise(_fetch(docs, materialise(wanted.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs")), "dedup-wanted")), "dedup-fetched")
    buckets = max(1, -(-pieces.count() // bucket_pieces))
    spans = spans.union(compare_pieces(fetched.join(hot, "h", "left_anti"), buckets, length))
    if not hot.isEmpty():
        for part in compare_hot(fetched.join(hot, "h", "left_semi"), length, bucket_pieces, hot_pieces):
            spans = spans.union(part)
    return _merge(spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")))


def _merge(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a text become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            s, e = flat.field("s").to_numpy().astype(np.int64), flat.field("e").to_numpy().astype(np.int64)
            order = np.lexsort((s, row))
            row, s, e = row[order], s[order], e[order]
            # rows follow each other on one line, so that one running maximum serves all
            base = row * (int(e.max(initial=0)) + 2)
            reach = np.maximum.accumulate(base + e)
            new = np.flatnonzero(np.concatenate([[True], base[1:] + s[1:] > reach[:-1]])) if len(s) else np.zeros(0, np.int64)
            stop = (reach[np.concatenate([new[1:], [len(s)]]) - 1] - base[new]) if len(s) else s
            offsets = np.searchsorted(row[new], np.arange(batch.num_rows + 1))
            merged = pa.StructArray.from_arrays([pa.array(s[new], pa.int32()), pa.array(stop, pa.int32())], ["s", "e"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), merged)], ["doc_id", "th", "spans"])

    return in_arrow(spans, run, "doc_id long, th long, spans array<struct<s:int,e:int>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, th, n_bytes, n_removed, n_spans, kept, spans) of each row; ``kept`` is the remaining bytes."""
    spans = settle(docs.sparkSession, lambda: repeated_spans(docs, length, **options), "dedup-spans")
    d = _keyed(docs)
    total = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    side = small(spans, BROADCAST_ROWS) if total <= BROADCAST_SPANS else spans
    joined = d.join(side, d["doc_id"].eqNullSafe(side["doc_id"]) & (d["th"] == side["th"]), "left").select(d["doc_id"], d["th"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            data, offsets = textvec.raw(textvec.strings(batch.column(2)))
            kept, removed, count = [], [], []
            for i, spans_ in enumerate(batch.column(3).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                at, parts = 0, []
                for x in spans_ or ():
                    parts.append(text[at : x["s"]])
                    at = x["e"]
                parts.append(text[at:])
                kept.append(b"".join(parts))
                removed.append(len(text) - len(kept[-1]))
                count.append(len(spans_ or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), batch.column(3)], ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return in_arrow(joined, run, "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<s:int,e:int>>")

