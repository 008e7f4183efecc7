"""Benchmark decontamination on question templates.

A text becomes a template: words in order, where runs of numbers, units after numbers, and runs of names (capitalised
words inside a sentence) give way to one typed placeholder each. Windows of ``WIDTH`` template tokens of the
benchmark are joined to those of the documents by hash, and so are windows of ``WIDTH`` plain lower-cased words, so that
a copy whose capitals or line breaks differ is found too. A hit counts for the item's plain windows that it spans.

Hits of one document and item are judged at each alignment (document position minus item position) and over chains of
alignments that lie less than the item's length apart, so that an inserted or dropped word does not part a copy. The slots behind
the placeholders are compared: a re-parameterised question keeps one value for each value of the original,
and windows that hold another value than most places of it don't count. A document holds
an item if consistent hits cover at least ``COVERAGE`` of the item's windows, or ``RUN_WORDS`` words of it in a row.

Documents are read once; a fixed-size bit map of the benchmark's hashes (``FILTER_BITS``, whatever the
benchmark's size) drops windows that cannot hit before anything is shuffled. Hits meet the benchmark's windows in
a join that is broadcast only if the benchmark's windows are few.

Defined cases: null, empty and blank texts hold nothing; a very long text is searched whole; repeated rows are found once; of equal
coverages the larger number of hits is reported; an empty table or benchmark gives an empty result; an item of fewer than ``WIDTH`` words is one
window of all its words if it has at least ``MIN_WORDS``, else it is not sought; a template of fewer than ``MIN_WORDS`` tokens meets
only windows of as many words as the item's own; a repeated item is found under
each of its ids, and items without id are not sought; repeated and null document ids are told apart by their text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalguard.llm import textvec
from evalguard.llm.common import in_arrow, materialise, settle, small

WIDTH, MIN_WORDS, COVERAGE = 8, 5, 0.5
#: So many words of an item in a row are a hit, whatever their share of a long item.
RUN_WORDS = 20
#: Words that a template window must hold besides its placeholders: a window of placeholders alone would meet every table of numbers.
LITERAL = 2
FILTER_BITS = 24
#: Words that are units right after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles g kg mg lb lbs pound pounds oz ounce ounces ton tons s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons k c f degree degrees percent "
    "dollar dollars euro euros cent cents usd eur mph kmh hz khz mhz ghz w kw v volt volts watt watts j cal kcal pa bar"
).split()
_U = np.uint64
RUN_BASE = _U(0xD6E8FEB86659FD93)
NUMBER, NAME, UNIT = (textvec.mix(np.array([x], np.uint64))[0] for x in (0x11, 0x22, 0x33))
_unit_hashes: list[np.ndarray] = []


def _units() -> np.ndarray:
    if not _unit_hashes:
        _unit_hashes.append(np.sort(textvec.words(pa.array([" ".join(UNITS)])).hash))
    return _unit_hashes[0]


def template(rows: pa.Array) -> tuple[textvec.Words, np.ndarray, np.ndarray]:
    """Words of a slice, their template hashes, and which are slots, word by word; ``tokens`` joins runs."""
    lower = textvec.words(rows)
    n = len(lower.hash)
    t, slot = lower.hash.copy(), np.zeros(n, bool)
    if not n:
        return lower, t, slot
    data, start = lower.data, lower.start
    digit = (data[start] >= 48) & (data[start] <= 57)
    t[digit], slot[digit] = NUMBER, True
    after = np.zeros(n, bool)
    after[1:] = digit[:-1] & (lower.row[1:] == lower.row[:-1])
    known = _units()
    unit = after & ~digit & (known[np.minimum(np.searchsorted(known, lower.hash), len(known) - 1)] == lower.hash)
    t[unit], slot[unit] = UNIT, True
    # lower case changes the bytes of some letters, but neither joins nor parts words: the n-th word stays the n-th
    original, offsets = textvec.raw(rows)
    begin, stop = textvec.spans(original, offsets)
    first = original[begin]
    # a name: an upper-case letter, lower case after it, and a word before it in the same sentence
    capital = (first >= 65) & (first <= 90) & (stop - begin > 1)
    second = original[np.minimum(begin + 1, len(original) - 1)]
    capital &= (second >= 97) & (second <= 122)
    gap = np.zeros(len(original) + 1, np.int64)
    np.cumsum(np.isin(original, np.frombuffer(b".!?:;\n\r|\"", np.uint8)), out=gap[1:])
    inside = np.zeros(n, bool)
    inside[1:] = (gap[begin[1:]] == gap[stop[:-1]]) & (lower.row[1:] == lower.row[:-1])
    name = capital & inside
    t[name], slot[name] = NAME, True
    return lower, t, slot


@dataclass
class Tokens:
    """Template tokens: hash, whether a slot, the value behind it, first and last-plus-one word, row."""

    hash: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def tokens(w: textvec.Words, t: np.ndarray, slot: np.ndarray) -> Tokens:
    """Runs of number words (1,250 or 3.5) and of name words become one token; its value is the whole run."""
    n = len(t)
    head = np.ones(n, bool)
    head[1:] = ~((t[1:] == t[:-1]) & ((t[1:] == NUMBER) | (t[1:] == NAME)) & slot[1:] & slot[:-1] & (w.row[1:] == w.row[:-1]))
    start = np.flatnonzero(head)
    inside = np.arange(n) - start[np.cumsum(head) - 1]
    value = np.add.reduceat(w.hash * np.power(RUN_BASE, inside.astype(np.uint64)), start) if n else np.zeros(0, np.uint64)
    return Tokens(t[start], slot[start], value.view(np.int64), start, np.append(start[1:], n), w.row[start])


def _slotted(k: Tokens, size: int) -> np.ndarray:
    """First tokens of the windows that lie in one row, hold a slot, and ``LITERAL`` words or more; those without a slot are their own plain form."""
    i = np.flatnonzero(k.row[: max(len(k.row) - size + 1, 0)] == k.row[size - 1 :])
    total = np.concatenate([[0], np.cumsum(k.slot)])
    slots = total[i + size] - total[i]
    return i[(slots > 0) & (slots <= size - min(LITERAL, size - 1))]


def _slot_values(k: Tokens, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values behind the windows' placeholders, window after window, and how many each window has."""
    total = np.concatenate([[0], np.cumsum(k.slot)])
    n = total[first + size] - total[first]
    where = np.repeat(total[first] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return k.value[np.flatnonzero(k.slot)][where], n


WINDOW_SCHEMA = "item_id long, window long, pos int, last int, n_windows int, slots array<long>, slot_at array<int>, plain boolean, width int, need int"


def _windows_of(text: pa.Array, width: int) -> list[tuple]:
    """An item's windows, as in WINDOW_SCHEMA but for the id.

    ``pos`` to ``last``: the plain windows that a hit counts for. ``need``: words that a document's window must have.
    """
    w, t, slot = template(text)
    n = len(t)
    if n < MIN_WORDS:
        return []
    size = min(width, n)
    count = n - size + 1
    out = [(x, i, i, count, [], [], True, size, size) for i, x in enumerate(textvec.windows(w.hash, size).view(np.int64).tolist())]
    k = tokens(w, t, slot)
    few = min(width, len(k.hash))
    h = textvec.windows(k.hash, few).view(np.int64)
    need = few if few >= min(MIN_WORDS, width) else size
    at = _slotted(k, few)
    values, sizes = _slot_values(k, at, few)
    lists = np.split(values, np.cumsum(sizes)[:-1]) if len(at) else []
    return out + [(int(h[i]), int(k.start[i]), int(k.end[i + few - 1]) - size, count, v.tolist(), k.start[i : i + few][k.slot[i : i + few]].tolist(), False, few, need) for i, v in zip(at.tolist(), lists, strict=True)]


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All windows of the items, as templates and as plain words, by WINDOW_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = textvec.strings(batch.column(1))
            out = [(ids[i], *r) for i in range(len(texts)) for r in _windows_of(texts.slice(i, 1), width)]
            yield pa.RecordBatch.from_pylist([dict(zip(_ITEM_ARROW.names, r, strict=True)) for r in out], schema=_ITEM_ARROW)

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return in_arrow(rows, run, WINDOW_SCHEMA)


_ITEM_ARROW = pa.schema(
    [("item_id", pa.int64()), ("window", pa.int64()), ("pos", pa.int32()), ("last", pa.int32()), ("n_windows", pa.int32()), ("slots", pa.list_(pa.int64())), ("slot_at", pa.list_(pa.int32())), ("plain", pa.bool_()), ("width", pa.int32()), ("need", pa.int32())]
)
HIT_SCHEMA = "doc_id long, th long, window long, at int, words int, doc_slots array<long>"
_HIT_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("window", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("doc_slots", pa.list_(pa.int64()))])


def _bitmap(windows: DataFrame, bits: int) -> tuple[list[tuple[bool, int, int]], bytes]:
    """Kinds of windows in use (plain, width, least words), and a bit map of hashes: distinct bytes of the map come back, at most 2**bits / 8."""
    place = F.shiftrightunsigned(F.col("window"), 64 - bits)
    words = windows.groupBy((place / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(window, %d), 64) as int))" % (64 - bits))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    kinds = sorted(tuple(r) for r in windows.groupBy("plain", "width").agg(F.min("need")).collect())  # at most 2 * WIDTH values
    return kinds, out.tobytes()


def document_hits(docs: DataFrame, windows: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Windows of documents that the benchmark may have, by HIT_SCHEMA: ``at`` is the first word, ``words`` their number."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, raw = shared.value
        found = np.frombuffer(raw, np.uint64)

        def known(h: np.ndarray) -> np.ndarray:
            place = h >> _U(64 - bits)
            return (found[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1

        for batch in batches:
            row, window, place, words, sizes, slots = ([] for _ in range(6))
            for at, part in textvec.slices(textvec.strings(batch.column(2))):
                w, t, slot = template(part)
                k = tokens(w, t, slot)
                for plain, size, need in kinds:
                    h = textvec.windows(w.hash if plain else k.hash, size)
                    if plain:
                        i = np.flatnonzero(w.row[: len(h)] == w.row[size - 1 :]) if len(h) else np.zeros(0, np.int64)
                        start, end = i, i + size
                    else:
                        i = _slotted(k, size)
                        start, end = k.start[i], k.end[i + size - 1]
                    x = np.flatnonzero(known(h[i]) & (end - start >= need))
                    r = w.row[start[x]]
                    values, n = (np.zeros(0, np.int64), np.zeros(len(x), np.int64)) if plain else _slot_values(k, i[x], size)
                    for store, y in zip((row, window, place, words, sizes, slots), (at + r, h[i[x]].view(np.int64), start[x] - w.bounds[r], end[x] - start[x], n, values), strict=True):
                        store.append(y)
            cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            take = pa.array(cat(row), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cat(sizes))]), pa.int32()), pa.array(cat(slots), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cat(window), pa.int64()), pa.array(cat(place), pa.int32()), pa.array(cat(words), pa.int32()), lists], schema=_HIT_ARROW)

    text = F.col("text").cast("string")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return in_arrow(rows, run, HIT_SCHEMA)


def _consistent(hits: list[dict]) -> list[dict]:
    """The hits whose slots agree: each value of the item stands for the value that most of its places have.

    A hit with the original's own values always agrees. Where no value has more places than each other one, only the original's agrees.
    """
    places: dict[int, dict[int, set[int]]] = {}
    for h in hits:
        for was, value, at in zip(h["slots"], h["doc_slots"], h["slot_at"], strict=True):
            places.setdefault(was, {}).setdefault(value, set()).add(at)
    stands: dict[int, int] = {}
    for was, values in places.items():
        most = max(map(len, values.values()))
        first = [v for v, at in values.items() if len(at) == most]
        stands[was] = first[0] if len(first) == 1 else was
    return [h for h in hits if h["slots"] == h["doc_slots"] or all(stands[was] == value for was, value in zip(h["slots"], h["doc_slots"], strict=True))]


def _alignments(hits: list[dict], reach: int) -> list[list[dict]]:
    """Hits of each shift, and of each chain of shifts less than ``reach`` apart."""
    by: dict[int, list[dict]] = {}
    for h in hits:
        by.setdefault(h["at"] - h["pos"], []).append(h)
    chains: list[list[int]] = []
    for s in sorted(by):
        if chains and s - chains[-1][-1] < reach:
            chains[-1].append(s)
        else:
            chains.append([s])
    return [*by.values(), *([h for s in c for h in by[s]] for c in chains if len(c) > 1)]


def _judge(hits: list[dict], width: int, coverage: float, run_words: int) -> tuple[int, int, float, bool] | None:
    """(n_hits, n_windows, coverage, exact) of the best alignment of one document and item; None if no alignment suffices."""
    n = hits[0]["n_windows"]
    best = None
    for part in _alignments(hits, n + width - 1):
        got, same = np.zeros(n, bool), np.zeros(n, bool)
        for h in _consistent(part):
            got[h["pos"] : h["last"] + 1] = True
            if h["slots"] == h["doc_slots"]:
                same[h["pos"] : h["last"] + 1] = True
        count = int(got.sum())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], got.view(np.int8), [0]])))
        run = int((edges[1::2] - edges[::2]).max()) + width - 1 if count else 0
        if count and (count / n >= coverage or run >= run_words):
            found = (count, n, count / n, bool((same == got).all()))
            best = found if best is None else max(best, found)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, th, item_id, n_hits, n_windows, coverage, exact) of each document and item it holds.

    ``n_hits`` of the item's plain windows are hit. ``exact``: all slots have the original's values.
    """
    windows = materialise(item_windows(benchmark, width), "bench-windows")
    hits = document_hits(docs, windows)
    joined = hits.join(small(windows), "window").where((F.size("slots") == F.size("doc_slots")) & (F.col("words") >= F.col("need")))
    names = ["doc_id", "th", "item_id", "n_hits", "n_windows", "coverage", "exact"]

    def run(table: pa.Table) -> pa.Table:
        hits = table.to_pylist()
        found = _judge(hits, width, coverage, run_words)
        rows = [(hits[0]["doc_id"], hits[0]["th"], hits[0]["item_id"], *found)] if found else []
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_FOUND_ARROW)

    rows = joined.select("doc_id", "th", "item_id", "at", "pos", "last", "n_windows", "slots", "slot_at", "doc_slots")
    return rows.groupBy("doc_id", "th", "item_id").applyInArrow(run, "doc_id long, th long, item_id long, n_hits long, n_windows long, coverage double, exact boolean")


_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("n_hits", pa.int64()), ("n_windows", pa.int64()), ("coverage", pa.float64()), ("exact", pa.bool_())])


def marked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, th, item_ids, n_items, coverage, exact): one row for each document that holds an item; item ids ascend."""
    return contaminated(docs, benchmark, **options).groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count_distinct("item_id").alias("n_items"), F.round(F.max("coverage"), 9).alias("coverage"), F.max("exact").alias("exact")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item; all columns stay."""
    bad = small(settle(docs.sparkSession, lambda: marked(docs, benchmark, **options).select("doc_id", "th"), "bench-docs"))
    same = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["th"])
    return docs.join(bad, same, "left_anti")
