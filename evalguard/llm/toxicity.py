"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring words and of words one
apart, in ``2**BITS`` slots. FTRL-proximal (McMahan et al., 2013) gives each coordinate its own rate
and, through L1, an exact zero to most: what remains is a short list of slots and weights that is
broadcast, with a proven bound of ``MAX_WEIGHTS`` entries.

It learns from a bounded sample of labelled rows, whole texts: at most ``SAMPLE_ROWS`` of each class by the hash
of their ids, as long as their features fit into ``SAMPLE_FEATURES`` a class (a text that doesn't fit any more
is passed over for the next one). Every whole text is scored.

Defined cases: a null or empty text has the bias as its only feature; a very long text is scored whole; labels that are null or belong
to no document teach nothing, an id with several labels is toxic if one says so, and a repeated id teaches once; without both classes in the
sample every score is the share of toxic rows (0.5 with no row); a score of exactly 0.5 counts as toxic; documents with null ids
are scored; repeated rows get the same score; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalguard.llm import textvec
from evalguard.llm.common import in_arrow, materialise

BITS = 20
SAMPLE_ROWS, SAMPLE_FEATURES = 3_000, 3_000_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
EPOCHS = 8
#: A toxic row weighs as much as so many others.
TOXIC_WEIGHT = 4.0
MAX_WEIGHTS = 1 << BITS
_U = np.uint64


def slots(words: textvec.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of all unigrams, bigrams and skip-grams of a slice, repeats included."""
    h, row = words.hash, words.row
    out, rows = [h], [row]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            out.append(textvec.mix(h[:-gap] * _U(salt) + h[gap:])[same])
            rows.append(row[:-gap][same])
    return (np.concatenate(out) >> _U(64 - bits)).astype(np.int64), np.concatenate(rows)


@dataclass
class Weights:
    """The non-zero slots in ascending order, their weights, and the bias."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


class Ftrl:
    """FTRL-proximal for logistic loss over rows of distinct binary features."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, features: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        n = self.n[at]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] = n + g * g


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> Weights:
    """Weights learned from (distinct slots, label) pairs, shuffled in each epoch by a fixed seed."""
    labels = [y for _, y in rows]
    if len(set(labels)) < 2:
        share = min(max(sum(labels) / len(labels), 1e-6), 1 - 1e-6) if labels else 0.5
        return Weights(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    model, order = Ftrl(1 << bits), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            model.step(x, y, TOXIC_WEIGHT if y else 1.0)
    w = model.weights(slice(0, 1 << bits))
    kept = np.flatnonzero(w)
    return Weights(kept, w[kept], float(model.weights(np.array([1 << bits]))[0]))


def fitting(sizes: list[int], room: int) -> list[int]:
    """Which of the items, in their order, are taken while they fit into the room; one that doesn't fit is passed over."""
    out = []
    for i, n in enumerate(sizes):
        if n <= room:
            out.append(i)
            room -= n
    return out


def learning_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, features: int = SAMPLE_FEATURES, bits: int = BITS) -> list[tuple[np.ndarray, int]]:
    """Distinct slots and label of at most ``rows`` labelled texts of each class, with at most ``features`` slots in all."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64(F.lit("toxic"), "doc_id").alias("h"))
    known = known.groupBy("doc_id", "h").agg(F.max("toxic").alias("toxic"))
    pools = [known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(rows) for y in (0, 1)]
    chosen = materialise(pools[0].unionByName(pools[1]).select("doc_id", "toxic", "h"), "toxic-sample")  # at most 2 * rows
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("r")).select("doc_id", "toxic", "h", "r.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for _, part in textvec.slices(textvec.strings(batch.column(3))):
                slot, row = slots(textvec.words(part), bits)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(part) + 1))
                lists += [np.unique(slot[order[a:b]]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in lists], pa.int64()), pa.array([x.tobytes() for x in lists], pa.binary())], ["doc_id", "toxic", "h", "n", "slots"])

    learned = materialise(in_arrow(found, run, "doc_id long, toxic int, h long, n long, slots binary"), "toxic-features")
    sizes = learned.select("toxic", "h", "doc_id", "n").orderBy("toxic", "h", "doc_id").collect()
    taken = [r for y in (0, 1) for group in [[r for r in sizes if r["toxic"] == y]] for r in (group[i] for i in fitting([x["n"] for x in group], features))]
    if not taken:
        return []
    ids = spark.createDataFrame([(r["doc_id"],) for r in taken], "doc_id long")
    got = learned.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "slots").toArrow()
    order = sorted(zip(got["doc_id"].to_pylist(), got["toxic"].to_pylist(), got["slots"].to_pylist(), strict=True))
    return [(np.frombuffer(x, np.int32).astype(np.int64), y) for _, y, x in order]


def score(docs: DataFrame, weights: Weights, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every whole text."""
    if len(weights.slot) > MAX_WEIGHTS:
        raise ValueError("more weights than slots")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = np.zeros(1 << bits)
        dense[model.slot] = model.weight
        live = dense != 0
        for batch in batches:
            total = np.full(batch.num_rows, model.bias)
            for at, part in textvec.slices(textvec.strings(batch.column(1))):
                slot, row = slots(textvec.words(part), bits)
                hit = live[slot]
                pair = np.unique((row[hit] << bits) | slot[hit])  # a feature counts once in a text
                total[at : at + len(part)] += np.bincount(pair >> bits, weights=dense[pair & ((1 << bits) - 1)], minlength=len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")
