"""Approximate nearest neighbours by multi-index hashing.

1. Learning, on a bounded sample: ``ROTATIONS`` rotations of the centred, normalised vectors, each fitted by
   iterative quantisation; the signs of all rotated coordinates are a vector's binary code. The search radius is the
   ``RADIUS_QUANTILE`` of Hamming distances between sample vectors and those of their neighbours that stand, at the
   sample's density, for the wished ones.
2. Index: codes are split into substrings of ``SUB_BITS`` bits; every shard of the table keeps, for each
   substring, the lists of its rows by value.
3. Search: by the pigeonhole principle a code within radius r of the query's agrees with it within floor(r / m) bits in one
   of m substrings. All lists whose value is that near are read, full codes are compared, and every
   code within the radius is ranked by the inner product of the original vectors in double precision.
   A shard in which fewer than k codes are within the radius widens it until k are found or none is left.

Queries meet shards in blocks: a task holds one block of queries and one shard, both of bounded size,
and returns at most k rows a query. The best k of all shards are the result.

Defined cases: vectors that are null, of another dimension than most, zero, or hold null or non-finite values take no
part; ties go to the smaller id; a repeated id asks once, with its least vector, and is a candidate of other ids each time;
fewer candidates than k give fewer rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
SAMPLE, SAMPLE_QUERIES = 4096, 256
ROTATIONS, ROUNDS, SUB_BITS = 4, 10, 8
RADIUS_QUANTILE = 0.99
SHARD_ROWS, QUERY_ROWS, MIN_SHARDS = 20_000, 4096, 12


@dataclass
class Codes:
    """A learned code: centre, projection to signs, search radius."""

    mean: np.ndarray
    projection: np.ndarray
    radius: int

    def signs(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (unit - self.mean) @ self.projection > 0

    def words(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(self.signs(x), axis=1)


def learn(x: np.ndarray, n_rows: int, k: int = K, rotations: int = ROTATIONS, rounds: int = ROUNDS) -> Codes:
    """Codes and radius from a sample of ``x``, of a table of ``n_rows`` rows."""
    rng = np.random.default_rng(11)
    near = round(k * len(x) / max(1, n_rows))
    x = np.unique(x, axis=0)  # a common vector must not stand for most queries
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred, dim = unit - mean, x.shape[1]
    parts = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):  # Procrustes: the rotation that brings the points nearest to their signs
            u, _, v = np.linalg.svd(np.where(centred @ r > 0, 1.0, -1.0).T @ centred)
            r = (u @ v).T
        parts.append(r)
    pad = -(rotations * dim) % SUB_BITS
    codes = Codes(mean, np.concatenate([*parts, np.zeros((dim, pad))], axis=1), 0)
    words = codes.words(x)
    queries = np.sort(rng.permutation(len(x))[:SAMPLE_QUERIES])
    near = max(1, min(len(x) - 1, near))
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    top = np.argpartition(-score, min(near, len(x) - 1), axis=1)[:, :near] if len(x) > 1 else np.zeros((len(queries), 0), np.int64)
    distance = np.bitwise_count(words[queries][:, None, :] ^ words[top]).sum(axis=2) if top.size else np.zeros(1)
    codes.radius = int(np.quantile(distance, RADIUS_QUANTILE))
    return codes


class Shard:
    """Rows of one shard under a multi-index: for each substring, rows ordered by its value and where each value begins."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.codes = ids[order], x[order], codes
        self.words = codes.words(self.x)
        self.lists = [np.argsort(self.words[:, j], kind="stable") for j in range(self.words.shape[1])]
        self.starts = [np.searchsorted(self.words[a, j], np.arange(257)) for j, a in enumerate(self.lists)]
        self.apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])

    def within(self, word: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius of ``word``."""
        m, n = len(word), len(self.ids)
        reach = radius // m
        if reach >= SUB_BITS:  # every list is near enough
            rows = np.arange(n)
        else:
            seen = np.zeros(n, bool)
            for j in range(m):
                for value in np.flatnonzero(self.apart[word[j]] <= reach).tolist():
                    a, b = self.starts[j][value], self.starts[j][value + 1]
                    if a < b:
                        seen[self.lists[j][a:b]] = True
            rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.words[rows] ^ word).sum(axis=1, dtype=np.int64) <= radius]

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the k best rows found, best first; the query's own id takes no part."""
        word = self.codes.words(q[None, :])[0]
        radius, bits = self.codes.radius, self.codes.projection.shape[1]
        others = len(self.ids) - (np.searchsorted(self.ids, query_id, "right") - np.searchsorted(self.ids, query_id, "left"))
        while True:
            rows = self.within(word, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= min(k, others) or radius >= bits:
                break
            radius = min(bits, radius + len(word))
        score = (self.x[rows] * q).sum(axis=1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def _vectors(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    lists = table[name]
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def usable(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int, int]:
    """((vec_id, v) of vectors that take part, their number, their dimension)."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    by_size = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if by_size is None:
        return rows, 0, 0
    return rows.where(F.size("v") == by_size["dim"]), by_size["n"], by_size["dim"]


def nearest(embeddings: DataFrame, queries: F.Column, k: int = K, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that ``queries`` (a condition on vec_id) holds for, its k nearest found."""
    spark = embeddings.sparkSession
    rows, n, dim = usable(embeddings, column)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, 2 * SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    codes = spark.sparkContext.broadcast(learn(_vectors(sample, "v"), n, k))
    n_queries = rows.where(queries).count()
    shards, blocks = max(MIN_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    at = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(m)).cast("int")
    index = rows.select("vec_id", "v", at("shard", shards).alias("shard"), each(blocks).alias("block"))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", at("block", blocks).alias("block"), each(shards).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            shard = Shard(left["vec_id"].to_numpy(), _vectors(left, "v"), codes.value)
            for i, q in zip(right["vec_id"].to_pylist(), _vectors(right, "v"), strict=True):
                ids, score = shard.search(i, q, k)
                out.append((np.full(len(ids), i), ids, score))
        columns = [np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = index.groupBy("block", "shard").cogroup(asked.groupBy("block", "shard")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
