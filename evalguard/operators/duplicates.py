"""Exact and near duplicates within and across splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalguard.functions import metrics
from evalguard.operators.frames import pairs_of

#: Rows of a block where hashes are compared block by block, and the most blocks: beyond, blocks grow and no row is copied more often.
BLOCK, MOST_BLOCKS = 8192, 64
#: Bands of fewer bits than these cost more than a comparison of all hashes.
NARROW = 7
#: Hashes of both sides that are compared at once; the distances stay in the processor's cache.
TILE_ROWS, TILE = 16, 8192


def digest_groups(df: DataFrame, digest: str, split: str) -> DataFrame:
    """(digest, n, splits): contents that occur more than once; members are never listed."""
    return df.groupBy(F.col(digest).alias("digest")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("splits")).where("n > 1")


def cross_split(groups: DataFrame) -> DataFrame:
    """(split_a, split_b, n_groups, affected, redundant) of contents shared between splits."""
    return (
        groups.where(F.size("splits") > 1).select("n", F.explode(pairs_of(F.col("splits"))).alias("p")).groupBy("p.split_a", "p.split_b")
        .agg(F.count("*").alias("n_groups"), F.sum("n").alias("affected"), F.sum(F.col("n") - 1).alias("redundant"))
    )


def within_split(groups: DataFrame) -> DataFrame:
    """(split, n_groups, affected, redundant) of contents repeated in one split only."""
    return groups.where(F.size("splits") == 1).groupBy(F.col("splits")[0].alias("split")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("affected"), F.sum(F.col("n") - 1).alias("redundant"))


def largest_groups(df: DataFrame, digest: str, sample: str, split: str, n_groups: int = 20, n_members: int = 10) -> DataFrame:
    """(digest, n, splits, members): the largest groups with their first members; a report's top-k, kept small map side."""
    top = digest_groups(df, digest, split).orderBy(F.desc("n"), "digest").limit(n_groups)
    rows = df.select(F.col(digest).alias("digest"), F.col(split).alias("split"), F.col(sample).cast("string").alias("sample")).join(F.broadcast(top.select("digest")), "digest")
    # a group's members are thinned slice by slice before they meet
    first = rows.groupBy("digest", F.pmod(F.xxhash64("sample"), F.lit(64)).alias("slice")).agg(F.slice(F.array_sort(F.collect_set(F.struct("split", "sample"))), 1, n_members).alias("m"))
    members = first.groupBy("digest").agg(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, n_members).alias("members"))
    return top.join(members, "digest").select("digest", "n", "splits", "members")


def first_rows(df: DataFrame, digest: Column, order: str) -> DataFrame:
    """Exact de-duplication that keeps the row of least ``order``; a hot content is reduced map side."""
    row = F.struct(*(df[c] for c in df.columns))
    return df.groupBy(digest.alias("__digest")).agg(F.min_by(row, order).alias("__row")).select("__row.*")


def bands(threshold: int) -> list[tuple[int, int]]:
    """(shift, mask) of threshold + 1 bands of 64 bits: two hashes within the threshold agree in one (pigeonhole)."""
    n = min(64, threshold + 1)
    width = 64 // n
    return [(i * width, (1 << width) - 1 if width < 64 else -1) for i in range(n)]


def near_hashes(df: DataFrame, hash_: str, threshold: int = 6) -> DataFrame:
    """(ha, hb, distance): all pairs of different 64-bit hashes within the Hamming threshold; exact, without a bucket cap.

    Equal hashes collapse to one first, so a hot hash costs one row in the join; a pair is made only in the
    first band that it shares, so no distinct is needed. Narrow bands hold nearly all pairs: then blocks are compared.
    """
    cut = bands(threshold)
    hashes = df.where(F.col(hash_).isNotNull()).select(F.col(hash_).alias("h")).distinct()
    if 0 < cut[0][1] < 1 << (NARROW - 1):
        return _near_in_blocks(hashes, threshold)
    band = lambda h, s, m: F.shiftrightunsigned(h, s).bitwiseAND(F.lit(m)) if m != -1 else h
    spread = hashes.select("h", F.posexplode(F.array(*(band(F.col("h"), s, m) for s, m in cut))).alias("band", "value"))
    a, b = spread.alias("a"), spread.alias("b")
    joined = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.h") < F.col("b.h")))
    xor = F.col("a.h").bitwiseXOR(F.col("b.h"))
    earlier = [F.when(F.col("a.band") > i, band(xor, s, m) != 0).otherwise(True) for i, (s, m) in enumerate(cut[:-1])]
    return joined.where((F.bit_count(xor) <= threshold) & (F.forall(F.array(*earlier), lambda x: x) if earlier else F.lit(True))).select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb"), metrics.hamming(F.col("a.h"), F.col("b.h")).alias("distance"))


def close(a: np.ndarray, b: np.ndarray, threshold: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all a[i], b[j] at distances from 1 to the threshold, tile by tile; ``within`` one block (a is b) only i < j."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # the bits of an int64 are counted without its sign
    for s in range(0, len(a), TILE_ROWS):
        for q in range(s if within else 0, len(b), TILE):
            d = np.bitwise_count(a[s : s + TILE_ROWS, None] ^ b[None, q : q + TILE])
            width, d = d.shape[1], d.ravel()
            near = d <= threshold
            if near.size % 8:
                hit = np.flatnonzero(near)
            else:  # most are far: eight at a time
                some = (np.flatnonzero(near.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
                hit = some[near[some]]
            i, j, d = s + hit // width, q + hit % width, d[hit]
            keep = (d > 0) & (i < j) if within else d > 0
            if keep.any():
                yield i[keep], j[keep], d[keep]


def between_blocks(df: DataFrame, hash_: str, run, schema: str) -> DataFrame:
    """``run(a, b, within)`` for each two blocks of rows, and for each block with itself: every two rows meet in exactly one task, which holds two blocks."""
    n = max(1, min(MOST_BLOCKS, -(-df.count() // BLOCK)))
    own, other = F.col("__own"), F.col("__other")
    spread = df.withColumn("__own", F.pmod(F.xxhash64(hash_), F.lit(n)).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    dealt = spread.select(*df.columns, side.cast("byte").alias("__side"), F.least(own, other).alias("__lo"), F.greatest(own, other).alias("__hi")).repartition(n * (n + 1) // 2, "__lo", "__hi")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        side = rows["__side"].to_numpy()
        within = bool(side[0] == 2)
        yield from run(rows if within else rows.filter(pa.array(side == 0)), rows if within else rows.filter(pa.array(side == 1)), within)

    return dealt.groupBy("__lo", "__hi").applyInArrow(task, schema)


def _near_in_blocks(hashes: DataFrame, threshold: int) -> DataFrame:
    def run(a: pa.Table, b: pa.Table, within: bool) -> Iterator[pa.RecordBatch]:
        ha, hb = a["h"].to_numpy(), b["h"].to_numpy()
        batch = lambda rows: pa.record_batch({n: pa.array(np.concatenate(c), t) for n, c, t in zip(("ha", "hb", "distance"), zip(*rows), (pa.int64(), pa.int64(), pa.int32()))})
        found, n = [], 0
        for i, j, d in close(ha, hb, threshold, within):
            found.append((np.minimum(ha[i], hb[j]), np.maximum(ha[i], hb[j]), d.astype(np.int32)))
            n += len(d)
            if n >= 1 << 16:
                yield batch(found)
                found, n = [], 0
        if found:
            yield batch(found)

    return between_blocks(hashes, "h", run, "ha long, hb long, distance int")


def near_histogram(df: DataFrame, hash_: str, split: str, threshold: int = 6) -> DataFrame:
    """(x, y, distance, n): pairs of rows of different hashes within the threshold by their splits, x <= y, and distance.

    Exact: rows of one hash and split collapse to a size first, all sizes are compared in blocks, and only counts leave a task.
    """
    sizes = df.where(F.col(hash_).isNotNull()).groupBy(F.col(hash_).alias("h"), F.col(split).alias("split")).agg(F.count("*").alias("n"))

    def run(a: pa.Table, b: pa.Table, within: bool) -> Iterator[pa.RecordBatch]:
        sa, sb = a["split"].to_pylist(), b["split"].to_pylist()
        names = sorted({*sa, *sb})
        at = {x: i for i, x in enumerate(names)}
        sa, sb = np.array([at[x] for x in sa], np.int64), np.array([at[x] for x in sb], np.int64)
        na, nb = a["n"].to_numpy(), b["n"].to_numpy()
        counts = np.zeros((len(names), len(names), threshold + 1), np.int64)
        for i, j, d in close(a["h"].to_numpy(), b["h"].to_numpy(), threshold, within):
            np.add.at(counts, (np.minimum(sa[i], sb[j]), np.maximum(sa[i], sb[j]), d), na[i] * nb[j])
        x, y, d = np.nonzero(counts)
        yield pa.record_batch({"x": pa.array([names[k] for k in x], pa.string()), "y": pa.array([names[k] for k in y], pa.string()), "distance": pa.array(d, pa.int32()), "n": pa.array(counts[x, y, d], pa.int64())})

    return between_blocks(sizes, "h", run, "x string, y string, distance int, n long").groupBy("x", "y", "distance").agg(F.sum("n").alias("n"))


def closest_distances(histogram: DataFrame, k: int = 20) -> DataFrame:
    """(x, y, distance, n): the distances of the k closest pairs of each two splits, from (x, y, distance, n) of all."""
    before = F.sum("n").over(Window.partitionBy("x", "y").orderBy("distance")) - F.col("n")  # a row a distance
    return histogram.withColumn("before", before).where(F.col("before") < k).select("x", "y", "distance", F.least(F.col("n"), k - F.col("before")).alias("n"))


def near_pairs(df: DataFrame, sample: str, hash_: str, threshold: int = 6) -> DataFrame:
    """(a, b, distance): all pairs of rows of different hashes within the threshold, a < b; members come back by a join on the hash.

    Rows of one hash are no pairs here: ``equal_hash_classes`` and ``equal_hash_pairs`` report those of different content.
    """
    left = df.select(F.col(sample).alias("ia"), F.col(hash_).alias("ha"))
    right = df.select(F.col(sample).alias("ib"), F.col(hash_).alias("hb"))
    return near_hashes(df, hash_, threshold).join(left, "ha").join(right, "hb").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "distance").where("a < b")


def near_counts(df: DataFrame, hashes: DataFrame, hash_: str, split: str) -> DataFrame:
    """(x, y, n, least): pairs of rows behind pairs of hashes by their splits, x <= y, counted from sizes and never made."""
    sizes = df.where(F.col(hash_).isNotNull()).groupBy(F.col(hash_).alias("h"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    own = sizes.groupBy("h").agg(F.collect_list(F.struct("split", "n")).alias("s"))  # as many entries as splits
    a, b = own.select(F.col("h").alias("ha"), F.col("s").alias("sa")), own.select(F.col("h").alias("hb"), F.col("s").alias("sb"))
    both = F.expr("flatten(transform(sa, p -> transform(sb, q -> struct(least(p.split, q.split) as x, greatest(p.split, q.split) as y, p.n * q.n as n))))")
    return hashes.join(a, "ha").join(b, "hb").select("distance", F.explode(both).alias("p")).groupBy("p.x", "p.y").agg(F.sum("p.n").alias("n"), F.min("distance").alias("least"))


def closest_examples(df: DataFrame, hashes: DataFrame, sample: str, hash_: str, content: str, split: str, k: int = 20) -> DataFrame:
    """(x, y, a, b, distance): for each two splits, k pairs of least distance; one row stands for each content, hash and split."""
    rows = df.where(F.col(hash_).isNotNull()).groupBy(F.col(hash_).alias("h"), F.col(split).alias("split")).agg(F.min(F.struct(F.col(sample).cast("string").alias("id"), F.col(content).alias("c"))).alias("lo"), F.max(F.struct(F.col(content).alias("c"), F.col(sample).cast("string").alias("id"))).alias("hi"))
    one = rows.select("h", "split", F.col("lo.id").alias("id"), F.col("lo.c").alias("c"))
    other = one.unionByName(rows.select("h", "split", F.col("hi.id").alias("id"), F.col("hi.c").alias("c")))
    pick = lambda d, n: d.select(F.col("h").alias(f"h{n}"), F.col("split").alias(f"s{n}"), F.col("id").alias(f"i{n}"), F.col("c").alias(f"c{n}"))
    near = hashes.join(pick(one, "a"), "ha").join(pick(one, "b"), "hb").select("sa", "sb", "ia", "ib", "distance")
    equal = pick(other, "a").join(pick(other, "b"), F.col("ha") == F.col("hb")).where("not ca <=> cb and (sa < sb or sa = sb and ia < ib)").select("sa", "sb", "ia", "ib", F.lit(0).alias("distance"))
    x = near.unionByName(equal).select(F.least("sa", "sb").alias("x"), F.greatest("sa", "sb").alias("y"), F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "distance").distinct()
    # the k least of each two splits are kept map side
    part = x.groupBy("x", "y", F.pmod(F.xxhash64("a", "b"), F.lit(64))).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "a", "b"))), 1, k).alias("m"))
    return part.groupBy("x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, k).alias("m")).select("x", "y", F.explode("m").alias("e")).select("x", "y", "e.a", "e.b", "e.distance")


def equal_hash_classes(df: DataFrame, sample: str, hash_: str, content: str) -> DataFrame:
    """(sample, class_id, class_size, n_contents): rows whose hash (distance 0) stands for more than one content; class_id is the least sample."""
    rows = df.where(F.col(hash_).isNotNull()).select(F.col(sample), F.col(hash_).alias("h"), F.col(content).alias("c"))
    contents = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(sample).alias("least"))
    classes = contents.groupBy("h").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_contents")).where("n_contents > 1")
    return rows.select(sample, "h").join(classes, "h").select(sample, "class_id", "class_size", "n_contents")


def _pairs_by_split(df: DataFrame, keys: list[str], split: str) -> DataFrame:
    """(x, y, n): pairs of rows that share the keys by their splits, counted from sizes and never made; x <= y."""
    sizes = df.groupBy(*keys, F.col(split).alias("split")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("split", "n"))).alias("s"))
    # as many entries as splits
    pairs = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 1, size(s)), (b, j) -> struct(a.split as x, b.split as y, if(j = 0, a.n * (a.n - 1) div 2, a.n * b.n) as n))))")
    return sizes.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.sum("p.n").alias("n"))


def equal_hash_pairs(df: DataFrame, hash_: str, content: str, split: str) -> DataFrame:
    """(x, y, n): pairs of rows of equal hash and different content by their splits, x <= y."""
    rows = df.where(F.col(hash_).isNotNull()).select(F.col(hash_).alias("h"), F.col(content).alias("c"), split)
    same = _pairs_by_split(rows.where("c is not null"), ["h", "c"], split).withColumnRenamed("n", "same")
    return _pairs_by_split(rows, ["h"], split).join(same, ["x", "y"], "left").select("x", "y", (F.col("n") - F.coalesce("same", F.lit(0))).alias("n")).where("n > 0")


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """64-bit hash of a vector's signs."""
    powers = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(bits)))
    return F.aggregate(F.zip_with(F.slice(vector, 1, bits), powers, lambda x, p: F.when(x > 0, p).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
