"""Statistics of splits as plans, and their scalar forms for the driver.

Plans work on long tables, one row a (column, side, value), and first count by value. Ranks, distribution functions and exact
quantiles all come from that one table by running sums in two levels (``ranked``): slices of a column at approximate
quantiles, then inside a slice. So a column of distinct values only is spread over ``SLICES`` tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
PSI_BINS = 10
SLICES = 32


# ---- distributions over levels: rows (…by, level, p_count, q_count)

def shares(df: DataFrame, by: Sequence[str], p: str, q: str) -> DataFrame:
    """Add p and q, the shares of two counts within each ``by`` group; an all-zero side has zero shares."""
    totals = df.groupBy(*by).agg(F.sum(p).alias("__p"), F.sum(q).alias("__q"))
    joined = df.join(totals, list(by)) if by else df.crossJoin(F.broadcast(totals))
    share = lambda c, t: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(t).cast("double")), F.lit(0.0))
    return joined.withColumn("p", share(p, "__p")).withColumn("q", share(q, "__q")).drop("__p", "__q")


def tv() -> Column:
    return F.sum(F.abs(F.col("p") - F.col("q"))) / 2


def jensen_shannon() -> Column:
    """Square root of the divergence in nats; the middle is at least EPS."""
    m = F.greatest((F.col("p") + F.col("q")) / 2, F.lit(EPS))
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), (F.sum(part("p")) + F.sum(part("q"))) / 2))


def entropy_bits(share: Column) -> Column:
    return -F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0))


# ---- numbers: rows (…by, side, x), side being 'ref' or 'tgt'

def moments(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean and sample variance of both sides, and the standardised mean difference (target minus reference).

    Null where a side has fewer than two values, or where values don't vary but means differ.
    """
    ref, tgt = F.when(F.col("side") == "ref", F.col("x")), F.when(F.col("side") == "tgt", F.col("x"))
    out = values.groupBy(*by).agg(
        F.count(ref).alias("n_ref"), F.count(tgt).alias("n_tgt"), F.avg(ref).alias("mean_ref"), F.avg(tgt).alias("mean_tgt"),
        F.var_samp(ref).alias("var_ref"), F.var_samp(tgt).alias("var_tgt"),
    )
    pooled = F.sqrt(F.try_divide((F.col("n_ref") - 1) * F.col("var_ref") + (F.col("n_tgt") - 1) * F.col("var_tgt"), (F.col("n_ref") + F.col("n_tgt") - 2).cast("double")))
    gap = F.col("mean_tgt") - F.col("mean_ref")
    smd = F.when(pooled > EPS, gap / pooled).when(F.abs(gap) <= EPS, 0.0)
    return out.withColumn("smd", smd)


def value_counts(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """(…by, x, n_ref, n_tgt): the only table that distances between distributions need."""
    return values.groupBy(*by, "x").agg(F.count(F.when(F.col("side") == "ref", 1)).alias("n_ref"), F.count(F.when(F.col("side") == "tgt", 1)).alias("n_tgt"))


def ranked(counts: DataFrame, by: Sequence[str], sums: Sequence[str], slices: int = SLICES) -> DataFrame:
    """Counts by value with, for each column c of ``sums``, c_before (its sum over smaller values) and c_all, and the next larger value."""
    at = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("x", at, F.lit(10 * slices)).alias("cuts"))  # one row a column
    joined = counts.join(F.broadcast(cuts), list(by)) if by else counts.crossJoin(F.broadcast(cuts))
    sliced = joined.withColumn("slice", _below(F.col("cuts"), F.col("x"), 0, slices - 1)).drop("cuts")
    totals = sliced.groupBy(*by, "slice").agg(*(F.sum(c).alias(c) for c in sums), F.min("x").alias("least"))
    order = Window.partitionBy(*by).orderBy("slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "slice", F.lead("least").over(order).alias("__after"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in sums), *(F.sum(c).over(Window.partitionBy(*by)).alias(f"{c}_all") for c in sums)
    )  # at most ``slices`` rows a column
    inner = Window.partitionBy(*by, "slice").orderBy("x")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(F.broadcast(offsets), [*by, "slice"]).select(
        *by, "x", *sums, *(f"{c}_all" for c in sums), F.coalesce(F.lead("x").over(inner), F.col("__after")).alias("next"),
        *((F.col(f"__{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"{c}_before") for c in sums),
    )


def _below(cuts: Column, x: Column, low: int, high: int) -> Column:
    """How many of the ascending cuts low to high - 1 are less than x, plus low: a binary search that stays in generated code."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(cuts[middle] < x, _below(cuts, x, middle + 1, high)).otherwise(_below(cuts, x, low, middle))


def ecdf() -> list[Column]:
    """Aggregates over ranked counts: Kolmogorov-Smirnov D and the 1-D Wasserstein distance."""
    share = lambda c: F.try_divide((F.col(f"{c}_before") + F.col(c)).cast("double"), F.col(f"{c}_all").cast("double"))
    gap = F.abs(share("n_ref") - share("n_tgt"))
    return [F.max(gap).alias("ks"), F.sum(gap * F.coalesce(F.col("next") - F.col("x"), F.lit(0.0))).alias("wasserstein")]


def quantile(p: float, n: Column, before: Column, total: Column) -> Column:
    """Aggregate over ranked counts: the exact quantile, interpolated between neighbours."""
    place = (F.max(total) - 1) * F.lit(p)
    inner = (total - 1) * F.lit(p)
    at = lambda k: F.max(F.when((before <= k) & (k < before + n), F.col("x")))
    low, high = at(F.floor(inner)), at(F.ceil(inner))
    return low + (high - low) * (place - F.floor(place))


def bin_index(x: Column, edges: Column) -> Column:
    """Place of x among ascending edges, 0-based, the last bin closed; null outside."""
    i = F.size(F.filter(edges, lambda e: e <= x)) - 1
    last = F.size(edges) - 2
    return F.when((x >= edges[0]) & (x <= F.element_at(edges, -1)), F.least(i, last))


def psi_edges(bins: int = PSI_BINS) -> Column:
    """Aggregate over ranked counts: the distinct quantiles of the reference."""
    ref = F.col("n_ref"), F.col("n_ref_before"), F.col("n_ref_all")
    return F.array_sort(F.array_distinct(F.array(*(quantile(i / bins, *ref) for i in range(bins + 1)))))


def psi(counts: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Population stability index of value counts on ``edges``, (…by, edges), one row a column: (…by, psi)."""
    joined = counts.join(F.broadcast(edges), list(by)) if by else counts.crossJoin(F.broadcast(edges))
    binned = joined.where(F.size("edges") >= 2).withColumn("bin", bin_index(F.col("x"), F.col("edges"))).where("bin is not null")
    # bins that nobody is in still count, with probability EPS on both sides: they add nothing
    s = shares(binned.groupBy(*by, "bin").agg(F.sum("n_ref").alias("e"), F.sum("n_tgt").alias("a")), by, "e", "a")
    e, a = F.greatest("p", F.lit(EPS)), F.greatest("q", F.lit(EPS))
    return s.groupBy(*by).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def psi_usable(n_target: Column | int, threshold: float) -> Column | bool:
    """Whether a target is large enough that the index's noise, 9 degrees of freedom over its rows, stays below the threshold."""
    return 9 / n_target < threshold


def rank_auc(df: DataFrame, x: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC with average ranks: (…by, n, n_pos, auc), from counts by value."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("x")).agg(F.count("*").alias("n"), F.count(F.when(positive, 1)).alias("pos"))
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    s = ranked(counts, by, ["n", "pos"]).withColumn("rank", rank).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("rank")).alias("ranks"))
    pos, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    return s.withColumn("auc", F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, pos * neg)).drop("ranks")


def cramers_v(pairs: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Association of two categorical columns from 0 to 1; null where one has a single level: (…by, cramers_v)."""
    cells = pairs.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))
    nx, ny, n = (F.sum("n").over(Window.partitionBy(*by, *k)) for k in (("x",), ("y",), ()))
    w = cells.withColumn("nx", nx).withColumn("ny", ny).withColumn("all", n)
    # chi2 / n = sum(observed^2 / (row * column)) - 1, empty cells included
    out = w.groupBy(*by).agg((F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))) - 1).alias("phi2"), F.count_distinct("x").alias("rows"), F.count_distinct("y").alias("columns"))
    least = F.least("rows", "columns") - 1
    return out.select(*by, F.when(least > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("phi2")) / least)).alias("cramers_v"))


def normalised_mi(pairs: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information over the entropy of y, in nats; 0 where y has none: (…by, nmi)."""
    cells = pairs.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))
    nx, ny, n = (F.sum("n").over(Window.partitionBy(*by, *k)) for k in (("x",), ("y",), ()))
    w = cells.withColumn("nx", nx).withColumn("ny", ny).withColumn("all", n)
    mi = F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny"))))
    h = -F.sum(F.col("n") / F.col("all") * F.log(F.col("ny") / F.col("all")))
    return w.groupBy(*by).agg(mi.alias("mi"), h.alias("h")).select(*by, F.when(F.col("h") > EPS, F.col("mi") / F.col("h")).otherwise(0.0).alias("nmi"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# ---- scalars for tables of a few rows

def benjamini_hochberg(p: Sequence[float | None]) -> list[float | None]:
    """Step-up adjusted values; missing ones stay missing."""
    known = sorted((x, i) for i, x in enumerate(p) if x is not None and not math.isnan(x))
    out: list[float | None] = list(p)
    low, m = 1.0, len(known)
    for rank in range(m, 0, -1):
        x, i = known[rank - 1]
        low = min(low, x * m / rank)
        out[i] = low
    return out


def ks_p_value(d: float, n: int, m: int) -> float:
    """Two-sided asymptotic p-value of the two-sample statistic (Kolmogorov's series)."""
    if min(n, m) < 2:
        return math.nan
    t = d * math.sqrt(n * m / (n + m))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def effective_classes(bits: float) -> float:
    return 2.0**bits
