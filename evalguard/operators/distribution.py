"""Shift of features, missingness and image properties between a reference split and a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalguard.functions import canon, metrics
from evalguard.operators.frames import sides, unpivot

MAX_LEVELS, MIN_VALUES = 200, 5
#: Numeric image properties that are compared.
IMAGE_PROPERTIES = ("width", "height", "brightness", "contrast", "aspect_ratio")


def numeric_shift(df: DataFrame, columns: Sequence[str], split: str, reference: str, target: str) -> DataFrame:
    """(column, n_ref, n_tgt, means, variances, smd, psi, ks, wasserstein, normalised_wasserstein) of each numeric column."""
    values = unpivot(sides(df, split, reference, target), columns, ["side"], "number")
    by = ["column"]
    counts = metrics.value_counts(values, by)
    every = F.col("n_ref") + F.col("n_tgt"), F.col("n_ref_before") + F.col("n_tgt_before"), F.col("n_ref_all") + F.col("n_tgt_all")
    spread = metrics.quantile(0.95, *every) - metrics.quantile(0.05, *every)
    found = metrics.ranked(counts, by, ["n_ref", "n_tgt"]).groupBy(*by).agg(*metrics.ecdf(), spread.alias("scale"), metrics.psi_edges().alias("edges"))  # one row a column
    edges = found.select(*by, "edges")
    out = metrics.moments(values, by).join(metrics.psi(counts, edges, by), by, "left").join(found.drop("edges"), by)
    flat = F.when(F.col("wasserstein") > metrics.EPS, 1.0).otherwise(0.0)
    return out.withColumn("normalised_wasserstein", F.when(F.col("scale") > metrics.EPS, F.col("wasserstein") / F.col("scale")).otherwise(flat)).drop("scale")


def profile(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """(split, column, n, mean, std, sample_std): std is the population's."""
    long = unpivot(df, columns, [split], "number")
    return long.groupBy(F.col(split).alias("split"), "column").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.stddev_samp("x").alias("sample_std"))


def categorical_shift(df: DataFrame, columns: Sequence[str], split: str, reference: str, target: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(column, levels, tv, js) of each column with at most ``max_levels`` levels on both sides together."""
    values = unpivot(sides(df, split, reference, target), columns, ["side"], "text")
    counts = values.groupBy("column", "x").agg(F.count(F.when(F.col("side") == "ref", 1)).alias("r"), F.count(F.when(F.col("side") == "tgt", 1)).alias("t"))
    return metrics.shares(counts, ["column"], "r", "t").groupBy("column").agg(F.count("*").alias("levels"), metrics.tv().alias("tv"), metrics.jensen_shannon().alias("js")).where(F.col("levels") <= max_levels)


def missingness(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """(split, column, null_rate): one aggregate over the frame as it is."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rates = df.groupBy(F.col(split).alias("split")).agg(*(F.avg(canon.is_missing(df[c], kinds[c]).cast("double")).alias(c) for c in columns))
    return rates.select("split", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns))).alias("e")).select("split", "e.*")


def missingness_shift(df: DataFrame, columns: Sequence[str], split: str, reference: str, min_delta: float = 0.1) -> DataFrame:
    """(split, column, ref_rate, rate, delta) where the rates differ by ``min_delta``."""
    rates = missingness(df, columns, split)
    ref = rates.where(F.col("split") == reference).select("column", F.col("null_rate").alias("ref_rate"))
    out = rates.where(F.col("split") != reference).join(F.broadcast(ref), "column")  # a row for each column
    return out.select("split", "column", "ref_rate", F.col("null_rate").alias("rate"), (F.col("null_rate") - F.col("ref_rate")).alias("delta")).where(F.abs("delta") >= min_delta - 1e-12)
