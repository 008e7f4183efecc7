"""Splits, schemas, unseen levels, personal-data patterns, corrupt samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalguard.functions import canon
from evalguard.operators.frames import unpivot

#: Patterns of personal data in trimmed cells; digits and blanks of any script count, as (?U) says.
PII_PATTERNS = {
    "email": r"^[^@\s]{1,64}@[^@\s]{2,}\.",
    "phone_like": r"^\+?[0-9][0-9\s().-]{7,14}$",
    "national_id_like": r"^\d{6}[-+]?\d{4}$|^\d{9,11}$",
}
#: Fixed value: what looks like a date is no phone number.
DATE_SHAPE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"


def split_sizes(df: DataFrame, split: str, declared: Sequence[str]) -> DataFrame:
    """(split, role, n) of every declared split, empty ones too."""
    spark = df.sparkSession
    names = spark.createDataFrame([(s, canon.role_of(s)) for s in declared], "split string, role string")
    counts = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"))
    return names.join(counts, "split", "left").fillna(0, ["n"])


def identity_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    """(split, label, n) by grouping sets: sizes of splits (label null) and of classes (split null), in one pass."""
    rows = df.select(F.col(split).alias("split"), F.coalesce(F.col(label).cast("string"), F.lit("<unlabeled>")).alias("label"))
    return rows.groupingSets([["split"], ["label"]], "split", "label").agg(F.count("*").alias("n"))


def schema_table(spark: SparkSession, splits: dict[str, DataFrame]) -> DataFrame:
    """(split, column, type) of the splits' own schemas."""
    return spark.createDataFrame([(s, c, canon.logical_type(df, c)) for s, df in splits.items() for c in df.columns], "split string, column string, type string")


def schema_drift(spark: SparkSession, splits: dict[str, DataFrame]) -> DataFrame:
    """(split, column, problem, expected, found): missing and extra columns and types against the first split by name."""
    t = schema_table(spark, splits)
    first = min(splits)
    ref = t.where(F.col("split") == first).select("column", F.col("type").alias("expected"))
    names = spark.createDataFrame([(s,) for s in splits if s != first], "split string")
    wanted = names.crossJoin(F.broadcast(ref))  # splits x columns
    both = wanted.join(t.where(F.col("split") != first).withColumnRenamed("type", "found"), ["split", "column"], "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("found") != F.col("expected"), "type")
    return both.withColumn("problem", problem).where("problem is not null").select("split", "column", "problem", "expected", "found")


def unseen_levels(df: DataFrame, columns: Sequence[str], split: str, train: str) -> DataFrame:
    """(split, column, n_levels, n_rows) of values that the training split never has; a missing cell is the level 'nan'."""
    level = F.when(F.col("x") == canon.NULL_CELL, "nan").otherwise(F.col("x"))
    counts = unpivot(df, columns, [split], "cell").select(F.col(split).alias("split"), "column", level.alias("level")).groupBy("split", "column", "level").agg(F.count("*").alias("n"))
    known = counts.where(F.col("split") == train).select("column", "level")
    return counts.where(F.col("split") != train).join(known, ["column", "level"], "left_anti").groupBy("split", "column").agg(F.count("*").alias("n_levels"), F.sum("n").alias("n_rows"))


def pii_rates(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """(split, column, pattern, matches, cells, ratio): one aggregate, no values shown; dates are no phone numbers."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in columns:
        text = F.trim(F.when(~canon.is_missing(df[c], kinds[c]), canon.cell(df[c], kinds[c])))
        aggs.append(F.count(text).alias(f"{c}|cells"))
        for name, pattern in PII_PATTERNS.items():
            hit = text.rlike("(?U)" + pattern)
            if name == "phone_like":
                hit = hit & ~text.rlike("(?U)" + DATE_SHAPE)
            aggs.append(F.count(F.when(hit, 1)).alias(f"{c}|{name}"))
    wide = df.groupBy(F.col(split).alias("split")).agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("pattern"), F.col(f"`{c}|{p}`").alias("matches"), F.col(f"`{c}|cells`").alias("cells")) for c in columns for p in PII_PATTERNS]
    return wide.select("split", F.explode(F.array(*entries)).alias("e")).select("split", "e.*").withColumn("ratio", F.coalesce(F.try_divide("matches", "cells"), F.lit(0.0)))


def corrupt_rates(decoded: DataFrame, split: str) -> DataFrame:
    """(split, files, corrupt, uninspected, rate) from a table of decoding outcomes."""
    return decoded.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("files"), F.count(F.when(F.col("corrupt"), 1)).alias("corrupt"), F.count(F.when(~F.col("inspected"), 1)).alias("uninspected")).withColumn("rate", F.col("corrupt") / F.col("files"))
