"""Labels: conflicts on equal content, missing labels, imbalance, shift between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalguard.functions import canon, metrics


def conflicts(df: DataFrame, digest: str, label: str, split: str) -> DataFrame:
    """(digest, n, n_labels, n_forms, splits) of contents with more than one label; a missing label is one."""
    shown = F.coalesce(F.col(label).cast("string"), F.lit("<unlabeled>"))
    return (
        df.groupBy(F.col(digest).alias("digest")).agg(F.count("*").alias("n"), F.count_distinct(shown).alias("n_labels"), F.count_distinct(canon.label_form(shown)).alias("n_forms"), F.array_sort(F.collect_set(split)).alias("splits"))
        .where("n_labels > 1")
    )


def conflict_summary(groups: DataFrame) -> DataFrame:
    """(scope, n_groups, affected, encoding_only): scope is cross or the split."""
    scope = F.when(F.size("splits") > 1, "cross").otherwise(F.col("splits")[0])
    return groups.groupBy(scope.alias("scope")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("affected"), F.count(F.when(F.col("n_forms") == 1, 1)).alias("encoding_only"))


def missing(df: DataFrame, label: str, split: str) -> DataFrame:
    return df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"), F.count(F.when(canon.clean_label(F.col(label)).isNull(), 1)).alias("unlabelled")).withColumn("ratio", F.col("unlabelled") / F.col("rows"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.select(F.coalesce(canon.clean_label(F.col(label)), F.lit("<unlabeled>")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, rows, imbalance ratio, minority share, entropy (bits), effective classes."""
    counts = class_counts(df, label).where("label != '<unlabeled>'")
    total = F.sum("n").over(Window.partitionBy())
    rows = counts.withColumn("share", F.col("n") / total)
    out = rows.agg(F.count("*").alias("n_classes"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("n").alias("least"), metrics.entropy_bits(F.col("share")).alias("entropy"))
    return out.select("n_classes", "rows", F.when(F.col("n_classes") > 1, F.col("most") / F.col("least")).otherwise(1.0).alias("imbalance_ratio"), (F.col("least") / F.col("rows")).alias("minority_share"), "entropy", F.pow(F.lit(2.0), "entropy").alias("effective_classes"))


def shift(df: DataFrame, label: str, split: str, reference: str) -> DataFrame:
    """(split, tv, js, common_classes) of every other split against the reference."""
    counts = df.select(F.col(split).alias("split"), canon.clean_label(F.col(label)).alias("label")).where("label is not null").groupBy("split", "label").agg(F.count("*").alias("n"))
    # one row a class with its counts by split; each other split then takes its own and the reference's
    by_class = counts.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("by"))
    others = [r[0] for r in counts.select("split").distinct().where(F.col("split") != reference).collect()]  # splits are few
    count = lambda c: F.coalesce(F.try_element_at("by", c), F.lit(0))
    table = by_class.withColumn("split", F.explode(F.array(*map(F.lit, others)).cast("array<string>"))).select("split", "label", count(F.col("split")).alias("n"), count(F.lit(reference)).alias("r"))
    return metrics.shares(table, ["split"], "r", "n").groupBy("split").agg(metrics.tv().alias("tv"), metrics.jensen_shannon().alias("js"), F.count(F.when((F.col("n") > 0) & (F.col("r") > 0), 1)).alias("common_classes"))


def movers(df: DataFrame, label: str, split: str, reference: str, target: str, k: int = 20) -> DataFrame:
    """(label, p, q): the classes whose shares differ most between two splits; a report's top-k."""
    rows = df.select(F.col(split).alias("split"), canon.clean_label(F.col(label)).alias("label")).where(F.col("label").isNotNull() & F.col("split").isin(reference, target))
    counts = rows.groupBy("label").agg(F.count(F.when(F.col("split") == reference, 1)).alias("r"), F.count(F.when(F.col("split") == target, 1)).alias("t"))
    return metrics.shares(counts, [], "r", "t").select("label", "p", "q").orderBy(F.desc(F.abs(F.col("p") - F.col("q"))), "label").limit(k)
