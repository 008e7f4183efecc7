"""Shared entities, inverted time, target and identifier leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalguard.functions import canon, metrics
from evalguard.operators.frames import pairs_of, unpivot

#: Parts of names that look like identifiers.
ID_PARTS = ("id", "uuid", "guid", "filename", "file_name", "path", "row_no", "rownum", "index")


def entity_presence(df: DataFrame, entity: str, split: str) -> DataFrame:
    return df.select(canon.entity_key(F.col(entity)).alias("entity"), F.col(split).alias("split")).where("entity is not null").groupBy("entity", "split").agg(F.count("*").alias("n"))


def entity_pairs(df: DataFrame, entity: str, split: str) -> DataFrame:
    """(split_a, split_b, n_entities, affected_rows): entities in two splits and their rows in both."""
    by_entity = entity_presence(df, entity, split).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("rows")).where(F.size("rows") > 1)
    spread = by_entity.select("rows", F.explode(pairs_of(F.map_keys("rows"))).alias("p"))
    rows = F.col("rows")[F.col("p.split_a")] + F.col("rows")[F.col("p.split_b")]
    return spread.select("p.split_a", "p.split_b", rows.alias("n")).groupBy("split_a", "split_b").agg(F.count("*").alias("n_entities"), F.sum("n").alias("affected_rows"))


def largest_entities(df: DataFrame, entity: str, split: str, k: int = 20) -> DataFrame:
    """The k largest shared entities: a report's top-k."""
    by_entity = entity_presence(df, entity, split).groupBy("entity").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"))
    return by_entity.where(F.size("splits") > 1).orderBy(F.desc("n"), "entity").limit(k)


def entity_coverage(df: DataFrame, entity: str, split: str) -> DataFrame:
    """(split, rows, missing, distinct_entities, missing_ratio)."""
    key = canon.entity_key(F.col(entity))
    return df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"), F.count(F.when(key.isNull(), 1)).alias("missing"), F.count_distinct(key).alias("distinct_entities")).withColumn("missing_ratio", F.col("missing") / F.col("rows"))


def temporal_boundary(df: DataFrame, time: Column, split: str, train: str, test: str) -> DataFrame:
    """One row: latest training and earliest test moment, parsed rows, and training rows at or after the boundary."""
    t = df.select(F.col(split).alias("split"), time.alias("t"))
    b = t.agg(F.max(F.when(F.col("split") == train, F.col("t"))).alias("train_max"), F.min(F.when(F.col("split") == test, F.col("t"))).alias("test_min"), F.count(F.when(F.col("split") == train, F.col("t"))).alias("n_train"), F.count(F.when(F.col("split") == test, F.col("t"))).alias("n_test"))
    late = t.where(F.col("split") == train).crossJoin(F.broadcast(b.select("test_min"))).agg(F.count(F.when(F.col("t") >= F.col("test_min"), 1)).alias("violating"))  # one row against one row
    return b.crossJoin(F.broadcast(late))


def functional(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(column, n_f, n_y, max_y_per_f, max_f_per_y, identical): does a feature determine the label, or rename it?

    A missing feature cell takes part as a value of its own; rows without label don't.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.where(~canon.is_missing(df[label], kinds[label])).withColumn("__y", canon.cell(df[label], kinds[label]))
    pairs = unpivot(rows, features, ["__y"], "cell").groupBy("column", "x", "__y").agg(F.count("*").alias("n"))
    per_f = pairs.groupBy("column", "x").agg(F.count("*").alias("k")).groupBy("column").agg(F.max("k").alias("max_y_per_f"), F.count("*").alias("n_f"))
    per_y = pairs.groupBy("column", "__y").agg(F.count("*").alias("k")).groupBy("column").agg(F.max("k").alias("max_f_per_y"), F.count("*").alias("n_y"))
    same = pairs.groupBy("column").agg(F.min(F.col("x") == F.col("__y")).alias("identical"))
    return per_f.join(per_y, "column").join(same, "column")


def feature_auc(df: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """(column, n, n_pos, auc) of each numeric feature against the positive class."""
    return metrics.rank_auc(unpivot(df.withColumn("__pos", positive), features, ["__pos"], "number"), "x", F.col("__pos"), ["column"])


def feature_nmi(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(column, nmi) of each feature as text against the label."""
    return metrics.normalised_mi(unpivot(df.where(F.col(label).isNotNull()), features, [label], "cell"), "x", label, ["column"])


def correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(column, r): Pearson's correlation of each numeric column with a numeric label, all in one aggregate."""
    wide = df.agg(*(F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("r")) for c in columns))).alias("e")).select("e.*")


def quantile_binned(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """The frame with each column's numbers replaced by their quantile bin, 0 to ``bins`` - 1; other cells are bin 0."""
    counts = unpivot(df, columns, [], "number").groupBy("column", "x").agg(F.count("*").alias("n"))
    own = F.col("n"), F.col("n_before"), F.col("n_all")
    found = metrics.ranked(counts, ["column"], ["n"]).groupBy("column").agg(F.array(*(metrics.quantile(i / bins, *own) for i in range(bins + 1))).alias("edges"))
    out = df
    for r in found.collect():  # a row a column
        number = F.col(r["column"]).cast("double")
        inner = F.array(*(F.lit(x) for x in sorted(set(r["edges"]))[1:-1])).cast("array<double>")
        out = out.withColumn(r["column"], F.when(number.isNull(), 0).otherwise(F.size(F.filter(inner, lambda e: e <= number))))  # noqa: B023
    return out


def unique_ratio(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """(split, column, n_rows, n_unique, ratio); distinct values are exact, from one long aggregate."""
    sizes = df.groupBy(split).agg(F.count("*").alias("n_rows"))
    distinct = unpivot(df, columns, [split], "text").groupBy(split, "column", "x").agg(F.lit(1).alias("one")).groupBy(split, "column").agg(F.count("*").alias("n_unique"))
    return distinct.join(F.broadcast(sizes), split).select(F.col(split).alias("split"), "column", "n_rows", "n_unique", (F.col("n_unique") / F.col("n_rows")).alias("ratio"))


def value_shape(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """(split, column, filled, min_length, max_length, digits): the shape of values without showing any."""
    long = unpivot(df, columns, [split], "text")
    return long.groupBy(F.col(split).alias("split"), "column").agg(F.count("*").alias("filled"), F.min(F.length("x")).alias("min_length"), F.max(F.length("x")).alias("max_length"), F.avg(F.col("x").rlike("^[0-9]+$").cast("double")).alias("digits"))


def looks_like_id(name: str) -> bool:
    return any(p in name.lower() for p in ID_PARTS)
