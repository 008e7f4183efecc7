"""Reproducible splits that keep entities together and classes in proportion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalguard.functions import canon

ROLE_ORDER = {"train": 0, "val": 1, "test": 2}
NO_ENTITY = "__missing_entity__"
#: Units that one task of the greedy rule holds at most.
SLICE_UNITS = 100_000


def normalise(ratios: dict[str, float]) -> dict[str, float]:
    """Positive ratios that sum to 1, in the order train, val, test, others."""
    kept = {k: float(v) for k, v in ratios.items() if v > 0}
    if len(kept) < 2:
        raise ValueError("at least two splits need a positive ratio")
    total = sum(kept.values())
    return {k: kept[k] / total for k in sorted(kept, key=lambda k: (ROLE_ORDER.get(canon.role_of(k), 3), k))}


def units(df: DataFrame, entity: str | None, label: str | None, order: str) -> DataFrame:
    """(unit, weight, stratum): an entity or row, its rows, and its majority label; of ties the one with the least ``order``, a number."""
    unit = F.coalesce(canon.entity_key(F.col(entity)), F.lit(NO_ENTITY)) if entity else F.col(order).cast("string")
    rows = df.select(unit.alias("unit"), (F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")).alias("label"), F.col(order).alias("o"))
    by_label = rows.groupBy("unit", "label").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    best = F.max_by("label", F.struct("n", (-F.col("first")).alias("o")))
    return by_label.groupBy("unit").agg(F.sum("n").alias("weight"), best.alias("stratum"))


def _order_key(seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "stratum", "unit").cast("binary"), 256)


def assign(u: DataFrame, ratios: dict[str, float], seed: int, slice_units: int = SLICE_UNITS) -> DataFrame:
    """(unit, split): in each stratum, units in hash order go where rows fall shortest of the ratio.

    The choice depends on all choices before, so it is a sequential task over units, one row an entity. A stratum
    of more than ``slice_units`` is cut into that many more hash slices, each as near to the ratios: no task holds more.
    """
    sizes = u.groupBy("stratum").agg(F.ceil(F.count("*") / F.lit(slice_units)).alias("slices"))
    sliced = u.join(sizes, "stratum").withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.col("slices")).cast("int")).drop("slices")
    return _greedy(sliced, ratios, seed)


def _greedy(u: DataFrame, ratios: dict[str, float], seed: int) -> DataFrame:
    names, shares = list(ratios), list(ratios.values())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "unit"])
        owned = [0.0] * len(names)
        out = []
        for w in pdf["weight"]:
            i = min(range(len(names)), key=lambda j: (owned[j] + w) / shares[j])
            owned[i] += w
            out.append(names[i])
        return pd.DataFrame({"unit": pdf["unit"], "split": out})

    return u.withColumn("key", _order_key(seed)).groupBy("stratum", "slice").applyInPandas(run, "unit string, split string")


def cycle(ratios: dict[str, float], n: int) -> Iterator[str]:
    """Choices of the greedy rule for n units of weight 1."""
    owned = dict.fromkeys(ratios, 0)
    for _ in range(n):
        best = min(ratios, key=lambda k: (owned[k] + 1) / ratios[k])
        owned[best] += 1
        yield best


def assign_rows(u: DataFrame, ratios: dict[str, float], seed: int, period: int = 1000) -> DataFrame:
    """(unit, split) for units of weight 1, without Python: rank in the stratum modulo a period of the greedy choices."""
    spark = u.sparkSession
    table = spark.createDataFrame(list(enumerate(cycle(ratios, period))), "k long, split string")
    # ranks in two levels: the hash key's first digits, then inside them
    keyed = u.withColumn("key", _order_key(seed)).withColumn("head", F.substring("key", 1, 2))
    sizes = keyed.groupBy("stratum", "head").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("stratum").orderBy("head")) - F.col("n")
    inner = F.row_number().over(Window.partitionBy("stratum", "head").orderBy("key", "unit")) - 1
    ranked = keyed.withColumn("inner", inner).join(sizes.select("stratum", "head", before.alias("before")), ["stratum", "head"])
    return ranked.withColumn("k", F.pmod(F.col("before") + F.col("inner"), F.lit(period)).cast("long")).join(F.broadcast(table), "k").select("unit", "split")  # ``period`` rows


def split_rows(df: DataFrame, ratios: dict[str, float], order: str, entity: str | None = None, label: str | None = None, seed: int = 1337) -> DataFrame:
    """All rows with a new column ``split``."""
    u = units(df, entity, label, order)
    assigned = assign(u, normalise(ratios), seed)
    unit = F.coalesce(canon.entity_key(F.col(entity)), F.lit(NO_ENTITY)) if entity else F.col(order).cast("string")
    return df.withColumn("__unit", unit).join(assigned.withColumnRenamed("unit", "__unit"), "__unit").drop("__unit")


def deviation(df: DataFrame, ratios: dict[str, float], split: str = "split") -> DataFrame:
    """(split, rows, share, wanted, off): how far the split is from its ratio."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(normalise(ratios).items()), "split string, wanted double")
    counts = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    return wanted.join(counts, "split", "left").fillna(0, ["rows"]).withColumn("share", F.col("rows") / total).withColumn("off", F.abs(F.col("share") - F.col("wanted")))
