"""Reshaping: tagged splits, long tables of strings and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalguard.functions import canon

SPLIT = "__split__"
#: Columns unpivoted at once; wider frames are unpivoted in groups and united.
CHUNK = 100


def stack(splits: dict[str, DataFrame], split: str = SPLIT) -> DataFrame:
    """One relation of all splits; a column that a split lacks is null there, and one whose types differ becomes text."""
    kinds: dict[str, set[str]] = {}
    for df in splits.values():
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    out = None
    for name, df in splits.items():
        tagged = df.select(*(df[c].cast("string").alias(c) if len(kinds[c]) > 1 else df[c] for c in df.columns), F.lit(name).alias(split))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    return out


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str], value: str) -> DataFrame:
    """(…keep, column, x) for each cell; ``value`` is 'number' (non-numbers dropped) or 'text' (missing cells dropped) or 'cell' (all)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def entry(c: str) -> Column:
        if value == "number":
            x = canon.number(df[c], kinds[c])
        elif value == "text":
            x = F.when(~canon.is_missing(df[c], kinds[c]), canon.cell(df[c], kinds[c]))
        else:
            x = canon.cell(df[c], kinds[c])
        return F.struct(F.lit(c).alias("column"), x.alias("x"))

    out = None
    for at in range(0, len(columns), CHUNK):
        part = df.select(*keep, F.explode(F.array(*(entry(c) for c in columns[at : at + CHUNK]))).alias("e")).select(*keep, "e.column", "e.x")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no columns")
    return out if value == "cell" else out.where("x is not null")


def sides(df: DataFrame, split: str, reference: str, target: str) -> DataFrame:
    """Rows of two splits with ``side`` 'ref' or 'tgt'."""
    return df.where(F.col(split).isin(reference, target)).withColumn("side", F.when(F.col(split) == reference, "ref").otherwise("tgt"))


def pairs_of(names: Column) -> Column:
    """All (a, b) with a < b of an array of split names: bounded by the number of splits squared."""
    ordered = F.array_sort(names)
    return F.flatten(F.transform(ordered, lambda a: F.transform(F.filter(ordered, lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
