"""Audits of append streams: entities that reach a second split, and repeated content.

State is one row an entity or digest in Spark's state store; a watermark bounds how long a digest is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from evalguard.functions import canon

_OUT = "entity string, split string, first_split string, rows long"


def entity_leaks(stream: DataFrame, entity: str, split: str) -> DataFrame:
    """(entity, split, first_split, rows) whenever a batch brings an entity's rows in a split other than its first."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for pdf in batches:
            for name, n in pdf["split"].value_counts().items():
                counts[name] = counts.get(name, 0) + int(n)
        # of several splits in an entity's first batch, the first by name counts as its first
        first = state.get[0] if state.exists else min(counts)
        state.update((first,))
        late = sorted((s, n) for s, n in counts.items() if s != first)
        yield pd.DataFrame([(key[0], s, first, n) for s, n in late], columns=["entity", "split", "first_split", "rows"])

    rows = stream.select(canon.entity_key(F.col(entity)).alias("entity"), canon.split_name(F.col(split)).alias("split")).where("entity is not null")
    return rows.groupBy("entity").applyInPandasWithState(update, _OUT, "first string", "append", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, columns: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The stream without rows whose content came before within the watermark."""
    tagged = stream.withColumn("__digest", canon.digest(stream, columns)).withWatermark(time, delay)
    return tagged.dropDuplicatesWithinWatermark(["__digest"]).drop("__digest")


def windowed_counts(stream: DataFrame, time: str, split: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window, split, rows) of an append stream, late rows dropped after the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), F.col(split).alias("split")).agg(F.count("*").alias("rows"))


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; for tests and scheduled runs."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
