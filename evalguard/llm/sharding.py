"""Sharding by a hierarchical weighted hash tree; DataFrame functions only.

Shards are the leaves of a tree of regions and racks. A document descends region, rack and shard; at
each level it goes to the child with the least draw. A leaf's draw is ``-ln(u)/weight`` with ``u``
hashed from the document id and the leaf's name, an exponential of the leaf's weight as rate. A
subtree's draw is the least of its leaves', hence again an exponential, of the subtree's total
weight. So each level is a weighted hash draw, and a draw changes only if a weight below it does:
raising a weight, or adding a shard, moves documents only into that shard, lowering one only out
of it, and subtrees whose weights stay exchange nothing.

Slots number the rows of a shard from 0 without gaps, by a prefix sum in two levels: counts by
shard and hash bucket (``SLOT_BUCKETS`` a shard, so the table of offsets has a fixed size), then a
window within each bucket.

Law ``key``: document id and shard count decide alone. Defined cases: a null id is an id of its own;
a null text has size 8 and the CRC of the empty string; a very long text counts with all its bytes; of equal draws the smaller
name wins; rows with equal ids share a shard and get slots by their content, repeated rows in any order; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalguard.llm.common import materialise

SLOT_BUCKETS = 1024
RACK_SHARDS, REGION_RACKS = 4, 2
_HEX = 13  # hex digits of a hash that make one draw: 52 bits, exact in a double


@dataclass(frozen=True)
class Shard:
    id: int
    region: int
    rack: int
    weight: float = 1.0


def topology(shards: int, weights: Sequence[float] | None = None) -> list[Shard]:
    """``shards`` leaves, four a rack, two racks a region; the next shard opens a rack or region when the last is full."""
    return [Shard(i, i // (RACK_SHARDS * REGION_RACKS), i // RACK_SHARDS, weights[i] if weights else 1.0) for i in range(shards)]


def leaf_draws(doc_id: Column, tree: Sequence[Shard]) -> Column:
    """An array of (draw, region, rack, shard), one entry a leaf."""
    fields = F.array(*(F.struct(F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack"), F.lit(s.id).alias("shard"), F.lit(float(s.weight)).alias("weight")) for s in tree))
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))

    def draw(leaf: Column) -> Column:
        key = F.md5(F.concat_ws(":", name, leaf["region"], leaf["rack"], leaf["shard"]).cast("binary"))
        u = (F.conv(F.substring(key, 1, _HEX), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**_HEX))
        return F.struct((-F.log(u) / leaf["weight"]).alias("draw"), leaf["region"].alias("region"), leaf["rack"].alias("rack"), leaf["shard"].alias("shard"))

    return F.transform(fields, draw)


def descend(rows: DataFrame, draws: Column, prefix: str = "") -> DataFrame:
    """Add ``region``, ``rack`` and ``shard`` (with a prefix): at each level the child whose subtree has the least draw; ties go to the smaller name."""
    rows = rows.withColumn("leaves", draws)
    for level in ("region", "rack", "shard"):
        rows = _descend(rows, level, prefix + level)
    return rows.drop("leaves")


def _descend(rows: DataFrame, level: str, chosen: str) -> DataFrame:
    def subtree(child: Column) -> Column:
        below = F.filter("leaves", lambda d: d[level] == child)
        return F.struct(F.array_min(F.transform(below, lambda d: d["draw"])).alias("draw"), child.alias("child"))

    children = F.array_distinct(F.transform("leaves", lambda d: d[level]))
    rows = rows.withColumn(chosen, F.array_min(F.transform(children, subtree))["child"])
    return rows.withColumn("leaves", F.filter("leaves", lambda d: d[level] == F.col(chosen)))


def shard_documents(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard); ``grown`` holds ``tree`` and later shards."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    leaves = {s.id: s for s in [*tree, *(grown or ())]}
    if sorted(leaves) != list(range(len(leaves))):
        raise ValueError("shard ids must run from 0 without gaps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    drawn = rows.withColumn("draws", leaf_draws(F.col("doc_id"), [leaves[i] for i in sorted(leaves)]))
    placed = descend(drawn, F.filter("draws", lambda d: d["shard"].isin([s.id for s in tree])))
    if grown:
        placed = descend(placed, F.filter("draws", lambda d: d["shard"].isin([s.id for s in grown])), "grown_")
    else:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    # the content takes part, so that rows of one id fill many buckets; buckets ascend by their number in the slots
    bucket = F.pmod(F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")).cast("binary")), F.lit(buckets)).cast("int")
    narrow = materialise(placed.select("doc_id", "size", "text_crc32", "region", "rack", "shard", "grown_shard", bucket.alias("bucket")), "shards")
    counts = narrow.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))  # at most shards x buckets rows
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return narrow.withColumn("within", within).join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard"
    )



def _oracle(shards: int = 24, grown: int = 25) -> str:
    """The same in DuckDB's SQL: every leaf's draw, then the least one, level by level (a subtree's draw is the least of its leaves')."""
    tree = topology(grown)
    leaves = ", ".join(f"({s.id}, {s.region}, {s.rack})" for s in tree)
    return f"""
with leaves as (select * from (values {leaves}) v(shard, region, rack)),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
ids as (select distinct doc_id from docs),
draws as (select doc_id, shard, -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || region || ':' || rack || ':' || shard), 1, {_HEX}) as bigint) + 0.5) / {float(16**_HEX)}) as draw from ids, leaves),
best as (select doc_id, arg_min(shard, draw) filter (shard < {shards}) as shard, arg_min(shard, draw) as grown_shard from draws group by doc_id)
select d.doc_id, strlen(d.text) + 8 as size, b.shard, b.shard // {RACK_SHARDS} as rack, b.shard // {RACK_SHARDS * REGION_RACKS} as region, 'key' as law, b.grown_shard
from docs d join best b on d.doc_id is not distinct from b.doc_id"""


ORACLE_SQL = _oracle()
