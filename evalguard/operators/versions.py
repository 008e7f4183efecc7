"""Fingerprints, snapshots and the comparison of two versions of a dataset."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalguard.functions import canon


def snapshot(df: DataFrame, ids: Sequence[str], split: str, label: str | None, skip: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """(sample_id, split, label, content, features): a version without its values.

    The id holds the split, so a row that moves gets another one. ``content`` leaves out the split, ``features`` also the label and ids.
    """
    content = [c for c in df.columns if c != split and c not in skip]
    features = [c for c in content if c != label and c not in ids]
    key = [canon.cell(df[c], df.schema[c].dataType) for c in (ids or content)]
    return df.select(
        canon.sample_id(F.col(split).cast("string"), *key).alias("sample_id"), F.col(split).cast("string").alias("split"),
        (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"), canon.digest(df, content).alias("content"), canon.digest(df, features).alias("features"),
        *(c.alias(n) for n, c in (extra or {}).items()),
    )


def id_of(df: DataFrame, ids: Sequence[str], split: str) -> Column:
    return canon.sample_id(F.col(split).cast("string"), *(canon.cell(df[c], df.schema[c].dataType) for c in ids))


def manifest(df: DataFrame, ids: Sequence[str], split: str, label: str | None, groups: Sequence[str] = (), mode: str = "full", fraction: float = 1.0, seed: int = 1337, sample: Column | None = None) -> DataFrame:
    """The snapshot with role, groups and whether the row is hashed.

    Modes: full hashes every row, metadata none, sampled a deterministic share of them. Digests that weren't asked for are never computed.
    """
    if mode not in ("full", "metadata", "sampled"):
        raise ValueError(f"no mode {mode}")
    snap = snapshot(df, ids, split, label, extra={"__sample": sample if sample is not None else id_of(df, ids or [c for c in df.columns if c != split], split), "__groups": F.create_map(*(x for g in groups for x in (F.lit(g), F.col(g).cast("string")))) if groups else F.create_map().cast("map<string,string>")})
    hashed = {"full": F.lit(True), "metadata": F.lit(False), "sampled": canon.sampled(seed, F.col("__sample"), fraction)}[mode]
    if mode == "sampled":  # never nothing: the least sample stands in
        r = snap.agg(F.count(F.when(hashed, 1)).alias("n"), F.min("__sample").alias("least")).first()
        hashed = hashed if r["n"] else F.col("__sample") == F.lit(r["least"])
    role = F.when(F.lower("split").isin(*canon.TRAIN_NAMES), "train").when(F.lower("split").isin(*canon.VAL_NAMES), "val").when(F.lower("split").isin(*canon.TEST_NAMES), "test").otherwise("unknown")
    return snap.withColumn("hash_sampled", hashed).select("sample_id", "split", role.alias("role"), "label", F.col("__groups").alias("groups"), "hash_sampled", F.when(F.col("hash_sampled"), F.col("content")).alias("content"), F.when(F.col("hash_sampled"), F.col("features")).alias("features"))


def finding_changes(before: list[dict] | None, after: list[dict] | None) -> dict[str, list[tuple]]:
    """New, resolved and changed findings by rule, scope and splits; nothing where a side was not audited."""
    out: dict[str, list[tuple]] = {"new": [], "resolved": [], "changed": []}
    if before is None or after is None:
        return out

    def table(findings: list[dict]) -> dict[tuple, tuple]:
        found: dict[tuple, list[dict]] = {}
        for f in findings:
            found.setdefault((f["rule_id"], f["metadata"].get("scope"), f["source_split"], f["target_split"]), []).append(f)
        return {k: (len(v), sum(f["affected_count"] for f in v), tuple(sorted(f["severity"] for f in v))) for k, v in found.items()}

    a, b = table(before), table(after)
    order = lambda k: tuple(map(str, k))
    out["new"], out["resolved"] = sorted(b.keys() - a.keys(), key=order), sorted(a.keys() - b.keys(), key=order)
    out["changed"] = sorted((k for k in a.keys() & b.keys() if a[k] != b[k]), key=order)
    return out


def manifest_hash(snap: DataFrame) -> str:
    """Order-independent hash of the multiset of (split, label, content): sums of digest parts, so that one row returns at any size."""
    line = F.sha2(F.concat_ws(canon.SEP, "split", F.coalesce("label", F.lit(canon.NULL_CELL)), "content").cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(4)]
    r = snap.select(line.alias("d")).agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x or 0) for x in r).encode()).hexdigest()[:32]


_PAIR_SLICES = 64
_SIDE = "struct<id:string,split:string,label:string,content:string,features:string>"


def _pair(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Rows (a, b, matched_by) with one side each become pairs one-to-one by a digest; those that are pairs stay, and so does what finds no partner.

    The k-th row of a digest on one side meets the k-th of the other. Rows are numbered slice by slice, so a hot digest is no single task.
    """
    one = F.coalesce("a", "b")
    alone = F.concat_ws("|", F.lit("~"), F.col("a").isNotNull().cast("string"), one["id"])  # pairs nothing
    own = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), alone).otherwise(F.coalesce(one[key], alone))
    keyed = rows.withColumn("key", own).withColumn("side", F.col("a").isNotNull()).withColumn("id", one["id"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(_PAIR_SLICES)))
    sizes = keyed.groupBy("key", "side", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key", "side").orderBy("slice")) - F.col("n")
    number = F.row_number().over(Window.partitionBy("key", "side", "slice").orderBy("id"))
    numbered = keyed.join(sizes.select("key", "side", "slice", before.alias("before")), ["key", "side", "slice"]).withColumn("k", F.col("before") + number)
    met = numbered.groupBy("key", "k").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("matched_by").alias("matched_by"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return met.select("a", "b", F.coalesce("matched_by", F.when(both, by)).alias("matched_by"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, id_a, id_b, split_a, split_b, label_a, label_b, matched_by): every difference of two snapshots.

    Kinds: moved, renamed, relabelled, modified, added, removed. Rows with the same id are compared; the
    others are paired by content, then by features; what is left was added or removed. A row of several kinds is listed under each.
    """
    side = lambda d, name: d.select("sample_id", F.struct(F.col("sample_id").alias("id"), "split", "label", "content", "features").cast(_SIDE).alias(name))
    both = side(old, "a").join(side(new, "b"), "sample_id", "full").select("a", "b")
    have = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = both.where(have).withColumn("matched_by", F.lit("id"))
    loose = both.where(~have).withColumn("matched_by", F.lit(None).cast("string"))
    every = same.unionByName(_pair(_pair(loose, "content", "content"), "features", "features"))
    a, b = F.col("a"), F.col("b")
    differs = lambda f: ~a[f].eqNullSafe(b[f])
    kinds = F.when(b.isNull(), F.array(F.lit("removed"))).when(a.isNull(), F.array(F.lit("added"))).otherwise(F.filter(F.array(
        F.when(differs("split"), "moved"), F.when(~differs("split") & differs("id"), "renamed"), F.when(differs("label"), "relabelled"), F.when((F.col("matched_by") == "id") & differs("features"), "modified"),
    ), lambda k: k.isNotNull()))
    return every.select(F.explode(kinds).alias("kind"), a["id"].alias("id_a"), b["id"].alias("id_b"), a["split"].alias("split_a"), b["split"].alias("split_b"), a["label"].alias("label_a"), b["label"].alias("label_b"), "matched_by")


def listed(changes: DataFrame, most: int = 2000) -> DataFrame:
    """The first rows of each kind, for a report."""
    order = ["id_a", "id_b", "split_a", "split_b"]
    kinds = ("added", "removed", "modified", "moved", "relabelled", "renamed")
    parts = [changes.where(F.col("kind") == k).orderBy(*order).limit(most) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("split_b") == "test", 1)).alias("into_test"))


def write_snapshot(snap: DataFrame, path: str, header: dict) -> None:
    """Records as Parquet, the header beside them as one JSON row."""
    snap.write.mode("errorifexists").parquet(f"{path}/records")
    snap.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/header")


def write_manifest(rows: DataFrame, path: str, header: dict) -> None:
    """A manifest as JSON lines, its header beside it."""
    rows.write.mode("errorifexists").json(f"{path}/records", ignoreNullFields=False)
    rows.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/header")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The records and header of a written manifest."""
    kinds = "sample_id string, split string, role string, label string, groups map<string,string>, hash_sampled boolean, content string, features string"
    return spark.read.schema(kinds).json(f"{path}/records"), json.loads(spark.read.text(f"{path}/header").first()[0])


def findings_digest(findings: list[dict]) -> list[dict]:
    """What a snapshot keeps of an audit: enough to match findings of two versions."""
    return [{"rule_id": f["rule_id"], "source_split": f["source_split"], "target_split": f["target_split"], "affected_count": f["affected_count"], "severity": f["severity"], "metadata": {"scope": f["metadata"].get("scope")}} for f in findings]


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/records"), json.loads(spark.read.text(f"{path}/header").first()[0])


def comparable(a: dict, b: dict) -> str | None:
    """Why two snapshots can't be compared, if they can't."""
    for key in ("dataset_type", "mode"):
        if a.get(key) != b.get(key):
            return f"{key} differs: {a.get(key)} and {b.get(key)}"
    return None
