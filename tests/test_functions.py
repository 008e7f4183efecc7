import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalguard.functions import canon, metrics
from evalguard.operators import distribution, duplicates, labels, resplit, versions


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(3)
    ref, tgt = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.4, 1.3, 200), 1)
    rows = [("train", float(x)) for x in ref] + [("test", float(x)) for x in tgt]
    return ref, tgt, spark.createDataFrame(rows, "split string, x double")


def test_numeric_shift_equals_numpy(two):
    ref, tgt, df = two
    r = distribution.numeric_shift(df, ["x"], "split", "train", "test").first()
    pooled = math.sqrt(((len(ref) - 1) * ref.var(ddof=1) + (len(tgt) - 1) * tgt.var(ddof=1)) / (len(ref) + len(tgt) - 2))
    assert r["smd"] == pytest.approx((tgt.mean() - ref.mean()) / pooled, abs=1e-9)
    grid = np.unique(np.concatenate([ref, tgt]))
    f, g = (np.searchsorted(np.sort(a), grid, "right") / len(a) for a in (ref, tgt))
    assert r["ks"] == pytest.approx(np.abs(f - g).max(), abs=1e-9)
    assert r["wasserstein"] == pytest.approx((np.abs(f - g)[:-1] * np.diff(grid)).sum(), abs=1e-9)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    e, a = (np.clip(np.histogram(x, edges)[0] / np.histogram(x, edges)[0].sum(), 1e-12, None) for x in (ref, tgt))
    assert r["psi"] == pytest.approx(((a - e) * np.log(a / e)).sum(), abs=1e-9)


def test_rank_auc_counts_ties_half(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 8, 120), rng.integers(0, 2, 120)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    pos, neg = x[y == 1], x[y == 0]
    want = np.mean(pos[:, None] > neg[None, :]) + 0.5 * np.mean(pos[:, None] == neg[None, :])
    assert metrics.rank_auc(df, "x", F.col("y") == 1).first()["auc"] == pytest.approx(want, abs=1e-9)


def test_normalised_mi_of_a_copy_is_one(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a"), ("c", "c")], "x string, y string")
    assert metrics.normalised_mi(df, "x", "y").first()["nmi"] == pytest.approx(1.0)


def test_benjamini_hochberg():
    assert metrics.benjamini_hochberg([0.01, 0.04, None, 0.03]) == pytest.approx([0.03, 0.04, None, 0.04])


def test_shift_over_disjoint_labels_is_largest(spark):
    df = spark.createDataFrame([("train", "a")] * 3 + [("test", "b")] * 2, "split string, label string")
    r = labels.shift(df, "label", "split", "train").first()
    assert r["tv"] == pytest.approx(1.0) and r["js"] == pytest.approx(math.sqrt(math.log(2)))


def test_cells_tell_null_from_text(spark):
    df = spark.createDataFrame([(None, 1.0, True), ("", float("nan"), None), ("x", 0.1 + 0.2, False)], "s string, d double, b boolean")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(*(canon.cell(F.col(c), kinds[c]).alias(c) for c in "sdb")).collect()
    assert [r["s"] for r in rows] == ["\0", "", "x"] and rows[1]["d"] == "\0" and rows[2]["d"] == "0.3" and [r["b"] for r in rows] == ["1", "\0", "0"]


def test_labels_and_splits_are_canonical(spark):
    df = spark.createDataFrame([(" NA ", "Training"), ("yes. ", "dev"), (None, ""), ("b", "Fold3")], "l string, s string")
    rows = df.select(canon.clean_label(F.col("l")).alias("l"), canon.label_form(F.col("l")).alias("f"), canon.split_name(F.col("s")).alias("s")).collect()
    assert [r["l"] for r in rows] == [None, "yes.", None, "b"] and rows[1]["f"] == "yes" and [r["s"] for r in rows] == ["train", "val", "unknown", "fold3"]


@pytest.mark.parametrize("threshold", [0, 3, 6, 20])
def test_near_pairs_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(threshold)
    base = rng.integers(-(1 << 63), 1 << 63, 12, dtype=np.int64).tolist()
    hashes = base + [h ^ int(1 << int(b)) for h in base for b in rng.integers(0, 63, 2)] + [base[0], base[0] ^ 0b111, -(1 << 63), 0]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    count = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(i, j, count(a, b)) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and a != b and count(a, b) <= threshold}
    got = [tuple(r) for r in duplicates.near_pairs(df, "id", "h", threshold).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("threshold", [0, 6, 16, 64])
def test_near_histogram_equals_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(duplicates, "BLOCK", 9)
    monkeypatch.setattr(duplicates, "TILE", 5)
    monkeypatch.setattr(duplicates, "TILE_ROWS", 4)
    rng = np.random.default_rng(threshold)
    base = rng.integers(-(1 << 63), 1 << 63, 8, dtype=np.int64).tolist()
    hashes = base + [h ^ int(1 << int(b)) for h in base for b in rng.integers(0, 63, 3)] + base + [base[0]] * 5 + [base[0] ^ 0xFFFF, -(1 << 63), 0, -1]
    rows = [(h, ("train", "val", "test")[int(rng.integers(0, 3))]) for h in hashes]
    want = {}
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1:]:
            d = bin((a ^ b) & (2**64 - 1)).count("1")
            if 0 < d <= threshold:
                want[min(s, t), max(s, t), d] = want.get((min(s, t), max(s, t), d), 0) + 1
    got = duplicates.near_histogram(spark.createDataFrame([*rows, (None, "val")], "h long, split string"), "h", "split", threshold).collect()
    assert {(r["x"], r["y"], r["distance"]): r["n"] for r in got} == want and len(got) == len(want)


def test_equal_hashes_of_different_content_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 6)) - 2, "abc"[int(rng.integers(0, 3))], ("train", "val", "test")[int(rng.integers(0, 3))]) for i in range(60)] + [(60, 77, "a", "train"), (61, 77, "a", "test"), (62, None, "b", "test")]
    df = spark.createDataFrame(rows, "id long, h long, c string, split string")
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] != b[2]]
    want = {}
    for a, b in pairs:
        key = tuple(sorted((a[3], b[3])))
        want[key] = want.get(key, 0) + 1
    assert {(r["x"], r["y"]): r["n"] for r in duplicates.equal_hash_pairs(df, "h", "c", "split").collect()} == want
    of = lambda h: [r for r in rows if r[1] == h]
    members = {r[0]: (min(x[0] for x in of(r[1])), len(of(r[1])), len({x[2] for x in of(r[1])})) for r in {r for p in pairs for r in p}}
    assert {r["id"]: (r["class_id"], r["class_size"], r["n_contents"]) for r in duplicates.equal_hash_classes(df, "id", "h", "c").collect()} == members


def snapshot(spark, rows):
    return versions.snapshot(spark.createDataFrame(rows, "id string, x int, y string, split string"), ["id"], "split", "y")


def test_moves_relabels_and_edits_are_told_apart(spark):
    old = [(f"r{i}", i, "a" if i % 2 else "b", "train" if i < 20 else "test") for i in range(30)]
    new = list(old)
    new[3] = ("r3", 3, "a", "test")  # moved
    new[4] = ("r4", 4, "z", "train")  # relabelled
    new[5] = ("r5", 500, "a", "train")  # edited
    new[6] = ("r6", 6, "z", "test")  # moved and relabelled
    new = [*new[:7], *new[8:], ("r99", 99, "a", "train")]
    kinds = {}
    for r in versions.compare(snapshot(spark, old), snapshot(spark, new)).collect():
        kinds.setdefault(r["kind"], []).append(r["matched_by"])
    assert {k: sorted(map(str, v)) for k, v in kinds.items()} == {"moved": ["content", "features"], "relabelled": ["features", "id"], "modified": ["id"], "removed": ["None"], "added": ["None"]}


def test_manifest_hash_ignores_order_and_partitions(spark):
    rows = [(f"r{i}", i, "a", "train") for i in range(50)]
    assert versions.manifest_hash(snapshot(spark, rows)) == versions.manifest_hash(snapshot(spark, rows[::-1]).repartition(7))
    assert versions.manifest_hash(snapshot(spark, rows)) != versions.manifest_hash(snapshot(spark, rows[1:]))


def test_entity_split_is_disjoint_and_seeded(spark):
    rows = spark.createDataFrame([(i, f"p{i // 6}", "ab"[i // 6 % 2]) for i in range(120)], "i long, p string, y string")
    one = lambda seed: sorted(tuple(r) for r in resplit.split_rows(rows, {"train": 0.5, "test": 0.5}, "i", "p", "y", seed).select("i", "p", "split").collect())
    a = one(1)
    assert a == one(1) and a != one(2) and len(a) == 120
    units = resplit.units(rows, "p", "y", "i")
    sliced = {r["unit"]: r["split"] for r in resplit.assign(units, {"train": 0.5, "test": 0.5}, 1, slice_units=3).collect()}  # more units than a task may hold
    assert len(sliced) == 20 and 5 <= sum(s == "train" for s in sliced.values()) <= 15
    for done in (a, [(i, p, sliced[p]) for i, p, _ in a]):
        assert all(len({s for _, p, s in done if p == q}) == 1 for q in {p for _, p, _ in done})
    assert abs(sum(s == "train" for _, _, s in a) - 60) <= 6
