import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalguard import api, cli
from evalguard.operators import versions
from evalguard.plans import engine, policy, report
from evalguard.sources import discovery, images, tables

PHI = (5**0.5 - 1) / 2
NAMES = ["record_id", "patient_id", "age", "sex", "bmi", "value", "target"]
KINDS = "record_id string, patient_id string, age int, sex string, bmi double, value double, target int"


def rows(n, patient, at=0, **over):
    out = []
    for i in range(at, at + n):
        r = dict(zip(NAMES, (f"r{i}", patient(i), 40 + i % 20 // 2, "MF"[i // 2 % 2], round(20 + i * PHI % 1 * 10, 4), round((i + 1) * 0.7548776662466927 % 1 * 100, 4), i % 2), strict=True))
        out.append(tuple((r | {k: f(i) for k, f in over.items()}).values()))
    return out


def run(spark, train, test, groups=("patient_id",), **raw):
    config = policy.Config.of({"labels": {"column": "target"}, "groups": list(groups), "id_columns": ["record_id"], **raw})
    return engine.audit(spark, engine.AuditSpec.of_splits({"train": spark.createDataFrame(train, KINDS), "test": spark.createDataFrame(test, KINDS)}, config))


def ids(r):
    return {f["rule_id"] for f in r.findings}


def test_entity_leak_invalidates(spark):
    r = run(spark, rows(40, lambda i: f"p{i % 5}"), rows(20, lambda i: f"p{i % 5}", 1000))
    f = next(f for f in r.findings if f["rule_id"] == "DD005")
    assert (f["severity"], f["affected_count"], f["evidence"]["entities"]) == ("CRITICAL", 60, 5) and r.verdict == policy.INVALID


def test_disjoint_entities_are_safe(spark):
    r = run(spark, rows(40, lambda i: f"p{i // 8}"), rows(20, lambda i: f"q{i // 4}", 1000))
    assert r.verdict == policy.SAFE, r.reasons


def test_duplicates_conflicts_and_suppression(spark):
    train = rows(40, lambda i: f"p{i // 8}")
    flipped = [(f"x{r[0]}", *r[1:-1], 1 - r[-1]) for r in train[:4]]
    test = [*rows(20, lambda i: f"q{i // 4}", 1000), *train[:3], *flipped]
    r = run(spark, train, test, suppressions=[{"rule": "DD003", "reason": "known"}])
    assert "DD003" not in ids(r) and next(o for o in r.outcomes if o["rule_id"] == "DD003")["status"] == "SUPPRESSED"
    assert next(f for f in r.findings if f["rule_id"] == "DD009")["severity"] == "CRITICAL"


def test_target_leak(spark):
    leak = {"sex": lambda i: f"DC{i % 2}"}
    r = run(spark, rows(60, lambda i: f"p{i}", **leak), rows(20, lambda i: f"q{i}", 1000, **leak), groups=())
    assert [f["severity"] for f in r.findings if f["rule_id"] == "DD007" and f["columns"] == ["sex"]] == ["CRITICAL"]


def test_shift_is_risky(spark):
    r = run(spark, rows(120, lambda i: f"p{i // 4}"), rows(60, lambda i: f"q{i // 4}", 1000, bmi=lambda i: 45 + i * PHI % 1))
    assert "DD012" in ids(r) and r.verdict == policy.RISKY


def test_schema_and_type_drift(spark):
    train, test = spark.createDataFrame(rows(40, lambda i: f"p{i}"), KINDS), spark.createDataFrame(rows(20, lambda i: f"q{i}", 1000), KINDS)
    r = engine.audit(spark, engine.AuditSpec.of_splits({"train": train, "test": test.drop("bmi").withColumn("value", test["sex"])}, policy.Config.of({"labels": {"column": "target"}})))
    assert {f["title"] for f in r.findings if f["rule_id"] == "DD014"} >= {"Columns of train differ", "Types differ between splits"}


def test_one_split_is_inconclusive(spark):
    spec = engine.AuditSpec.of_splits({"train": spark.createDataFrame(rows(40, lambda i: f"p{i // 8}"), KINDS)}, policy.Config.of({"labels": {"column": "target"}, "groups": ["patient_id"], "id_columns": ["record_id"]}))
    assert engine.audit(spark, spec).verdict == policy.UNKNOWN


def test_split_column_compares_splits_with_each_other(spark):
    df = spark.createDataFrame([(*r, "Train", "2026-01-01") for r in rows(20, lambda i: f"p{i // 2}")] + [(*r, "test", "2024-01-01") for r in rows(10, lambda i: f"q{i // 2}", 100)], KINDS + ", part string, day string")
    r = engine.audit(spark, engine.AuditSpec.of(df, "part", "target", ["patient_id"], ["record_id"], "day"))
    assert next(f for f in r.findings if f["rule_id"] == "DD006")["affected_count"] == 20 and "DD005" not in ids(r)


def fact(rule, severity, status, impact):
    return {"rule_id": rule, "title": "t", "severity": severity, "status": status, "formal_impact": impact, "affected_count": 1}


def test_verdict_contract():
    fine = [{"rule_id": "DD005", "status": "PASS", "reason": None}]
    gap = [{"rule_id": "DD005", "status": "INCONCLUSIVE", "reason": "x"}]
    assert policy.verdict([fact("DD005", "HIGH", "INCONCLUSIVE", "BLOCKING")], fine, 5)[0] == policy.UNKNOWN
    assert policy.verdict([fact("DD005", "LOW", "FAIL", "BLOCKING")], fine, 5)[0] == policy.INVALID
    assert policy.verdict([fact("DD012", "MEDIUM", "WARNING", "POTENTIAL")], gap, 5)[0] == policy.RISKY
    assert policy.verdict([fact("DD021", "MEDIUM", "WARNING", "NONE")], fine, 5)[0] == policy.SAFE
    assert policy.verdict([], gap, 5)[0] == policy.UNKNOWN and policy.verdict([], fine, 0)[0] == policy.UNKNOWN


def test_exit_codes():
    bad = [fact("DD005", "HIGH", "FAIL", "BLOCKING")]
    assert policy.exit_code(policy.INVALID, bad, []) == 1 and policy.exit_code(policy.INVALID, bad, [], fail_on="never") == 0
    assert policy.exit_code(policy.SAFE, [], [{"status": "INCONCLUSIVE"}]) == 0 and policy.exit_code(policy.SAFE, [], [{"status": "INCONCLUSIVE"}], strict=True) == 1
    assert policy.exit_code(policy.UNKNOWN, [], [], ci=True) == 1


def test_config_is_checked():
    for raw in ({"preset": "none"}, {"suppressions": [{"rule": "DD003"}]}, {"policies": {"exact_duplicate": {"severity": "loud"}}}, {"sampling": {"fraction": 0}}):
        with pytest.raises(policy.ConfigError):
            policy.Config.of(raw)
    assert policy.Config.of({"policies": {"duplicate": {"severity": "low"}, "nothing": {}}}).policies == {"exact_duplicate": {"severity": "LOW"}}


def test_csv_and_parquet_say_the_same(spark, tmp_path):
    data = rows(40, lambda i: f"p{i // 8}")
    text = ";".join(NAMES) + "\n" + "".join(";".join("NA" if i == 3 and k == 2 else str(v) for k, v in enumerate(r)) + "\n" for i, r in enumerate(data))
    (tmp_path / "a.csv").write_text(text)
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"record_id": "string", "patient_id": "string", "age": "bigint", "sex": "string", "bmi": "double", "value": "double", "target": "bigint"}
    assert df.where("age is null").count() == 1 and df.count() == 40
    tables.write_table(df, str(tmp_path / "b.parquet"))
    assert sorted(map(str, tables.read_table(spark, str(tmp_path / "b.parquet")).collect())) == sorted(map(str, df.collect()))
    tables.write_table(df, str(tmp_path / "c.feather"))
    assert sorted(map(str, tables.read_table(spark, str(tmp_path / "c.feather")).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(tables.Unreadable):
        tables.read_table(spark, str(tmp_path / "a.txt"))


def test_discovery_and_command_line(spark, tmp_path, capsys):
    cli.run(["demo", str(tmp_path / "data")])
    assert cli.run(["audit", str(tmp_path / "data"), "--out", str(tmp_path / "out")]) == 1
    assert "FORMAL_EVAL_INVALID" in (tmp_path / "out" / "report.md").read_text() and (tmp_path / "out" / "report.html").exists()
    assert cli.run(["snapshot", str(tmp_path / "data"), "--out", str(tmp_path / "snap")]) == 0
    capsys.readouterr()
    assert cli.run(["diff", str(tmp_path / "snap"), str(tmp_path / "data")]) == 0 and capsys.readouterr().out.strip() == "[]"
    text = (tmp_path / "out" / "report.md").read_text()
    assert "What to do" in text and "largest:" in text and "entity p000" in text and "- answered:" in text
    assert cli.run(["split", str(tmp_path / "data"), "--out", str(tmp_path / "new"), "--group", "patient_id", "--dedupe", "--ratios", "80/20"]) == 0
    spec = discovery.open_dataset(spark, str(tmp_path / "new"))
    assert sorted(spec.splits) == ["test", "train"]
    facts = json.loads((tmp_path / "new" / "split-manifest.json").read_text())
    assert facts["class_counts"]["train"] and facts["entities"]["train"] and len(facts["files"]) >= 2 and all(len(f["sha256"]) == 64 for f in facts["files"]) and facts["ratio_deviation_entities"] is not None
    assert "patient_id" in (tmp_path / "new" / "evalguard.yaml").read_text()
    assert cli.run(["fingerprint", str(tmp_path / "data"), "--out", str(tmp_path / "manifest"), "--mode", "sampled", "--fraction", "0.0000001"]) == 0
    records, header = versions.read_manifest(spark, str(tmp_path / "manifest"))
    assert records.count() == 245 and records.where("hash_sampled").count() == 1 and header["mode"] == "sampled"  # never nothing
    with pytest.raises(policy.ConfigError):
        cli.run(["split", str(tmp_path / "data"), "--out", str(tmp_path / "new")])
    saved = str(tmp_path / "out" / "report.json")
    assert cli.run(["report", saved, "--form", "html"]) == 0 and cli.run(["show", saved, "DD005"]) == 0 and cli.run(["show", saved]) == 0 and cli.run(["rules"]) == 0


def test_split_of_csv_keeps_its_suffix_and_diff_tells_findings(spark, tmp_path, capsys):
    cli.run(["demo", str(tmp_path / "data")])
    assert cli.run(["split", str(tmp_path / "data" / "train.csv"), "--out", str(tmp_path / "new"), "--group", "patient_id", "--ratios", "50/50"]) == 0
    assert (tmp_path / "new" / "train.csv").exists() and "patient_id" in (tmp_path / "new" / "evalguard.yaml").read_text()
    (tmp_path / "fixed").mkdir()
    (tmp_path / "fixed" / "evalguard.yaml").write_text((tmp_path / "data" / "evalguard.yaml").read_text())
    (tmp_path / "fixed" / "train.csv").write_text((tmp_path / "data" / "train.csv").read_text())
    (tmp_path / "fixed" / "test.csv").write_text("\n".join((tmp_path / "data" / "test.csv").read_text().splitlines()[:-5]) + "\n")
    for name in ("data", "fixed"):
        assert cli.run(["snapshot", str(tmp_path / name), "--out", str(tmp_path / f"{name}-snap"), "--audited"]) == 0
    found = api.diff(spark, str(tmp_path / "data-snap"), str(tmp_path / "fixed-snap"))
    assert {r["kind"]: r["n"] for r in found["counts"]} == {"removed": 5} and len(found["rows"]) == 5
    assert {r[0] for r in found["findings"]["resolved"]} >= {"DD003", "DD005"} and found["verdicts"][0] == policy.INVALID


def test_a_baseline_of_another_kind_is_a_finding(spark, tmp_path):
    cli.run(["demo", str(tmp_path / "data")])
    cli.run(["snapshot", str(tmp_path / "data"), "--out", str(tmp_path / "snap")])
    header = next((tmp_path / "snap" / "header").glob("part-*.txt"))
    header.write_text(header.read_text().replace("tabular", "image"))
    crc = header.with_name(f".{header.name}.crc")
    crc.unlink(missing_ok=True)
    r = api.audit(spark, discovery.open_dataset(spark, str(tmp_path / "data"), api.config_for(str(tmp_path / "data"))), str(tmp_path / "snap"))
    f = next(f for f in r.findings if f["rule_id"] == "DD018")
    assert (f["status"], f["formal_impact"]) == ("INCONCLUSIVE", "NONE") and "dataset_type" in f["evidence"]["why"]


def test_one_absent_group_column_hides_nothing(spark):
    r = run(spark, rows(40, lambda i: f"p{i % 5}"), rows(20, lambda i: f"p{i % 5}", 1000), groups=("nosuch", "patient_id"))
    f = next(f for f in r.findings if f["rule_id"] == "DD005")
    assert (f["severity"], f["affected_count"], f["evidence"]["absent_columns"]) == ("CRITICAL", 60, ["nosuch"]) and len(f["evidence"]["largest"]) == 5
    some = rows(40, lambda i: f"p{i}" if i % 2 else None)
    r = run(spark, some, rows(20, lambda i: f"q{i}", 1000))
    assert len([f for f in r.findings if f["rule_id"] == "DD005"]) == 2  # a row id, and missing in part


def test_evidence_lists(spark):
    train = [*rows(40, lambda i: f"p{i // 8}"), *rows(3, lambda i: "p9", 7) * 2]
    r = run(spark, train, [*rows(20, lambda i: f"q{i // 4}", 1000), *train[:2]])
    cross = next(f for f in r.findings if f["rule_id"] == "DD003" and f["target_split"])
    assert len(cross["evidence"]["largest"]) == 2 and any(m.startswith("test:") for m in cross["evidence"]["largest"][0]["members"])
    text = report.markdown(r)
    assert "What to do" in text and "members" in text and report.page(r).count("<section") == sum(f["status"] != "PASS" for f in r.findings)


def test_sampling_hides_no_row_from_the_rules(spark):
    r = run(spark, rows(40, lambda i: f"p{i % 5}"), rows(20, lambda i: f"p{i % 5}", 1000), sampling={"enabled": True, "fraction": 0.01})
    assert r.identity["num_samples"] == 60 and next(f for f in r.findings if f["rule_id"] == "DD005")["affected_count"] == 60


def test_files_of_differing_types_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n")
    (tmp_path / "b.csv").write_text('x,y\nq,"two\nlines"\n')
    df, bad = tables.read_tables(spark, [f"file://{tmp_path}/{n}.csv" for n in "ab"])
    assert not bad and sorted(tuple(r) for r in df.collect()) == [("1", "a"), ("q", "two\nlines")]
    assert [tables.broken_lines(spark, f"file://{tmp_path}/{n}.csv") for n in "ab"] == [False, True]


def test_images_are_split_by_the_entity_in_their_path(spark, tmp_path):
    for i in range(24):
        (tmp_path / "in" / "ab"[i % 2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "ab"[i % 2] / f"p{i // 2}_{i}.png").write_bytes(png(np.full((8, 8), i, np.uint8)))
    config = policy.Config.of({"dataset": {"type": "image"}})
    spec = discovery.open_dataset(spark, f"file://{tmp_path}/in", config)
    with pytest.raises(policy.ConfigError):
        api.split(spark, str(tmp_path / "in"), spec, str(tmp_path / "no"), {"train": 0.5, "test": 0.5}, entity_pattern=r"q(\d+)_")
    api.split(spark, str(tmp_path / "in"), spec, str(tmp_path / "out"), {"train": 0.5, "test": 0.5}, entity_pattern=r"p(\d+)_")
    owners = {s: {f.name.split("_")[0] for f in (tmp_path / "out" / s).rglob("*.png")} for s in ("train", "test")}
    assert not owners["train"] & owners["test"] and len(list((tmp_path / "out").rglob("*.png"))) == 24


def test_exit_codes_of_the_program(monkeypatch):
    for error, code in ((KeyboardInterrupt(), 130), (RuntimeError("x"), 3), (policy.ConfigError("x"), 2)):
        def fail(error=error):
            raise error

        monkeypatch.setattr(cli, "run", fail)
        with pytest.raises(SystemExit) as stopped:
            cli.main()
        assert stopped.value.code == code


def png(pixels):
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    tiles = [np.kron(rng.integers(0, 200, (8, 8)), np.ones((4, 4), int)).astype(np.uint8) for _ in range(24)]
    for i, t in enumerate(tiles):
        folder = tmp_path / "set" / ("train" if i < 14 else "test") / "ab"[i % 2]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(png(t))
    test = tmp_path / "set" / "test" / "a"
    (test / "copy.png").write_bytes(png(tiles[0]))
    (test / "bright.png").write_bytes(png((tiles[2] * 1.06 + 4).astype(np.uint8)))
    (test / "empty.png").write_bytes(b"")
    (test / "cut.png").write_bytes(png(tiles[4])[:60])
    spec = discovery.open_dataset(spark, f"file://{tmp_path}/set")
    assert spec.images
    r = engine.audit(spark, spec)
    by = {f["rule_id"]: f for f in r.findings}
    assert by["DD003"]["affected_count"] == 2 and by["DD004"]["evidence"]["pairs"] == 1 and by["DD016"]["affected_count"] == 2 and by["DD016"]["severity"] == "HIGH"
    assert r.verdict == policy.INVALID


def test_reencoded_images_of_equal_hash_are_near_copies(spark, tmp_path):
    rng = np.random.default_rng(5)
    tiles = [np.kron(rng.integers(0, 200, (8, 8)), np.ones((4, 4), int)).astype(np.uint8) for _ in range(6)]
    for i, t in enumerate(tiles):
        folder = tmp_path / "set" / ("train" if i < 4 else "test") / "ab"[i % 2]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(png(t))
    body = png(tiles[0])
    text = b"tEXtComment\0saved again"
    (tmp_path / "set" / "test" / "a" / "again.png").write_bytes(body[:33] + struct.pack(">I", len(text) - 4) + text + struct.pack(">I", zlib.crc32(text)) + body[33:])
    r = engine.audit(spark, discovery.open_dataset(spark, f"file://{tmp_path}/set"))
    near = [f for f in r.findings if f["rule_id"] == "DD004"]
    assert len(near) == 1 and near[0]["severity"] == "HIGH" and near[0]["evidence"]["pairs"] == 1 and near[0]["evidence"]["least_distance"] == 0
    assert "DD003" not in {f["rule_id"] for f in r.findings}


def test_phash_moves_little_under_brightness():
    t = np.kron(np.random.default_rng(2).integers(0, 200, (8, 8)), np.ones((4, 4)))
    assert bin((images.phash(t) ^ images.phash(t * 1.06 + 4)) & (2**64 - 1)).count("1") <= 2


def test_repair_plan_orders_steps():
    r = engine.Report(policy.INVALID, [], [fact("DD005", "CRITICAL", "FAIL", "BLOCKING") | {"finding_id": "DD005-0001"}, fact("DD003", "HIGH", "FAIL", "BLOCKING") | {"finding_id": "DD003-0001"}], [], {})
    assert [s["kind"] for s in report.repair_plan(r)] == ["deduplicate", "resplit", "verify"]


def test_hash_cache_and_copies(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in" / "a").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "a" / f"p{i}_x.png").write_bytes(bytes([i]) * 9)
    root = f"file://{tmp_path}/in"
    first = images.hash_files(spark, root)
    cache = spark.createDataFrame([(r["path"], r["length"], r["modified"], "kept") for r in first.collect() if "p0" in r["path"]], first.schema)
    again = {r["path"][-8:]: r["sha256"] for r in images.hash_files(spark, root, cache).collect()}
    assert again["p0_x.png"] == "kept" and len(again) == 3 and len(again["p1_x.png"]) == 64
    paths = spark.createDataFrame([("train/cat/p7_x.png",), ("x.png",)], "p string")
    got = paths.select(images.label_of_path(F.col("p")).alias("l"), images.entity_of_path(F.col("p"), r"p(\d+)_").alias("e")).collect()
    assert [tuple(r) for r in got] == [("cat", "7"), (None, None)]
    assigned = spark.createDataFrame([(f"a/p{i}_x.png", "train" if i else "test", f"{root}/a/p{i}_x.png") for i in range(3)], "relative_path string, split string, origin string")
    assert images.copy_split(assigned, f"file://{tmp_path}/out") == 3 and (tmp_path / "out" / "train" / "a" / "p2_x.png").read_bytes() == b"\2" * 9


def test_finding_changes():
    f = lambda rule, n: {"rule_id": rule, "metadata": {}, "source_split": "train", "target_split": "test", "affected_count": n, "severity": "HIGH"}
    got = versions.finding_changes([f("DD003", 1), f("DD005", 2)], [f("DD005", 3), f("DD006", 1)])
    assert [len(got[k]) for k in ("new", "resolved", "changed")] == [1, 1, 1] and versions.finding_changes(None, [f("DD003", 1)])["new"] == []
