"""The engine from code: open, scan, audit, fingerprint, snapshot, diff and split a dataset by its path."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalguard.functions import canon
from evalguard.operators import resplit, versions
from evalguard.operators.duplicates import first_rows
from evalguard.plans import engine, report
from evalguard.plans.policy import Config, ConfigError
from evalguard.sources import discovery, images, tables

CONFIG_NAME = "evalguard.yaml"
#: Rows of each kind that a diff lists.
LISTED = 2000


def config_for(root: str, path: str | None = None) -> Config:
    """The named configuration, the one beside the data, or the defaults."""
    if path:
        return Config.load(path)
    near = Path(root.removeprefix("file://")) / CONFIG_NAME
    return Config.load(near) if near.is_file() else Config()


def scan(spark: SparkSession, spec: engine.AuditSpec) -> dict[str, Any]:
    """Identity, sizes, classes and schema."""
    return engine.identity(engine.Context(spark, spec))


def audit(spark: SparkSession, spec: engine.AuditSpec, baseline: str | None = None, config: str | None = None) -> engine.Report:
    """Run every rule; a baseline that can't be compared is a finding, not an error."""
    if baseline:
        rows, header = open_version(spark, baseline, config)
        spec.baseline, spec.incomparable = rows, versions.comparable(header, _header(spec))
    return engine.audit(spark, spec)


def _header(spec: engine.AuditSpec) -> dict[str, Any]:
    return {"dataset_type": "image" if spec.images else "tabular", "mode": "full"}


def _version(spark: SparkSession, spec: engine.AuditSpec) -> DataFrame:
    ctx = engine.Context(spark, spec)
    return versions.snapshot(ctx.df, ctx.config.ids, engine.SPLIT, ctx.label)


def fingerprint(spark: SparkSession, spec: engine.AuditSpec, out: str | None = None, mode: str = "full", fraction: float = 1.0, seed: int = 1337) -> dict[str, Any]:
    """The version's hashes; with ``out`` also a manifest of its rows as JSON lines, hashed by mode."""
    facts = scan(spark, spec)
    if spec.config.sampling and mode == "full":
        (fraction, seed), mode = spec.config.sampling, "sampled"
    if out:
        rows = versions.manifest(spec.samples, spec.config.ids, engine.SPLIT, engine.Context(spark, spec).label, spec.config.groups, mode, fraction, seed)
        versions.write_manifest(rows, out, facts | _header(spec) | {"mode": mode, "fraction": fraction, "seed": seed})
    return {k: facts[k] for k in ("dataset_id", "manifest_hash", "config_hash")} | {"mode": mode}


def snapshot(spark: SparkSession, spec: engine.AuditSpec, out: str, audited: bool = False) -> None:
    """Write a version without its values; with ``audited`` its findings too, so that a diff can tell what was resolved."""
    found = engine.audit(spark, spec) if audited else None
    header = _header(spec) | {"identity": found.identity if found else scan(spark, spec)}
    if found:
        header |= {"verdict": found.verdict, "findings": versions.findings_digest(found.findings)}
    versions.write_snapshot(_version(spark, spec), out, json.loads(json.dumps(header, default=str)))


def open_version(spark: SparkSession, path: str, config: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """A saved snapshot, or a dataset's own."""
    if Path(path.removeprefix("file://"), "header").exists():
        return versions.read_snapshot(spark, path)
    spec = discovery.open_dataset(spark, path, config_for(path, config))
    return _version(spark, spec), _header(spec)


def diff(spark: SparkSession, old: str, new: str, config: str | None = None) -> dict[str, Any]:
    """Counts by kind, the first rows of each, and new, resolved and changed findings where both sides were audited."""
    (a, head_a), (b, head_b) = open_version(spark, old, config), open_version(spark, new, config)
    if why := versions.comparable(head_a, head_b):
        return {"comparable": False, "reason": why}
    a, b = a.persist(), b.persist()
    changes = versions.compare(a, b).persist()
    try:
        counts = [r.asDict() for r in versions.summary(changes).orderBy("kind").collect()]
        rows = [r.asDict() for r in versions.listed(changes, LISTED).collect()]
    finally:
        for df in (changes, a, b):
            df.unpersist()
    before, after = head_a.get("findings"), head_b.get("findings")
    found = versions.finding_changes(before, after)
    return {
        "comparable": True, "counts": counts, "rows": rows, "findings": {k: [list(x) for x in v] for k, v in found.items()}, "audited": [before is not None, after is not None],
        "verdicts": [head_a.get("verdict"), head_b.get("verdict")],
    }


def _guard(path: str, out: Path) -> None:
    if out.exists() and any(out.iterdir()):
        raise ConfigError(f"{out} is not empty")
    if Path(path.removeprefix("file://")).resolve().is_relative_to(out.resolve()):
        raise ConfigError("the output would hold the source")


def split(spark: SparkSession, path: str, spec: engine.AuditSpec, out: str, ratios: dict[str, float], group: str | None = None, seed: int = 1337, dedupe: bool = False, form: str | None = None, entity_pattern: str | None = None) -> dict[str, Any]:
    """Write a dataset's splits anew, with the manifest and configuration that make them reproducible."""
    target = Path(out.removeprefix("file://"))
    _guard(path, target)
    ratios = resplit.normalise(ratios)
    df = spec.samples.drop(engine.SPLIT)
    if spec.images:
        order = F.xxhash64("relative_path") if "relative_path" in df.columns else None
        if entity_pattern:
            df = df.withColumn("__entity", images.entity_of_path(F.col("relative_path"), entity_pattern))
            if n := df.where("__entity is null").count():
                raise ConfigError(f"{n} paths don't match {entity_pattern}")
            group = "__entity"
    else:
        order = None
    df = df.withColumn("__row", order if order is not None else F.monotonically_increasing_id()).persist()
    label = spec.config.label if spec.config.label in df.columns else None
    kept = df
    if dedupe:
        content = F.col("sha256") if spec.images else canon.digest(df, [c for c in df.columns if c != "__row"])
        kept = first_rows(df, content, "__row").persist()
    done = resplit.split_rows(kept, ratios, "__row", group, label, seed).persist()
    try:
        off = resplit.deviation(done, ratios).collect()
        if empty := [r["split"] for r in off if not r["rows"]]:
            raise ConfigError(f"nothing would be written: {', '.join(empty)} would be empty")
        entities = {}
        if group:
            owners = done.select("split", canon.entity_key(F.col(group)).alias("e")).where("e is not null").distinct().groupBy("split").agg(F.count("*").alias("n"))
            entities = {r["split"]: r["n"] for r in owners.collect()}
        classes: dict[str, dict[str, int]] = {}
        if label:
            for r in done.groupBy("split", F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n")).orderBy("split", F.desc("n"), "label").limit(engine.MAX_CLASSES * len(ratios)).collect():
                classes.setdefault(r["split"], {})[str(r["label"])] = r["n"]
        if spec.images:
            images.copy_split(done.select("relative_path", "split", "origin"), out)
        else:
            suffix = form or tables.suffix(path).lstrip(".") or "parquet"
            for name in ratios:
                tables.write_table(done.where(F.col("split") == name).drop("split", "__row"), str(target / f"{name}.{suffix}"))
    finally:
        for x in (done, kept, df):
            x.unpersist()
    total = sum(entities.values())
    facts = {r["split"]: {"rows": r["rows"], "share": r["share"], "wanted": r["wanted"]} for r in off}
    by_entity = max((abs(entities.get(k, 0) / total - v) for k, v in ratios.items()), default=0.0) if total else None
    by_row = max(r["off"] for r in off)
    manifest = {
        "source": path, "seed": seed, "ratios": ratios, "group": entity_pattern or group, "stratify": label, "dedupe": dedupe, "splits": facts, "entities": entities, "class_counts": classes,
        "ratio_deviation_rows": round(by_row, 4), "ratio_deviation_entities": None if by_entity is None else round(by_entity, 4), "approximate": by_row > 0.05,
        "files": [] if spec.images else file_digests(target), "reproduce": f"evalguard split {path} --ratios {','.join(f'{k}={v:g}' for k, v in ratios.items())} --seed {seed}" + (f" --group {group}" if group and not entity_pattern else "") + (" --dedupe" if dedupe else "") + " --out NEW",
    }
    report.write(target / "split-manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    carry_config(path, target, spec.config)
    return facts


def file_digests(folder: Path) -> list[dict[str, str]]:
    """SHA-256 of each written file, read in blocks."""
    out = []
    for f in sorted(x for x in folder.rglob("*") if x.is_file() and not x.name.startswith((".", "_"))):
        h = hashlib.sha256()
        with f.open("rb") as data:
            while block := data.read(1 << 20):
                h.update(block)
        out.append({"path": f.relative_to(folder).as_posix(), "sha256": h.hexdigest()})
    return out


def carry_config(path: str, out: Path, config: Config) -> None:
    """The source's configuration goes with its data; without one, what was declared is written down."""
    near = Path(path.removeprefix("file://")) / CONFIG_NAME
    if near.is_file():
        import yaml

        raw = yaml.safe_load(near.read_text()) or {}
        text = "\n".join(line for line in near.read_text().splitlines())
        if raw.get("splits") or (raw.get("temporal") or {}).get("split_column"):  # they name the old layout
            raw.pop("splits", None)
            (raw.get("temporal") or {}).pop("split_column", None)
            text = yaml.safe_dump(raw, sort_keys=True)
        report.write(out / CONFIG_NAME, "# carried over from the source\n" + text + "\n")
        return
    lines = [f"labels: {{column: {json.dumps(config.label)}}}"] * bool(config.label) + [f"groups: {{columns: {json.dumps(config.groups)}}}"] * bool(config.groups) + [f"id_columns: {json.dumps(config.ids)}"] * bool(config.ids)
    if lines:
        report.write(out / CONFIG_NAME, "# from the flags of the split\n" + "\n".join(lines) + "\n")
