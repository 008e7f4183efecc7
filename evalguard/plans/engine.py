"""The audit: rules over one tagged relation, findings, outcomes and the verdict.

Each rule is a plan that returns a few rows (per split, column or class); only those reach the driver.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalguard.functions import canon, metrics
from evalguard.operators import distribution, duplicates, frames, labels, leakage, structural, versions
from evalguard.plans import policy
from evalguard.plans.registry import RULES, rank

SPLIT = frames.SPLIT
#: Rules that run at once.
THREADS = 8
#: Classes that a report lists, the largest first.
MAX_CLASSES = 1000
FINDING_SCHEMA = (
    "finding_id string, rule_id string, title string, category string, severity string, status string, evidence_type string, formal_impact string, "
    "affected_count long, source_split string, target_split string, columns array<string>, evidence string"
)


class NotApplicable(Exception):
    """The rule has nothing to ask here."""

    def __init__(self, reason: str, status: str = "NOT_RUN") -> None:
        super().__init__(reason)
        self.status = status


class NoEvidence(Exception):
    """The rule could not be answered."""


@dataclass
class AuditSpec:
    """What is audited: one relation with a split column, the splits' own frames, and the roles of columns."""

    samples: DataFrame
    splits: dict[str, DataFrame]
    config: policy.Config
    images: bool = False
    unreadable: list[str] = field(default_factory=list)
    baseline: DataFrame | None = None
    #: Why the baseline can't be compared, if so.
    incomparable: str | None = None

    @classmethod
    def of(cls, df: DataFrame, split: str, label: str | None = None, groups: list[str] | None = None, ids: list[str] | None = None, temporal: str | None = None, **raw: Any) -> AuditSpec:
        """From one frame with a split column; a row's split is that column's value."""
        config = policy.Config.of(raw)
        config.label, config.groups, config.ids, config.temporal = label, list(groups or []), list(ids or []), temporal
        tagged = df.withColumn(SPLIT, canon.split_name(F.col(split))).drop(split)
        names = sorted(r[0] for r in tagged.select(SPLIT).distinct().collect())  # splits are few
        return cls(tagged, {n: tagged.where(F.col(SPLIT) == n).drop(SPLIT) for n in names}, config)

    @property
    def columnar(self) -> bool:
        """Whether all rows come from files that are read column by column, so that reading them again is cheap."""
        plan = self.samples._jdf.queryExecution().analyzed().toString()
        leaves = re.findall(r"^[\s:+|-]*((?:Relation|LogicalRDD|LocalRelation|Range|MapInArrow|MapInPandas|InMemoryRelation|Join)\b.*)$", plan, re.MULTILINE)
        return bool(leaves) and all(re.search(r"\] (?:parquet|orc)$", x.strip()) for x in leaves)

    @classmethod
    def of_splits(cls, splits: dict[str, DataFrame], config: policy.Config, **more: Any) -> AuditSpec:
        return cls(frames.stack(splits), splits, config, **more)


@dataclass
class Report:
    verdict: str
    reasons: list[str]
    findings: list[dict[str, Any]]
    outcomes: list[dict[str, Any]]
    identity: dict[str, Any]

    def findings_frame(self, spark: SparkSession) -> DataFrame:
        names = [p.split()[0] for p in FINDING_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(json.dumps(f[n], sort_keys=True, default=str) if n == "evidence" else f[n] for n in names) for f in self.findings], FINDING_SCHEMA)

    def summary(self) -> dict[str, Any]:
        count = lambda key: {v: sum(f[key] == v for f in self.findings) for v in sorted({f[key] for f in self.findings})}
        return {"findings": len(self.findings), "by_severity": count("severity"), "by_status": count("status"), "by_category": count("category"), "not_run": [o["rule_id"] for o in self.outcomes if o["status"] == "NOT_RUN"]}


class Context:
    """What rules share: the relation, its schema by role, and a few cached facts."""

    def __init__(self, spark: SparkSession, spec: AuditSpec) -> None:
        self.spark, self.spec, self.config = spark, spec, spec.config
        df = spec.samples
        self.columns = [c for c in df.columns if c != SPLIT]
        label = self.config.label
        if label is None:  # the usual names, in this order
            label = next((c for c in ("label", "target", "class", "y", "category", "outcome") if c in self.columns), None)
        self.label = label if label in self.columns else None
        special = {self.label, *self.config.ids, *self.config.groups}
        self.features = [c for c in self.columns if c not in special]
        content = [c for c in self.columns]
        features = [c for c in self.columns if c != self.label and c not in self.config.ids]
        # the file's bytes are an image's content
        self.row = F.col("sha256") if spec.images else canon.digest(df, content)
        self.same = F.col("sha256") if spec.images else canon.digest(df, features) if features else F.lit(None).cast("string")
        self.df = df
        key = [canon.cell(df[c], df.schema[c].dataType) for c in (self.config.ids if not spec.images and all(c in self.columns for c in self.config.ids) else [])]
        sample = F.col("sample_id") if "sample_id" in self.columns else F.concat_ws("/", *key) if key else self.row
        #: Keys and digests only: what the rules on contents share.
        self.digests = df.select(sample.alias("__sample"), F.col(SPLIT), *([F.col(self.label)] if self.label else []), self.row.alias("__row"), self.same.alias("__features"))
        self.kinds = {f.name: f.dataType for f in df.schema.fields}
        self.sizes = {n: 0 for n in spec.splits} | {r[SPLIT]: r["count"] for r in self.df.groupBy(SPLIT).count().collect()}
        self.total = sum(self.sizes.values())

    def by_role(self, role: str) -> list[str]:
        return [s for s in sorted(self.sizes) if canon.role_of(s) == role and self.sizes[s]]

    def reference(self) -> str | None:
        return next(iter(self.by_role("train")), next((s for s in sorted(self.sizes) if self.sizes[s]), None))

    def block(self, rule: str) -> dict[str, Any]:
        return self.config.policy(RULES[rule].policy)

    def numeric(self, columns: list[str]) -> list[str]:
        """Numbers in every split that has the column."""
        own = [{f.name: f.dataType for f in d.schema.fields} for d in self.spec.splits.values()]
        return [c for c in columns if all(canon.is_numeric(k[c]) for k in own if c in k)]

    def needs_splits(self, n: int = 2) -> None:
        if sum(1 for v in self.sizes.values() if v) < n:
            raise NoEvidence(f"fewer than {n} splits hold samples")


def finding(rule: str, title: str, severity: str, status: str, impact: str, affected: int = 0, source: str | None = None, target: str | None = None, columns: list[str] | None = None, scope: str | None = None, **evidence: Any) -> dict[str, Any]:
    r = RULES[rule]
    return {
        "finding_id": "", "rule_id": rule, "title": title, "category": r.category, "severity": severity, "status": status, "evidence_type": r.evidence, "formal_impact": impact,
        "affected_count": int(affected), "source_split": source, "target_split": target, "columns": columns or [], "evidence": evidence, "metadata": {"scope": scope} if scope else {},
    }


RUN: dict[str, Callable[[Context], list[dict[str, Any]]]] = {}


def rule(*ids: str):
    def add(f: Callable[[Context], list[dict[str, Any]]]):
        for i in ids:
            RUN[i] = f
        return f

    return add


def identity(ctx: Context) -> dict[str, Any]:
    by = ctx.digests.select(F.col(SPLIT).alias("split"), (F.col(ctx.label).cast("string") if ctx.label else F.lit(None).cast("string")).alias("label"), F.col("__row").alias("content"))
    h = versions.manifest_hash(by)
    classes = {r["label"]: r["n"] for r in labels.class_counts(ctx.df, ctx.label).orderBy(F.desc("n"), "label").limit(MAX_CLASSES).collect()} if ctx.label else {}
    return {
        "dataset_id": "ds_" + h[:8], "manifest_hash": h, "config_hash": ctx.config.hash(), "num_samples": ctx.total, "split_sizes": ctx.sizes, "class_counts": classes,
        "schema": {c: canon.logical_type(ctx.df, c) for c in ctx.columns}, "dataset_type": "image" if ctx.spec.images else "tabular",
    }


@rule("DD001")
def _identity(ctx: Context) -> list[dict[str, Any]]:
    return [finding("DD001", "Dataset identity", "INFO", "PASS", "NONE", ctx.total, **identity(ctx))]


@rule("DD002")
def _splits(ctx: Context) -> list[dict[str, Any]]:
    out = []
    if len(ctx.sizes) < 2:
        out.append(finding("DD002", "Fewer than two splits", "HIGH", "INCONCLUSIVE", "POTENTIAL", splits=sorted(ctx.sizes)))
    out += [finding("DD002", f"Split {s} is empty", "HIGH", "FAIL", "BLOCKING", source=s) for s, n in sorted(ctx.sizes.items()) if not n]
    paths: dict[str, list[str]] = {}
    for s, p in ctx.config.splits.items():
        paths.setdefault(p.rstrip("/"), []).append(s)
    out += [finding("DD002", f"Splits {', '.join(s)} are the same path", "CRITICAL", "FAIL", "BLOCKING", splits=s) for s in paths.values() if len(s) > 1 and not ctx.config.split_column]
    if len(ctx.sizes) >= 2 and not any(canon.role_of(s) == "test" for s in ctx.sizes):
        out.append(finding("DD002", "No test split", "MEDIUM", "INCONCLUSIVE", "POTENTIAL", splits=sorted(ctx.sizes)))
    return out


@rule("DD003")
def _exact(ctx: Context) -> list[dict[str, Any]]:
    rows = ctx.digests.where("__row is not null")
    groups = duplicates.digest_groups(rows, "__row", SPLIT).persist()
    try:
        out = []
        cross, within = duplicates.cross_split(groups).collect(), duplicates.within_split(groups).orderBy("split").collect()
        top = [r.asDict(recursive=True) for r in duplicates.largest_groups(rows, "__row", "__sample", SPLIT, 200).orderBy(F.desc("n"), "digest").collect()] if cross or within else []

        def largest(*splits: str) -> list[dict[str, Any]]:
            mine = [g for g in top if (set(splits) <= set(g["splits"]) if len(splits) > 1 else g["splits"] == list(splits))]
            return [{"digest": g["digest"], "n": g["n"], "members": [f"{m['split']}:{m['sample']}" for m in g["members"]]} for g in mine[:20]]

        for r in cross:
            hard = {canon.role_of(r["split_a"]), canon.role_of(r["split_b"])} >= {"train", "test"}
            out.append(finding("DD003", f"Identical samples in {r['split_a']} and {r['split_b']}", "CRITICAL" if hard else "HIGH", "FAIL", "BLOCKING", r["affected"], r["split_a"], r["split_b"], groups=r["n_groups"], redundant=r["redundant"], largest=largest(r["split_a"], r["split_b"])))
        order = lambda f: (f["severity"] != "CRITICAL", "test" not in (f["source_split"], f["target_split"]), -f["evidence"]["groups"])
        out.sort(key=order)
        for r in within:
            out.append(finding("DD003", f"Repeated samples in {r['split']}", "MEDIUM", "WARNING", "POTENTIAL", r["affected"], r["split"], scope="within_split", groups=r["n_groups"], redundant=r["redundant"], largest=largest(r["split"])))
        return out
    finally:
        groups.unpersist()


@rule("DD004")
def _near(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.spec.images:
        raise NotApplicable("only images have perceptual hashes", "UNSUPPORTED")
    if "phash" not in ctx.columns:
        raise NoEvidence("no perceptual hashes")
    if ctx.df.where("phash is not null").limit(2).count() < 2:
        raise NoEvidence("fewer than two hashes")
    t = int(ctx.block("DD004")["hamming_threshold"])
    rows = ctx.df.select("sample_id", "phash", SPLIT, F.col("sha256").alias("__row"))
    hashes = duplicates.near_hashes(rows, "phash", t).persist()
    try:
        near = duplicates.near_counts(rows, hashes, "phash", SPLIT)
        equal = duplicates.equal_hash_pairs(rows, "phash", "__row", SPLIT).withColumn("least", F.lit(0))
        counts = near.unionByName(equal).groupBy("x", "y").agg(F.sum("n").alias("n"), F.min("least").alias("least")).orderBy("x", "y").collect()
        examples = [r.asDict() for r in duplicates.closest_examples(rows, hashes, "sample_id", "phash", "__row", SPLIT).collect()] if counts else []
    finally:
        hashes.unpersist()
    out = []
    for r in counts:
        cross = r["x"] != r["y"]
        mine = [{"a": e["a"], "b": e["b"], "distance": e["distance"]} for e in examples if (e["x"], e["y"]) == (r["x"], r["y"])]
        out.append(finding("DD004", f"Similar images in {r['x']} and {r['y']}" if cross else f"Similar images in {r['x']}", "HIGH" if cross else "LOW", "WARNING", "POTENTIAL" if cross else "NONE", 2 * r["n"], r["x"], r["y"] if cross else None, scope=None if cross else "within_split", pairs=r["n"], least_distance=r["least"], threshold=t, closest=mine))
    return out


@rule("DD005")
def _groups(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.config.groups:
        raise NotApplicable("no group column is declared")
    present = [c for c in ctx.config.groups if c in ctx.columns]
    absent = [c for c in ctx.config.groups if c not in ctx.columns]
    if not present:
        raise NoEvidence(f"there is no column {', '.join(absent)}")
    ctx.needs_splits()
    out = []
    for column in present:
        coverage = leakage.entity_coverage(ctx.df, column, SPLIT).collect()
        rows, missing = sum(r["rows"] for r in coverage), sum(r["missing"] for r in coverage)
        facts = {"rows": rows, "missing": missing, "coverage": round(1 - missing / rows, 6) if rows else 0.0} | ({"absent_columns": absent} if absent else {})
        if missing == rows:
            out.append(finding("DD005", f"{column} names no entity", "HIGH", "INCONCLUSIVE", "BLOCKING", rows, columns=[column], **facts))
            continue
        pairs = leakage.entity_pairs(ctx.df, column, SPLIT).orderBy("split_a", "split_b").collect()
        if pairs:
            top = [r.asDict() for r in leakage.largest_entities(ctx.df, column, SPLIT, 200).collect()]
            for r in pairs:
                hard = {r["split_a"], r["split_b"]} == {"train", "test"}
                largest = [{"entity": e["entity"], "rows": e["n"], "splits": e["splits"]} for e in top if {r["split_a"], r["split_b"]} <= set(e["splits"])][:20]
                out.append(finding("DD005", f"{column}: entities in {r['split_a']} and {r['split_b']}", "CRITICAL" if hard else "HIGH", "FAIL", "BLOCKING", r["affected_rows"], r["split_a"], r["split_b"], [column], entities=r["n_entities"], largest=largest, **facts))
            continue
        checked = rows - missing
        if sum(r["distinct_entities"] for r in coverage) / checked > 0.98:
            out.append(finding("DD005", f"{column} looks like a row id, not an entity", "LOW", "WARNING", "NONE", columns=[column], **facts))
        if missing:
            out.append(finding("DD005", f"{column} is missing in {missing} rows", "LOW", "WARNING", "NONE", missing, columns=[column], **facts))
    return out


@rule("DD006")
def _time(ctx: Context) -> list[dict[str, Any]]:
    column, block = ctx.config.temporal, ctx.block("DD006")
    if not column or not block["train_before_test"]:
        raise NotApplicable("no order in time is declared")
    if column not in ctx.columns:
        raise NoEvidence(f"there is no column {column}")
    kind = canon.logical_type(ctx.df, column)
    time_ = F.col(column).cast("timestamp") if kind == "datetime" else canon.moment(F.col(column))
    out, measured = [], False
    for train in ctx.by_role("train"):
        for test in ctx.by_role("test"):
            r = leakage.temporal_boundary(ctx.df, time_, SPLIT, train, test).first()
            measured |= bool(r["n_train"] and r["n_test"])
            if r["violating"]:
                out.append(finding("DD006", f"{train} rows dated at or after {test}", "HIGH", "FAIL", "BLOCKING", r["violating"], train, test, [column], train_max=r["train_max"], test_min=r["test_min"]))
    if not measured:
        out.append(finding("DD006", "The order in time could not be measured", "HIGH", "INCONCLUSIVE", "BLOCKING", columns=[column]))
    return out


@rule("DD007")
def _target(ctx: Context) -> list[dict[str, Any]]:
    if ctx.spec.images:
        raise NotApplicable("images have no feature columns", "UNSUPPORTED")
    if not ctx.label:
        raise NoEvidence("no label column")
    ctx.needs_splits()
    kind = ctx.kinds[ctx.label]
    rows = ctx.df.where(~canon.is_missing(F.col(ctx.label), kind))
    classes = sorted(r[0] for r in rows.select(F.col(ctx.label).cast("string")).distinct().limit(1001).collect())
    if len(classes) < 2:
        raise NoEvidence("the label has fewer than two values")
    features = ctx.features
    if not features:
        return []
    n = rows.count()
    filled = rows.agg(*(F.count(F.when(~canon.is_missing(F.col(c), ctx.kinds[c]), 1)).alias(c) for c in features)).first()
    features = [c for c in features if filled[c] >= 2]
    out, hard = [], set()
    facts = {r["column"]: r for r in leakage.functional(rows, features, ctx.label).collect()} if features else {}
    numbers = set(ctx.numeric(features))
    binary = len(classes) == 2 and canon.is_numeric(kind)
    corr = {r["column"]: r["r"] for r in leakage.correlations(rows, sorted(numbers), ctx.label).collect()} if numbers and binary else None
    for c in features:
        f = facts[c]
        why = None
        if f["identical"]:
            why = "is the label"
        elif f["max_y_per_f"] == 1 and f["max_f_per_y"] == 1:
            why = "is a deterministic relabelling of the label"
        elif f["max_y_per_f"] == 1 and f["n_f"] <= 20:
            why = "determines the label"
        elif corr is not None and c in numbers and filled[c] == n and corr[c] is not None and abs(corr[c]) >= 0.999999:
            why = "is a linear function of the label"
        if why:
            hard.add(c)
            out.append(finding("DD007", f"{c} {why}", "CRITICAL", "FAIL", "BLOCKING", n, columns=[c], values=f["n_f"], classes=f["n_y"]))
    block = ctx.block("DD007")
    soft = [c for c in features if c not in hard]
    if block["heuristic"] and len(classes) <= 50 and soft:
        auc = {r["column"]: r["auc"] for r in leakage.feature_auc(rows, soft, F.col(ctx.label).cast("string") == classes[-1]).where(F.col("n") >= 0.8 * n).collect()}
        levels = {r["column"]: r["n_f"] for r in facts.values()}
        edges = max(2, min(10, int(n**0.5)))
        cuts = [c for c in soft if c in numbers and levels[c] > 2]
        binned = leakage.quantile_binned(rows, cuts, edges) if cuts else rows
        nmi = {r["column"]: r["nmi"] for r in leakage.feature_nmi(binned, soft, ctx.label).collect()}
        for c in soft:
            a, m = auc.get(c) if levels[c] > 2 else None, nmi.get(c)
            if (a is not None and a >= block["min_single_feature_auc"]) or (m is not None and m >= block["min_normalized_mutual_info"]):
                out.append(finding("DD007", f"{c} predicts the label unusually well", "MEDIUM", "WARNING", "POTENTIAL", n, columns=[c], auc=a, nmi=m))
    return out


@rule("DD008")
def _identifiers(ctx: Context) -> list[dict[str, Any]]:
    out, seen = [], set()
    if not ctx.features:
        return out
    limit = ctx.block("DD008")["unique_ratio"]
    for r in leakage.unique_ratio(ctx.df, ctx.features, SPLIT).where(F.col("ratio") >= limit).orderBy("split", "column").collect():
        if r["column"] not in seen:
            seen.add(r["column"])
            out.append(finding("DD008", f"{r['column']} is almost unique in {r['split']}", "MEDIUM" if leakage.looks_like_id(r["column"]) else "LOW", "WARNING", "POTENTIAL", r["n_rows"], r["split"], columns=[r["column"]], unique=r["n_unique"], ratio=r["ratio"]))
    return out


@rule("DD009")
def _conflicts(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.label:
        raise NoEvidence("no label column")
    out = []
    for r in labels.conflict_summary(labels.conflicts(ctx.digests.where("__features is not null"), "__features", ctx.label, SPLIT)).orderBy("scope").collect():
        role = canon.role_of(r["scope"])
        severity, status, impact = ("CRITICAL", "FAIL", "BLOCKING") if r["scope"] == "cross" else ("HIGH", "FAIL", "BLOCKING") if role in ("val", "test") else ("MEDIUM", "WARNING", "POTENTIAL")
        where = "across splits" if r["scope"] == "cross" else f"in {r['scope']}"
        out.append(finding("DD009", f"Conflicting labels on identical content ({r['n_groups']} groups, {where})", severity, status, impact, r["affected"], None if r["scope"] == "cross" else r["scope"], groups=r["n_groups"], encoding_only_groups=r["encoding_only"]))
    return out


@rule("DD010")
def _unlabelled(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.label:
        raise NotApplicable("no label column")
    out = []
    for r in labels.missing(ctx.df, ctx.label, SPLIT).where("unlabelled > 0").orderBy("split").collect():
        evaluation = canon.role_of(r["split"]) in ("val", "test")
        severity = "HIGH" if evaluation else "MEDIUM" if r["ratio"] > 0.02 else "LOW"
        out.append(finding("DD010", f"{r['unlabelled']} samples without label in {r['split']}", severity, "WARNING", "POTENTIAL" if evaluation else "NONE", r["unlabelled"], r["split"], ratio=r["ratio"]))
    if ctx.spec.images:
        r = ctx.df.select(canon.clean_label(F.col(ctx.label)).alias("l")).agg(F.count("l").alias("n"), F.count_distinct("l").alias("k")).first()
        if r["n"] >= 20 and r["k"] / r["n"] > 0.9:
            out.append(finding("DD010", "Almost every image has a class of its own", "MEDIUM", "INCONCLUSIVE", "POTENTIAL", r["n"], classes=r["k"]))
    return out


@rule("DD011")
def _imbalance(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.label:
        raise NoEvidence("no label column")
    r = labels.imbalance(ctx.df, ctx.label).first()
    if not r["n_classes"]:
        raise NoEvidence("no labels")
    facts = {k: r[k] for k in ("n_classes", "imbalance_ratio", "minority_share", "entropy", "effective_classes")}
    if r["n_classes"] == 1:
        return [finding("DD011", "There is one class", "HIGH", "WARNING", "POTENTIAL", r["rows"], **facts)]
    block = ctx.block("DD011")
    facts["smallest_classes"] = [{"class": c["label"], "count": c["n"]} for c in labels.class_counts(ctx.df, ctx.label).where("label != '<unlabeled>'").orderBy("n", "label").limit(5).collect()]
    if r["imbalance_ratio"] > block["max_imbalance_ratio"] or r["minority_share"] < block["min_minority_ratio"]:
        return [finding("DD011", "Classes are unbalanced", "MEDIUM" if r["minority_share"] < 0.1 * block["min_minority_ratio"] else "LOW", "WARNING", "POTENTIAL", round(r["minority_share"] * r["rows"]), **facts)]
    return []


@rule("DD012")
def _feature_shift(ctx: Context) -> list[dict[str, Any]]:
    ctx.needs_splits()
    ref, block, out = ctx.reference(), ctx.block("DD012"), []
    numbers = ctx.numeric(ctx.features)
    others = [c for c in ctx.features if c not in numbers and c != ctx.config.temporal]
    for target in (s for s in sorted(ctx.sizes) if s != ref and ctx.sizes[s]):
        rows: list[dict[str, Any]] = []
        if numbers:
            for r in distribution.numeric_shift(ctx.df, numbers, SPLIT, ref, target).where(f"n_ref >= {distribution.MIN_VALUES} and n_tgt >= {distribution.MIN_VALUES}").collect():
                constant = r["smd"] is None  # both sides constant, at different values
                smd = float("inf") if constant else abs(r["smd"])
                usable = metrics.psi_usable(r["n_tgt"], block["min_psi"])
                if smd >= block["min_std_mean_diff"] or (usable and r["psi"] is not None and r["psi"] >= block["min_psi"]):
                    rows.append({"column": r["column"], "abs_smd": smd, "psi": r["psi"], "psi_usable": usable, "ks": r["ks"], "p": metrics.ks_p_value(r["ks"], r["n_ref"], r["n_tgt"]), "wasserstein": r["wasserstein"]})
            if len(rows) > 1:
                for row, q in zip(rows, metrics.benjamini_hochberg([x["p"] for x in rows]), strict=True):
                    row["q"], row["significant"] = q, q is not None and q <= block["fdr_alpha"]
        if others:
            for r in distribution.categorical_shift(ctx.df, others, SPLIT, ref, target).where(F.col("tv") >= block["min_std_mean_diff"] / 2).collect():
                rows.append({"column": r["column"], "abs_smd": 2 * r["tv"], "tv": r["tv"], "js": r["js"], "levels": r["levels"]})
        if rows:
            rows.sort(key=lambda x: (-x["abs_smd"], x["column"]))
            worst = rows[0]["abs_smd"]
            out.append(finding("DD012", f"{ref} vs {target} ({len(rows)} columns)", "HIGH" if worst >= 0.8 else "MEDIUM" if worst >= 0.5 else "LOW", "WARNING", "POTENTIAL", ctx.sizes[target], ref, target, [x["column"] for x in rows], top=rows[:20]))
    return out


@rule("DD013")
def _label_shift(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.label:
        raise NoEvidence("no label column")
    ctx.needs_splits()
    ref, out = ctx.reference(), []
    for r in labels.shift(ctx.df, ctx.label, SPLIT, ref).where(F.col("tv") >= ctx.block("DD013")["min_tv_distance"]).orderBy("split").collect():
        out.append(finding("DD013", f"{ref} vs {r['split']}", "HIGH" if r["tv"] >= 0.3 else "MEDIUM" if r["tv"] >= 0.15 else "LOW", "WARNING", "POTENTIAL", ctx.sizes[r["split"]], ref, r["split"], [ctx.label], tv=r["tv"], js=r["js"], common_classes=r["common_classes"], movers=[{"class": m["label"], "reference": m["p"], "target": m["q"]} for m in labels.movers(ctx.df, ctx.label, SPLIT, ref, r["split"]).collect()]))
    return out


@rule("DD014")
def _schema(ctx: Context) -> list[dict[str, Any]]:
    ctx.needs_splits()
    own = {s: d for s, d in ctx.spec.splits.items() if ctx.sizes.get(s)}
    rows = structural.schema_drift(ctx.spark, own).collect()
    out = []
    for s in sorted(own):
        named = {p: sorted(r["column"] for r in rows if r["split"] == s and r["problem"] == p) for p in ("missing", "extra")}
        if any(named.values()):
            out.append(finding("DD014", f"Columns of {s} differ", "HIGH", "FAIL", "BLOCKING", source=min(own), target=s, columns=named["missing"] + named["extra"], **named))
    if types := sorted({r["column"] for r in rows if r["problem"] == "type"}):
        out.append(finding("DD014", "Types differ between splits", "HIGH", "FAIL", "BLOCKING", columns=types, types=[(r["split"], r["column"], r["expected"], r["found"]) for r in rows if r["problem"] == "type"]))
    train = next(iter(ctx.by_role("train")), None)
    texts = [c for c in ctx.features if c not in ctx.numeric(ctx.features) and c != ctx.config.temporal]
    if train and texts:
        near_unique = {r["column"] for r in leakage.unique_ratio(ctx.df, texts, SPLIT).where("n_rows >= 10 and ratio > 0.9").collect()}
        texts = [c for c in texts if c not in near_unique]
        if texts:
            for r in structural.unseen_levels(ctx.df, texts, SPLIT, train).orderBy("split", "column").collect():
                if canon.role_of(r["split"]) in ("val", "test"):
                    out.append(finding("DD014", f"{r['column']}: values in {r['split']} that {train} never has", "MEDIUM", "WARNING", "POTENTIAL", 0, train, r["split"], [r["column"]], levels=r["n_levels"], rows=r["n_rows"]))
    return out


@rule("DD015")
def _missingness(ctx: Context) -> list[dict[str, Any]]:
    ctx.needs_splits()
    ref = ctx.reference()
    shared = [c for c in ctx.columns if all(c in d.columns for s, d in ctx.spec.splits.items() if ctx.sizes.get(s))]
    found = distribution.missingness_shift(ctx.df, shared, SPLIT, ref, ctx.block("DD015")["min_rate_delta"]).orderBy("split", "column").collect() if shared else []
    out = []
    for s in sorted({r["split"] for r in found}):
        rows = [r for r in found if r["split"] == s]
        out.append(finding("DD015", f"Missing values differ between {ref} and {s}", "MEDIUM" if max(abs(r["delta"]) for r in rows) >= 0.3 else "LOW", "WARNING", "POTENTIAL", 0, ref, s, [r["column"] for r in rows], deltas={r["column"]: r["delta"] for r in rows}))
    return out


@rule("DD016")
def _corrupt(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.spec.images:
        if not ctx.spec.unreadable:
            return []
        hard = any(canon.role_of(p.split("/")[0]) in ("val", "test") for p in ctx.spec.unreadable)
        return [finding("DD016", f"{len(ctx.spec.unreadable)} files can't be read", "HIGH" if hard else "MEDIUM", "WARNING", "POTENTIAL", len(ctx.spec.unreadable), n_files=len(ctx.spec.unreadable))]
    rows = structural.corrupt_rates(ctx.df, SPLIT).collect()
    files, bad, unopened = (sum(r[c] for r in rows) for c in ("files", "corrupt", "uninspected"))
    if unopened == files:
        raise NoEvidence("no image was decoded")
    if not bad:
        return []
    evaluation = any(r["corrupt"] and canon.role_of(r["split"]) in ("val", "test") for r in rows)
    severity = "HIGH" if evaluation or (not unopened and bad / files >= 0.01) else "MEDIUM"
    return [finding("DD016", f"{bad} of {files} images are corrupt", severity, "FAIL" if evaluation else "INCONCLUSIVE" if unopened else "WARNING", "POTENTIAL", bad, by_split={r["split"]: r["corrupt"] for r in rows})]


@rule("DD017")
def _image_shift(ctx: Context) -> list[dict[str, Any]]:
    if not ctx.spec.images:
        raise NotApplicable("only images have properties", "UNSUPPORTED")
    df = ctx.df.where("not corrupt").withColumn("aspect_ratio", F.try_divide(F.col("width").cast("double"), F.col("height").cast("double")))
    present = [s for s in ctx.sizes if not df.where(F.col(SPLIT) == s).isEmpty()]
    if len(present) < 2:
        raise NoEvidence("fewer than two splits have decoded images")
    ref = ctx.reference() if ctx.reference() in present else min(present)
    out = []
    for target in sorted(s for s in present if s != ref):
        values = frames.unpivot(frames.sides(df, SPLIT, ref, target), distribution.IMAGE_PROPERTIES, ["side"], "number")
        rows = [r for r in metrics.moments(values, ["column"]).collect() if min(r["n_ref"], r["n_tgt"]) >= distribution.MIN_VALUES and (r["smd"] is None or abs(r["smd"]) >= 0.5)]
        if rows:
            worst = max(float("inf") if r["smd"] is None else abs(r["smd"]) for r in rows)
            out.append(finding("DD017", f"Image properties differ between {ref} and {target}", "MEDIUM" if worst >= 1.5 else "LOW", "WARNING", "POTENTIAL", ctx.sizes[target], ref, target, sorted(r["column"] for r in rows), smd={r["column"]: r["smd"] for r in rows}))
    return out


@rule("DD018", "DD019")
def _drift(ctx: Context) -> list[dict[str, Any]]:
    if ctx.spec.baseline is None:
        raise NotApplicable("no baseline version")
    if ctx.spec.incomparable:
        return [finding("DD018", "The baseline can't be compared", "MEDIUM", "INCONCLUSIVE", "NONE", why=ctx.spec.incomparable)]
    now = versions.snapshot(ctx.df, ctx.config.ids, SPLIT, ctx.label).persist()
    changes = versions.compare(ctx.spec.baseline, now).persist()
    try:
        n = {r["kind"]: r["n"] for r in versions.summary(changes).collect()}
        if not n:
            return []
        touched = sum(n.get(k, 0) for k in ("added", "removed", "modified"))
        samples = [r.asDict() for r in versions.listed(changes, 50).select("kind", "id_a", "id_b", "split_a", "split_b", "label_a", "label_b").collect()]
        out = [finding("DD018", "The dataset changed since the baseline", "MEDIUM" if touched / max(1, ctx.total) >= 0.05 else "LOW", "WARNING", "POTENTIAL", sum(n.values()), **n, samples=samples)]
        if n.get("moved"):
            into_test = not changes.where("kind = 'moved' and split_b = 'test'").isEmpty()
            out.append(finding("DD019", f"{n['moved']} samples changed their split", "CRITICAL" if into_test else "HIGH", "FAIL", "BLOCKING", n["moved"], into_test=into_test))
        if n.get("relabelled"):
            out.append(finding("DD019", f"{n['relabelled']} samples changed their label", "HIGH", "WARNING", "POTENTIAL", n["relabelled"]))
        return out
    finally:
        changes.unpersist()
        now.unpersist()


@rule("DD020")
def _provenance(ctx: Context) -> list[dict[str, Any]]:
    wanted = ("source", "version", "license", "download_date")
    have = [k for k in wanted if str(ctx.config.provenance.get(k) or "").strip()]
    if not have:
        return [finding("DD020", "No provenance is declared", "LOW", "WARNING", "NONE", missing=list(wanted))]
    return [finding("DD020", "Provenance is partly declared", "INFO", "PASS", "NONE", declared=have)] if len(have) < len(wanted) else []


@rule("DD021")
def _private(ctx: Context) -> list[dict[str, Any]]:
    found = structural.pii_rates(ctx.df, ctx.columns, SPLIT).where(F.col("ratio") >= ctx.block("DD021")["min_match_ratio"]).where("matches > 0").orderBy("split", "column", "pattern").collect() if ctx.columns else []
    first: dict[tuple[str, str], Any] = {}
    for r in found:
        first.setdefault((r["column"], r["pattern"]), r)
    return [finding("DD021", f"{r['column']} looks like {r['pattern']}", "MEDIUM", "WARNING", "NONE", r["matches"], r["split"], columns=[r["column"]], pattern=r["pattern"], ratio=r["ratio"]) for r in first.values()]


def audit(spark: SparkSession, spec: AuditSpec) -> Report:
    """Run every rule; a rule that can't answer says so, and never stops the others."""
    ctx = Context(spark, spec)
    # contents are digested once; other rules read their own columns, from the files where those hold columns apart
    ctx.digests = ctx.digests.persist()
    again = not spec.columnar
    if again:
        ctx.df = ctx.df.persist()
    findings, outcomes = [], []
    asked: dict[str, Future] = {}
    shared: dict[Callable, Future] = {}
    try:
        # rules don't depend on each other: their small jobs fill the cluster together
        with ThreadPoolExecutor(THREADS) as pool:
            for rule_id, meta in RULES.items():
                off = rule_id in policy.SWITCHABLE and not ctx.block(rule_id)["enabled"]
                if not off and (meta.images if spec.images else meta.tables):
                    run = RUN[rule_id]
                    if run not in shared:
                        shared[run] = pool.submit(inheritable_thread_target(spark)(_timed), run, ctx)
                    asked[rule_id] = shared[run]
        for rule_id, meta in RULES.items():
            found, reason, ms = [], None, 0
            if rule_id not in asked:
                status, reason = ("UNSUPPORTED", "not for this type of dataset") if not (meta.images if spec.images else meta.tables) else ("NOT_RUN", "switched off")
            else:
                try:
                    every, ms = asked[rule_id].result()
                    found = [policy.apply_severity(f, spec.config) for f in every if f["rule_id"] == rule_id]
                    status = policy.status_of(found)
                except NotApplicable as e:
                    status, reason = e.status, str(e)
                except NoEvidence as e:
                    status, reason = "INCONCLUSIVE", str(e)
                except Exception as e:  # a broken rule is a missing answer, which the verdict takes into account
                    status, reason = "INCONCLUSIVE", f"{type(e).__name__}: {str(e)[:200]}"
            if rule_id in spec.config.suppressions:
                found, status, reason = [], "SUPPRESSED", spec.config.suppressions[rule_id]
            for k, f in enumerate(found, 1):
                f["finding_id"] = f"{rule_id}-{k:04d}"
            findings += found
            outcomes.append({"rule_id": rule_id, "name": meta.name, "status": status, "findings": len(found), "highest": max((f["severity"] for f in found), key=rank, default=None), "reason": reason, "ms": ms})
        verdict, reasons = policy.verdict(findings, outcomes, ctx.total, spec.images)
        facts = next((f["evidence"] for f in findings if f["rule_id"] == "DD001"), None) or identity(ctx)
        return Report(verdict, reasons, findings, outcomes, facts)
    finally:
        ctx.digests.unpersist()
        if again:
            ctx.df.unpersist()


def _timed(run: Callable[[Context], list[dict[str, Any]]], ctx: Context) -> tuple[list[dict[str, Any]], int]:
    began = time.time()
    return run(ctx), int(1000 * (time.time() - began))
