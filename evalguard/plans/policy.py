"""Configuration, presets, severities, the verdict and the exit code: driver-side algebra over a few rows."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from evalguard.plans.registry import ASSERTIVE, CORE, GATING, OTHER_POLICIES, RULES, SEVERITIES, rank

SAFE, RISKY, INVALID, UNKNOWN = "FORMAL_EVAL_SAFE", "FORMAL_EVAL_RISKY", "FORMAL_EVAL_INVALID", "INCONCLUSIVE"
#: Presets change severities and switches, never a measurement.
PRESETS: dict[str, dict[str, Any]] = {
    "standard": {},
    "research": {"near_duplicate": {"enabled": True}, "outlier": {"enabled": False}},
    "medical": {"group_leakage": {"enabled": True, "severity": "CRITICAL"}, "pii_scan": {"enabled": True}, "temporal_leakage": {"enabled": True}},
    "vision": {"near_duplicate": {"enabled": True, "hamming_threshold": 6}, "image_property_shift": {"enabled": True}},
    "time_series": {"temporal_leakage": {"enabled": True, "severity": "CRITICAL"}, "feature_shift": {"enabled": True}},
}
ALIASES = {"class imbalance": "class_imbalance", "distribution_shift": "feature_shift", "duplicate": "exact_duplicate", "entity_leak": "group_leakage"}
#: Rules that ``enabled: false`` switches off.
SWITCHABLE = {"DD004", "DD006", "DD011", "DD012", "DD013", "DD014", "DD015", "DD017", "DD021"}
DEFAULTS: dict[str, dict[str, Any]] = {
    "near_duplicate": {"hamming_threshold": 6}, "temporal_leakage": {"train_before_test": True},
    "target_leakage": {"heuristic": True, "min_single_feature_auc": 0.95, "min_normalized_mutual_info": 0.6}, "identifier_leakage": {"unique_ratio": 0.98},
    "class_imbalance": {"max_imbalance_ratio": 20, "min_minority_ratio": 0.02}, "label_shift": {"min_tv_distance": 0.05},
    "feature_shift": {"min_std_mean_diff": 0.2, "min_psi": 0.2, "fdr_alpha": 0.05}, "missingness_shift": {"min_rate_delta": 0.1}, "pii_scan": {"min_match_ratio": 0.05},
}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass
class Config:
    preset: str = "standard"
    splits: dict[str, str] = field(default_factory=dict)
    label: str | None = None
    groups: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    temporal: str | None = None
    split_column: str | None = None
    dataset_type: str = "auto"
    policies: dict[str, dict[str, Any]] = field(default_factory=dict)
    suppressions: dict[str, str] = field(default_factory=dict)
    provenance: dict[str, str] = field(default_factory=dict)
    sampling: tuple[float, int] | None = None
    warnings: list[str] = field(default_factory=list)

    def policy(self, name: str) -> dict[str, Any]:
        return {"enabled": True, "severity": None} | DEFAULTS.get(name, {}) | PRESETS[self.preset].get(name, {}) | self.policies.get(name, {})

    def hash(self) -> str:
        text = json.dumps({k: v for k, v in vars(self).items() if k != "warnings"}, sort_keys=True, default=str)
        return "cfg_" + hashlib.sha256(text.encode()).hexdigest()[:16]

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Config:
        preset = str(raw.get("preset", "standard"))
        if preset not in PRESETS:
            raise ConfigError(f"unknown preset {preset}; there are {', '.join(sorted(PRESETS))}")
        known = {r.policy for r in RULES.values()} | OTHER_POLICIES
        policies, warnings = {}, []
        for key, block in (raw.get("policies") or {}).items():
            name = ALIASES.get(key, key)
            if name not in known:
                warnings.append(f"policy {key} is unknown and ignored")
                continue
            block = dict(block or {})
            if block.get("severity") is not None:
                block["severity"] = str(block["severity"]).upper()
                if block["severity"] not in SEVERITIES:
                    raise ConfigError(f"policy {key}: no severity {block['severity']}")
            policies[name] = block
        suppressed = {}
        for s in raw.get("suppressions") or []:
            if not re.fullmatch(r"DD\d{3}", str(s.get("rule", ""))) or not str(s.get("reason", "")).strip():
                raise ConfigError("a suppression needs a rule DDnnn and a reason")
            suppressed[s["rule"]] = s["reason"]
        groups = raw.get("groups") or {}
        columns = groups if isinstance(groups, list) else groups.get("columns") or ([groups["column"]] if groups.get("column") else [])
        temporal, sampling = raw.get("temporal") or {}, raw.get("sampling") or {}
        fraction = float(sampling.get("fraction", 1.0))
        if not 0 < fraction <= 1:
            raise ConfigError("sampling.fraction must be in (0, 1]")
        return cls(
            preset, {str(k): str(v) for k, v in (raw.get("splits") or {}).items()}, (raw.get("labels") or {}).get("column"), [str(c) for c in columns], [str(c) for c in raw.get("id_columns") or []],
            temporal.get("column"), temporal.get("split_column"), (raw.get("dataset") or {}).get("type", "auto"), policies, suppressed, dict(raw.get("provenance") or {}),
            (fraction, int(sampling.get("seed", 1337))) if sampling.get("enabled") else None, warnings,
        )

    @classmethod
    def load(cls, path: str | Path) -> Config:
        import yaml

        try:
            raw = yaml.safe_load(Path(path).read_text()) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{path} is no YAML: {e}") from e
        if not isinstance(raw, dict):
            raise ConfigError(f"{path} holds no mapping")
        return cls.of(raw)


def apply_severity(finding: dict[str, Any], config: Config) -> dict[str, Any]:
    """The policy's severity; findings within one split have a knob of their own."""
    block = config.policy(RULES[finding["rule_id"]].policy)
    wanted = block.get("within_split_severity") if finding["metadata"].get("scope") == "within_split" else block.get("severity")
    if wanted and wanted != finding["severity"]:
        return finding | {"severity": wanted, "metadata": finding["metadata"] | {"severity_source": "policy", "default_severity": finding["severity"]}}
    return finding


def status_of(findings: list[dict[str, Any]]) -> str:
    found = {f["status"] for f in findings}
    return next((s for s in ("FAIL", "INCONCLUSIVE", "WARNING") if s in found), "PASS")


def verdict(findings: list[dict[str, Any]], outcomes: list[dict[str, Any]], samples: int, images: bool = False) -> tuple[str, list[str]]:
    """One of four values and its reasons. Only findings that assert something can make a dataset invalid or risky."""
    say = lambda f: f"{f['rule_id']} {f['title']}: {f['affected_count']} samples, {f['severity']} {f['status']}"
    asserted = [f for f in findings if f["status"] in ASSERTIVE]
    if blocking := [f for f in asserted if f["formal_impact"] == "BLOCKING"]:
        return INVALID, [say(f) for f in blocking[:8]]
    if not samples:
        return UNKNOWN, ["there are no samples"]
    if risky := [f for f in asserted if f["formal_impact"] != "NONE" and rank(f["severity"]) >= rank("MEDIUM")]:
        return RISKY, [say(f) for f in risky[:8]]
    open_ = [o for o in outcomes if o["status"] == "INCONCLUSIVE"]
    unasked = [o for o in outcomes if o["status"] in ("NOT_RUN", "UNSUPPORTED")]
    rules = {o["rule_id"]: RULES[o["rule_id"]] for o in outcomes}
    gaps = [o for o in outcomes if o["status"] in ("INCONCLUSIVE", "UNSUPPORTED") and o["rule_id"] in CORE and rules[o["rule_id"]].category in GATING and (rules[o["rule_id"]].images if images else rules[o["rule_id"]].tables)]
    unproven = [f for f in findings if f["formal_impact"] == "BLOCKING" and f["status"] not in ASSERTIVE]
    if gaps or unproven:
        return UNKNOWN, [f"{o['rule_id']} could not be measured: {o['reason'] or 'no evidence'}" for o in gaps] + [say(f) for f in unproven[:8]]
    if len(open_) >= max(3, len(outcomes) // 3):
        return UNKNOWN, [f"{len(open_)} of {len(outcomes)} rules have no answer: {', '.join(sorted(o['rule_id'] for o in open_))}"]
    if open_ or unasked:
        return SAFE, [f"not covered: {', '.join(sorted(o['rule_id'] for o in open_ + unasked))}"]
    return SAFE, []


def exit_code(verdict_: str, findings: list[dict[str, Any]], outcomes: list[dict[str, Any]], ci: bool = False, strict: bool = False, fail_on: str | None = None) -> int:
    """0 or 1. ``fail_on`` replaces the ladder: a severity, or 'never'."""
    if fail_on:
        return 0 if fail_on.lower() == "never" else int(any(rank(f["severity"]) >= rank(fail_on.upper()) and f["status"] != "PASS" for f in findings))
    asserted = [f for f in findings if f["status"] in ASSERTIVE]
    if any(f["formal_impact"] == "BLOCKING" or f["severity"] == "CRITICAL" for f in asserted):
        return 1
    if (ci or strict) and (verdict_ != SAFE or any(rank(f["severity"]) >= rank("MEDIUM") for f in asserted)):
        return 1
    return int(strict and any(o["status"] == "INCONCLUSIVE" for o in outcomes))
