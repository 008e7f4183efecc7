"""The rules: what each is called, and what its findings can mean for a formal evaluation."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
ASSERTIVE = ("FAIL", "WARNING")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    policy: str
    category: str
    severity: str
    impact: str
    evidence: str
    images: bool = True
    tables: bool = True
    why: str = ""
    fix: str = ""


#: Id, name, policy block, category, default severity, formal impact, kind of evidence.
RULES = {
    r.id: r
    for r in (
        Rule("DD001", "Dataset Identity", "dataset_identity", "IDENTITY", "INFO", "NONE", "DETERMINISTIC",
             why="A result can only be compared with another one if both are known to come from the same version of the data.",
             fix="Keep the manifest hash beside every reported score."),
        Rule("DD002", "Split Integrity", "split_integrity", "SPLIT_INTEGRITY", "HIGH", "BLOCKING", "DETERMINISTIC",
             why="Without two separate, filled splits there is no evaluation to speak of.",
             fix="Declare each split once, with its own files, and name the one that is tested on."),
        Rule("DD003", "Exact Duplicate", "exact_duplicate", "DUPLICATE", "CRITICAL", "BLOCKING", "DETERMINISTIC",
             why="A test sample that was trained on measures memory.",
             fix="Keep one of each group of copies, on one side; `split --dedupe` does both."),
        Rule("DD004", "Near Duplicate", "near_duplicate", "DUPLICATE", "HIGH", "POTENTIAL", "HEURISTIC", tables=False,
             why="Edited or re-encoded copies leak nearly as much as equal ones, and no checksum shows them.",
             fix="Look at the closest pairs; put copies of one picture on one side."),
        Rule("DD005", "Group / Entity Leakage", "group_leakage", "LEAKAGE", "CRITICAL", "BLOCKING", "DETERMINISTIC",
             why="Rows of one person or device resemble each other; if both sides have them, the score says little about new ones.",
             fix="Split again by the entity: `split --group COLUMN`."),
        Rule("DD006", "Temporal Leakage", "temporal_leakage", "LEAKAGE", "HIGH", "BLOCKING", "DETERMINISTIC",
             why="A model that has seen the time it is tested on was told about the future.",
             fix="Cut the splits at a date, with training before it."),
        Rule("DD007", "Target Leakage", "target_leakage", "LEAKAGE", "CRITICAL", "BLOCKING", "DETERMINISTIC", images=False,
             why="A column that gives the label away will not be there when the model is used.",
             fix="Find out when the column is filled; drop it if that is after the label."),
        Rule("DD008", "Identifier / Feature Leakage", "identifier_leakage", "LEAKAGE", "MEDIUM", "POTENTIAL", "HEURISTIC", images=False,
             why="A column with a value for each row invites a model to learn rows by heart.",
             fix="Declare it under id_columns, or leave it out of the features."),
        Rule("DD009", "Label Conflict", "label_conflict", "LABEL", "CRITICAL", "BLOCKING", "DETERMINISTIC",
             why="Where equal inputs carry different labels no model can be right about all of them.",
             fix="Settle the label of each group; spellings of one label need a common form."),
        Rule("DD010", "Missing Labels", "missing_labels", "LABEL", "MEDIUM", "POTENTIAL", "DETERMINISTIC",
             why="Rows without label are left out silently and change what the score is about.",
             fix="Label them, or take them out and say so."),
        Rule("DD011", "Class Imbalance", "class_imbalance", "DISTRIBUTION", "LOW", "POTENTIAL", "STATISTICAL",
             why="With rare classes a constant answer can look accurate.",
             fix="Report scores by class; suppress the rule with a reason if rarity is the point."),
        Rule("DD012", "Feature / Distribution Shift", "feature_shift", "DISTRIBUTION", "MEDIUM", "POTENTIAL", "STATISTICAL", images=False,
             why="A test split of another kind measures transfer, which may not be what was meant.",
             fix="Look at the columns that moved most; draw the splits again or state the shift."),
        Rule("DD013", "Label Distribution Shift", "label_shift", "DISTRIBUTION", "MEDIUM", "POTENTIAL", "STATISTICAL",
             why="Thresholds and averages tuned on one class mix do not carry over to another.",
             fix="Stratify by the label, or report scores that do not depend on the mix."),
        Rule("DD014", "Schema Drift", "schema_drift", "SCHEMA", "HIGH", "BLOCKING", "DETERMINISTIC", images=False,
             why="Columns that differ between splits are filled in or dropped somewhere, unseen.",
             fix="Give all splits the same columns and types; fit encoders on training levels only."),
        Rule("DD015", "Missingness Shift", "missingness_shift", "SCHEMA", "MEDIUM", "POTENTIAL", "STATISTICAL", images=False,
             why="Values that are missing on one side only hint at another way of collecting them.",
             fix="Compare how the splits were collected."),
        Rule("DD016", "Corrupt Sample", "corrupt_sample", "INTEGRITY", "HIGH", "POTENTIAL", "DETERMINISTIC",
             why="Samples that cannot be read are skipped, and the evaluation shrinks without saying so.",
             fix="Replace them or take them out of the split."),
        Rule("DD017", "Image Property Shift", "image_property_shift", "DISTRIBUTION", "LOW", "POTENTIAL", "STATISTICAL", tables=False,
             why="Size, brightness and contrast can tell splits or sources apart without any content.",
             fix="Compare cameras and preprocessing of the splits."),
        Rule("DD018", "Version Drift", "version_drift", "VERSIONING", "MEDIUM", "POTENTIAL", "DETERMINISTIC",
             why="Scores before and after a change of the data are not about the same thing.",
             fix="Publish the change with the score, or go back to the baseline."),
        Rule("DD019", "Split Drift", "split_drift", "VERSIONING", "CRITICAL", "BLOCKING", "DETERMINISTIC",
             why="A sample that moves into the test split may have been trained on before.",
             fix="Keep the splits of the baseline, or train again from nothing."),
        Rule("DD020", "Dataset Provenance", "provenance", "PROVENANCE", "LOW", "NONE", "DETERMINISTIC",
             why="Without source and licence nobody can get, or use, the same data again.",
             fix="Fill in source, version, license and download_date."),
        Rule("DD021", "PII Exposure", "pii_scan", "PRIVACY", "MEDIUM", "NONE", "HEURISTIC", images=False,
             why="Personal data in a shared dataset is a matter of law before it is one of scores.",
             fix="Check the column; mask or drop it before sharing."),
    )
}
#: Rules whose missing answer keeps a verdict from being safe.
CORE = {"DD001", "DD002", "DD003", "DD005", "DD009", "DD011", "DD012", "DD014", "DD016", "DD018", "DD019"}
GATING = {"LEAKAGE", "DUPLICATE", "SPLIT_INTEGRITY"}
#: Policy blocks without a rule of their own.
OTHER_POLICIES = {"entity_leakage", "label_cardinality", "category_drift", "outlier"}


def rank(severity: str) -> int:
    return SEVERITIES.index(severity)
