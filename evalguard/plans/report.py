"""Reports of an audit as JSON, Markdown and HTML, and the order in which to work its findings."""

from __future__ import annotations

import html
import json
import os
import tempfile
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from evalguard.plans.engine import Report
from evalguard.plans.registry import RULES, rank

#: The kinds of repair in the order to do them, and the rules of each.
STEPS = {
    "declare": ("DD020",), "remove": ("DD016",), "deduplicate": ("DD003", "DD004"), "resplit": ("DD005", "DD006", "DD009"),
    "review": ("DD002", "DD007", "DD008", "DD014", "DD018", "DD019", "DD021"), "recalibrate": ("DD010", "DD011", "DD012", "DD013", "DD015", "DD017"), "verify": (),
}
ACTIONS = {
    "declare": "State where the data comes from and under which licence.", "remove": "Leave out or replace samples that can't be read.", "deduplicate": "Keep one of each group of equal or similar samples.",
    "resplit": "Split again so that entities, contents and time stay on one side.", "review": "Look at the columns and changes named and decide on each.", "recalibrate": "Account for the shift, or draw the splits again.",
    "verify": "Audit the new version and compare it with this one.",
}

METHOD = (
    "Contents are compared by SHA-256 of canonical cells or of file bytes; counts are exact, lists are a top-k.",
    "Distances use the training split as reference; quantiles are exact, PSI bins are the reference's deciles.",
    "A finding asserts something only with status FAIL or WARNING; what could not be measured is INCONCLUSIVE and never counts as a pass.",
    "The verdict is a fixed sequence of rules over findings and outcomes, not a score.",
)
LIMITS = (
    "Copies that differ in any cell are no exact duplicates; near duplicates are sought among images only.",
    "Entities are as good as the declared column; undeclared ones are not guessed.",
    "Single-feature prediction and personal-data patterns are heuristics and need a look.",
)


def repair_plan(report: Report) -> list[dict[str, Any]]:
    """Steps in order; none of them touches the dataset in place."""
    out = []
    for kind, rules in STEPS.items():
        found = [f for f in report.findings if f["rule_id"] in rules and not (f["severity"] == "INFO" and f["status"] == "PASS")]
        if found or kind == "verify":
            out.append({"step": len(out) + 1, "kind": kind, "action": ACTIONS[kind], "rules": sorted({f["rule_id"] for f in found}), "findings": [f["finding_id"] for f in found]})
    return out


def as_dict(report: Report) -> dict[str, Any]:
    return {
        "generated_at": datetime.now(UTC).replace(microsecond=0).isoformat(), "verdict": report.verdict, "reasons": report.reasons, "identity": report.identity, "summary": report.summary(),
        "outcomes": report.outcomes, "coverage": coverage(report), "findings": [f | {"why": RULES[f["rule_id"]].why, "fix": RULES[f["rule_id"]].fix} for f in report.findings], "repair_plan": repair_plan(report), "methodology": METHOD, "limitations": LIMITS,
    }


def _ordered(report: Report) -> list[dict[str, Any]]:
    return sorted(report.findings, key=lambda f: (-rank(f["severity"]), f["finding_id"]))


def coverage(report: Report) -> dict[str, list[str]]:
    """Rules by what became of them."""
    groups = {"answered": ("PASS", "WARNING", "FAIL"), "without evidence": ("INCONCLUSIVE",), "not asked": ("NOT_RUN", "UNSUPPORTED"), "suppressed": ("SUPPRESSED",)}
    return {name: [o["rule_id"] for o in report.outcomes if o["status"] in states] for name, states in groups.items()}


def evidence_lines(value: Any, name: str = "", most: int = 20) -> list[str]:
    """Evidence as short lines: a list of rows becomes one line a row."""
    if isinstance(value, dict):
        flat = {k: v for k, v in value.items() if not isinstance(v, (dict, list, tuple))}
        out = [f"{name}: " * bool(name) + ", ".join(f"{k} {_plain(v)}" for k, v in flat.items())] if flat else []
        for k, v in value.items():
            if k not in flat:
                out += evidence_lines(v, k, most)
        return out
    if isinstance(value, (list, tuple)):
        out = [f"{name}:"] if value else []
        for x in value[:most]:
            out.append("  " + (", ".join(f"{k} {_plain(v)}" for k, v in x.items()) if isinstance(x, dict) else _plain(x)))
        return out + ([f"  and {len(value) - most} more"] if len(value) > most else [])
    return [f"{name} {_plain(value)}"]


def _plain(x: Any) -> str:
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return " ".join(map(_plain, x))
    return str(x)


def _facts(report: Report) -> list[tuple[str, str]]:
    i = report.identity
    out = [("samples", str(i["num_samples"])), ("splits", ", ".join(f"{k} {v}" for k, v in i["split_sizes"].items())), ("version", i["manifest_hash"]), ("configuration", i["config_hash"]), ("type", i["dataset_type"])]
    if i.get("class_counts"):
        top = sorted(i["class_counts"].items(), key=lambda x: (-x[1], x[0]))
        out.append(("classes", ", ".join(f"{k} {v}" for k, v in top[:20]) + (f" and {len(top) - 20} more" if len(top) > 20 else "")))
    if i.get("schema"):
        out.append(("columns", ", ".join(f"{k} {v}" for k, v in list(i["schema"].items())[:50])))
    return out


def _scope(f: dict[str, Any]) -> str:
    where = " against ".join(x for x in (f["source_split"], f["target_split"]) if x)
    return ", ".join(x for x in (where, f"columns {', '.join(f['columns'][:20])}" if f["columns"] else "") if x)


def markdown(report: Report) -> str:
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# Audit: {report.verdict}", "", *(f"- {r}" for r in report.reasons), "", f"{report.identity['num_samples']} samples in {len(report.identity['split_sizes'])} splits, version {report.identity['manifest_hash']}.", ""]
    lines += ["| | |", "| --- | --- |", *(f"| {k} | {cell(v)} |" for k, v in _facts(report)), ""]
    lines += ["| finding | severity | status | impact | what | affected |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {f['finding_id']} | {f['severity']} | {f['status']} | {f['formal_impact']} | {cell(f['title'])} | {f['affected_count']} |" for f in _ordered(report)]
    for f in (f for f in _ordered(report) if f["status"] != "PASS"):
        rule = RULES[f["rule_id"]]
        lines += ["", f"## {f['finding_id']} {f['title']}", "", f"{rule.name}, {f['severity']} {f['status']}, {f['evidence_type'].lower()} evidence, {f['affected_count']} samples" + (f", {_scope(f)}" if _scope(f) else "") + "."]
        lines += ["", rule.why, "", f"What to do: {rule.fix}"]
        if shown := evidence_lines(f["evidence"]):
            lines += ["", "```", *shown, "```"]
    lines += ["", "## Rules", "", "| rule | name | status | findings | ms | reason |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {o['rule_id']} | {o['name']} | {o['status']} | {o['findings']} | {o['ms']} | {cell(o['reason'] or '')} |" for o in report.outcomes]
    lines += ["", *(f"- {name}: {', '.join(rules) or 'none'}" for name, rules in coverage(report).items())]
    lines += ["", "## Repair", "", *(f"{s['step']}. {s['action']} ({', '.join(s['findings']) or 'always'})" for s in repair_plan(report)), "", "## Method", "", *(f"- {x}" for x in METHOD), "", "## Limits", "", *(f"- {x}" for x in LIMITS)]
    return "\n".join(lines) + "\n"


STYLE = "body{font-family:sans-serif;margin:2em auto;max-width:70em}td,th{vertical-align:top;text-align:left;padding:.3em .6em;border-top:1px solid #ccc}pre{background:#f6f6f6;padding:.6em;overflow:auto}.CRITICAL,.HIGH{color:#a00}.MEDIUM{color:#a60}section{margin:1.5em 0}"


def page(report: Report) -> str:
    e = lambda x: html.escape(str(x))
    row = lambda *x: "<tr>" + "".join(f"<td>{e(v)}</td>" for v in x) + "</tr>"
    facts = "".join(row(k, v) for k, v in _facts(report))
    index = "".join(f"<tr><td><a href='#{e(f['finding_id'])}'>{e(f['finding_id'])}</a></td><td class={e(f['severity'])}>{e(f['severity'])}</td><td>{e(f['status'])}</td><td>{e(f['formal_impact'])}</td><td>{e(f['title'])}</td><td>{f['affected_count']}</td></tr>" for f in _ordered(report))
    details = "".join(
        f"<section id='{e(f['finding_id'])}'><h3 class={e(f['severity'])}>{e(f['finding_id'])} {e(f['title'])}</h3><p>{e(RULES[f['rule_id']].name)}, {e(f['severity'])} {e(f['status'])}, {f['affected_count']} samples {e(_scope(f))}</p>"
        f"<p>{e(RULES[f['rule_id']].why)}</p><p><b>What to do:</b> {e(RULES[f['rule_id']].fix)}</p><pre>{e(chr(10).join(evidence_lines(f['evidence'])))}</pre></section>"
        for f in _ordered(report) if f["status"] != "PASS"
    )
    rules = "".join(row(o["rule_id"], o["name"], o["status"], o["findings"], o["ms"], o["reason"] or "") for o in report.outcomes)
    covered = "".join(f"<li>{e(name)}: {e(', '.join(x) or 'none')}</li>" for name, x in coverage(report).items())
    steps = "".join(f"<li>{e(s['action'])} {e(', '.join(s['findings']))}</li>" for s in repair_plan(report))
    notes = "".join(f"<li>{e(x)}</li>" for x in (*METHOD, *LIMITS))
    return (
        f"<!doctype html><meta charset=utf-8><title>Audit: {e(report.verdict)}</title><style>{STYLE}</style><h1>{e(report.verdict)}</h1><ul>{''.join(f'<li>{e(r)}</li>' for r in report.reasons)}</ul><table>{facts}</table>"
        f"<h2>Findings</h2><table><tr><th>finding</th><th>severity</th><th>status</th><th>impact</th><th>what</th><th>affected</th></tr>{index}</table>{details}"
        f"<h2>Rules</h2><table>{rules}</table><ul>{covered}</ul><h2>Repair</h2><ol>{steps}</ol><h2>Method and limits</h2><ul>{notes}</ul>"
    )


def write(path: str | Path, text: str) -> None:
    """Write a file whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_all(report: Report, folder: str | Path) -> None:
    write(Path(folder) / "report.json", json.dumps(as_dict(report), indent=1, default=str))
    write(Path(folder) / "report.md", markdown(report))
    write(Path(folder) / "report.html", page(report))


def render(data: dict[str, Any], form: str) -> str:
    """A saved JSON report in another form."""
    report = Report(data["verdict"], data["reasons"], data["findings"], data["outcomes"], data["identity"])
    return {"md": markdown, "html": page, "json": lambda r: json.dumps(data, indent=1)}[form](report)


def rules_table() -> str:
    return "\n".join(f"{r.id}  {r.severity:<8}  {r.impact:<9}  {r.evidence:<13}  {r.name}" for r in RULES.values())
