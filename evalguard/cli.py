"""Command line: audit, scan, fingerprint, snapshot, diff, split, report, show, rules, init, demo."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from evalguard import api
from evalguard.api import CONFIG_NAME
from evalguard.plans import engine, report
from evalguard.plans.policy import PRESETS, ConfigError, exit_code
from evalguard.sources import discovery, tables

TEMPLATE = """# evalguard
preset: standard
dataset:
  type: auto
# splits: {train: train.csv, test: test.csv}
# labels: {column: target}
# groups: {columns: [patient_id]}
# id_columns: [record_id]
# temporal: {column: collected_at, split_column: split}
# policies: {exact_duplicate: {severity: CRITICAL}}
# suppressions: [{rule: DD008, reason: ids are expected here}]
# provenance: {source: where from, license: which}
"""


def session() -> SparkSession:
    return SparkSession.builder.appName("evalguard").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _spec(args: argparse.Namespace, spark: SparkSession) -> engine.AuditSpec:
    config = api.config_for(args.path, args.config)
    for name, key in (("label", "label"), ("temporal", "temporal"), ("split_column", "split_column")):
        if getattr(args, name, None):
            setattr(config, key, getattr(args, name))
    config.groups = args.group or config.groups
    config.ids = args.id or config.ids
    if getattr(args, "preset", None):
        config.preset = args.preset
    return discovery.open_dataset(spark, args.path, config)


def parse_ratios(text: str) -> dict[str, float]:
    """train=0.7,val=0.1,test=0.2 or 70/10/20."""
    try:
        if "=" in text:
            return {k.strip(): float(v) for k, v in (x.split("=") for x in text.split(","))}
        parts = [float(x) for x in text.replace(":", "/").split("/")]
        return dict(zip(("train", "val", "test") if len(parts) == 3 else ("train", "test"), parts, strict=True))
    except ValueError as e:
        raise ConfigError(f"no ratios: {text}") from e


def demo(spark: SparkSession, folder: str) -> None:
    """A small clinical table with planted leaks, as train.csv and test.csv."""
    rows = [(f"r{i:05d}", f"p{i // 4:03d}", 40 + i % 20, "MF"[i // 2 % 2], round(20 + (i * 0.618) % 10, 4), i % 2) for i in range(240)]
    names = ["record_id", "patient_id", "age", "sex", "bmi", "target"]
    for name, part in (("train", rows[:180]), ("test", [*rows[180:], *rows[:5]])):
        text = ",".join(names) + "\n" + "".join(",".join(map(str, r)) + "\n" for r in part)
        report.write(Path(folder) / f"{name}.csv", text)
    report.write(Path(folder) / CONFIG_NAME, "labels: {column: target}\ngroups: {columns: [patient_id]}\nid_columns: [record_id]\n")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evalguard", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("audit", "scan", "fingerprint", "snapshot", "split"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--config")
        s.add_argument("--label")
        s.add_argument("--group", action="append")
        s.add_argument("--id", action="append")
        s.add_argument("--temporal")
        s.add_argument("--split-column", dest="split_column")
        s.add_argument("--preset", choices=sorted(PRESETS))
        s.add_argument("--out")
    a = sub.choices["audit"]
    a.add_argument("--ci", action="store_true")
    a.add_argument("--strict", action="store_true")
    a.add_argument("--fail-on", dest="fail_on")
    a.add_argument("--baseline")
    x = sub.choices["split"]
    x.add_argument("--ratios", default="70/10/20")
    x.add_argument("--seed", type=int, default=1337)
    x.add_argument("--dedupe", action="store_true")
    x.add_argument("--format")
    x.add_argument("--entity-from", dest="entity_from", help="a pattern that finds an image's entity in its path")
    f = sub.choices["fingerprint"]
    f.add_argument("--mode", choices=("full", "sampled", "metadata"), default="full")
    f.add_argument("--fraction", type=float, default=1.0)
    f.add_argument("--seed", type=int, default=1337)
    sub.choices["snapshot"].add_argument("--audited", action="store_true")
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--config")
    d.add_argument("--out")
    r = sub.add_parser("report")
    r.add_argument("path")
    r.add_argument("--form", default="md", choices=("md", "html", "json"))
    w = sub.add_parser("show")
    w.add_argument("path")
    w.add_argument("finding", nargs="?")
    sub.add_parser("rules")
    for name in ("init", "demo"):
        sub.add_parser(name).add_argument("path", nargs="?", default=".")
    return p


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "rules":
        print(report.rules_table())
        return 0
    if args.command == "init":
        target = Path(args.path) / CONFIG_NAME
        if target.exists():
            raise ConfigError(f"{target} exists")
        report.write(target, TEMPLATE)
        return 0
    if args.command == "report":
        print(report.render(json.loads(Path(args.path).read_text()), args.form))
        return 0
    if args.command == "show":
        print(show(args.path, args.finding))
        return 0
    spark = session()
    if args.command == "demo":
        demo(spark, args.path)
        return 0
    if args.command == "diff":
        found = api.diff(spark, args.old, args.new, args.config)
        if not found["comparable"]:
            print(f"not comparable: {found['reason']}")
            return 2
        if args.out:
            report.write(Path(args.out), json.dumps(found, indent=1, default=str))
        print(json.dumps(found["counts"]))
        for kind, rows in found["findings"].items():
            for r in rows:
                print(f"{kind}: {' '.join(str(x) for x in r if x)}")
        return int(any(r["kind"] == "moved" and r["into_test"] for r in found["counts"]))
    spec = _spec(args, spark)
    if args.command == "split":
        if not args.out:
            raise ConfigError("--out is needed")
        print(json.dumps(api.split(spark, args.path, spec, args.out, parse_ratios(args.ratios), args.group[0] if args.group else None, args.seed, args.dedupe, args.format, args.entity_from)))
        return 0
    if args.command == "audit":
        found = api.audit(spark, spec, args.baseline, args.config)
        if args.out:
            report.write_all(found, args.out)
        print(report.markdown(found))
        return exit_code(found.verdict, found.findings, found.outcomes, args.ci, args.strict, args.fail_on)
    if args.command == "snapshot":
        if not args.out:
            raise ConfigError("--out is needed")
        api.snapshot(spark, spec, args.out, args.audited)
        return 0
    facts = api.scan(spark, spec) if args.command == "scan" else api.fingerprint(spark, spec, args.out, args.mode, args.fraction, args.seed)
    print(json.dumps(facts, indent=1, default=str))
    return 0


def show(path: str, finding: str | None) -> str:
    """One finding of a saved report in full, or the list of them."""
    data = json.loads(Path(path).read_text())
    if finding is None:
        return "\n".join(f"{f['finding_id']}  {f['severity']:<8}  {f['status']:<12}  {f['title']}" for f in data["findings"])
    found = [f for f in data["findings"] if f["finding_id"] == finding or f["rule_id"] == finding]
    if not found:
        raise ConfigError(f"there is no finding {finding}")
    return json.dumps(found, indent=1)


def main() -> None:
    try:
        code = run()
    except (ConfigError, tables.Unreadable) as e:
        print(f"error: {e}", file=sys.stderr)
        code = 2
    except KeyboardInterrupt:
        code = 130
    except Exception as e:  # anything else is a fault of this program
        print(f"internal error: {type(e).__name__}: {e}", file=sys.stderr)
        code = 3
    sys.exit(code)


if __name__ == "__main__":
    main()
