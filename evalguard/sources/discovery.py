"""Where the splits of a dataset are: declared, in a column, in directories or in files named after them."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalguard.functions import canon
from evalguard.plans.engine import SPLIT, AuditSpec
from evalguard.plans.policy import Config, ConfigError
from evalguard.sources import images, tables

#: Names that are never data.
IGNORED = (".git", ".venv", "venv", "env", "node_modules", "__pycache__", ".ipynb_checkpoints", ".DS_Store", "Thumbs.db", "*.tmp", "*.part", "*.partial", "desktop.ini")
#: Column names of a split in a single file, in order.
SPLIT_COLUMNS = ("split", "set", "partition", "fold", "usage")


@dataclass
class Entry:
    path: str
    name: str
    is_dir: bool


@dataclass
class Layout:
    splits: dict[str, str] = field(default_factory=dict)
    single: str | None = None
    notes: list[str] = field(default_factory=list)


def listing(spark: SparkSession, path: str) -> list[Entry]:
    """A directory's entries that may be data, through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ConfigError(f"{path} does not exist")
    found = [Entry(s.getPath().toString(), s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)]
    return sorted((e for e in found if not ignored(e.name)), key=lambda e: e.name)


def is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ConfigError(f"{path} does not exist")
    return fs.getFileStatus(p).isDirectory()


def ignored(name: str) -> bool:
    return name.startswith((".", "_")) or any(fnmatch.fnmatch(name, p) for p in IGNORED)


def _written_by_spark(e: Entry) -> bool:
    return e.is_dir and tables.suffix(e.name) in tables.SUFFIXES


def _is_table(e: Entry) -> bool:
    return (not e.is_dir or _written_by_spark(e)) and tables.suffix(e.name) in tables.SUFFIXES


def layout(spark: SparkSession, root: str, config: Config, depth: int = 0) -> Layout:
    """Declared splits; a single file; directories, then files named as splits; a few directories of tables; one wrapper; all in one."""
    if config.splits:
        return Layout({k: v if "://" in v or v.startswith("/") else f"{root.rstrip('/')}/{v}" for k, v in config.splits.items()})
    if not is_dir(spark, root) or tables.suffix(root) in tables.SUFFIXES:
        return Layout(single=root)
    entries = listing(spark, root)
    dirs = [e for e in entries if e.is_dir and not _written_by_spark(e)]
    files = [e for e in entries if _is_table(e)]
    out = Layout()
    for e in dirs:
        if canon.role_of(e.name) != "unknown":
            out.splits[canon.role_of(e.name)] = e.path
    for e in files:
        role = canon.role_of(e.name.split(".")[0])
        if role != "unknown":
            if role in out.splits:
                out.notes.append(f"{e.name} is left out: the directory of that name wins")
            else:
                out.splits[role] = e.path
    if out.splits:
        return out
    if len(files) == 1 and not dirs:
        return Layout(single=files[0].path)
    holding = [e for e in dirs if any(_is_table(x) for x in listing(spark, e.path))]
    if holding and len(holding) <= 6 and not files:
        return Layout({e.name: e.path for e in holding})
    if len(dirs) == 1 and not files and depth < 3:
        return layout(spark, dirs[0].path, config, depth + 1)
    return Layout({"all": root})


def files_of(spark: SparkSession, path: str) -> list[str]:
    if not is_dir(spark, path) or tables.suffix(path) in tables.SUFFIXES:
        return [path]
    return [e.path for e in listing(spark, path) if _is_table(e)]


def has_images(spark: SparkSession, path: str, limit: int = 8, depth: int = 0) -> bool:
    """Whether a directory holds more images than tables, among the first entries of each level."""
    if not is_dir(spark, path):
        return False
    entries = listing(spark, path)
    pictures = sum(tables.suffix(e.name) in images.SUFFIXES for e in entries if not e.is_dir)
    if pictures or any(_is_table(e) for e in entries):
        return pictures > sum(_is_table(e) for e in entries)
    return depth < 3 and any(has_images(spark, e.path, limit, depth + 1) for e in entries[:limit] if e.is_dir)


def open_dataset(spark: SparkSession, root: str, config: Config | None = None) -> AuditSpec:
    """Read a dataset as the audit wants it."""
    config = config or Config()
    found = layout(spark, root, config)
    if found.single:
        df = tables.read_table(spark, found.single)
        column = config.split_column or next((c for c in SPLIT_COLUMNS if c in df.columns), None)
        if column is None:
            return AuditSpec.of_splits({"all": df}, config)
        return _by_column(df, column, config)
    if config.dataset_type == "image" or (config.dataset_type == "auto" and any(has_images(spark, p) for p in found.splits.values())):
        return _images(spark, found, config)
    splits, bad = {}, []
    for name, path in found.splits.items():
        df, unreadable = tables.read_tables(spark, files_of(spark, path), name)
        bad += [f"{name}/{x.rsplit('/', 1)[-1]}" for x in unreadable]
        if df is not None:
            splits[name] = df
    if not splits:
        raise ConfigError(f"no table in {root} can be read")
    if config.split_column:
        stacked = AuditSpec.of_splits(splits, config)
        return _by_column(stacked.samples.drop(SPLIT), config.split_column, config)
    return AuditSpec.of_splits(splits, config, unreadable=bad)


def _by_column(df: DataFrame, column: str, config: Config) -> AuditSpec:
    if column not in df.columns:
        raise ConfigError(f"there is no split column {column}")
    spec = AuditSpec.of(df, column, config.label, config.groups, config.ids, config.temporal)
    spec.config = config
    return spec


def _images(spark: SparkSession, found: Layout, config: Config) -> AuditSpec:
    splits = {name: images.read_images(spark, path) for name, path in found.splits.items()}
    config.label = config.label or "label"
    spec = AuditSpec.of_splits(splits, config, images=True)
    spec.samples = spec.samples.withColumn("sample_id", F.concat_ws("/", F.col(SPLIT), F.col("relative_path")))
    return spec
