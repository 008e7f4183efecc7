"""Images in class directories: content hash, decoding outcome, properties and a 64-bit perceptual hash.

The listing comes from the driver's file system and the bytes from Spark's binaryFile source, which leaves out empty
files; they come back as corrupt by a join on the path. Pixels are decoded on the JVM (ImageIO); the DCT hash is
numpy in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif")
#: Formats that every JDK decodes; the others count as not inspected.
DECODED = (".jpg", ".jpeg", ".png", ".bmp", ".gif")
#: Directory names that are no label.
NO_LABELS = ("", "unknown", "none", "null", "unlabeled", "unmapped", "-")
HASH_SIDE, HASH_PIXELS = 8, 32
_SCHEMA = "path string, width int, height int, channels int, brightness double, contrast double, phash long"


def _dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n))


def resize(grey: np.ndarray, side: int) -> np.ndarray:
    """Box average down, linear up: rows, then columns."""

    def weights(n: int) -> np.ndarray:
        at = (np.arange(side) + 0.5) * n / side - 0.5
        reach = max(1.0, n / side)
        w = np.maximum(0.0, 1 - np.abs(np.arange(n)[None, :] - at[:, None]) / reach)
        return w / w.sum(axis=1, keepdims=True)

    return weights(grey.shape[0]) @ grey @ weights(grey.shape[1]).T


def phash(grey: np.ndarray) -> int:
    """Signs of the low DCT frequencies against their median, as a signed 64-bit number."""
    d = _dct_matrix(HASH_PIXELS)
    low = (d @ resize(grey.astype(np.float64), HASH_PIXELS) @ d.T)[:HASH_SIDE, :HASH_SIDE]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64))


def properties(path: str, height: int, width: int, channels: int, data: bytes) -> tuple:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels >= 3:  # blue, green, red
        grey = pixels[:, :, 2] * 0.299 + pixels[:, :, 1] * 0.587 + pixels[:, :, 0] * 0.114
    else:
        grey = pixels[:, :, 0].astype(np.float64)
    return path, width, height, channels, float(grey.mean()), float(grey.std()), phash(grey)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all image files under a directory, empty ones too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    rows = []
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString()
        if name.lower().endswith(SUFFIXES):
            rows.append((name, f.getLen()))
    return spark.createDataFrame(rows, "path string, length long")


def hash_files(spark: SparkSession, path: str, cache: DataFrame | None = None) -> DataFrame:
    """(path, length, modified, sha256); files that ``cache`` has with equal path, length and time are not read again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    key = [F.col("path"), F.col("length"), F.col("modificationTime").alias("modified")]
    if cache is None:
        return files.select(*key, F.sha2("content", 256).alias("sha256"))
    listed = files.select(*key)
    known = listed.join(cache, ["path", "length", "modified"])
    missing = [r["path"] for r in listed.join(cache, ["path", "length", "modified"], "left_anti").select("path").collect()]  # the names to open
    return known.unionByName(hash_files_of(spark, missing)) if missing else known


def hash_files_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def label_of_path(path: F.Column) -> F.Column:
    """The parent directory's name, split names left out."""
    parts = F.filter(F.split(path, "/"), lambda x: ~F.lower(x).isin("train", "val", "test") & (x != ""))
    return F.try_element_at(parts, F.lit(-2))


def entity_of_path(path: F.Column, pattern: str) -> F.Column:
    """The pattern's first group, or all of its match; null where it doesn't match."""
    import re

    group = 1 if re.compile(pattern).groups else 0
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, group))


def copy_split(assigned: DataFrame, out: str) -> int:
    """Copy (relative_path, split, origin) files to ``out/split/relative_path`` from the executors; returns the number of files.

    Bytes are read by Spark's binaryFile source; ``out`` must be reachable under one path from every executor.
    """
    spark = assigned.sparkSession
    key = lambda c: F.regexp_replace(c, "^(file:)?/*", "/")
    roots = sorted(r[0] for r in assigned.select(F.regexp_replace("origin", "/[^/]*$", "").alias("d")).distinct().collect())  # folders
    files = spark.read.format("binaryFile").load([f"{r}/*" for r in roots]).select(key(F.col("path")).alias("key"), "content")
    rows = files.join(assigned.select(key(F.col("origin")).alias("key"), "relative_path", "split"), "key").select("relative_path", "split", "content")
    target = out.removeprefix("file://")

    def write(part) -> None:
        from pathlib import Path

        for r in part:
            to = Path(target, r["split"], r["relative_path"])
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(r["content"])

    n = rows.count()
    rows.foreachPartition(write)
    return n


def decode(spark: SparkSession, path: str) -> DataFrame:
    """Properties of the images that decode."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([properties(*r) for r in pdf.itertuples(index=False)], columns=names)

    return images.mapInPandas(run, _SCHEMA)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: relative_path, label, size, sha256, corrupt, inspected and the properties of those that decode."""
    root = path.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^(file:)?/*", "/")
    listed = list_files(spark, path).withColumn("key", relative)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(relative.alias("key"), F.sha2("content", 256).alias("sha256"))
    found = decode(spark, path).withColumn("key", relative).drop("path")
    joined = listed.join(content, "key", "left").join(found, "key", "left")
    base = "/" + root.removeprefix("file:").lstrip("/") + "/"
    rel = F.expr("substring(key, {})".format(len(base) + 1))
    label = F.when(F.size(F.split(rel, "/")) > 1, F.split(rel, "/")[0])
    inspected = F.lower("key").rlike("(" + "|".join(s.replace(".", r"\.") for s in DECODED) + ")$")
    return joined.select(
        rel.alias("relative_path"), F.when(~F.lower(label).isin(*NO_LABELS), label).alias("label"), F.col("length").alias("size"), "sha256", ((F.col("length") == 0) | (inspected & F.col("width").isNull())).alias("corrupt"),
        (inspected | (F.col("length") == 0)).alias("inspected"), F.col("path").alias("origin"), "width", "height", "channels", "brightness", "contrast", "phash",
    )
