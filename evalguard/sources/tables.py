"""Table files: CSV with the usual null texts, TSV, Parquet, ORC, JSON, Feather and Excel."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evalguard.functions import canon

SUFFIXES = (".csv", ".tsv", ".parquet", ".pq", ".orc", ".jsonl", ".feather", ".xlsx", ".xls")
SNIFF_BYTES = 8192


class Unreadable(ValueError):
    """A file that no reader accepts."""


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name[name.rfind(".") :] if "." in name else ""


def head(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file, through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():  # as a Spark writer leaves it
        parts = sorted((f.getPath().getName(), f.getPath()) for f in fs.listStatus(p) if f.getLen() and not f.getPath().getName().startswith(("_", ".")))
        if not parts:
            return b""
        p = parts[0][1]
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def delimiter(sample: str) -> str:
    """The delimiter of a CSV sample; a comma where it can't be told."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text, the usual null texts made null, then the narrowest type that fits every cell, in one pass."""
    start = head(spark, path).decode("utf-8", "replace")
    if not start.strip():
        raise Unreadable(f"{path} is empty")
    df = spark.read.csv(path, header=True, sep=sep or delimiter(start), multiLine=broken_lines(spark, path), escape='"', inferSchema=False)
    for c in df.columns:
        df = df.withColumn(c, F.when(~F.trim(F.col(f"`{c}`")).isin(*canon.CSV_NULLS), F.col(f"`{c}`")))
    return infer_types(df)


def broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes on over a line's end: only then must a file be read as a whole, by one task."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become bool, long, double or timestamp if all their cells are."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    checks = []
    for i, c in enumerate(texts):
        x = F.trim(F.col(f"`{c}`"))
        # leading zeros and signs without digits keep a column text
        kinds = {"bool": F.lower(x).isin("true", "false"), "long": x.rlike(r"^[+-]?(0|[1-9][0-9]{0,17})$"), "double": x.try_cast("double").isNotNull() & x.rlike(r"[0-9]"), "time": x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+)?$") & F.try_to_timestamp(x).isNotNull()}
        checks += [F.count(x).alias(f"{i}|n"), *(F.count(F.when(k, 1)).alias(f"{i}|{name}") for name, k in kinds.items())]
    found = df.agg(*checks).first()
    types = {"bool": "boolean", "long": "bigint", "double": "double", "time": "timestamp"}
    for i, c in enumerate(texts):
        fit = next((t for t in types if found[f"{i}|n"] and found[f"{i}|{t}"] == found[f"{i}|n"]), None)
        if fit:
            df = df.withColumn(c, F.trim(F.col(f"`{c}`")).cast(types[fit]))
    return df


class _ArrowSource(DataSource):
    """A reader of one file a partition that yields Arrow batches."""

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self.table(self.options["path"]).schema)

    def table(self, path: str):
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArrowReader(self, self.options["path"])


class _ArrowReader(DataSourceReader):
    def __init__(self, source: _ArrowSource, path: str) -> None:
        self.source, self.path = source, path

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator:
        yield from self.source.table(partition.value).to_batches(max_chunksize=10_000)


def _local(path: str) -> str:
    return path.removeprefix("file://")


class FeatherSource(_ArrowSource):
    @classmethod
    def name(cls) -> str:
        return "evalguard_feather"

    def table(self, path: str):
        from pyarrow import feather

        return feather.read_table(_local(path))


class ExcelSource(_ArrowSource):
    """A sheet of a workbook: the one named by the option ``sheet``, or the only one."""

    @classmethod
    def name(cls) -> str:
        return "evalguard_excel"

    def table(self, path: str):
        import pandas as pd
        import pyarrow as pa

        book = pd.ExcelFile(_local(path))
        wanted = self.options.get("sheet")
        if wanted not in book.sheet_names and len(book.sheet_names) != 1:
            raise Unreadable(f"{path} has the sheets {book.sheet_names}, none of them {wanted}")
        return pa.Table.from_pandas(book.parse(wanted if wanted in book.sheet_names else book.sheet_names[0]), preserve_index=False)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One table file (or a directory that a Spark writer made) as a frame."""
    kind = suffix(path)
    if kind in (".csv", ".tsv"):
        return read_csv(spark, path, "\t" if kind == ".tsv" else None)
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if kind == ".orc":
        return spark.read.orc(path)
    if kind == ".jsonl":
        return spark.read.json(path)
    if kind == ".feather":
        spark.dataSource.register(FeatherSource)
        return spark.read.format("evalguard_feather").option("path", path).load()
    if kind in (".xlsx", ".xls"):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise Unreadable(f"{path}: reading workbooks needs openpyxl") from e
        spark.dataSource.register(ExcelSource)
        return spark.read.format("evalguard_excel").option("path", path).option("sheet", sheet or "").load()
    raise Unreadable(f"{path} has an unknown suffix")


def read_tables(spark: SparkSession, paths: Sequence[str], sheet: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """All files of a split as one frame, and the files that can't be read."""
    out, bad = None, []
    for path in paths:
        try:
            part = read_table(spark, path, sheet)
            part.schema  # noqa: B018  the reader looks at the file here
        except Exception as e:  # whatever a reader raises is reported, not fatal
            bad.append(f"{path}: {type(e).__name__}")
            continue
        out = part if out is None else _union(out, part)
    return out, bad


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name; where types differ the column becomes text."""
    kinds = dict(b.dtypes)
    odd = [c for c, kind in a.dtypes if c in kinds and kinds[c] != kind]
    as_text = {c: F.col(f"`{c}`").cast("string") for c in odd}
    return a.withColumns(as_text).unionByName(b.withColumns(as_text), allowMissingColumns=True) if odd else a.unionByName(b, allowMissingColumns=True)


#: Rows of a format that is written as one file, by the driver.
ONE_FILE_ROWS = 1_000_000


def write_table(df: DataFrame, path: str) -> None:
    """Write by suffix; CSV and TSV with header. Feather and Excel hold one table in one file, so the rows pass the driver."""
    kind = suffix(path)
    if kind in (".parquet", ".pq"):
        df.write.mode("errorifexists").parquet(path)
    elif kind == ".orc":
        df.write.mode("errorifexists").orc(path)
    elif kind == ".jsonl":
        df.write.mode("errorifexists").json(path)
    elif kind in (".csv", ".tsv", ""):
        df.write.mode("errorifexists").csv(path, header=True, sep="\t" if kind == ".tsv" else ",", escape='"')
    elif kind in (".feather", ".xlsx") and df.limit(ONE_FILE_ROWS + 1).count() > ONE_FILE_ROWS:
        raise Unreadable(f"{path}: over {ONE_FILE_ROWS} rows don't go into one file; choose .parquet")
    elif kind == ".feather":
        from pyarrow import feather

        feather.write_feather(df.toArrow(), _local(path))
    elif kind == ".xlsx":
        df.toPandas().to_excel(_local(path), index=False)
    else:
        raise Unreadable(f"{path} has an unknown suffix")
