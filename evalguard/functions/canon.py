"""Canonical cells, keys and digests: column expressions only, so they stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "\u001f"
NULL_CELL = "\u0000"
#: Texts that mean "no label", after trimming and lower-casing.
NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none", "unknown", "-", "?", "<na>")
#: Split names by role.
TRAIN_NAMES = ("train", "training", "trn", "fit")
VAL_NAMES = ("val", "valid", "validation", "dev", "evaluate")
TEST_NAMES = ("test", "testing", "tst", "eval")
#: Cell texts that the CSV reader takes for null.
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def role_of(name: str) -> str:
    key = name.strip().lower()
    for role, names in (("train", TRAIN_NAMES), ("val", VAL_NAMES), ("test", TEST_NAMES)):
        if key in names:
            return role
    return "unknown"


def split_name(c: Column) -> Column:
    """Lower-cased trimmed name, its role's name where it is an alias, ``unknown`` where it is blank."""
    key = F.lower(F.trim(c.cast("string")))
    return (
        F.when(key.isin(*TRAIN_NAMES), "train").when(key.isin(*VAL_NAMES), "val").when(key.isin(*TEST_NAMES), "test")
        .when(key.isNull() | (key == ""), "unknown").otherwise(key)
    )


def is_missing(c: Column, kind: T.DataType) -> Column:
    """Null, or NaN in floating columns."""
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def cell(c: Column, kind: T.DataType) -> Column:
    """Text of a cell: a null mark, 1/0, floats rounded to 12 places, JSON for nested values."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "1").otherwise("0")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.round(c.cast("double"), 12).cast("string")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    else:
        text = c.cast("string")
    return F.when(is_missing(c, kind), F.lit(NULL_CELL)).otherwise(text)


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    kinds = _kinds(df)
    return F.concat_ws(SEP, *(cell(df[c], kinds[c]) for c in columns))


def digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical cells in column order."""
    return F.sha2(row_key(df, columns).cast("binary"), 256)


def clean_label(c: Column) -> Column:
    """Trimmed text; null where it is a null token."""
    text = F.trim(c.cast("string"))
    return F.when(F.lower(text).isin(*NULL_TOKENS), None).otherwise(text)


def label_form(c: Column) -> Column:
    """The label without trailing blanks and full stops: two spellings of one class agree."""
    return F.regexp_replace(F.trim(c), r"[\s.]+$", "")


def entity_key(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def sample_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEP, *parts).cast("binary"), 256), 1, 16)


def sampled(seed: int, sample: Column, fraction: float) -> Column:
    """Deterministic sampling by the first 32 bits of a hash."""
    head = F.conv(F.substring(F.sha2(F.concat_ws(SEP, F.lit(str(seed)), sample).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return head < F.lit(int(fraction * 2**32))


def number(c: Column, kind: T.DataType | None = None) -> Column:
    """A double, null where the cell's text is none or NaN."""
    value = c.cast("double") if kind is not None and is_numeric(kind) else c.cast("string").try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def moment(c: Column, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm")) -> Column:
    """A timestamp, null where no format fits."""
    return F.coalesce(F.try_to_timestamp(c.cast("string")), *(F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats))


def logical_type(df: DataFrame, column: str) -> str:
    """Name of the column's logical type, as schema drift compares them."""
    kind = _kinds(df)[column]
    for types, name in (
        ((T.StringType, T.VarcharType, T.CharType), "string"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType), "float"),
        ((T.BooleanType,), "bool"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "datetime"), ((T.BinaryType,), "bytes"),
    ):
        if isinstance(kind, types):
            return name
    return kind.simpleString()


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))
