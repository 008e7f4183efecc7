"""The queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalguard.llm.mixing import ORACLE_SQL as MIXING_SQL
from evalguard.llm.sharding import ORACLE_SQL as SHARDING_SQL

#: Counts of base spans of personal data; cards need Luhn's sum, which the tests check.
PII_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
m as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as e, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as i, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') as p from t)
select doc_id, cast(len(e) as bigint) as n_email, cast(len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: cast(y as double))) <= 255)) as bigint) as n_ip,
cast(len(list_filter(p, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 9 and 15)) as bigint) as n_phone from m"""

#: Vocabulary file of the public byte-level tokenizer.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_bucket(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import language_id as op

    docs = table(spark, sf_dir, "documents")
    model = op.train(op.collect_sample(docs.where(crc_bucket(3) != 1)))
    return op.identify(docs, model).select("doc_id", F.coalesce(crc_bucket(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "phrases")


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import sharding as op

    return op.shard_documents(table(spark, sf_dir, "documents"), op.topology(24), op.topology(25))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import token_store as op

    return op.token_store(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import substring_dedup as op

    return op.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import mixing as op

    return op.schedule(table(spark, sf_dir, "documents")).drop("th")


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import hamming_index as op

    return op.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import pii as op

    return op.personal_data(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import toxicity as op

    docs = table(spark, sf_dir, "documents")
    weights = op.train(op.learning_sample(docs, table(spark, sf_dir, "labels").where(crc_bucket(5) != 0)))
    held_out = F.coalesce(crc_bucket(5) == 0, F.lit(False))
    return op.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import decontaminate as op

    return op.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalguard.llm import jaccard_join as op

    return op.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def placement_of_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's shards, without the columns that SQL cannot compute; slots are checked for gaps by tests."""
    return op2_hash_tree_sharding(spark, sf_dir).select("doc_id", "size", "shard", "rack", "region", "law", "grown_shard")


def base_spans_of_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's counts of base spans."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_hash_tree_sharding": op2_hash_tree_sharding,
    "op3_token_store": op3_token_store,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_multi_index_hashing": op6_multi_index_hashing,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
    "placement_of_shards": placement_of_shards,
    "base_spans_of_pii": base_spans_of_pii,
}
#: op2's text_crc32 and slot are beyond DuckDB (it has no CRC), so its SQL checks placement through a query of its own; so with op7's cards.
ORACLES: dict[str, str] = {"op5_temperature_mixing": MIXING_SQL, "placement_of_shards": SHARDING_SQL, "base_spans_of_pii": PII_SQL}
