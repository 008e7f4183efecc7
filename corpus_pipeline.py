"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalguard.llm import decontaminate, jaccard_join, language_id, mixing, token_store
from evalguard.llm.common import materialise, settle, small
from evalguard.llm.queries import table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language and writes it to ``lang``; those without a letter go.

    Null, empty and blank texts, and texts of digits and signs only, have no letter: they go whatever their label. Texts of any length are
    parsed whole. Ties go to the language that sorts first. Repeated rows, and rows of one id, stay or go each by its own text. Without any
    labelled text no language is learned and every document goes. An empty table stays empty; further columns are kept.
    """
    # a label of "und" names no language: it is not learned, so only documents without a letter are predicted as it
    labelled = docs.where(~F.col("lang").eqNullSafe(language_id.UNDETERMINED))
    found = settle(spark, lambda: language_id.identify(docs, language_id.train(language_id.collect_sample(labelled))).select("doc_id", "text_hash", "lang_pred").dropDuplicates(["doc_id", "text_hash"]), "pipeline-langs")
    th = F.xxhash64(docs["text"].cast("string"))
    # only documents that go, or whose language changes, need a row of their own
    old = docs.select(docs["doc_id"].cast("long").alias("doc_id"), th.alias("text_hash"), docs["lang"].alias("lang"))
    same = old["doc_id"].eqNullSafe(found["doc_id"]) & old["text_hash"].eqNullSafe(found["text_hash"])
    changed = old.join(found, same).where((F.col("lang_pred") == language_id.UNDETERMINED) | ~F.col("lang").eqNullSafe(F.col("lang_pred"))).select(found["doc_id"], found["text_hash"], "lang_pred").distinct()
    c = small(materialise(changed, "pipeline-changed"))
    joined = docs.join(c, docs["doc_id"].cast("long").eqNullSafe(c["doc_id"]) & th.eqNullSafe(c["text_hash"]), "left")
    kept = joined.where(F.coalesce(c["lang_pred"], F.lit("")) != language_id.UNDETERMINED)
    return kept.select(*(F.coalesce(c["lang_pred"], docs["lang"]).alias("lang") if n == "lang" else docs[n] for n in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one of least id, null ids last, then of least text hash.

    Null and blank texts are nobody's copy and stay. Of rows that agree in id and text one stays. Texts of any length are compared whole; pairs at
    exactly the threshold are copies. An empty table stays empty; further columns are kept.
    """
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null, empty and blank texts hold none. Long texts are searched whole. Rows of one id go each by its own text, repeated rows together. Nulls among
    the items are not sought; with an empty benchmark all documents stay, an empty table stays empty, and further columns are kept.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are read up to ``mixing.MAX_EPOCHS`` times: rows repeat, none is lost.

    A null source is a source of its own. Null, empty and blank texts have no tokens and are read once. A long text counts with all its tokens.
    Rows that agree in id and text are read equally often. An empty table stays empty; further columns are kept.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store in ascending document order and describes it from its files.

    A null text is empty, an empty text holds the end id alone, a long text is one row. Null ids come first; rows of one id, the repeated readings
    of the stage before among them, follow each other by the hash of their text. An empty table gives an empty store; other columns are left out.
    """
    return token_store.token_store(spark, docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token-ID output", write_tokens),
]

#: Language models, MinHash and tokens are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(spark, lambda: stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))  # noqa: B023
    return docs
