"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Every stage reads what the one before it wrote; all but the last return the columns of documents, whatever further columns
those have. Each takes an empty table, and whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, mixing, near_dups, pii, quality
from tallyspark.llm.common import store, table


#: The setting of the session that holds the key of the pseudonyms.
KEY_SETTING = "spark.tallyspark.pseudonymKey"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the current policy go: null, empty and short texts among them. Repeated rows are judged each."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates stays, and of repeated rows one. Texts whose id is null are
    documents of their own; null, empty and blank texts are copies of their like."""
    return near_dups.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; ``n_chars`` follows the text (null for a null text). All rows stay. The key is the
    session's ``KEY_SETTING``; without one, a public key stands in, whose pseudonyms anyone can undo: for tests only."""
    return pii.mask(docs, spark.conf.get(KEY_SETTING, "public-test-key")).selectExpr(*("CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target: documents that are not drawn go, those drawn twice come twice, shuffled in their shards.
    A null source is one of its own; texts without words travel with their block; repeated rows are drawn together."""
    return mixing.Mix(docs).shards().select(*(f"`{c}`" for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their count, and digests of the ids and of the bytes they decode to. Null and empty texts have
    no ids; repeated rows are encoded each."""
    return bpe.digest(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Edit alignment, keyed permutations, hypergeometric draws and BPE aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
