"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing and tokens, in this order.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of docs (the last: tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, pieces, pii, simhash, toxicity
from tidemark.llm.common import checkpointed, read, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go (toxicity.clean).

    Null and empty texts score 0 and stay; copies, and rows that share an id, are each judged by their own whole text, so
    ties are alike and all stay or go; an empty table stays empty; other columns pass, whatever their names.
    """
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a five-word shingle similarity of 0.8 or more stays (simhash.keep_one).

    That is the one with the smallest doc_id, rows without id last; null and empty texts are one group; unlike texts stay
    though their ids repeat; very long texts are compared as a whole; an empty table stays empty; other columns pass.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emails, addresses, cards and phones in the texts give way to their kinds (pii.redact).

    Null texts stay null and empty ones empty; n_chars, where there is one, is that of the new text; rows that repeat are
    masked alike; of overlapping spans the first, of those that begin together the longest names the gap (of equal ones the
    first kind listed); very long texts are masked as a whole; an empty table stays empty; other columns pass.
    """
    small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated by a Poisson count with its source's mean, and all are shuffled (mixing.mix).

    Documents with a count of 0 go: that is the sampling. Nothing is ranked, so there are no ties. Rows that share an id have equal counts; null sources count
    as unnamed ones; null, empty and very long texts are mixed as they are; an empty table stays empty; other columns pass.
    """
    return mixing.mix(docs, mixing.WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (with begin and end id), n_tokens of every document of the mixture, and decoded.

    Null and empty texts have the begin and end id only; a text has one encoding (of merges of equal rank the leftmost goes
    first); repeated rows are encoded each; very long texts as a whole; an
    empty table gives no rows; other columns are not looked at.
    """
    small_batches(spark)
    tokens = pieces.encode(docs, keep=("source",))
    return tokens.selectExpr("doc_id", "source", "ids", "cast(size(ids) as bigint) as n_tokens", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL has no training, Golay decoding or byte-pair merges; tests/llm hold the stages to brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))  # stages read their input more than once
    return STAGES[-1][1](spark, docs, sf_dir)
