"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents, extra ones too, whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import materialize, table
from rivulet.llm.mixing import mixed_documents
from rivulet.llm.near_dedup import deduplicated
from rivulet.llm.packing import pack
from rivulet.llm.quality import train, without_rejected
from rivulet.llm.queries import tokenizer
from rivulet.llm.secrets import redacted
from rivulet.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.5 go.

    Null and empty texts have no words and get the score of an empty feature set; a score of
    exactly 0.5 stays. Repeated rows are scored each and alike; null ids stay or go by their text; labels
    that are null, or of a null id, teach nothing. Texts are scored whole.
    """
    ship(spark)
    return without_rejected(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays. Null texts, texts without words and rows without an id are
    linked with nothing and all stay; rows that repeat an id are one document, of whose texts
    with words that of the least hash stays. Whole texts are compared.
    """
    ship(spark)
    return deduplicated(docs, shingle_words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark.

    Spans that touch or overlap the one before are joined into its mark. Null and empty texts stay as they are, as does every row; n_chars
    is made anew where a text changed. Repeated rows change alike; texts are scanned whole.
    """
    ship(spark)
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of the sources are taken by weight, in blocks, up to twice.

    Documents without words give no row; others a row for each pass that takes words of
    them. Null sources are one source, the last in order; null ids are values like others; each of several
    repeated rows has words of its own. Sources of equal size differ by their weights only.
    """
    ship(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens.

    Null and empty texts are an end token alone; null ids stay null; repeated rows are packed
    as often as they come; of bins with equally much space the last opened is filled first. Texts are tokenised whole.
    """
    ship(spark)
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("packing", packing)]

#: No SQL: the classifier, the inferred formats, the draws of the mixture and the tokenizer can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
