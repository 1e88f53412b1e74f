"""The corpus pipeline: quality rules, near-duplicates, personal data, mixture and packing, in that order.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm.common import materialize, table
from loomdex.llm.mixing import BLOCK, mix_documents
from loomdex.llm.neardup import drop_near_duplicates
from loomdex.llm.packing import pack_documents
from loomdex.llm.pii import redact_documents
from loomdex.llm.repetition import keep_unrepetitive


#: Tokens of a block that is drawn: a piece of it, with the id that ends it, fits the shortest window, even if its text, cut at
#: the block's border, is encoded in a few ids more.
PIECE = BLOCK - 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much go. Null and empty texts stay, each of repeated rows is judged like the
    others, texts of any length are judged as a whole, and all columns are kept. An empty table gives an empty one."""
    return keep_unrepetitive(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id; of rows that repeat a doc_id, one.
    Rows without a doc_id, and texts that are null, empty or white space, are in no group and stay. Very long texts are
    compared as a whole. All columns are kept. An empty table gives an empty one."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, in texts of any length. All rows stay, null and empty texts as
    they are; of the columns only text and n_chars change. An empty table gives an empty one."""
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources are drawn to the target weights; a row is a document's piece of a drawn block.

    A source's blocks are of PIECE tokens of the vocabulary. Rows without text hold no tokens and go; a null doc_id,
    a null source and repeated rows are as good as any. An empty table gives an empty one."""
    return mix_documents(docs, block=PIECE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces are packed into context windows of several lengths: a row is a window with its token ids and the
    documents that lie in it. Rows without text have no tokens; a null doc_id and repeated rows are packed each by
    itself; a text longer than a window is cut. Columns but doc_id and text are dropped. An empty table gives an
    empty one."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the suffix arrays, the signatures and the packing; tests/llm compares the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
