"""A training corpus from raw documents: five stages, each one operator of the `llm` subpackage.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, or, the last one, their tokens. All but the last
return the columns of `docs` as they are, whatever further columns there are and whatever they are called, read texts of any
length whole, and make an empty table of an empty one. What each does with nulls and repeated rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, line_dedup, mixing, near_dedup, scratch, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labels doesn't reject.

    Null and empty texts stay, and so do rows without an id or a source; repeated rows stay or go together.
    """
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document already; documents of which nothing is left go.

    Null and empty texts stay. Null ids come first in the order of documents. Rows equal in id and text are one document, so
    neither is cut for the other's sake; rows that share an id alone are different documents. n_chars is counted anew.
    """
    return line_dedup.dedup_lines(docs, length_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Rows with a null id or text stay. Of rows equal in id and text one stays; rows that share an id alone are different
    documents. Empty texts are duplicates of one another.
    """
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of all sources in equal parts by tokens, as far as sources with nine tenths of the weight can fill these.

    Rows with a null id or source, or a null or empty text, can't be chosen and go. Of rows equal in id and text one stays; all
    texts of a chosen id stay.
    """
    chosen = scratch.written(mixing.mix_sources(docs).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "chosen")
    return near_dedup.one_per_text(docs.join(chosen, "doc_id", "left_semi").select(*docs.columns), docs, "doc_id", "text")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token lists of the documents: (doc_id, n_tokens, token_ids, round_trip), one row for each, repeated ones too.

    A null text has null tokens, an empty one an empty list; null ids stay null.
    """
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", tokenise),
]

#: No SQL expresses training, ProbMinHash, the subset sums or BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return docs
