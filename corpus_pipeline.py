"""A corpus from raw documents to packed training sequences.

Each stage takes what its predecessor kept: documents that read as toxic go, of near-duplicates one stays,
personal data is replaced by its kind, sources are repeated towards target weights, and what is left is
packed. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, pii, simhash, toxicity
from lectern.llm.common import table, written
from lectern.llm.queries import WEIGHTS

#: Several stages learn or decide by rules that SQL can't state.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of the labels in sf_dir.

    Null and empty texts score as text without evidence, so they stay; repeated rows are judged alike; without
    labels all stay; an empty table gives no rows.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, named=("_lectern_toxicity", "_lectern_passages"))
    return scored.filter("_lectern_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id.

    Null and blank texts are copies of one another; rows with a null doc_id stay; of rows with one doc_id and text
    one stays, and rows with one doc_id but different texts are judged by their texts; an empty table gives no rows.
    """
    return simhash.keep_first(docs).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind; n_chars, where there is such a column, follows the text.

    Null and empty texts stay as they are (a null text has a null n_chars); repeated rows are treated each for
    itself; an empty table gives no rows.
    """
    done = pii.redact(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the sources' target weights and shuffled; copies are equal rows.

    Rows with a null or unknown source stay once each; rows with a null doc_id are drawn by their text; an
    empty table gives no rows.
    """
    return mixing.mix(docs, WEIGHTS, named=("_lectern_copy", "_lectern_key")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; `row` tells the copies of a document apart.

    A null text is an empty one; repeated rows are packed as often as they come; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
