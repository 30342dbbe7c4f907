"""The corpus pipeline: quality rules, language ID, line dedup, MinHash near-dedup, packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Every stage is written as Parquet in the shared checkpoint folder and reread as the next one's input, so each works
on all rows that the one before it kept and none is computed twice. A stage with nothing to read returns nothing.

1. quality: documents that fail the base rules or are robust outliers of their language and source go.
2. language_id: documents without an identified language (no letter, or a posterior under one half) go.
3. line_dedup: later copies of line runs of 50 words or more are deleted from the texts.
4. near_dedup: of documents that share 80 % of their 5-word shingles, the one with the smallest doc_id stays.
5. packing: the documents' tokens in sequences of 4096; one row per piece.

Rows with null columns, empty texts, repeated rows and extra columns pass as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecospark.llm import langid, linededup, minhash, packing, quality
from ecospark.llm.queries import PIECES, WORDS, tokenizer
from ecospark.llm.tables import stored
from ecospark.session import table

END_ID = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, tokenizer(PIECES))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text that is left."""
    out = linededup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer(WORDS), end_id=END_ID).drop("tokens")


STAGES = [
    ("quality", quality_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: the stages' models are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
