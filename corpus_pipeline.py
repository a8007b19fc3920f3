"""A corpus pipeline: quality rules, toxicity, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives all rows that it keeps, with the columns of documents, but
for the last, which gives the packed pieces. The operators carry a row's columns along with their verdict, so each
row is judged by itself, whatever its id: null ids and rows that repeat an id are no exception.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stardeck.llm.common import bucket_of_id, written
from stardeck.llm.line_dedup import dedup_lines
from stardeck.llm.packing import pack
from stardeck.llm.quality_rules import quality_rules
from stardeck.llm.simhash import first_of_each
from stardeck.llm.toxicity import learn, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = ("text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality_rules(docs, _labels(spark, sf_dir), carry=CARRIED).where("kept").select(COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    held_out = bucket_of_id("doc_id", 5) == 0
    lexicon = learn(docs, _labels(spark, sf_dir), ~held_out)
    return score(docs, lexicon, held_out, CARRIED).where("predicted = 0").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document has; n_chars is the length of what stays."""
    kept = dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id, once."""
    return first_of_each(docs.select(COLUMNS))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", keep_clean),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: Learned rules, a learned grammar, fingerprint groups and packing are beyond SQL.
ORACLE_SQL = None
