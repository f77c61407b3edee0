"""A corpus pipeline of five stages over `documents`: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs; all but the last return the columns of documents. Each stage works on all that its predecessor
kept. A stage's limits on nulls, ties, repeated rows and empty tables are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.jaccard import jaccard_components
from docloom.llm.linededup import dedup_lines
from docloom.llm.mixing import mixed
from docloom.llm.packing import pack
from docloom.llm.quality import judged, measure, thresholds
from docloom.llm.queries import TOKENIZER
from docloom.sources.store import forget, written
from docloom.sources.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the fences of their language and source."""
    ship(spark)
    limits = thresholds(written(measure(docs.select(*COLUMNS)).drop("text")))
    return judged(measure(docs.select(*COLUMNS)), limits).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document with a smaller id holds too; n_chars follows the text."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id."""
    groups = jaccard_components(docs, n=5, num=80, den=100)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' token ids and their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Mixing and packing have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:  # nothing reads the stage before last any more
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
