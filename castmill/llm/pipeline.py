"""Corpus pipeline: quality, toxicity, near-duplicates, secrets, packing. Each stage reads what the one before kept.

Decisions are taken row by row: rows without an id, and repeated ids, are judged by their own text, and of
each group of near copies exactly one row stays, also where an id or a whole row is repeated. Null and empty
texts are one group of copies. Ties of the smallest id go by the text's hash. Columns beside those of
`documents` don't stay. An empty table gives an empty result in every stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, scratch, table
from .copies import one_of_each_group
from .packing import pack
from .quality import keep_good
from .secrets import redact
from .toxicity import keep_clean

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go."""
    return keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8) stays, that of the smallest id."""
    return one_of_each_group(docs.select(*COLUMNS))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text are replaced, and n_chars follows."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, with their ids."""
    return pack(docs)


STAGES = [("quality", keep_quality), ("toxicity", keep_not_toxic), ("simhash", keep_one_of_group), ("secrets", hide_secrets), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(durable(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
