"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes every stage's result to
the shared checkpoint folder as Parquet and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import exact_dedup, packing, secrets, simhash, toxicity
from folio.llm.util import Scratch, rested


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score of 0.5 or more) go.

    The text alone decides, so equal texts, repeated rows and rows that share a doc_id fare alike. Null, empty and wordless texts
    score by the bias alone; very long ones are read whole. An empty table gives no rows; further columns come back as they are.
    """
    rested(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.trained(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest, of those the smallest doc_id, of those any.

    Rows that share a doc_id but not the text are different documents; a null doc_id loses to any other. Null, empty and blank
    texts are equal; very long ones are compared whole. An empty table gives no rows; further columns come back as they are.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more in five-word shingles, directly or over others, the smallest doc_id stays.

    Rows that share a doc_id, or have none, are documents of their own if their texts differ; of rows equal in both one stays.
    Null, empty and blank texts are similar to each other; very long ones count whole; exactly 0.8 is similar. An empty table
    gives no rows; further columns come back as they are.
    """
    rested(spark)
    return simhash.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; documents stay.

    Every row gives one row, repeated ones and those without a doc_id too; null and empty texts come back as they are; very long
    ones are scanned whole; of overlapping secrets the whole stretch goes. An empty table gives no rows; n_chars follows the
    text, further columns come back as they are.
    """
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces.

    Every row is packed, repeated ones and those without a doc_id too; null and empty texts are one token; very long ones are cut
    into pieces. Ties in length go by arrival. An empty table gives no rows; further columns are ignored.
    """
    rested(spark)
    # A smaller store than op4's: the heaps that the stages before have grown leave workers less memory.
    return packing.packed(docs, cached=400_000, batch_bytes=4 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        mark = len(Scratch.made)
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        Scratch.clean(spark, mark)  # the stage's own tables
        if before is not None:
            scratch.drop(before)
        before = name
    return docs
