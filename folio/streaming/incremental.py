"""Incremental grading of a folder of Parquet files as a stream that runs to its end and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators import lines as L
from folio.operators import quality


def grade_new_files(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str) -> None:
    """Grades documents (doc_id, text) of files that no earlier call saw, and replaces their rows in the state table.

    The stream's checkpoint knows the files that are done, so a call that was cut off goes on where it stopped. Each batch
    writes a version of its own; latest() reads the newest row of every document.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        pages = L.normalise_pages(batch.select("doc_id", "text"), ["doc_id"]).withColumn("page_no", F.lit(1))
        quality.assess(pages, doc="doc_id").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{state}/batch={batch_id:09d}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, state: str) -> DataFrame:
    """The newest row of every document."""
    rows = spark.read.option("basePath", state).parquet(state)
    columns = [c for c in rows.columns if c not in ("doc_id", "batch")]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("doc_id", "r.*")
