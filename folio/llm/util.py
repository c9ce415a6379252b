"""What the operators of this subpackage share: scratch tables, Arrow batches of whole texts, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that all contracts here mean by "white space", as a Java and RE2 class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Most bytes of text that one Arrow batch hands to Python at once (one longer text still goes alone).
BATCH_BYTES = 4 << 20
#: A join side is broadcast only if its measured size is at most this; larger sides take the sort-merge join.
BROADCAST_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir of the session.

    Where it is unset (tests on a local master) a temporary folder is set; on a cluster that would lose files, so it is
    an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folio-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Written tables of one operator call, below the shared checkpoint folder.

    Returned frames read them, so they stay until clean() deletes them.
    """

    made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/folio-{operator}-{uuid.uuid4().hex}"
        Scratch.made.append(self.path)

    @classmethod
    def clean(cls, spark: SparkSession, mark: int = 0) -> None:
        """Deletes all tables that this process wrote after the first `mark`, once no frame of theirs is needed any more."""
        while len(cls.made) > mark:
            delete(spark, cls.made.pop())

    def write(self, frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Writes the frame and reads it back, which cuts its lineage: a lost executor costs only a re-read."""
        where = f"{self.path}/{name}"
        schema = frame.schema
        writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
        writer.parquet(where)
        return self.spark.read.schema(schema).parquet(where)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        delete(self.spark, f"{self.path}/{name}")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that JVM and Python exchange, so that long texts don't gather in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches of at most `most` text bytes (one row at least) and their texts as UTF-8; null is empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        begin, held = 0, 0
        for i, text in enumerate(texts):
            if held and held + len(text) > most:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(text)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def lean(stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stage, after which its Python worker, which lives on, gives memory that it no longer uses back to the machine."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stage(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)

    return run


def rested(spark: SparkSession) -> None:
    """Has the executors collect their heaps, so that what a stage before no longer needs goes back to the machine.

    Python workers need their memory beside the heap, which else only ever grows. As many tasks as there are cores meet about
    every executor; one that is missed only keeps what it has.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def gathered(batches: Iterator[tuple[pa.RecordBatch, list[bytes]]], most: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Joins what text_batches() yields up to `most` text bytes."""
    parts: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    held = 0
    for part, some in batches:
        size = sum(map(len, some))
        if parts and held + size > most:
            yield pa.Table.from_batches(parts), texts
            parts, texts, held = [], [], 0
        parts.append(part)
        texts += some
        held += size
    if parts:
        yield pa.Table.from_batches(parts), texts


def only(frame: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash with an operator's own."""
    return frame.select(*[F.col(f"`{c}`") for c in columns])


def join_checked(left: DataFrame, right: DataFrame, on: str, how: str, right_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins with the right side broadcast if its measured bytes fit the limit, else by sort-merge."""
    return left.join(F.broadcast(right) if right_bytes <= limit else right.hint("merge"), on, how)


class Generations:
    """A bounded store in two halves: entries that were asked for since the last turn outlive it, the rest are forgotten."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def missing(self, keys: set) -> list:
        """Makes the known ones of keys ready in `now` and returns the others, which the caller must add to it."""
        now, before = self.now, self.before
        if len(now) > self.most // 2:
            before = self.before = now
            now = self.now = {}
        out = []
        for x in keys:
            if x not in now:
                found = before.get(x)
                if found is None:
                    out.append(x)
                else:
                    now[x] = found
        return out
