"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hash, documents, last document) rows, bucketed and sorted by hash. A batch of documents is reduced to
its own distinct hashes (combined on the map side: a line in a third of all documents travels as one row per task), merged
against the runs with a sort-merge anti-join that tells new lines from known ones, and added as a run of level 0. When a
level holds `fanout` runs they are merged into one run of the next level, so that a lookup meets few runs at any size.
Runs share their bucketing, so joins between runs move no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.util import BROADCAST_BYTES, Scratch, bounded_batches, join_checked, only, text_batches

#: ASCII white space, as bytes.strip() takes it.
SPACE = b" \t\n\x0b\x0c\r"
LEAST_POINTS, LEAST_DOCS = 40, 5
#: Batches that one table is taken in, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 4, 2
#: Lines for each bucket of the runs, about: a run is one file a bucket.
BUCKET_LINES = 250_000

#: Common lines that may hold more than an even share of all rows: those in at least one of so many rows, so at most as many.
HOT_LINES = 10_000

LINE_SCHEMA = "doc_id long, version long, line_nos array<int>, hash binary, batch int"


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _batch_of(doc_id: int | None, batches: int) -> int:
    return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=4).digest(), "big") % batches


def lines(docs: DataFrame, batches: int = 1, least_points: int = LEAST_POINTS) -> DataFrame:
    """(doc_id, version, line_nos, hash, batch) of every document's keys with least_points code points or more, and where they stand.

    hash is a 16-byte digest of the key; version is a hash of the text, which tells apart rows that share a doc_id. A line that
    a document repeats is one row.
    """
    bounded_batches(docs.sparkSession)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(it):
            doc_ids, versions, places, hashes, numbers = [], [], [], [], []
            for doc_id, version, text in zip(part.column("doc_id").to_pylist(), part.column("version").to_pylist(), texts, strict=True):
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least_points and (len(key) >= 4 * least_points or len(key.decode("utf-8", "replace")) >= least_points):
                        own.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
                doc_ids += [doc_id] * len(own)
                versions += [version] * len(own)
                hashes += own
                places += own.values()
                numbers += [_batch_of(doc_id, batches)] * len(own)
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.binary()), pa.array(numbers, pa.int32())], names=["doc_id", "version", "line_nos", "hash", "batch"])

    return only(docs, "doc_id", "text").withColumn("version", F.xxhash64("text")).mapInArrow(split, LINE_SCHEMA)


class LineRuns:
    """The levelled runs. Tables are external, below the shared scratch folder, and hold no text."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.scratch = Scratch(spark, "runs")
        self.levels: list[list[str]] = []

    def _write(self, entries: DataFrame) -> str:
        name = f"folio_run_{uuid.uuid4().hex}"
        (entries.select("hash", "n_docs", "last_doc").repartition(self.buckets, "hash").sortWithinPartitions("hash")
            .write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.scratch.path}/{name}").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(name)

    def close(self) -> None:
        """Deletes the runs."""
        for name in (x for level in self.levels for x in level):
            self._drop(name)
        self.levels = []

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged into one: a full outer merge join keeps their bucketing, so no row moves."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            old, new = out.alias("old"), self.spark.table(name).hint("merge").alias("new")
            n_docs = F.coalesce("old.n_docs", F.lit(0)) + F.coalesce("new.n_docs", F.lit(0))
            out = old.join(new, "hash", "full").select("hash", n_docs.alias("n_docs"), F.greatest("old.last_doc", "new.last_doc").alias("last_doc"))
        return out

    def contents(self) -> DataFrame | None:
        """One row per hash over all runs, None before the first batch."""
        names = [x for level in self.levels for x in level]
        return self._merged(names) if names else None

    def new_entries(self, entries: DataFrame, settled: int | None = None) -> DataFrame:
        """The batch's entries that no run holds: a merge anti-join with each run in turn.

        With `settled`, an entry counts as held only by a run that has it in at least so many documents and with as late a
        document: it could change neither that the line is common nor who keeps it.
        """
        for name in (x for level in self.levels for x in level):
            run = self.spark.table(name).hint("merge")
            on = entries["hash"] == run["hash"]
            if settled is not None:
                on &= (run["n_docs"] >= settled) & (run["last_doc"] >= F.coalesce(entries["last_doc"], run["last_doc"]))
            entries = entries.join(run, on, "left_anti")
        return entries

    def add(self, entries: DataFrame) -> None:
        """Adds a batch's entries as a run of level 0, then compacts full levels."""
        names, level = [self._write(entries)], 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level] += names
            if len(self.levels[level]) < self.fanout:
                return
            full = self.levels[level]
            names, self.levels[level], level = [self._write(self._merged(full))], [], level + 1
            for name in full:
                self._drop(name)


def entries_of(batch_lines: DataFrame) -> DataFrame:
    """(hash, n_docs, last_doc) of a batch: rows that repeat a doc_id count once."""
    once = batch_lines.select("hash", "doc_id").distinct()
    return once.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def first_seen(runs: LineRuns, docs: DataFrame) -> DataFrame:
    """One incremental step for a stream of batches: the batch's lines that no earlier batch held, then the batch becomes a run."""
    scratch = Scratch(docs.sparkSession, "lines")
    own = scratch.write(lines(docs), "lines")
    entries = scratch.write(entries_of(own), "entries")
    fresh = scratch.write(runs.new_entries(entries).select("hash"), "fresh")
    runs.add(entries)
    return own.join(fresh, "hash", "left_semi").withColumn("line_no", F.explode("line_nos")).drop("line_nos")


def with_common(found: DataFrame, common: DataFrame, n_rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """found (hash, ...) with the last_doc of its common lines (hash, n_docs, last_doc), others dropped.

    Common lines are broadcast if their measured size is at most `limit`. Beyond, only those that hold a HOT_LINES-th of all
    rows are, of which there can't be more than HOT_LINES; none of the others is large enough to make a task of its own.
    """
    size = 64 * common.count()
    rest = common.select("hash", "last_doc")
    if size <= limit:
        return found.join(F.broadcast(rest), "hash")
    least = max(1, -(-n_rows // HOT_LINES))
    hot = found.join(F.broadcast(common.where(F.col("n_docs") >= least).select("hash", "last_doc")), "hash")
    return hot.unionByName(found.join(common.where(F.col("n_docs") < least).select("hash", "last_doc").hint("merge"), "hash"))


def repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, least_points: int = LEAST_POINTS, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, version, dropped: sorted line numbers) of the documents that lose lines, and the table's size in bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    # A batch is a folder of the table, so each batch reads its own rows only.
    found = scratch.write(lines(docs, batches, least_points), "lines", "batch")
    n_rows = found.count()
    runs = LineRuns(spark, max(1, -(-n_rows // BUCKET_LINES)), fanout)
    try:
        for i in range(batches):
            runs.add(runs.new_entries(entries_of(found.where(F.col("batch") == i)), settled=least_docs))
        common = scratch.write(runs.contents().where(F.col("n_docs") >= least_docs).select("hash", "n_docs", "last_doc"), "common")
    finally:
        runs.close()
    dropped = with_common(found, common, n_rows, limit).where("NOT doc_id <=> last_doc").groupBy("doc_id", "version").agg(F.sort_array(F.flatten(F.collect_set("line_nos"))).alias("dropped"))
    dropped = scratch.write(dropped, "dropped")
    scratch.drop("lines")
    scratch.drop("common")
    size = dropped.agg(F.sum(F.size("dropped") * 4 + 40)).first()[0] or 0
    return dropped, size


def kept_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, least_points: int = LEAST_POINTS, texts: bool = True, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every document without the lines that repeat across documents.

    A key (see line_key) of at least least_points code points that at least least_docs documents hold loses all its lines
    except those of the largest doc_id holding it. Returns doc_id, n_lines (before), n_dropped, kept_sha256 and, with
    texts, the kept text. Null or empty text is one empty line. Rows that repeat a doc_id count as one document, with a row
    each; all rows with a null doc_id count as one document that is never the largest. Very long texts are split whole, one at a
    time. An empty table gives no rows; other columns are ignored.
    """
    dropped, size = repeated_lines(docs, least_docs, batches, fanout, least_points, limit)
    docs = only(docs, "doc_id", "text")
    key = F.concat_ws(":", "doc_id", "version").alias("row_key")  # doc_id may be null
    joined = join_checked(docs.withColumn("version", F.xxhash64("text")).select(key, "doc_id", "text"), dropped.select(key, "dropped"), "row_key", "left", size, limit)

    def rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in text_batches(it):
            n_lines, n_dropped, digest, kept = [], [], [], []
            for text, gone in zip(found, part.column("dropped").to_pylist(), strict=True):
                rows = text.split(b"\n")
                n_lines.append(len(rows))
                n_dropped.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    text = b"\n".join(x for i, x in enumerate(rows) if i not in gone)
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.record_batch([*columns, pa.array(kept, pa.binary()).cast(pa.string())] if texts else columns, names=[*names, "text"] if texts else names)

    return joined.mapInArrow(rebuild, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * texts)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP3_SQL = r"""
WITH listed AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM listed
), common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line_no, k.line, c.key IS NOT NULL AND c.last_doc <> k.doc_id AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
