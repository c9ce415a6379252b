"""Sinks: atomic text files from executors, the state as Parquet, its JSON export, pruning."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from folio.operators.planning import prunable
from folio.schema import PIPELINE_VERSION, RECORD, SCHEMA_VERSION


def write_atomic(path: str, chunks: str | Iterable[str]) -> None:
    """Through a temporary file beside the target, so that readers see the old or the new text."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=".folio-", suffix=".tmp", dir=os.path.dirname(path))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            for chunk in [chunks] if isinstance(chunks, str) else chunks:
                file.write(chunk)
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def write_texts(texts: DataFrame) -> int:
    """Writes (target, text) from the executors; the number written."""

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for target, text in zip(batch.column("target").to_pylist(), batch.column("text").to_pylist(), strict=True):
                write_atomic(target, text)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return texts.select("target", "text").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def copy_files(files: DataFrame) -> int:
    """Copies (path, target) with their times, where the target differs."""

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, target in zip(batch.column("path").to_pylist(), batch.column("target").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                shutil.copy2(path, target + ".folio-tmp")
                os.replace(target + ".folio-tmp", target)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("path", "target").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def save_state(records: DataFrame, artifacts: DataFrame, meta_dir: str) -> None:
    """Stages the new state beside the old one, then swaps."""
    new, now = f"{meta_dir}/state.new", f"{meta_dir}/state"
    shutil.rmtree(new, ignore_errors=True)
    records.write.parquet(f"file://{new}/records")
    artifacts.write.parquet(f"file://{new}/artifacts")
    old = f"{meta_dir}/state.old"
    shutil.rmtree(old, ignore_errors=True)
    if os.path.exists(now):
        os.rename(now, old)
    os.rename(new, now)
    shutil.rmtree(old, ignore_errors=True)


def load_state(spark: SparkSession, meta_dir: str) -> tuple[DataFrame, DataFrame, bool]:
    """(records, artifacts, found): empty where there is no state or it can't be read.

    Where a run was cut off while it swapped states, the one before counts; without either, MANIFEST.json is read.
    """
    for name in ("state", "state.old"):
        with contextlib.suppress(Exception):  # a missing or damaged state is no state
            records = spark.read.schema(RECORD).parquet(f"file://{meta_dir}/{name}/records")
            artifacts = spark.read.schema("target string").parquet(f"file://{meta_dir}/{name}/artifacts")
            records.limit(1).count()
            return records, artifacts, True
    with contextlib.suppress(Exception):
        return *read_manifest(spark, meta_dir), True
    return spark.createDataFrame([], RECORD), spark.createDataFrame([], "target string"), False


def read_manifest(spark: SparkSession, meta_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, artifacts) of MANIFEST.json, as export_manifest() writes it: a line for each. ValueError if it isn't one."""
    lines = spark.read.text(f"file://{meta_dir}/MANIFEST.json")
    head = lines.where(F.col("value").startswith('{"schema_version": ')).first()
    if head is None or json.loads(head["value"].rsplit(', "artifacts": [', 1)[0] + "}")["schema_version"] != SCHEMA_VERSION:
        raise ValueError("no manifest of this version")
    body = F.regexp_extract("value", r'^"(?:[^"\\]|\\.)*": (\{.*\}),?$', 1)
    marked = lines.where(F.col("value").startswith('"')).select("value", body.alias("body"))
    records = marked.where("body <> ''").select(F.from_json("body", RECORD).alias("r")).select("r.*")
    rel = F.from_json(F.concat(F.lit("["), F.regexp_replace("value", ",$", ""), F.lit("]")), "array<string>")[0]
    above = os.path.dirname(meta_dir)
    target = F.when(F.col("rel").startswith("../"), F.concat(F.lit(above + "/"), F.expr("substring(rel, 4)"))).otherwise(F.concat(F.lit(meta_dir + "/"), F.col("rel")))
    artifacts = marked.where("body = ''").select(rel.alias("rel")).select(target.alias("target"))
    return records, artifacts


def export_manifest(records: DataFrame, artifacts: DataFrame, meta_dir: str, head: dict) -> None:
    """MANIFEST.json: head, artifacts in order, files by rel, a record at a time."""

    def parts() -> Iterator[str]:
        yield json.dumps({"schema_version": SCHEMA_VERSION, "pipeline_version": PIPELINE_VERSION, **head}, ensure_ascii=False)[:-1]
        yield ', "artifacts": ['
        for i, row in enumerate(artifacts.orderBy("target").toLocalIterator()):
            yield (",\n" if i else "\n") + json.dumps(os.path.relpath(row["target"], meta_dir), ensure_ascii=False)
        yield '\n], "files": {'
        rows: Iterator[Row] = records.select("rel", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).orderBy("rel").toLocalIterator()
        for i, row in enumerate(rows):
            yield (",\n" if i else "\n") + json.dumps(row["rel"], ensure_ascii=False) + ": " + row["j"]
        yield "\n}}\n"

    write_atomic(f"{meta_dir}/MANIFEST.json", parts())


def pruned(orphans: DataFrame, roots: list[str]) -> DataFrame:
    """Deletes, in tasks, those of the orphans (target, generated) that planning.prunable() allows: (target) of what is gone."""
    real_roots = [os.path.realpath(r) for r in roots]

    def resolve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            real = [os.path.realpath(x) for x in batch.column("target").to_pylist()]
            yield batch.append_column("path", pa.array(real, pa.string())).append_column("exists", pa.array([os.path.isfile(x) for x in real], pa.bool_()))

    def unlink(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            gone = []
            for target, path in zip(batch.column("target").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with contextlib.suppress(OSError):  # what can't be deleted stays an orphan
                    os.unlink(path)
                    gone.append(target)
            yield pa.record_batch([pa.array(gone, pa.string())], names=["target"])

    found = orphans.select("target", "generated").mapInArrow(resolve, "target string, generated boolean, path string, exists boolean")
    return prunable(found, real_roots).where("deletable").select("target", "path").mapInArrow(unlink, "target string")


def write_sections(rows: DataFrame) -> int:
    """Writes files of many rows each, from the tasks: rows (path, head, place, row), each file's rows in the order of place."""

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        rows = (x for batch in it for x in zip(*(batch.column(c).to_pylist() for c in ("path", "head", "row")), strict=True))
        for path, own in groupby(rows, key=lambda x: x[0]):

            def chunks(own: Iterator = own) -> Iterator[str]:
                for i, (_, head, row) in enumerate(own):
                    yield (head if i == 0 else "") + row + "\n"

            write_atomic(path, chunks())
            n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return rows.repartition("path").sortWithinPartitions("path", "place").select("path", "head", "row").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
