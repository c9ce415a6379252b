"""Exact dedup by a minimal perfect hash over the distinct digests seen before.

The history's distinct digests are dealt into buckets of bounded size. Each bucket is one index row: a levelled bit-array
minimal perfect hash (every level places the keys that collide with no other, the rest go to the next level; a slot is the
rank of the placed bit) and, by slot, the full 32-byte digest, the winner's locator and the group's size. A batch is first
reduced to its distinct digests, so copies never travel; each digest is looked up in its bucket and compared byte by byte
with the slot's, since the hash maps strangers to some slot too. Members join the slot's group, nonmembers group separately.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.util import SPACE_CLASS, Scratch, join_checked, only

#: Digests in an index bucket, about; a bucket is built and searched in one task's memory (about 100 bytes a digest).
BUCKET_DIGESTS = 40_000
#: Bits of a level's array for each key that it still has to place.
GAMMA = 2.0

GROUP_SCHEMA = "digest binary, best_points long, best_id long, group_size long, seen_before boolean"


def normalised(text: Column) -> Column:
    """The text without any of the six ASCII white-space characters; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text, 32 bytes) and code points of the original text."""
    text = F.col("text")
    return only(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_points"))


def groups(digest_rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the best row's points and id, and the size. Combined on the map side, so copies don't pile up.

    Most code points win, then the smallest doc_id; a null doc_id loses to any other.
    """
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus_id")))
    return digest_rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.n_points").alias("best_points"), (-F.col("best.minus_id")).alias("best_id"), "group_size")


def _words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 4)


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of digests for a level: a multiply-and-shift mix of two of the digest's words."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] + words[:, (level + 1) % 4] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: slots 0 to n - 1. Anything else gets a slot too, or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of booleans
        self.before = np.cumsum([0] + [int(x.sum()) for x in levels])[:-1]
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """Raises ValueError on repeated keys, which no level could tell apart."""
        if len(set(keys)) != len(keys):
            raise ValueError("keys repeat")
        left, levels = _words(keys), []
        while len(left):
            size = max(64, int(len(left) * GAMMA))
            at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        words = _words(keys)
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_mixed(words[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return found

    def to_bytes(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def from_bytes(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in levels])


INDEX_SCHEMA = "bucket int, levels array<binary>, slots binary, best_points array<long>, best_id array<long>, group_size array<long>"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _build_bucket(key: tuple, table: pa.Table) -> pa.Table:
    keys = table["digest"].to_pylist()
    order = np.argsort((found := PerfectHash.build(keys)).slots(keys))
    by_slot = table.take(pa.array(order))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "levels": [found.to_bytes()], "slots": [b"".join(by_slot["digest"].to_pylist())], **{c: [by_slot[c].to_pylist()] for c in ("best_points", "best_id", "group_size")}})


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index of history groups (see groups()): one row per bucket."""
    return history.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(_build_bucket, INDEX_SCHEMA)


def _better(points: int, doc: int | None, other_points: int, other: int | None) -> bool:
    if points != other_points:
        return points > other_points
    return doc is not None and (other is None or doc < other)


def _absorb_bucket(index: pa.Table, batch: pa.Table) -> pa.Table:
    """All groups of a bucket after the batch: the slots, updated by members, and the nonmembers."""
    out: dict[str, list] = {"digest": [], "best_points": [], "best_id": [], "group_size": [], "seen_before": []}
    if index.num_rows:
        row = index.to_pylist()[0]
        out |= {"digest": [row["slots"][i : i + 32] for i in range(0, len(row["slots"]), 32)], **{c: list(row[c]) for c in ("best_points", "best_id", "group_size")}}
        out["seen_before"] = [True] * len(out["digest"])
    known = len(out["digest"])
    keys = batch["digest"].to_pylist()
    slots = PerfectHash.from_bytes(row["levels"]).slots(keys).tolist() if known and keys else [-1] * len(keys)
    for slot, key, points, doc, size in zip(slots, keys, *(batch[c].to_pylist() for c in ("best_points", "best_id", "group_size")), strict=True):
        if slot >= 0 and out["digest"][slot] == key:  # byte-checked: a stranger's slot holds another digest
            out["group_size"][slot] += size
            if _better(points, doc, out["best_points"][slot], out["best_id"][slot]):
                out["best_points"][slot], out["best_id"][slot] = points, doc
        else:
            for name, value in zip(out, (key, points, doc, size, False), strict=True):
                out[name].append(value)
    return pa.table(out, schema=pa.schema([("digest", pa.binary()), ("best_points", pa.int64()), ("best_id", pa.int64()), ("group_size", pa.int64()), ("seen_before", pa.bool_())]))


def absorb(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """Looks the batch's groups up in the index; returns all groups, seen before or new."""
    return index.groupBy("bucket").cogroup(batch.withColumn("bucket", _bucket(buckets)).groupBy("bucket")).applyInArrow(_absorb_bucket, GROUP_SCHEMA)


def dedup(history: DataFrame, batch: DataFrame, bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """Every row of history and batch with its group of equal texts.

    Both frames have doc_id and text; other columns are ignored. Texts are equal if identical without ASCII white space;
    null counts as empty. Returns doc_id, keep_id, group_size, kept, text_sha256, seen_before (the text is in the history).
    Empty frames give no rows. Repeated rows count once each in group_size and get a row each. A null doc_id loses every
    tie; where all rows of a group have none, keep_id is null and none of its rows is kept except if it is alone.
    """
    scratch = Scratch(history.sparkSession, "exact")
    both = scratch.write(digests(history).withColumn("part", F.lit(0)).unionByName(digests(batch).withColumn("part", F.lit(1))), "digests")
    old = scratch.write(groups(both.where("part = 0")), "history")
    new = scratch.write(groups(both.where("part = 1")), "batch")
    buckets = max(1, -(-max(old.count(), new.count()) // bucket_digests))
    index = scratch.write(build_index(old, buckets), "index")
    resolved = absorb(index, new, buckets)
    kept = F.coalesce(F.col("doc_id") == F.col("best_id"), F.col("group_size") == 1)
    return both.join(resolved, "digest").select("doc_id", F.col("best_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "seen_before")


def dedup_table(docs: DataFrame, bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """dedup() of one table, taken in two batches by a hash of doc_id: the first is the history that the second is held against."""
    first = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) < (1 << 31)
    return dedup(docs.where(first), docs.where(~first), bucket_digests)


def without_copies(docs: DataFrame, **options: int) -> DataFrame:
    """The documents, all columns, of which exactly one row of each group of equal texts stays.

    That is the row with the most code points, then with the smallest doc_id (nulls last), then any of those equal in both.
    Rows that share a doc_id but not the text are different documents. Null, empty and blank texts are equal; very long ones
    are compared whole. An empty table gives no rows; column names may clash with the operator's own.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    found = scratch.write(dedup_table(docs, **options).where("group_size > 1").select("doc_id", "keep_id", "kept", "text_sha256"), "grouped")
    # More than one row of a group may bear the winner's doc_id, and where none has a doc_id, none is the winner.
    tied = scratch.write(found.where("kept OR keep_id IS NULL").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("text_sha256"), "tied")
    gone = scratch.write(found.where("NOT kept").join(tied, "text_sha256", "left_anti").select("doc_id", "text_sha256").distinct(), "gone")
    key, turn = (f"_folio_{name}" + "_" * max([0, *map(len, docs.columns)]) for name in ("key", "turn"))  # no document column's name
    row_key = lambda doc_id, digest: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), digest)
    marked = docs.withColumn(key, F.sha2(normalised(F.col("text")), 256))
    n_tied = tied.count()
    some = None
    if n_tied:
        groups_tied = tied.select(F.col("text_sha256").alias(key))
        some = join_checked(marked, groups_tied, key, "left_semi", 80 * n_tied)
        marked = join_checked(marked, groups_tied, key, "left_anti", 80 * n_tied)
        order = F.struct(-F.coalesce(F.char_length("text"), F.lit(0)), F.col("doc_id").isNull(), F.col("doc_id"))
        # The rank filter keeps a row per group and task before anything is shuffled.
        some = some.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(turn) == 1).drop(turn)
    marked = marked.withColumn(key, row_key(F.col("doc_id"), F.col(key)))
    left = join_checked(marked, gone.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(key)), key, "left_anti", 96 * gone.count())
    out = left if some is None else left.unionByName(some)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_table(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("seen_before")


OP2_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""
