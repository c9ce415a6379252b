"""All pairs of similar texts by prefix filter: no fingerprint, sample or bucket size decides which pairs are found.

In any one order of all shingles, two sets with a Jaccard similarity of t or more share one of the first |x| - ceil(t |x|) + 1
shingles of each. The order puts shingles that a bounded sample shows often last, so that keys stay selective; it decides cost
only, never results. Members of a bucket that are not yet in one group are all compared, by size and by the parities of 512
hash classes (which differ at most as often as the sets do): both only ever turn away pairs that can't hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.util import Scratch, bounded_batches, join_checked, lean, only, text_batches

SEED, SKETCH_BITS = 42, 512
#: Classes of the sketch that a bucket's rows carry for sets longer than the first one tells apart, as a power of two.
ROW_BITS = 11
#: Documents from which common shingles are told, and how many of those are ordered last at most.
SAMPLE, MOST_COMMON = 10_000, 200_000
#: Rows of a bucket's block: every two blocks of a bucket are compared in a unit of their own.
BLOCK = 1024
#: Pairs that a bucket task holds before it hands them on.
HELD_PAIRS = 200_000


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, ascending; fewer words than a shingle make one."""
    own = text.lower().split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(own[i : i + words]), SEED) for i in range(max(1, len(own) - words + 1))], np.uint64))


def prefix_length(n: int, similarity: float) -> int:
    return n - ceil(similarity * n - 1e-9) + 1


def sketch(own: np.ndarray) -> bytes:
    """A bit per class of hashes: whether an odd number of the set is in it."""
    return np.packbits((np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool)).tobytes()


def fine_sketch(own: np.ndarray, most: int = 20) -> bytes:
    """The same over at least as many classes as the set has hashes (a power of two, up to 2 ** most): parities that long
    sets need, since a few hundred classes fill up."""
    bits = min(most, max(9, (len(own) - 1).bit_length()))
    return np.packbits((np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(bool)).tobytes()


def odd_classes(a: bytes, b: bytes) -> int:
    """In how many classes of the coarser of two fine sketches the sets' parities differ: at most in as many hashes the sets do."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(n, -1), axis=1) for s in (x, y))
    return int((x ^ y).sum())


def common(docs: DataFrame, words: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; counts) of shingles that are frequent in a sample of n documents."""
    bounded_batches(docs.sparkSession)

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(it):
            yield pa.record_batch([pa.array(np.concatenate([shingles(x, words) for x in texts]).view(np.int64))], names=["shingle"])

    some = only(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0)
    counts = some.mapInArrow(lean(listed), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 2")
    rows = counts.orderBy(F.desc("held"), "shingle").limit(MOST_COMMON).toArrow()
    hashes = rows["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["held"].to_numpy().astype(np.int64)[order]


def prefixes(docs: DataFrame, words: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, size, whole (a hash of the set), sketch, middle (empty for short sets), fine, keys (the set's prefix in the common order)."""
    bounded_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(often)

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = told.value
        for part, texts in text_batches(it):
            sizes, wholes, sketches, middle, fine, keys = [], [], [], [], [], []
            for text in texts:
                own = shingles(text, words)
                rank = np.zeros(len(own), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    rank = np.where(hashes[at] == own, held[at], 0)
                sizes.append(len(own))
                wholes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sketches.append(sketch(own))
                middle.append(fine_sketch(own, ROW_BITS) if len(own) > SKETCH_BITS else b"")
                fine.append(fine_sketch(own))
                keys.append(own[np.lexsort((own, rank))[: prefix_length(len(own), similarity)]].view(np.int64))
            whole = pa.array(np.array(wholes, np.uint64).view(np.int64))
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), whole, pa.array(sketches, pa.binary()), pa.array(middle, pa.binary()), pa.array(fine, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "size", "whole", "sketch", "middle", "fine", "keys"])

    return only(docs, "doc_id", "text").mapInArrow(lean(listed), "doc_id long, size long, whole long, sketch binary, middle binary, fine binary, keys array<long>")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their doc_id by labels (node, label), itself where it has none."""
    own = labels.select(F.col("node").alias("doc_id"), "label")
    return join_checked(rows, own, "doc_id", "left", 16 * own.count()).withColumn("label", F.coalesce("label", "doc_id"))


def crossing(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows (key, doc_id, label, held) of keys that documents of different groups share; held counts the key's rows.

    Keys are counted on the map side; those that remain are broadcast where they are few, else the join's large side can be
    split: no key has a task to itself.
    """
    bounds = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("held")).where("least <> most")
    bounds = scratch.write(bounds.select("key", "held"), f"{name}-keys")
    return scratch.write(join_checked(rows, bounds, "key", "inner", 24 * bounds.count()).select("key", "doc_id", "label", "held"), name)


def compared(at_key: np.ndarray, doc: np.ndarray, label: np.ndarray, size: np.ndarray, marks: np.ndarray, middle: list[bytes], similarity: float, nearest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of documents of a bucket with different labels that may hold; of nearest neighbours only, if given.

    Rows are ordered by key, and by size if all are compared.
    """
    end = np.searchsorted(at_key, at_key, side="right")
    found: list[np.ndarray] = []
    held, at, step = 0, np.arange(len(doc)), 1

    def taken() -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate(found, axis=1)
        found.clear()
        ends = doc[rows]
        both, first = np.unique(np.stack([ends.max(axis=0), ends.min(axis=0)]), axis=1, return_index=True)
        # Where both sets are too long for the sketch that is compared at once, a finer one decides, once a pair.
        a, b = rows[0, first], rows[1, first]
        keep = np.ones(len(a), bool)
        for k in np.flatnonzero(np.minimum(size[a], size[b]) > SKETCH_BITS).tolist():
            x, y = int(a[k]), int(b[k])
            keep[k] = odd_classes(middle[x], middle[y]) <= (1 - similarity) / (1 + similarity) * (size[x] + size[y]) + 1e-9
        return both[0, keep], both[1, keep]

    while len(at := at[at + step < end[at]]) and (step <= nearest or not nearest):
        if not nearest:
            at = at[size[at] >= similarity * size[at + step] - 1e-9]  # sizes only grow from here
        a = at[label[at] != label[at + step]]
        b = a + step
        bits = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64)
        fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        fits &= bits <= (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-9
        a, b = a[fits], b[fits]
        if len(a):
            found.append(np.stack([a, b]))
            held += len(a)
            if held > HELD_PAIRS:
                yield taken()
                held = 0
        step += 1
    if found:
        yield taken()


def near_enough(pairs: DataFrame, listed: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that sizes and fine sketches don't turn away; these are far smaller than the sets."""

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_size", "b_size", "a_fine", "b_fine")), strict=True):
                if min(n, m) >= similarity * max(n, m) - 1e-9 and odd_classes(x, y) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9:
                    found.append((a, b))
            yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    bounded_batches(pairs.sparkSession)
    for end in ("a", "b"):
        pairs = pairs.join(listed.select(F.col("doc_id").alias(end), F.col("size").alias(f"{end}_size"), F.col("fine").alias(f"{end}_fine")), end)
    return pairs.select("a", "b", "a_size", "b_size", "a_fine", "b_fine").mapInArrow(lean(kept), "a long, b long")


def in_blocks(rows: DataFrame, block: int, pairwise: bool) -> DataFrame:
    """Adds unit to rows (key, doc_id, held): the row's block of its bucket; pairwise, every pair of blocks that it is in."""
    n = F.ceil(F.col("held") / block).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "key"), n).cast("long")
    if not pairwise:
        return rows.withColumn("unit", own)
    pair = lambda i: F.least(own, i.cast("long")) * (1 << 31) + F.greatest(own, i.cast("long"))
    return rows.withColumn("unit", F.explode(F.transform(F.sequence(F.lit(0), n - 1), pair)))


def candidates(rows: DataFrame, listed: DataFrame, similarity: float, tasks: int, nearest: int = 0, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) from crossing() rows: all that may hold, or those with some neighbours in each block if `nearest` is given.

    No task holds a bucket: it is dealt into blocks by a hash, and to find all pairs every two blocks meet in a unit.
    """

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held and sum(x.num_rows for x in held) else None
            held.clear()
            if table is None:
                return
            key, unit, doc, label, size = (table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "unit", "doc_id", "label", "size"))
            at_key = np.concatenate([[0], (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]).cumsum()
            whole = len(key) if last else int(np.searchsorted(at_key, at_key[-1]))  # the last bucket may go on
            if whole < len(key):
                held.append(table.slice(whole))
            if whole:
                marks = np.frombuffer(b"".join(table.column("sketch").slice(0, whole).to_pylist()), np.uint64).reshape(whole, -1)
                middle = table.column("middle").slice(0, whole).to_pylist()
                for a, b in compared(at_key[:whole], doc[:whole], label[:whole], size[:whole], marks, middle, similarity, nearest):
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        size, least = 0, 20_000
        for batch in it:
            held.append(batch)
            size += batch.num_rows
            if size >= least:
                yield from cut(False)
                size = sum(x.num_rows for x in held)
                least = max(20_000, 2 * size)
        yield from cut(True)

    rows = in_blocks(rows.join(listed.select("doc_id", "size", "sketch", "middle"), "doc_id"), block, not nearest)
    order = F.xxhash64("key", "doc_id") if nearest else F.col("size")
    return rows.repartition(tasks, "key", "unit").sortWithinPartitions("key", "unit", order, "doc_id").mapInArrow(lean(pairs), "a long, b long").distinct()
