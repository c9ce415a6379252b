"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints that differ in at most T bits must, for parts of the bits with thresholds t_i whose sum of (t_i + 1) is T + 1,
differ in at most t_i bits in some part. Correlated bits are put in one part, so that the other parts stay selective, and the
thresholds (-1 skips a part) come from a dynamic program over candidate counts estimated from a bounded sample of
fingerprints; the plan decides cost only, never results. Distinct fingerprints are probed by their parts' values (with one
bit masked for t_i = 1) and verified. A bucket of some size is compared block by block, each two blocks apart from the others,
in tasks of their own. A bucket too large for that is split by masking every two of its free bits, which
leaves at most four fingerprints together, all of them linked: no bucket ever emits all its pairs.
Links are closed to components by rounds of hooking and contraction over tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import jaccard
from folio.llm.util import Scratch, bounded_batches, join_checked, lean, only, text_batches

BITS, SEED = 64, 42
WORDS, MOST_BITS = 3, 2
#: Distinct fingerprints from which the plan is estimated; fingerprints of a bucket that are compared pairwise.
PLAN_SAMPLE, PAIR_BUCKET = 20_000, 2048
#: Rows of a bucket's block: larger buckets are compared block by block, each two blocks in a unit of their own.
BLOCK = 128
#: Fingerprints of a bucket that are compared where more bits are allowed and texts are checked afterwards.
WIDE_BUCKET = 1024
#: Neighbours in a prefix filter's bucket that are looked at before all are.
NEAREST = 4
#: Costs of a key row (about 4.5 microseconds) and of a comparison (about 9 nanoseconds), relative to each other.
KEY_COST, PAIR_COST = 1.0, 0.002


def fingerprint(text: bytes, words: int = WORDS) -> bytes:
    """8 bytes, most significant first: a bit is set if it is in over half of the shingles' XXH64; no words: zero."""
    own = text.lower().split()
    if not own:
        return bytes(8)
    joined = b" ".join(own)
    # Words stand one byte apart in `joined`, so a shingle is one slice of it.
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in own)]
    starts = [0, *(x + 1 for x in ends[:-1])]
    ends = ends[min(words, len(own)) - 1 :]
    votes, n, digest = np.zeros(BITS, np.int64), len(ends), xxhash.xxh64_digest
    for at in range(0, n, 1 << 15):
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=False)])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > n).tobytes()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(it):
            found = np.frombuffer(b"".join([fingerprint(x, words) for x in texts]), ">i8").astype(np.int64)
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(lean(marked), "doc_id long, fp long")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]  # 0 is the least significant
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def _coincidences(values: np.ndarray) -> float:
    """The share of pairs with equal values."""
    counts = np.unique(values, return_counts=True)[1].astype(float)
    n = len(values)
    return float((counts * (counts - 1)).sum() / max(1, n * (n - 1)))


def group_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Deals the bits to parts of nearly equal width, correlated bits together: each part grows by the bit closest to its own."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    close = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-9)
    still = spread < 1e-9  # bits that never change tell nothing: together
    close[np.ix_(still, still)] = 1
    left, out = set(range(BITS)), []
    for i in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - i)
        own = [max(left, key=lambda b: (close[b, sorted(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < width:
            best = max(left, key=lambda b: (close[b, own].mean(), -b))
            own.append(best)
            left.discard(best)
        out.append(tuple(sorted(own)))
    return out


def plan(sample: np.ndarray, n: int, most_bits: int = MOST_BITS) -> list[Part]:
    """The parts and thresholds of least estimated cost for n distinct fingerprints, of which sample is a sample."""
    sample = sample if len(sample) > 1 else np.zeros(2, np.uint64)
    best: tuple[float, list[Part]] = (float("inf"), [])
    for m in range(max(2, (most_bits + 2) // 2), most_bits + 3):
        groups = group_bits(sample, m)
        costs = []
        for own in groups:
            mask = np.uint64(sum(1 << b for b in own))
            masked = [_coincidences(sample & (mask ^ np.uint64(1 << b))) for b in own]
            costs.append((0.0, KEY_COST * n + PAIR_COST * n * n / 2 * _coincidences(sample & mask), KEY_COST * n * len(own) + PAIR_COST * n * n / 2 * sum(masked)))
        # reach[k]: the least cost so far with thresholds whose sum of (t + 1) is k.
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for k, (so_far, chosen) in reach.items():
                for t in (-1, 0, 1):
                    if k + t + 1 <= most_bits + 1 and (k + t + 1 not in after or so_far + cost[t + 1] < after[k + t + 1][0]):
                        after[k + t + 1] = (so_far + cost[t + 1], [*chosen, t])
            reach = after
        if most_bits + 1 in reach and reach[most_bits + 1][0] < best[0]:
            best = (reach[most_bits + 1][0], [Part(g, t) for g, t in zip(groups, reach[most_bits + 1][1], strict=True) if t >= 0])
    return best[1]


KEY_SCHEMA = "part int, value long, fp long"


def in_units(shared: DataFrame, rows: str, size: str = "size", block: int = BLOCK) -> DataFrame:
    """Adds unit to rows of buckets whose size is known, so that no task needs to hold a bucket.

    A bucket is dealt into blocks of about `block` rows by a hash of the column `rows`; a row goes to one unit for each block
    of its bucket, so every two rows meet in at least one unit, and no unit has more than two blocks.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(rows), n).cast("long")
    other = lambda i: F.least(own, i.cast("long")) * (1 << 31) + F.greatest(own, i.cast("long"))
    return shared.withColumn("unit", F.explode(F.transform(F.sequence(F.lit(0), n - 1), other)))


def _rows(part: list[np.ndarray], value: list[np.ndarray], fp: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
    return pa.record_batch([pa.array(join(part, np.int32)), pa.array(join(value, np.int64)), pa.array(join(fp, np.int64))], names=["part", "value", "fp"])


def _unsigned(batch: pa.RecordBatch, column: str = "fp") -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def key_masks(parts: list[Part]) -> list[tuple[int, int]]:
    """(number, mask) of a fingerprint's probe keys: for threshold 0 the part's bits, for 1 the part's bits but one, for each."""
    masks = []
    for i, part in enumerate(parts):
        masks += [(i * 65, part.mask)] if part.threshold == 0 else [(i * 65 + 1 + b, part.mask ^ (1 << b)) for b in part.bits]
    return masks


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crowded_keys(sample: np.ndarray, n: int, parts: list[Part], pair_bucket: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By key number: the values that far more than pair_bucket of n fingerprints have, by the sample, and into how many they are dealt."""
    out = {}
    least = 8 if len(sample) < n else 1
    for number, mask in key_masks(parts):
        values, counts = np.unique(sample & np.uint64(mask), return_counts=True)
        size = counts * (n / max(1, len(sample)))
        crowded = (size > pair_bucket) & (counts >= least)
        if crowded.any():
            out[number] = (values[crowded], np.ceil(2 * size[crowded] / pair_bucket).astype(np.uint64))
    return out


def part_keys(fps: DataFrame, parts: list[Part], crowded: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """The probe keys (part, value, fp) of fingerprints. Values of `crowded` are dealt into several by a hash of fingerprint and key."""
    masks = key_masks(parts)

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = _unsigned(batch)
            values = []
            for number, mask in masks:
                own = fp & np.uint64(mask)
                if crowded and number in crowded:
                    known, deals = crowded[number]
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    deal = _mixed(fp ^ _mixed(np.full(len(fp), number + 1, np.uint64))) % deals[at]
                    own = np.where(known[at] == own, _mixed(own ^ _mixed(deal + np.uint64(1))), own)
                values.append(own.view(np.int64))
            yield _rows([np.full(len(fp), i) for i, _ in masks], values, [fp.view(np.int64)] * len(masks))

    return fps.select("fp").mapInArrow(keyed, KEY_SCHEMA)


def fold(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links (a, b), given what it reached before."""
    label = np.arange(n) if label is None else label
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for ends in (label[a], label[b], a, b):
            np.minimum.at(after, ends, least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _star(fp: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    linked = label != np.arange(len(fp))
    return pa.record_batch([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], names=["a", "b"])


def by_buckets(buckets: DataFrame, compare, tasks: int, block: int = 1 << 62) -> DataFrame:
    """Links (a, b) that compare(group, fp) finds; group are ascending numbers of the rows' units (of part, value, unit, fp), whole
    ones, some at a time.

    A unit of more than `block` rows is cut into blocks of as many neighbouring fingerprints.
    """

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held and sum(x.num_rows for x in held) else None
            held.clear()
            if table is None:
                return
            part, value, unit, fp = (table.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "unit", "fp"))
            new = np.concatenate([[0], (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (unit[1:] != unit[:-1])]).cumsum()
            place = (np.arange(len(new)) - np.searchsorted(new, new)) // block
            new = np.concatenate([[0], (new[1:] != new[:-1]) | (place[1:] != place[:-1])]).cumsum()
            whole = len(fp) if last else int(np.searchsorted(new, new[-1]))  # the last bucket may go on
            if whole < len(fp):
                held.append(table.slice(whole))
            if whole:
                yield compare(new[:whole], fp[:whole].astype(np.int64).view(np.uint64))

        for batch in it:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 20_000:
                yield from cut(False)
        yield from cut(True)

    return buckets.repartition(tasks, "part", "value", "unit").sortWithinPartitions("part", "value", "unit", "fp").mapInArrow(lean(links), "a long, b long")


def verified_links(buckets: DataFrame, most_bits: int, tasks: int) -> DataFrame:
    """Links inside units of bounded size: compared pairwise, given as a star per component of a unit."""

    def compare(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        n = len(fp)
        end = np.searchsorted(group, group, side="right")
        label, at, step = np.arange(n), np.arange(n), 1
        while len(at := at[at + step < end[at]]):
            near = np.bitwise_count(fp[at] ^ fp[at + step]) <= most_bits
            if near.any():
                label = fold(n, at[near], at[near] + step, label)
            step += 1
        return _star(fp, label)

    return by_buckets(buckets, compare, tasks)


def forest(n: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a spanning forest of least bits over n positions."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    chosen: list[int] = []
    left, size = np.argsort(bits, kind="stable"), 256
    while len(left):
        for k in left[:size].tolist():
            x, y = root(int(a[k])), root(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                chosen.append(k)
        # Most of the rest lies inside of components by now.
        label = np.array(parent)
        while not np.array_equal(label, label := label[label]):
            pass
        left, size = left[size:], 2 * size
        left = left[label[a[left]] != label[b[left]]]
    return np.array(chosen, np.int64)


def forest_links(buckets: DataFrame, most_bits: int, tasks: int, block: int) -> DataFrame:
    """Links inside buckets, or blocks of large ones: a spanning forest of each, of least differing bits.

    Whatever hangs together at any number of bits up to most_bits also does over links of the forest with no more bits. Near
    pairs are held some hundred thousand at a time: with the forest so far, they give the next.
    """

    def compare(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        n = len(fp)
        end = np.searchsorted(group, group, side="right")
        links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def thin() -> None:
            a, b, bits = (np.concatenate(x) for x in zip(*links, strict=True))
            kept = forest(n, a, b, bits)
            links[:] = [(a[kept], b[kept], bits[kept])]

        held, at, step = 0, np.arange(n), 1
        while len(at := at[at + step < end[at]]):
            bits = np.bitwise_count(fp[at] ^ fp[at + step])
            near = bits <= most_bits
            if near.any():
                links.append((at[near], at[near] + step, bits[near]))
                held += len(links[-1][0])
                if held > 300_000:
                    thin()
                    held = len(links[0][0])
            step += 1
        if links:
            thin()
        a, b = links[0][:2] if links else (np.empty(0, np.int64),) * 2
        return pa.record_batch([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    return by_buckets(buckets, compare, tasks, block)


def masked_links(crowded: DataFrame, parts: list[Part], most_bits: int, tasks: int) -> DataFrame:
    """Links inside buckets of any size: all fingerprints that agree outside of some `most_bits` free bits, as stars.

    Two members of a bucket agree on the bits of its key, so they link if and only if they agree under some mask of that many
    other bits. Such a mask leaves at most 2 ** most_bits fingerprints together.
    """

    def masked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                fp, kinds = _unsigned(batch), batch.column("part").to_numpy(zero_copy_only=False)
                out: tuple[list, list, list] = ([], [], [])
                for kind in np.unique(kinds).tolist():
                    own, part = fp[kinds == kind], parts[kind // 65]
                    fixed = set(part.bits) - {kind % 65 - 1}
                    for some in combinations([b for b in range(BITS) if b not in fixed], most_bits):
                        code = 0
                        for b in some:
                            code = code * BITS + b
                        out[0].append(np.full(len(own), code))
                        out[1].append((own & ~np.uint64(sum(1 << b for b in some))).view(np.int64))
                        out[2].append(own.view(np.int64))
                yield _rows(*out)

    def stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple = (None, None, None)
        for batch in it:
            a, b = [], []
            for part, value, fp in zip(*(batch.column(c).to_pylist() for c in ("part", "value", "fp")), strict=True):
                if before[:2] == (part, value):
                    if fp != before[2]:
                        a.append(fp)
                        b.append(before[2])
                else:
                    before = (part, value, fp)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return crowded.mapInArrow(masked, KEY_SCHEMA).repartition(tasks, "part", "value").sortWithinPartitions("part", "value", "fp").mapInArrow(stars, "a long, b long")


def _planned(fps: DataFrame, most_bits: int, sample: int) -> tuple[int, np.ndarray, list[Part]]:
    """The number of fingerprints, the bounded sample and the plan."""
    n = fps.count()
    rows = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    found = np.array([x["fp"] for x in rows], np.int64).view(np.uint64)
    return n, found, plan(found, n, most_bits)


def _tasks(frame: DataFrame) -> int:
    return max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def links(fps: DataFrame, scratch: Scratch, most_bits: int = MOST_BITS, pair_bucket: int = PAIR_BUCKET, sample: int = PLAN_SAMPLE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within most_bits of each other, directly or over others."""
    tasks = _tasks(fps)
    _, _, parts = _planned(fps, most_bits, sample)
    keys = scratch.write(part_keys(fps, parts), "keys")
    sizes = scratch.write(keys.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = keys.join(sizes, ["part", "value"])
    found = verified_links(in_units(shared.where(F.col("size") <= pair_bucket), "fp").select("part", "value", "unit", "fp"), most_bits, tasks)
    if sizes.where(F.col("size") > pair_bucket).limit(1).count():
        found = found.unionByName(masked_links(shared.where(F.col("size") > pair_bucket).select("part", "fp"), parts, most_bits, tasks))
    return found


def wide_links(fps: DataFrame, most_bits: int, wide_bucket: int = WIDE_BUCKET, sample: int = PLAN_SAMPLE) -> DataFrame:
    """Links (a, b) within more bits than links() is meant for, as spanning forests, for a check of the texts.

    Masking every pair of bits would not do for large buckets here. Those that the sample shows are dealt into smaller ones, by
    another hash for each of a fingerprint's keys, others that turn out large are cut into blocks of neighbours:
    members of a dense group meet often, and links() holds their closest ones. Keys move once and are never written.
    """
    n, found, parts = _planned(fps, most_bits, sample)
    keys = part_keys(fps, parts, crowded_keys(found, n, parts, wide_bucket)).withColumn("unit", F.lit(0).cast("long"))
    return forest_links(keys, most_bits, _tasks(fps), wide_bucket)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of each component, for all nodes that have a link.

    Each round hooks every node to its smallest neighbour, follows the hooks a few steps and contracts the links; rounds end
    when no link is left. Nodes and links are only ever joined and aggregated as tables.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, hooks, i = scratch.write(ordered, "links-0"), [], 0
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), f"hooks-{i}")
        for k in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = scratch.write(hook.join(above, "up").select("node", F.col("top").alias("up")), f"hooks-{i}-{k}")
        hooks.append(hook)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(hook.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")), end)
        ordered = ends.where("a_up <> b_up").select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b")).distinct()
        i += 1
        edges = scratch.write(ordered, f"links-{i}")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = hooks[0].withColumnRenamed("up", "label")
    for hook in hooks[1:]:
        label = label.join(hook.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return label


def near_groups(docs: DataFrame, words: int = WORDS, most_bits: int = MOST_BITS, **options: int) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that is reachable over links, itself included) of every document.

    Fingerprints link at most_bits differing bits or fewer. Null, empty or blank text has the fingerprint zero, which links
    like any other; fewer words than a shingle make one shingle. Rows that repeat a doc_id get a row each; a null doc_id is
    never the smallest, and component_id is null if all of a component's are. An empty table gives no rows; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, words), "fingerprints")
    distinct = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    label = components(links(distinct.select("fp"), scratch, most_bits, **options), scratch)
    labelled = scratch.write(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return marked.join(labelled.join(smallest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles: the distinct hashes of the text's shingles."""
    bounded_batches(docs.sparkSession)

    def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(it):
            sets = [jaccard.shingles(text, words).view(np.int64) for text in texts]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return only(docs, "doc_id", "text").mapInArrow(lean(gathered), "doc_id long, shingles array<long>")


def held_pairs(docs: DataFrame, pairs: DataFrame, listed: DataFrame, words: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar: sets of shingles move only for pairs that sketches don't turn away."""
    pairs = scratch.write(jaccard.near_enough(pairs, listed, similarity), f"{name}-pairs")
    ends = scratch.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ends")
    sets = scratch.write(shingle_sets(join_checked(docs, ends, "doc_id", "left_semi", 16 * ends.count()), words), f"{name}-shingles")
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"{end}_set")), end)
    both = F.size(F.array_intersect("a_set", "b_set"))
    held = scratch.write(pairs.where(both >= similarity * (F.size("a_set") + F.size("b_set") - both)).select("a", "b").distinct(), f"{name}-held")
    scratch.drop(f"{name}-shingles")
    return held


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, most_bits: int = 8, pair_bucket: int = PAIR_BUCKET, wide_bucket: int = WIDE_BUCKET, block: int = jaccard.BLOCK) -> DataFrame:
    """(node, label) of documents in groups of similar texts: label is the group's smallest doc_id.

    A pair holds if the texts' sets of `words`-word shingles have a Jaccard similarity of at least `similarity`; groups are
    closed over all pairs that hold. Fingerprints (of WORDS-word shingles) within most_bits, equal sets and neighbours in
    the prefix filter's buckets only join most of each group at little cost; the prefix filter then finds every pair between
    different groups (jaccard.py).

    doc_id tells texts apart (numbered() makes it so): of rows that repeat one, any decides. Rows with a null doc_id are in no
    group. Null, empty and blank texts have the one empty shingle, so they are similar to each other; fewer words than a
    shingle make one. Very long texts count whole, one at a time. A tie at exactly `similarity` holds. An empty table gives no
    rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    docs = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    marked = scratch.write(fingerprints(docs), "fingerprints")
    distinct = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    fps = distinct.select("fp")
    near = links(fps, scratch, MOST_BITS, pair_bucket).unionByName(wide_links(fps, most_bits, wide_bucket)).distinct()
    for end in ("a", "b"):
        near = near.join(distinct.select(F.col("fp").alias(end), F.col("first_id").alias(f"{end}_id")), end)
    equal = marked.join(distinct, "fp").where("doc_id <> first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    n, n_ids = marked.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    listed = jaccard.prefixes(docs, words, similarity, jaccard.common(docs, words, n))
    listed = scratch.write(listed if n == n_ids else listed.dropDuplicates(["doc_id"]), "prefixes")
    same = listed.join(listed.groupBy("whole").agg(F.min("doc_id").alias("b")), "whole").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    pairs = near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(equal).unionByName(same).distinct()
    held = held_pairs(docs, pairs, listed, words, similarity, scratch, "first")
    label = scratch.write(components(held, Scratch(docs.sparkSession, "similar")), "first-labels")
    keys = jaccard.labelled(listed, label).select(F.explode("keys").alias("key"), "doc_id", "label")
    crossing = jaccard.crossing(keys, scratch, "crossing")
    for name, nearest in (("some", NEAREST), ("all", 0)):
        found = held_pairs(docs, jaccard.candidates(crossing, listed, similarity, _tasks(docs), nearest, block), listed, words, similarity, scratch, name)
        held = held.unionByName(found)
        label = scratch.write(components(held, Scratch(docs.sparkSession, "similar")), f"{name}-labels")
        if nearest:
            crossing = jaccard.crossing(jaccard.labelled(crossing.drop("label", "held"), label), scratch, "crossing-left")
    return label


def numbered(docs: DataFrame, scratch: Scratch, node: str, key: str) -> tuple[DataFrame, bool]:
    """docs with `node`, a number that tells apart all rows that differ in doc_id or text, and whether it isn't just the doc_id.

    Rows whose doc_id others share, or that have none, get numbers above all doc_ids, in a written table, the same for rows
    equal in doc_id and text; `key` is then added too: doc_id and a digest of the text.
    """
    ids = docs.groupBy(F.col("doc_id").alias(node)).agg(F.count(F.lit(1)).alias("held")).where(F.col(node).isNull() | (F.col("held") > 1)).select(F.coalesce(node, F.lit(0)).alias(node), F.col(node).isNull().alias("none"))
    ids = scratch.write(ids, "repeated")
    n = ids.count()
    if not n:
        return docs.withColumn(node, F.col("doc_id")), False
    # Texts are keyed only where their doc_id doesn't do.
    known = scratch.write(ids.where("NOT none").select(node), "repeated-ids")
    marked = join_checked(docs.withColumn(node, F.col("doc_id")), known.withColumn(key, F.lit("")), node, "left", 24 * n)
    shared = F.col(node).isNull() | F.col(key).isNotNull()
    marked = marked.withColumn(key, F.when(shared, F.concat_ws(":", F.coalesce(F.col(node).cast("string"), F.lit("none")), F.md5(F.coalesce("text", F.lit(""))))))
    above = docs.agg(F.max("doc_id")).first()[0]
    fresh = scratch.write(marked.where(F.col(key).isNotNull()).select(key).distinct().select(key, (F.monotonically_increasing_id() + F.lit((above or 0) + 1)).alias("number")), "numbers")
    marked = join_checked(marked, fresh.withColumnRenamed("number", f"{key}_number"), key, "left", 80 * fresh.count())
    return marked.withColumn(node, F.coalesce(f"{key}_number", node)).drop(f"{key}_number"), True


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, of which one of each group of similar texts stays: the smallest doc_id, nulls last.

    See similar_groups() for what a group is. Rows that share a doc_id, or have none, are documents of their own if their texts
    differ; rows equal in doc_id and text are one document, of which one row stays; of a group's rows with one doc_id the
    smallest digest stays. Null, empty and blank texts make one group. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    node, key = (f"_folio_{name}" + "_" * max([0, *map(len, docs.columns)]) for name in ("node", "key"))  # no document column's name
    marked, repeats = numbered(docs, scratch, node, key)
    label = similar_groups(marked.select(F.col(node).alias("doc_id"), "text"), **options)
    if repeats:
        names = scratch.write(marked.where(F.col(key).isNotNull()).select(F.col(node).alias("node"), "doc_id", F.col(key).alias("key")).distinct(), "names")
        label = label.join(names, "node", "left").withColumn("order", F.struct((F.col("key").isNotNull() & F.col("doc_id").isNull()).alias("none"), F.coalesce("doc_id", F.when(F.col("key").isNull(), F.col("node"))).alias("id"), F.col("key").alias("key")))
        label = label.join(label.groupBy("label").agg(F.min("order").alias("first")), "label")
        gone = label.where("order <> first")
    else:
        gone = label.where("node <> label")
    gone = scratch.write(gone.select(F.col("node").alias(node)).distinct(), "gone")
    if repeats:
        marked = marked.where(F.col(key).isNull()).unionByName(marked.where(F.col(key).isNotNull()).dropDuplicates([key]))
    return join_checked(marked, gone, node, "left_anti", 16 * gone.count()).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
