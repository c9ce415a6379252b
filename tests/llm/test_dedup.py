import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import exact_dedup, line_dedup, simhash
from folio.llm.util import Scratch

from .conftest import odd_rows


def test_perfect_hash_is_minimal():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    found = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(found.slots(keys).tolist()) == list(range(5000))
    strangers = [hashlib.sha256(b"x%d" % i).digest() for i in range(1000)]
    slots = found.slots(strangers)
    assert (slots >= -1).all() and (slots < 5000).all() and (slots >= 0).any()  # so a lookup must compare digests
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(keys + keys[:1])
    assert exact_dedup.PerfectHash.build([]).slots(keys[:2]).tolist() == [-1, -1]


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        out += [(i, keep, len(members), (i == keep) if i is not None and keep is not None else len(members) == 1, hashlib.sha256(text.encode()).hexdigest()) for *_, i in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_digests", [1, 4, 40_000])
def test_exact_dedup(odd, empty, bucket_digests):
    got = exact_dedup.dedup_table(odd, bucket_digests)
    assert sorted((tuple(r) for r in got.drop("seen_before").collect()), key=repr) == expected_groups(odd_rows())
    assert exact_dedup.dedup_table(empty).count() == 0


def test_history_and_batch(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    history, batch = frame([(5, "a b"), (6, "x")]), frame([(1, "ab"), (2, "a  b"), (3, "new"), (4, "n ew")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["seen_before"]) for r in exact_dedup.dedup(history, batch).collect()}
    assert got == {5: (2, 3, False, True), 1: (2, 3, False, True), 2: (2, 3, True, True), 6: (6, 1, True, True), 3: (4, 2, False, False), 4: (4, 2, True, False)}
    assert exact_dedup.dedup(frame([]), batch).count() == 4 and exact_dedup.dedup(history, frame([])).count() == 2


def expected_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            k = key(x)
            if len(k) < 40 or len(holders[k]) < 5 or i == max((j for j in holders[k] if j is not None), default=None):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout, limit", [(1, 2, 1 << 23), (5, 2, 0), (4, 3, 1 << 23)])
def test_line_dedup(odd, empty, batches, fanout, limit):
    got = line_dedup.kept_lines(odd, batches=batches, fanout=fanout, limit=limit)
    assert sorted((tuple(r) for r in got.drop("text").collect()), key=repr) == expected_lines(odd_rows())
    for r in got.collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    assert line_dedup.kept_lines(empty).count() == 0


def test_hot_lines(spark, monkeypatch):
    """A line in a third of all documents: joined apart from the rest, with the result of one broadcast."""
    line = lambda i: f"this is line number {i} and it is quite long enough to count"
    docs = spark.createDataFrame([(i, f"{line('hot') if i % 3 == 0 else i}\n{line(('six', i // 6))}\n{line(i)}\n{line(('six', i // 6))}") for i in range(240)], "doc_id long, text string")
    want = sorted(tuple(r) for r in line_dedup.kept_lines(docs, texts=False).collect())
    assert sum(r[2] for r in want) == 79 + 40 * 5 * 2
    monkeypatch.setattr(line_dedup, "HOT_LINES", 20)
    assert sorted(tuple(r) for r in line_dedup.kept_lines(docs, texts=False, limit=0).collect()) == want


def test_runs_tell_new_lines_from_known(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    line = lambda c: c * 50
    runs = line_dedup.LineRuns(spark, 3, fanout=2)
    seen = []
    for batch in ([(1, f"{line('a')}\n{line('b')}")], [(2, f"{line('b')}\n{line('c')}")], [(3, line("a")), (4, line("d"))], [(5, line("d"))]):
        seen.append(sorted((r["doc_id"], r["line_no"]) for r in line_dedup.first_seen(runs, frame(batch)).collect()))
    assert seen == [[(1, 0), (1, 1)], [(2, 1)], [(4, 0)], []]
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.contents().collect()) == [(1, 2), (2, 2), (2, 3), (2, 5)]
    assert [len(x) for x in runs.levels] == [0, 0, 1]


def plain_fingerprint(text, n=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(sample):
    for text in ["", " \n", "One", "One two", "a b c a b c", "Ünï ÇODE Abc  d"] + list(sample.values())[:40]:
        assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == plain_fingerprint(text)


def brute_components(fps, bits):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    values = np.array(sorted(fps), np.uint64)
    for i, f in enumerate(values.tolist()):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= bits):
            a, b = sorted((find(f), find(int(values[j]))))
            label[b] = a
    return {f: find(f) for f in fps}


def partition(labels):
    groups = defaultdict(set)
    for k, v in labels.items():
        groups[v].add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("bits, pair_bucket", [(2, 2048), (2, 3), (1, 2), (3, 2048)])
def test_links_against_all_pairs(spark, bits, pair_bucket):
    rng = random.Random(bits)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 8))):
            fps.add(f)
            for _ in range(rng.randint(1, bits + 2)):
                f ^= 1 << rng.choice((rng.randrange(64), rng.randrange(6)))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = Scratch(spark, "test")
    got = {r["node"]: r["label"] for r in simhash.components(simhash.links(frame, scratch, bits, pair_bucket, 50), scratch).collect()}
    assert partition(got) == partition({int(np.uint64(k).astype(np.int64)): v for k, v in brute_components(fps, bits).items()})


def test_plan_puts_correlated_bits_together():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    same = np.uint64(0x5555_5555)  # sixteen bits that are all the same
    sample = np.where(rng.random(4000) < 0.5, sample | same, sample & ~same)
    groups = simhash.group_bits(sample, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert max(sum(b in range(0, 32, 2) for b in g) for g in groups) == 16
    parts = simhash.plan(sample, 1_000_000)
    assert not any(set(range(0, 32, 2)) <= set(p.bits) and len(p.bits) == 16 for p in parts)  # the telling parts are probed
    for n in (0, 1, 10, 10**9):
        chosen = simhash.plan(sample[:n], n)
        assert sum(p.threshold + 1 for p in chosen) == 3


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 100 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {1000: 100}


def test_near_groups(odd, empty):
    rows = odd_rows()
    fps = {plain_fingerprint(t or "") for _, t, *_ in rows}
    label = brute_components(fps, 2)
    first = {}
    for i, t, *_ in rows:
        own = label[plain_fingerprint(t or "")]
        first[own] = min((x for x in (first.get(own), i) if x is not None), default=None)
    want = sorted(((i, first[label[plain_fingerprint(t or "")]]) for i, t, *_ in rows), key=repr)
    got = simhash.near_groups(odd)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=repr) == want
    assert simhash.near_groups(empty).count() == 0


def test_similar_groups(spark, odd, empty):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    other = [f"v{rng.randrange(5000)}" for _ in range(300)]
    edited = lambda words, n: " ".join(w if i not in set(range(10, 10 + 20 * n, 20)) else "changed" for i, w in enumerate(words))
    rows = [(1, " ".join(base)), (2, edited(base, 1)), (3, edited(base, 3)), (4, " ".join(other)), (5, " ".join(base[:150] + other[:150])), (9, " ".join(base))]
    got = {r["node"]: r["label"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1}
    assert simhash.similar_groups(empty).count() == 0
    assert {r["node"] for r in simhash.similar_groups(odd).collect()} >= {7, 30, 31}


def test_dense_buckets_stay_linked(spark):
    """A group of near copies that is far larger than a bucket may be."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        own = list(words)
        own[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.similar_groups(docs, pair_bucket=16, wide_bucket=24).collect()
    assert len(got) >= 118 and {r["label"] for r in got} == {0}
    assert docs.agg(F.count("doc_id")).first()[0] == 120


def test_scratch_tables_can_be_deleted(spark):
    scratch = Scratch(spark, "test")
    assert scratch.write(spark.range(3), "t").count() == 3
    Scratch.clean(spark)
    assert not Scratch.made
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{scratch.path}/t")


def test_forest_keeps_what_hangs_together():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (30, 40), (200, 3000)):
        a, b, bits = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        kept = simhash.forest(n, a, b, bits)
        for most in range(9):
            every, some = bits <= most, kept[bits[kept] <= most] if m else []
            assert np.array_equal(simhash.fold(n, a[every], b[every]), simhash.fold(n, a[some], b[some]) if m else np.arange(n))
        assert len(kept) == n - len(set(simhash.fold(n, a, b).tolist()))
