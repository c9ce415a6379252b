"""The near-dedup stage against all pairs of texts."""

import random
from itertools import combinations

import pytest

from folio.llm import simhash


def brute(rows):
    """{doc_id: the smallest doc_id of its group} of all documents in groups, by the Jaccard similarity of every pair."""
    sets = {}
    for i, text in rows:
        own = text.lower().split()
        sets[i] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    held = [x for x in label.values()]
    return {i: x for i, x in label.items() if held.count(x) > 1}


def words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def edited(rng, own, n):
    own = list(own)
    for i in rng.sample(range(len(own)), n):
        own[i] = f"x{rng.randrange(10**9)}"
    return own


def around(rng):
    """Groups whose pairs lie around 0.8."""
    for g in range(6):
        base = words(rng, 300)
        yield from ((100 * g + i, " ".join(edited(rng, base, rng.randint(2, 9)))) for i in range(25))


def far(rng):
    """Pairs with text appended, a block replaced or words edited, whose fingerprints often differ in more than 8 bits."""
    for g in range(60):
        base = words(rng, 300)
        other = [base + words(rng, 68), base[:130] + words(rng, 30) + base[160:], edited(rng, base, 5)][g % 3]
        yield from ((2 * g, " ".join(base)), (2 * g + 1, " ".join(other)))


def crowded(rng):
    """A chain of groups far larger than a bucket may be."""
    base = words(rng, 400)
    for g in range(6):
        base = edited(rng, base, 8)
        yield from ((100 * g + i, " ".join(edited(rng, base, rng.randint(1, 4)))) for i in range(50))


def dense(rng):
    """400 texts with one to three changed words: tens of thousands of pairs hold, thousands don't."""
    base = words(rng, 200)
    yield from ((i, " ".join(edited(rng, base, rng.randint(1, 3)))) for i in range(400))


def boilerplate(rng):
    """Short texts that are mostly one passage: its shingles are in every prefix, and few pairs hold."""
    line = words(rng, 12)
    for g in range(150):
        own = words(rng, 8)
        yield 2 * g, " ".join(line + own)
        yield 2 * g + 1, " ".join(line + own + (words(rng, 1) if g % 2 else words(rng, 9)))


def repeated(rng):
    """A repeated line decides the fingerprint of texts with different remainders, some of them near copies of each other."""
    line = words(rng, 11) * 200
    yield 0, " ".join(line + words(rng, 60))
    for g in range(1, 20):
        rest = words(rng, 60)
        yield from ((2 * g, " ".join(line + rest)), (2 * g + 1, " ".join(line + rest + words(rng, 4))))


CASES = {"around": (around, {}), "far": (far, {}), "crowded": (crowded, {"pair_bucket": 8, "wide_bucket": 8}), "repeated": (repeated, {}), "dense": (dense, {}), "blocks": (dense, {"pair_bucket": 64, "wide_bucket": 16, "block": 7}), "boilerplate": (boilerplate, {"block": 16})}


@pytest.mark.parametrize("name", list(CASES))
def test_against_all_pairs(spark, name):
    make, options = CASES[name]
    rows = list(make(random.Random(7)))
    want = brute(rows)
    got = {r["node"]: r["label"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert want and got == want


def test_repeated_ids(spark):
    """Rows with one doc_id and different texts are documents of their own; equal rows are one."""
    rng = random.Random(5)
    a, b, c, d = (words(rng, 100) for _ in range(4))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(edited(rng, a, 1))), (None, " ".join(edited(rng, b, 1))), (None, " ".join(c)), (None, " ".join(edited(rng, c, 1))), (3, " ".join(d)), (3, " ".join(d)), (3, " ".join(edited(rng, d, 1)))]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.without_near_copies(frame).collect()), key=repr)
    assert [g for g in got if g[0] == 1] == sorted(rows[:2], key=repr)
    assert not [g for g in got if g[0] == 2] and len([g for g in got if g[0] is None]) == 1 and len([g for g in got if g[0] == 3]) == 1


def test_copies_with_repeated_ids(spark):
    from folio.llm import exact_dedup

    rows = [(1, "a b"), (1, "c"), (2, "a  b"), (3, "c"), (None, "d"), (None, "d "), (4, "e"), (4, "e"), (5, None), (6, " "), (7, "f")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = sorted((tuple(r)[:2] for r in exact_dedup.without_copies(frame).collect()), key=repr)
    assert got == sorted([(2, "a  b"), (1, "c"), (None, "d "), (4, "e"), (6, " "), (7, "f")], key=repr)


def test_sketches_turn_no_pair_away():
    """Fine sketches of any two lengths differ in no more classes than the sets do in hashes."""
    import numpy as np

    from folio.llm import jaccard

    rng = np.random.default_rng(2)
    for n in (1, 5, 600, 3000, 40_000):
        own = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        for change in (0, 1, n // 5, n):
            other = np.unique(np.concatenate([own[change // 2 :], rng.integers(0, 1 << 64, change, np.uint64, endpoint=False)]))
            apart = len(np.setxor1d(own, other))
            assert jaccard.odd_classes(jaccard.fine_sketch(own), jaccard.fine_sketch(other)) <= apart
            if apart > n:
                assert jaccard.odd_classes(jaccard.fine_sketch(own), jaccard.fine_sketch(other)) > 0.25 * n
