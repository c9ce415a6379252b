import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import bpe, packing

from .conftest import odd_rows

ALPHABET = list("ab eE1'!\n\t  \x0b\x0c\r\xa0　́éßÀ<|>\x1c\x85İµ.,-\"(東😀") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " a", "the", "tion"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join)


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(packing.tokenizer_path())


@settings(max_examples=80, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_bpe_equals_the_library(byte_level, some):
    ours = bpe.loaded(bpe.tokenizer_path())
    got = list(ours.encode_batch([t.encode() for t in some]))
    assert got == [byte_level.encode(t, add_special_tokens=False).ids for t in some]
    assert [ours.decode(x).decode() for x in got] == [byte_level.decode(x, skip_special_tokens=False) for x in got]


def test_bpe_on_real_texts_and_broken_ids(byte_level, sample):
    ours = bpe.Bpe(bpe.tokenizer_path())
    some = list(sample.values())
    got = list(ours.encode_batch([t.encode() for t in some]))
    assert got == [x.ids for x in byte_level.encode_batch(some, add_special_tokens=False)]
    rng = random.Random(0)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 8))]
        assert ours.decode(ids).decode() == byte_level.decode(ids, skip_special_tokens=False)
    assert ours.merge_all([]) == [] and ours.merge_all([b"aaaaaaa", b"aaa"]) == [tuple(byte_level.encode(x).ids) for x in ("aaaaaaa", "aaa")]


def test_stores_stay_bounded(byte_level, monkeypatch, sample):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 500)
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 500)
    ours, other = bpe.Bpe(bpe.tokenizer_path()), packing.ChunkEncoder(packing.tokenizer_path())
    for t in list(sample.values())[:60]:
        assert list(ours.encode_batch([t.encode()])) == [byte_level.encode(t, add_special_tokens=False).ids]
        list(other.encode_batch([t.encode()]))
    most = 250 + max(len(set(t.split())) * 2 for t in sample.values())
    assert len(ours.known.now) <= most and len(other.known.now) <= most


def test_bpe_operator(odd, empty, byte_level):
    rows = bpe.round_trip(odd, bpe.tokenizer_path()).collect()
    want = []
    for i, t, *_ in odd_rows():
        ids = byte_level.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in rows), key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    assert bpe.round_trip(empty, bpe.tokenizer_path()).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_chunk_encoder_equals_the_library(word_level, some):
    got = packing.chunk_encoder(packing.tokenizer_path()).encode_batch([t.encode() for t in some])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [word_level.encode(t, add_special_tokens=False).ids for t in some]


def check_packing(rows, docs, encode, capacity=2048):
    """Whole pieces, gapless sequences; the number of sequences."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for i, t in docs:
        ids = np.array([*encode(t or ""), 0], "<u4")
        want[i] += [(n, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for n, k in enumerate(range(0, len(ids), capacity))]
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    return len(sequences), sum(p[2] for own in want.values() for p in own)


@pytest.mark.parametrize("round_items", [7, 50_000])
def test_packing(spark, odd, empty, word_level, sample, round_items):
    encode = lambda t: word_level.encode(t, add_special_tokens=False).ids
    check_packing(packing.packed(odd, round_items=round_items).collect(), [r[:2] for r in odd_rows()], encode)
    docs = spark.createDataFrame(list(sample.items()), "doc_id long, text string").repartition(5)
    n, tokens = check_packing(packing.packed(docs, round_items=round_items).collect(), sample.items(), encode)
    assert n <= -(-tokens // 2048) + (1 if round_items > 100 else 12)
    assert packing.packed(empty).count() == 0


def test_items_that_nothing_fits_beside(spark):
    rows = [(i, 0, 0, 1100, 0) for i in range(300)]
    got = packing.pack_pieces(spark.createDataFrame(rows, packing.PIECE).repartition(4), round_items=40).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) == 300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_takes_the_fullest(lengths):
    fit = packing.BestFit(20)
    plain: list[list[int]] = []
    for n in lengths:
        fit.put(n, n)
        fits = [b for b in plain if sum(b) + n <= 20]
        if fits:
            max(fits, key=sum).append(n)
        else:
            plain.append([n])
    assert sorted(map(sum, fit.bins)) == sorted(map(sum, plain))
