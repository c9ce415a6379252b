"""The registered queries that SQL can't express, each over its whole table, against brute force in plain Python."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from folio.llm import bpe, packing, pii, toxicity
from folio.llm.queries import QUERIES

from .test_dedup import brute_components, plain_fingerprint
from .test_scans import PII_KINDS, base
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(sample):
    return {i: t or "" for i, t in sample.items()}


def rows_of(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    return rows, {r["doc_id"]: r for r in rows}


def test_op1(spark, table):
    rows, by_id = rows_of(spark, "op1_media")
    assert len(rows) == len(table) == len(by_id)
    same = {}
    for i, text in table.items():
        r, body = by_id[i], text.encode()
        payload = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert same.setdefault(text, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_op4(spark, table):
    rows, _ = rows_of(spark, "op4_best_fit_packing")
    library = Tokenizer.from_file(packing.tokenizer_path())
    n, tokens = check_packing(rows, table.items(), lambda t: library.encode(t, add_special_tokens=False).ids)
    assert n <= math.ceil(tokens / 2048) + 1


def test_op6(spark, table):
    """Scores by the definition: n-grams to words, words to windows, the worst window."""
    rows, by_id = rows_of(spark, "op6_toxicity")
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    texts, marks = toxicity.training_sample(docs, labels)
    model = toxicity.train(texts, marks)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    trained_on = {t for i, t in table.items() if known.get(i) is not None and zlib.crc32(str(i).encode()) % 5}
    assert set(texts) <= trained_on

    def word(w):
        marked = f"<{w}>"
        grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked]
        return sum(float(model.ngram[zlib.crc32(g.encode()) % (1 << 17)]) for g in grams) / len(grams)

    assert len(rows) == len(table)
    for i, text in table.items():
        scores = [word(w) for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", text.lower())]
        n = min(3, len(scores))
        logit = model.bias + (max(sum(scores[k : k + n]) / n for k in range(len(scores) - n + 1)) if n else 0)
        assert by_id[i]["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)
        assert by_id[i]["predicted"] == (by_id[i]["score"] >= 0.5) and by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op7(spark, table):
    """Base spans by the contract's patterns; added ones by the best of all segmentations of what base spans leave."""
    rows, by_id = rows_of(spark, "op7_personal_data")
    field = pii.train(pii.training_texts(spark.read.parquet(f"{SF}/documents.parquet")))
    assert len(rows) == len(table)
    for i, text in table.items():
        want = base(PII_KINDS, text)
        assert by_id[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [by_id[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in want) for k in pii.KINDS]
        spans = by_id[i]["spans"].split(",") if by_id[i]["spans"] else []
        assert set(want) <= set(spans)
        added = {tuple(s.split(":")) for s in spans} - {tuple(s.split(":")) for s in want}
        best = set()
        for begin, stop in pii.uncovered(text, pii.base_spans(text)):
            tokens = pii.TOKEN.findall(text[begin:stop])
            _, found, feats = field.prepared(tokens)
            top = [(0.0, ())] + [None] * len(tokens)
            for j in range(1, len(tokens) + 1):
                ways = [top[j - 1]]
                for s, (a, b) in enumerate(found):
                    if b == j:
                        scores = field.weights[feats[s]].sum(axis=0)
                        ways.append((top[a][0] + float(scores.max()), (*top[a][1], (a, int(scores.argmax()), b))))
                top[j] = max(ways, key=lambda w: w[0])
            place = lambda k, tokens=tokens, begin=begin: begin + sum(map(len, tokens[:k]))
            best |= {(pii.KINDS[k], str(place(a)), str(place(b))) for a, k, b in top[-1][1]}
        assert added == best


def test_op8(spark, table):
    rows, by_id = rows_of(spark, "op8_bpe")
    library = Tokenizer.from_file(bpe.tokenizer_path())
    assert len(rows) == len(table)
    for i, text in table.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(by_id[i])[1:4] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op9(spark, table):
    rows, by_id = rows_of(spark, "op9_simhash")
    marks = {i: plain_fingerprint(t) for i, t in table.items()}
    label = brute_components(set(marks.values()), 2)
    first = defaultdict(list)
    for i, f in marks.items():
        first[label[f]].append(i)
    assert len(rows) == len(table)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in by_id.items()} == {i: (f"{f:016x}", min(first[label[f]])) for i, f in marks.items()}
