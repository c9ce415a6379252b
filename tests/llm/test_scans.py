import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import pii, secrets, toxicity, url_filter

from .conftest import odd_rows

SECRET_KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


PII_KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
]


def base(kinds, text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))
    return [f"{kinds[k][0]}:{a}:{b}" for a, k, b in found]


def check(rows, kinds, texts):
    """Base spans are exact and stay; returns what the method added, by doc_id."""
    added = {}
    left = sorted(((i, t or "") for i, t, *_ in texts), key=repr)
    for r in rows:
        own = [x for x in left if x[0] == r["doc_id"]]
        text = next(t for _, t in own if hashlib.sha256(",".join(base(kinds, t)).encode()).hexdigest() == r["base_sha256"])
        left.remove((r["doc_id"], text))
        want, got = base(kinds, text), [s for s in r["spans"].split(",") if s]
        assert [s for s in got if s in set(want)] == want
        for name, *_ in kinds:
            assert r[f"n_{name}"] == sum(s.startswith(name + ":") for s in want)
        added[r["doc_id"]] = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got if s not in set(want)]
    assert not left
    return added


def test_secrets(odd, empty):
    added = check(secrets.secrets(odd).collect(), SECRET_KINDS, odd_rows())
    assert {s for _, s in added[19]} == {"Xk3hQ9fLp2Vz8RtYw6Bn4Mc7Jd5Gs1Ua0Ei", "Qq7ZtR2vKx9LmP4sW8yB6nD3fH5jA1cGe"}
    assert added[21] == []
    assert secrets.secrets(empty).count() == 0


ENCODED = {name: (pattern, alphabet, *rest) for name, pattern, alphabet, *rest in secrets.ENCODINGS}


def plain_battery(token):
    name = next((n for n, (p, *_) in ENCODED.items() if re.search(p, token)), None)
    if name is None or not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return None, None
    _, alphabet, squares, switch, relation = ENCODED[name]
    core = token.lower() if name == "hex" else token.rstrip("=")
    n, k = len(core), len(alphabet)
    chi = sum((core.count(s) - n / k) ** 2 / (n / k) for s in alphabet)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c for c in core]
    changes = sum(a != b for a, b in zip(kind, kind[1:], strict=False)) + sum(a == b and not a.isalpha() for a, b in zip(kind, kind[1:], strict=False))
    x = np.array([alphabet.index(c) for c in core], float)
    off = x - x.mean()
    serial = (off[:-1] * off[1:]).sum() / (off**2).sum() if (off**2).sum() > 0 else 1.0
    excess = k * squares - 1
    z = [(k - 1 + (n - 1) * excess - chi) / math.sqrt(2 * (k - 1) + 4 * n * excess), (changes - (n - 1) * switch) / math.sqrt((n - 1) * switch * (1 - switch)), (relation - serial) * math.sqrt(n)]
    s = sum(z) / math.sqrt(3)
    return name, 1 / (1 + math.exp(min(1.5976 * s + 0.07056 * s**3, 700)))


def test_battery_against_plain_python(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) for _ in range(60) for a in ("0123456789abcdef", ENCODED["base64"][1], ENCODED["base32"][1], ENCODED["base64url"][1])]
    tokens += ["MyConfigurationFileVersion2Final", "aaaaaaaaaaaaaaaaaaaa1", "2024_01_01_report_of_the_year", "abc+/_-def1234567890x", "CAPITALLETTERSANDDIGIT2"]
    rows = secrets.battery(spark.createDataFrame([(t,) for t in tokens], "hit string")).collect()
    for r in rows:
        name, p = plain_battery(r["hit"])
        assert r["encoding"] == name
        if name:
            assert r["p"] == pytest.approx(p, rel=1e-6, abs=1e-12)
    p = {r["hit"]: r["p"] for r in rows}
    assert p["MyConfigurationFileVersion2Final"] > 0.02 and p["2024_01_01_report_of_the_year"] > 0.02
    assert np.median([r["p"] for r in rows if r["encoding"] == "base64" and r["n"] > 40]) < 1e-6


def test_false_discoveries_are_controlled(spark):
    rng = np.random.default_rng(3)
    null = rng.random(4000)
    rows = [(float(n), "hex", float(p), False) for n, p in zip(rng.integers(20, 200, 4000), null, strict=True)] + [(50.0, "hex", 1e-9, True)] * 200
    got = secrets.discovered(spark.createDataFrame(rows, "n double, encoding string, p double, real boolean"), 0.05).where("chosen").collect()
    assert sum(r["real"] for r in got) == 200 and sum(not r["real"] for r in got) <= 30


def test_redaction(spark, odd, empty):
    got = {r["doc_id"]: r for r in secrets.redacted(odd).where("doc_id IS NOT NULL").collect()}
    assert got[17]["text"] == "[SECRET]' TOKEN:ab [SECRET]\" [SECRET]" and got[17]["n_chars"] == len(got[17]["text"])
    want = {i: t for i, t, *_ in odd_rows()}
    assert all(got[i]["text"] == want[i] for i in got if i not in (6, 17, 19, 21)) and secrets.redacted(odd).columns == odd.columns
    assert sorted(map(repr, secrets.redacted(odd, limit=0).collect())) == sorted(map(repr, secrets.redacted(odd).collect()))
    assert secrets.redacted(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aZ9.@+-_ ()%\né", "a.b@c.de", "10.0.0.1", "999", "4111 1111 1111 1111", "+1 (555) 123-4567", "0000"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.listed(pii.base_spans(text)) == ",".join(base(PII_KINDS, text))


def test_no_text_makes_the_shapes_slow():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1" * 50_000, "1." * 100_000, "@" * 100_000, "a@b" * 30_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field(sample):
    rng = random.Random(0)
    made = [f"call {rng.choice(['me', 'us'])} +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now or {rng.choice('abc')}x.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com and {rng.randint(1, 3000)} items" for _ in range(40)]
    return pii.train(made + list(sample.values())[:60])


def test_field_finds_other_ways_of_writing(field):
    text = "call me (312) 555-0199 today, 12 of 4500 items, in 2024-01-02"
    _, spans = pii.all_spans(text, field)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [("phone", "(312) 555-0199")]


def test_gradient_is_the_likelihoods(field):
    tokens = pii.TOKEN.findall("me (312) 555-0199 or 4111-1111-1111-1111 x")
    model = pii.SemiMarkov(np.random.default_rng(0).normal(0, 0.05, (pii.FEATURES, len(pii.KINDS))))
    prepared = model.prepared(tokens)
    gold = {(*prepared[1][3][:1], 3, prepared[1][3][1])}
    slope = np.zeros_like(model.weights)
    model.gradient(prepared, gold, slope)
    used = sorted({int(f) for row in prepared[2] for f in row})[:5]
    for f in used:
        for k in (0, 3):
            ends = []
            for d in (1e-5, -1e-5):
                model.weights[f, k] += d
                ends.append(model.gradient(prepared, gold, np.zeros_like(slope)))
                model.weights[f, k] -= d
            assert slope[f, k] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-4)


def test_best_is_best_of_all_segmentations(field):
    tokens = pii.TOKEN.findall("(312) 555-0199 x 5550123")
    model = pii.SemiMarkov(np.random.default_rng(1).normal(0, 1, (pii.FEATURES, len(pii.KINDS))))
    _, found, feats = model.prepared(tokens)
    scores = model.weights[feats].sum(axis=1)
    most = {0: 0.0}
    for j in range(1, len(tokens) + 1):
        most[j] = max([most[j - 1], *(most[i] + scores[s].max() for s, (i, e) in enumerate(found) if e == j)])
    got = sum(scores[found.index((i, j)), k] for i, k, j in model.best(tokens))
    assert got == pytest.approx(most[len(tokens)])


def test_personal_data(odd, empty, field):
    check(pii.personal_data(odd, field).collect(), PII_KINDS, odd_rows())
    assert pii.personal_data(empty, field).count() == 0
    assert (pii.train([]).weights == 0).all() and pii.training_texts(empty) == []


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    plain = ["".join(rng.choice("aeiounrtls") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    bad = ["wretched", "blockhead", "nincompoop", "scoundrel"]
    make = lambda toxic: " ".join(rng.choice(bad) if toxic and i % 90 == 40 else rng.choice(plain) for i in range(rng.randint(60, 300)))
    texts = [(make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    return toxicity.train([t for t, _ in texts[:300]], [y for _, y in texts[:300]]), texts[300:]


def test_toxicity_held_out_and_misspelt(model):
    fitted, rest = model
    score = lambda t: fitted.score(fitted.word_scores(toxicity.words_of(t)))
    right = sum((score(t) >= 0.5) == bool(y) for t, y in rest)
    assert right >= 95
    clean = next(t for t, y in rest if not y)
    assert score(clean + " you blockheadd there") > 0.5 > score(clean)
    assert 0 <= score("") < 0.5


def test_toxicity_operator(spark, odd, empty, model):
    rows = toxicity.scored(odd, model[0]).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    kept = toxicity.without_toxic(odd, model[0])
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    assert toxicity.scored(empty, model[0]).count() == 0
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(22)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    texts, toxic = toxicity.training_sample(odd, labels)
    assert texts and set(toxic) == {0, 1}
    want = {t for i, t, *_ in odd_rows() if t and i is not None and i < 22 and zlib.crc32(str(i).encode()) % 5 and len(t) <= toxicity.SAMPLE_LENGTH}
    assert set(texts) <= want | {t for _, t, *_ in odd_rows() if t in want}
    nothing = toxicity.trained(odd, labels.limit(0))
    assert {r["predicted"] for r in toxicity.scored(odd, nothing).collect()} == {0}
    held = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in held)


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if r[0] and r[2] and host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1] or "")]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1] or ""), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + (best[1] or ""), best[2] if best else "allow"


@pytest.mark.parametrize("range_pages", [1, 7, 200_000])
def test_url_filter(spark, range_pages):
    rng = random.Random(range_pages)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xample.net", "org", "w.org", "EXAMPLE.com", "é.org", "net:80", "u@example.net", "." * 3, "l" * 150 + ".net", "x." + "l" * 150 + ".net"]
    paths = ["", "/", "/en/", "/en/x", "/e", "/de/q?r#s", "/fr/", "?/en/", "#x", "/en/very/long/path"]
    urls = [None, "", "no scheme", "://", "http:///en/", "a://b://c/d", "http://\n/x"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + ["https://hot.example.net/en/1"] * 60
    rules = [*url_filter.RULES, ("example.net", "/en/", "block"), ("a.example.net", "", "allow"), ("net", "/en/very/long/", "allow"), ("l" * 150 + ".net", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("w.org", "/", None)]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string").repartition(3)
    want = sorted(((i if i % 50 else None), *plain_verdict(u, rules)) for i, u in enumerate(urls) if i % 50)
    got = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), range_pages=range_pages).collect()
    assert sorted(tuple(r) for r in got if r["page_id"] is not None) == want and len(got) == len(urls)
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, spark.createDataFrame([], url_filter.RULE_SCHEMA), "block").collect()} == {"block"}
