"""Recall and precision of what the learnt operators add, on planted tables with known answers."""

import random

import pytest

from folio.llm import pii, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.training_texts(spark.read.parquet(f"{SF}/documents.parquet")))


def luhn_number(rng, n=16):
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(n - 2))
    return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))


def personal(rng, kind):
    """An entity written in a way that the known shapes don't match."""
    if kind == "email":
        local, host = f"{rng.choice('abcdefgh')}{rng.choice(['ann', 'lee', 'kim', 'ito'])}{rng.randrange(100)}", rng.choice(["mail", "post", "corp"])
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", "."), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", ".")])
        return f"{local}{at}{host}{dot}{rng.choice(['com', 'org', 'net'])}"
    if kind == "ip":
        return rng.choice(("[.]", " . ", " dot ", "(.)")).join(str(rng.randrange(1, 255)) for _ in range(4))
    if kind == "card":
        digits = luhn_number(rng)
        return rng.choice((".", "_", "/")).join(digits[i : i + 4] for i in range(0, 16, 4))
    d = [str(rng.randrange(200, 999)), str(rng.randrange(200, 999)), str(rng.randrange(1000, 9999))]
    return rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1-{}-{}-{}")).format(*d)


def harmless(rng):
    y, a, b = rng.randrange(1950, 2030), rng.randrange(1, 13), rng.randrange(1, 29)
    return rng.choice([f"on {y}-{a:02}-{b:02} at {b}:{a:02}", f"version {a}.{b}.{a}", f"pages {a}, {b} and {y}", f"we met at noon and put a dot at line {b}", f"{a * 1000:,}.{b:02} of {y * 977:,}", f"order {y}{a:02}{b:02}", f"look (at) table {a}", f"chapter {a} dot {b}", f"scores of {a} {b} {a + 1} {b + 1}"])


def test_personal_data_beyond_the_shapes(field):
    rng = random.Random(3)
    words = ["write", "call", "note", "river", "house", "green", "under", "paper", "seven", "light"]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 12)))
    found, planted, right, false = {}, {}, 0, 0
    for i in range(800):
        kind = pii.KINDS[i % 4]
        head, entity = some() + " ", personal(rng, kind)
        text = f"{head}{entity} {some()}. {harmless(rng)}, {some()}"
        base, every = pii.all_spans(text, field)
        added = [s for s in every if s not in base]
        hit = (len(head), pii.KINDS.index(kind), len(head) + len(entity)) in every
        key = "card, a way that training lacks" if kind == "card" and "/" in entity else kind
        planted[key] = planted.get(key, 0) + 1
        found[key] = found.get(key, 0) + hit
        right += hit
        false += sum(s[0] >= len(head) + len(entity) or s[2] <= len(head) for s in added)
    clean = sum(len(pii.all_spans(f"{some()} {harmless(rng)} {some()} {harmless(rng)}", field)[1]) for _ in range(500))
    rates = {k: found[k] / n for k, n in planted.items()}
    print(rates, right, false, clean)
    assert all(r >= (0.5 if "lacks" in k else 0.9) for k, r in rates.items())
    assert right / (right + false) >= 0.9 and clean <= 10
