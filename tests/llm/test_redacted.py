"""Random values inside of longer runs are cut out of texts."""

import random
import string

from folio.llm import secrets


def test_values_inside_of_runs(spark):
    rng = random.Random(3)
    value = lambda signs, n=40: "".join(rng.choice(signs) for _ in range(n - 3)) + "Q7z"
    plain = string.ascii_letters + string.digits
    rows, values = [], []
    for i in range(12):
        values.append(value(plain + "+" if i % 4 < 2 else plain))
        run = ["SESSION={}", "AWS_SECRET_ACCESS_KEY={}", "/srv/app_conf/{}", "first-part_of={}"][i % 4]
        rows.append((i, f"set {run.format(values[-1])} here"))
    rows += [(100 + i, "see /usr/share/some_long-name/with/many/parts_of_it/readme and NAME=some_ordinary_long_value2") for i in range(3)]
    found = {r["doc_id"]: r["text"] for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, v in enumerate(values) if v in found[i] or "[SECRET]" not in found[i]] == []
    assert all(found[i] == t for i, t in rows if i >= 100)


ALPHABETS = {"base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_", "base32": string.ascii_uppercase + "234567", "hex": "0123456789ABCDEF"}


def planted(rng, n_each=25):
    """(doc_id, text, planted value or None): random values by alphabet and length among names, paths and words."""
    words = ["config", "Reader", "server", "Index", "table", "Update", "value", "handler", "Request", "buffer", "stream", "Value", "number", "window"]
    rows = []
    for name, signs in ALPHABETS.items():
        for n in (20, 24, 32, 40, 64, 100):
            for _ in range(n_each):
                value = "".join(rng.choice(signs) for _ in range(n))
                rows.append(((name, n), f"the value {value} is here", value))
    for _ in range(1500):
        parts = [rng.choice(words) for _ in range(rng.randint(4, 9))]
        rows.append((None, f"see {rng.choice(('/', '_', '-', '')).join(parts)}{rng.randrange(1, 3000)} there", None))
    return [(i, *r) for i, r in enumerate(rows)]


def test_recall_by_length(spark):
    """Planted random values of every alphabet and length are found, and next to no names and paths."""
    rows = planted(random.Random(11))
    found = {r["doc_id"]: r["spans"] for r in secrets.secrets(spark.createDataFrame([(i, t) for i, _, t, _ in rows], "doc_id long, text string")).collect()}
    share = {}
    for i, key, text, value in rows:
        if key:
            start = text.index(value)
            tested = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            share.setdefault(key, []).append(f"random:{start}:{start + len(value)}" in found[i].split(",") or not tested)
    rates = {k: sum(v) / len(v) for k, v in share.items()}
    false = sum("random" in found[i] for i, key, _, _ in rows if key is None)
    assert false <= 0.02 * sum(key is None for _, key, _, _ in rows)
    long = [r for (_, n), r in rates.items() if n >= 24]
    assert sum(long) / len(long) >= 0.95 and min(long) >= 0.85 and min(rates.values()) >= 0.75
