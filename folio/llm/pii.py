"""Personal data by four known shapes and a semi-Markov conditional random field.

The field sees windows around digits, @ and what stands for it (a bracketed "at", the word "dot"): everywhere else no
candidate segment exists, and a dynamic program over the whole text would pass through. A window's segmentation is a chain of single outside tokens and entity segments of at most
MOST_TOKENS tokens; a segment's score is the sum of the weights of features of the whole span (shape, digits, separators,
checks such as Luhn's, the words before and after), so boundaries and types are chosen jointly. It is trained by maximum
likelihood (forward-backward over segments, in numpy) on windows of a bounded sample of documents, whose entities are what
the known shapes match, on copies of them written in the other ways that people write them, and on numbers that are no personal
data.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.util import bounded_batches, only, text_batches

KINDS = ("email", "ip", "card", "phone")
#: An email's part before the @ and after it; the first is sought backwards from each @, in steps that no text makes quadratic.
LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
#: Around what windows lie: digits, @, a bracketed "at" and the word "dot".
TRIGGER = re.compile(r"[0-9@]|[(\[{][\x20]?[Aa][Tt][\x20]?[)\]}]|(?<![A-Za-z])(?:dot|DOT)(?![A-Za-z])")

#: Tokens of an entity at most; whitespace-separated chunks of context on each side of a window.
MOST_TOKENS, CONTEXT = 26, 2
#: Documents with a match and without one that the field is trained on at most, passes, step and weight decay.
TRAIN_WITH, TRAIN_WITHOUT, PASSES, STEP, DECAY = 160, 60, 10, 0.3, 1e-3
#: Ways in which each training entity is rewritten.
REWRITES = 7
#: Longest training documents in characters and training windows in tokens.
TRAIN_LENGTH, TRAIN_TOKENS = 20_000, 400
FEATURES = 1 << 14
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            free = found.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the four known shapes, in order; a match that fails its check is dropped without a retry."""
    out = []
    if "@" in text:
        out += [(begin, 0, stop) for begin, stop in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @: their chunk and CONTEXT chunks on each side; stretches that meet are one."""
    begin = stop = -1
    at = 0
    while (m := TRIGGER.search(text, at)) is not None:
        low = _back(text, m.start(), CONTEXT + 1)
        high = _on(text, m.start(), CONTEXT + 1)
        if low <= stop:
            stop = max(stop, high)
        else:
            if stop >= 0:
                yield begin, stop
            begin, stop = low, high
        at = _on(text, m.start(), 1)
    if stop >= 0:
        yield begin, stop


def _back(text: str, at: int, chunks: int) -> int:
    """Where the chunk that holds `at`, or the one so many before it, begins; at most 40 characters a chunk are looked at."""
    for i in range(chunks):
        while at > 0 and i and text[at - 1].isspace():
            at -= 1
        floor = max(0, at - 40)
        while at > floor and not text[at - 1].isspace():
            at -= 1
    return at


def _on(text: str, at: int, chunks: int) -> int:
    n = len(text)
    for i in range(chunks):
        while at < n and i and text[at].isspace():
            at += 1
        ceiling = n if i == 0 else min(n, at + 40)
        while at < ceiling and not text[at].isspace():
            at += 1
    return at


def _shape(span: str) -> str:
    """Digits as 9, letters as a, repeats once."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", span)))


def features(tokens: list[str], i: int, j: int) -> list[int]:
    """Hashed whole-span features of the tokens from i up to j."""
    span = "".join(tokens[i:j])
    digits = NOT_DIGIT.sub("", span)
    groups = re.findall("[0-9]+", span)
    before = next((t.lower() for t in reversed(tokens[max(0, i - 4) : i]) if not t.isspace()), "^")
    after = tokens[j] if j < len(tokens) else "$"
    marks = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", span))))
    words = [t.lower() for t in tokens[i:j]]
    joins = ("@", "at", "dot", "(", ")", "[", "]", "{", "}")
    # Spaces that don't stand beside what joins an address, and whether it ends in a dot and a few letters.
    loose = sum(t.isspace() and 0 < k < len(words) - 1 and words[k - 1] not in joins and words[k + 1] not in joins for k, t in enumerate(words))
    rest = [t for t in words if not t.isspace() and t not in "()[]{}"]
    ending = len(rest) > 2 and rest[-2] in (".", "dot") and rest[-1].isalpha() and 2 <= len(rest[-1]) <= 4
    named = [
        f"address={loose > 0},{ending},{span.count('@') + words.count('at')}", f"loose={min(loose, 3)},{len(digits) >= 7}", "bias", "shape=" + _shape(span)[:24], f"digits={min(len(digits), 20)}", "groups=" + ",".join(str(len(g)) for g in groups[:6]),
        "marks=" + marks[:8], f"at={span.count('@')}", f"dots={min(span.count('.'), 4)}", f"first={_shape(tokens[i][:1])}", f"last={_shape(tokens[j - 1][-1:])}",
        f"luhn={14 <= len(digits) <= 19 and len(digits) + len(marks) >= len(span) - 5 and luhn(digits)}", f"octets={len(groups) == 4 and all(int(g[:9]) < 256 for g in groups)},{marks}",
        f"phone={10 <= len(digits) <= 15},{bool(re.search('[A-Za-z@]', span))}", f"cut={_shape(tokens[j - 1][-1:])}{_shape(after[:1])}", f"open={_shape(tokens[i - 1][-1:]) if i else '^'}{_shape(tokens[i][:1])}",
        "links=" + ",".join(t for t in (x.lower() for x in tokens[i:j]) if t in ("at", "dot"))[:24], f"groups={len(groups)},{marks[:4]},{max(map(len, groups), default=0) <= 3}",
        "word=" + (before if before.isalpha() else _shape(before)[:3]), f"balanced={span.count('(') == span.count(')')}",
    ]
    return [zlib.crc32(x.encode()) % FEATURES for x in named]


def at_marks(tokens: list[str]) -> list[bool]:
    """Which tokens stand between the two parts of an address: @, or "at" in brackets or, before a "dot", between spaces."""
    words = [t.lower() for t in tokens]
    out = [t == "@" for t in tokens]
    for i, w in enumerate(words):
        if w == "at" and 0 < i < len(words) - 1:
            before, after = (next((t for t in side if not t.isspace()), " ") for side in (words[max(0, i - 2) : i][::-1], words[i + 1 : i + 3]))
            out[i] = after in ")]}" if before in "([{" else "dot" in words[i + 1 : i + 13]
    return out


def segments(tokens: list[str]) -> list[tuple[int, int]]:
    """Candidate entities: at most MOST_TOKENS tokens, from a letter, digit, + or ( to a letter, digit or ), with a mark between
    the parts of an address, seven digits or four groups of them."""
    out, between = [], at_marks(tokens)
    for i, first in enumerate(tokens):
        if not (first.isalnum() or first in "+("):
            continue
        n_digits = marks = n_groups = 0
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            token = tokens[j - 1]
            if token.isspace() and (len(token) > 1 or token != " "):
                break
            if token.isdigit():
                n_digits += len(token)
                n_groups += 1
            marks += between[j - 1]
            if n_digits > 24 or marks > 1:
                break
            if (marks or n_digits >= 7 or n_groups == 4) and (token.isalnum() or token == ")"):
                out.append((i, j))
    return out


class SemiMarkov:
    """Weights of (feature, kind); a token outside entities scores zero."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, len(KINDS))) if weights is None else weights

    @staticmethod
    def prepared(tokens: list[str]) -> tuple[int, list[tuple[int, int]], np.ndarray]:
        found = segments(tokens)
        return len(tokens), found, np.array([features(tokens, i, j) for i, j in found] or np.empty((0, 1)), np.int64)

    def best(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (i, kind, j)."""
        n, found, feats = self.prepared(tokens)
        if not found:
            return []
        scores = self.weights[feats].sum(axis=1)
        kinds, tops = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        ending: dict[int, list[int]] = {}
        for s, (_, j) in enumerate(found):
            if tops[s] > 0:
                ending.setdefault(j, []).append(s)
        total, back = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            total[j] = total[j - 1]
            for s in ending.get(j, ()):
                if total[found[s][0]] + tops[s] > total[j]:
                    total[j], back[j] = total[found[s][0]] + tops[s], s
        out, j = [], n
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                i, _ = found[back[j]]
                out.append((i, kinds[back[j]], j))
                j = i
        return out[::-1]

    def gradient(self, prepared: tuple, gold: set[tuple[int, int, int]], into: np.ndarray) -> float:
        """Adds the gradient of the log-likelihood of the gold entities (i, kind, j); returns the log-likelihood."""
        n, found, feats = prepared
        scores = self.weights[feats].sum(axis=1)
        into_of: dict[int, list[int]] = {}
        out_of: dict[int, list[int]] = {}
        for s, (i, j) in enumerate(found):
            into_of.setdefault(j, []).append(s)
            out_of.setdefault(i, []).append(s)
        most = scores.max(axis=1)
        summed = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
        alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
        starts, stops = np.array([i for i, _ in found]), np.array([j for _, j in found])
        for j in range(1, n + 1):
            own = into_of.get(j)
            alpha[j] = alpha[j - 1] if own is None else np.logaddexp.reduce(np.append(alpha[starts[own]] + summed[own], alpha[j - 1]))
        for i in range(n - 1, -1, -1):
            own = out_of.get(i)
            beta[i] = beta[i + 1] if own is None else np.logaddexp.reduce(np.append(beta[stops[own]] + summed[own], beta[i + 1]))
        expected = np.exp(alpha[starts][:, None] + scores + beta[stops][:, None] - alpha[n])
        truth = np.array([[(i, k, j) in gold for k in range(len(KINDS))] for i, j in found], float)
        np.add.at(into, feats.ravel(), np.repeat(truth - expected, feats.shape[1], axis=0))
        return float((truth * scores).sum() - alpha[n])


def rewritten(kind: int, span: str, turn: int) -> str:
    """Another way to write an entity."""
    digits = NOT_DIGIT.sub("", span)
    if kind == 0:
        local, domain = span.split("@", 1)
        if turn % 2:  # as seen, or of two parts
            domain = ".".join(domain.split(".")[-2:])
        if turn % 3:
            local = local.replace(".", "_" if turn % 3 == 1 else "")
        at, dot = ((" (at) ", " (dot) "), (" [at] ", "."), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", "."), (" AT ", " DOT "))[turn % 7]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", ("[.]", " . ", " dot ", "(.)")[turn % 4])
    if kind == 2:
        return (" ", "-", ".", "_")[turn % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    return (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"1-{local[:3]}-{local[3:6]}-{local[6:]}")[turn % 4]


def examples(text: str, turn: int) -> Iterator[tuple[list[str], set[tuple[int, int, int]]]]:
    """Training windows of a text: as it stands and, if it has entities, rewritten."""
    spans = base_spans(text)
    for begin, stop in windows(text):
        own = [s for s in spans if begin <= s[0] and s[2] <= stop]
        # Of overlapping matches the first stays: a segmentation can't hold both.
        kept: list[tuple[int, int, int]] = []
        for s in own:
            if not kept or s[0] >= kept[-1][2]:
                kept.append(s)
        for rewrite in (None, *range(turn, turn + REWRITES)) if kept else (None,):
            tokens, gold, at = [], set(), begin
            for start, kind, end in kept:
                tokens += TOKEN.findall(text[at:start])
                inner = TOKEN.findall(text[start:end] if rewrite is None else rewritten(kind, text[start:end], rewrite))
                gold.add((len(tokens), kind, len(tokens) + len(inner)))
                tokens += inner
                at = end
            tokens += TOKEN.findall(text[at:stop])
            if len(tokens) <= TRAIN_TOKENS:
                yield tokens, gold


def counterexamples(turn: int) -> list[str]:
    """Numbers that are no personal data: dates, times, amounts, versions, order and book numbers."""
    d = [zlib.crc32(f"{turn}:{i}".encode()) for i in range(8)]
    day, month, year = d[0] % 28 + 1, d[1] % 12 + 1, 1950 + d[2] % 90
    return [
        f"on {year}-{month:02}-{day:02} and {day:02}.{month:02}.{year} at {d[3] % 24:02}:{d[4] % 60:02}:{d[5] % 60:02}", f"between {day}/{month}/{year} and {year}-{month}", f"about {d[3] % 9000:,}.{d[4] % 100:02} of {d[5] % 10**7:,} in {year}",
        f"order {d[6] % 10**8} of {year} costs {d[7] % 10**6}.{d[0] % 100:02}", f"version {d[1] % 20}.{d[2] % 20}.{d[3] % 9} build {d[4] % 10**7}", f"ISBN 978-{d[5] % 9}-{d[6] % 90 + 10}-{d[7] % 10**6:06}-{d[0] % 9}",
        f"we met at noon on day {day} and put a dot at line {d[1] % 90} of page {d[2] % 400}", f"look (at) figure {d[3] % 40} and at the dot in table {month}", f"section {d[4] % 9} dot {d[5] % 20} and rows {d[6] % 90}, {d[7] % 90}, {day}, {month} of {d[1] % 300}",
        f"scores were {d[0] % 10} {d[1] % 10} {d[2] % 10} {d[3] % 10} at home, {d[4] % 40}-{d[5] % 40} and {d[6] % 40}:{d[7] % 40} away", f"sold at {d[3] % 900}.{d[4] % 100:02} dot matrix printers at {d[6] % 90} each",
    ]


def train(texts: list[str], passes: int = PASSES) -> SemiMarkov:
    """Adaptive-gradient ascent of the penalised likelihood over the texts' windows."""
    model = SemiMarkov()
    ready = []
    for turn, text in enumerate(texts):
        for tokens, gold in [*examples(text, turn), *((TOKEN.findall(x), set()) for x in counterexamples(turn)[turn % 3 :: 3])]:
            prepared = model.prepared(tokens)
            if prepared[1] and gold <= {(i, k, j) for i, j in prepared[1] for k in range(len(KINDS))}:
                ready.append((prepared, gold))
    square = np.full_like(model.weights, 1e-2)
    for _ in range(passes):
        for begin in range(0, len(ready), 16):
            step = np.zeros_like(model.weights)
            for prepared, gold in ready[begin : begin + 16]:
                model.gradient(prepared, gold, step)
            step -= DECAY * model.weights
            square += step * step
            model.weights += STEP * step / np.sqrt(square)
    return model


def training_texts(docs: DataFrame) -> list[str]:
    """The bounded training sample: documents in the order of a hash, with and without a match of the known shapes."""
    text = F.col("text")
    shaped = text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([\x20-]?[0-9]){13}|\+[0-9]")
    short = only(docs, "doc_id", "text").where(F.length(text) <= TRAIN_LENGTH)
    order = (F.xxhash64("doc_id", "text"), "doc_id")
    some = lambda rows, n: rows.select("doc_id", F.xxhash64("text").alias("place"), order[0].alias("turn")).orderBy("turn", "doc_id").limit(n)
    # Ids first, so that only chosen texts move: at most TRAIN_WITH + TRAIN_WITHOUT rows.
    chosen = some(short.where(shaped), TRAIN_WITH).unionByName(some(short.where(~shaped & text.rlike("[0-9]")), TRAIN_WITHOUT)).collect()
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, place long, turn long")
    found = only(docs, "doc_id", "text").withColumn("place", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "place"])
    return [r["text"] for r in found.orderBy("turn", "doc_id").select("text", "turn", "doc_id").collect()]


def uncovered(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans leave of the windows, where it still has a digit or @: base spans stay, so entities can only lie between them."""
    b = 0
    for begin, stop in windows(text):
        at = begin
        while b < len(base) and base[b][0] < stop:
            if at < base[b][0] and TRIGGER.search(text, at, base[b][0]):
                yield at, base[b][0]
            at = max(at, base[b][2])
            b += 1
        if at < stop and TRIGGER.search(text, at, stop):
            yield at, stop


def all_spans(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, stop): entities that the field finds beside base spans are added."""
    base = base_spans(text)
    added = []
    for begin, stop in uncovered(text, base):
        tokens = TOKEN.findall(text[begin:stop])
        found = model.best(tokens)
        if found:
            at = [begin]
            for token in tokens:
                at.append(at[-1] + len(token))
            added += [(at[i], kind, at[j]) for i, kind, j in found]
    if not added:
        return base, base
    return base, sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in spans)


def personal_data(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """Every document (doc_id, text) with its personal data.

    Returns doc_id, n_email, n_ip, n_card, n_phone (of the known shapes), base_sha256, spans (kind:start:stop in code points,
    comma-joined, by start and then kind). Null or empty text has none; very long texts are scanned whole, of a chunk without
    white space the 40 characters next to a digit or @ are the field's context. Every row gives one row, repeated ones too; an
    empty table gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))  # of fixed size

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkov(known.value)
        for part, texts in text_batches(it):
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in texts:
                base, every = all_spans(text.decode("utf-8", "replace"), model) if TRIGGER_BYTES.search(text) else ([], [])
                for kind, column in enumerate(counts):
                    column.append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests), pa.array(spans)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return only(docs, "doc_id", "text").mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


TRIGGER_BYTES = re.compile(TRIGGER.pattern.encode())


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_data(docs, train(training_texts(docs)))
