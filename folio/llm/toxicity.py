"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of itself, so a misspelling that was never seen shares
most of its parts with words that were. A window of words is the mean of its words, classified by a linear softmax; a
document is as toxic as its most toxic window, which a few words in a long text would not be on the average of all. Training
starts on whole documents and then goes on with each document's most toxic windows (the label is the document's, windows
are not marked), with adaptive gradient steps for embeddings and softmax together.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.util import Generations, bounded_batches, lean, only, text_batches

#: Buckets of n-grams, embedding length, n-gram lengths, words of a window.
BUCKETS, WIDTH, NGRAMS, WINDOW = 1 << 17, 8, (3, 4, 5), 3
#: Labelled documents of each class that training reads at most, in the order of a hash, and the longest of them in characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_LENGTH = 800, 1600, 20_000
#: Passes over whole documents and over worst windows, such windows of a document (that don't overlap), step, weight decay.
WARM, PASSES, WORST, STEP, DECAY = 25, 60, 3, 0.05, 1e-4
#: Training documents of at least so many that must hold an n-gram for it to be trained.
LEAST_DOCS = 3
#: Documents whose words are in memory as vectors at a time in training.
CHUNK_DOCS = 200
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: Words' scores that a scoring task keeps, and bytes of text that are words at a time.
CACHED_WORDS, SCORE_BYTES = 400_000, 2 << 20


def ngram_ids(word: str) -> list[int]:
    """Buckets of the n-grams of <word> and of the whole."""
    marked = f"<{word}>"
    parts = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in (*parts, marked)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    """word_weight: what each n-gram adds to the difference of the two classes' logits; bias: the same without words."""

    ngram: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> list[float]:
        ids = [ngram_ids(w) for w in words]
        lengths = np.array([len(x) for x in ids])
        flat = self.ngram[np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))]
        return (np.add.reduceat(flat, np.cumsum(lengths) - lengths) / lengths).tolist() if words else []

    def score(self, scores: list[float]) -> float:
        """The probability for a document's word scores; a text without words has the bias alone."""
        logit = self.bias + (windowed(np.array(scores)).max() if scores else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def windowed(scores: np.ndarray) -> np.ndarray:
    """Means over every window of WINDOW words, or over all if they are fewer."""
    n = min(WINDOW, len(scores))
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return (sums[n:] - sums[:-n]) / n


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fits embeddings and softmax to documents labelled 0 or 1; without both classes every score is the share of toxic ones."""
    labels = np.array(toxic, float)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), 30.0 if share else -30.0)
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, labels = [docs[i] for i in keep], labels[keep]
    lengths, flat = array("i"), array("i")
    for word in numbers:
        own = ngram_ids(word)
        lengths.append(len(own))
        flat.extend(own)
    lengths, grams = np.array(lengths, np.int64), np.array(flat)
    del numbers, flat
    begins = np.cumsum(lengths) - lengths
    gram_places = lambda own: np.repeat(begins[own] - (np.cumsum(lengths[own]) - lengths[own]), lengths[own]) + np.arange(lengths[own].sum())
    # N-grams of few documents would only learn those documents by heart.
    seen = np.zeros(BUCKETS, np.int32)
    for d in docs:
        seen[np.unique(grams[gram_places(np.unique(d))])] += 1
    trained = seen >= min(LEAST_DOCS, len(docs))
    rng = np.random.default_rng(0)
    embed = (rng.normal(0, 0.1, (BUCKETS, WIDTH)) * trained[:, None]).astype(np.float32)
    soft = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (embed, soft, offset)]
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))  # both classes count alike
    per_word = np.zeros(len(lengths), np.float32)

    def bag(i: int, warm: bool) -> tuple[np.ndarray, np.ndarray]:
        """A document's words in play and their weights: every distinct word, or those of the WORST most toxic windows."""
        d = docs[i]
        if warm:
            own = np.unique(d)
            return own, np.full(len(own), 1 / len(own))
        means, n = windowed(per_word[d]), min(WINDOW, len(d))
        worst: list[int] = []
        for at in np.argsort(-means, kind="stable")[: WORST * (2 * n - 1)].tolist():
            if len(worst) < WORST and all(abs(at - w) >= n for w in worst):
                worst.append(at)
        worst = np.array(worst)
        return d[(worst[:, None] + np.arange(n)).ravel()], np.full(n * len(worst), 1 / (n * len(worst)))

    for turn in range(1, WARM + PASSES + 1):
        if turn > WARM:
            per_gram = embed @ (soft[:, 1] - soft[:, 0])
            for w in range(0, len(lengths), 50_000):
                own = lengths[w : w + 50_000]
                first = int(begins[w])
                per_word[w : w + 50_000] = np.add.reduceat(per_gram[grams[first : first + int(own.sum())]], begins[w : w + 50_000] - first) / own
        down, soft_down, offset_down = np.zeros_like(embed), DECAY * soft, np.zeros(2)
        step = CHUNK_DOCS if turn <= WARM else len(docs)
        for begin in range(0, len(docs), step):
            bags = [bag(i, turn <= WARM) for i in range(begin, min(begin + step, len(docs)))]
            sizes = np.array([len(x) for x, _ in bags])
            at_doc, at_word, at_share = np.repeat(np.arange(len(bags)), sizes), np.concatenate([x for x, _ in bags]), np.concatenate([x for _, x in bags]).astype(np.float32)
            own, place = np.unique(at_word, return_inverse=True)
            own_grams, own_lengths = grams[gram_places(own)], lengths[own]
            own_begins = np.cumsum(own_lengths) - own_lengths
            vectors = np.add.reduceat(embed[own_grams], own_begins, axis=0) / own_lengths[:, None].astype(np.float32)
            mixed = np.add.reduceat(vectors[place] * at_share[:, None], np.cumsum(sizes) - sizes, axis=0)
            logits = mixed @ soft + offset
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            truth = labels[begin : begin + len(bags)]
            error = ((chance - np.stack([1 - truth, truth], axis=1)) * weight[begin : begin + len(bags), None]).astype(np.float32)
            to_doc = error @ soft.T
            for k in range(WIDTH):
                to_word = np.bincount(place, to_doc[at_doc, k] * at_share, len(own)) / own_lengths
                down[:, k] += np.bincount(own_grams, np.repeat(to_word, own_lengths), BUCKETS)
            soft_down = soft_down + mixed.T @ error
            offset_down = offset_down + error.sum(axis=0)
        down = down * trained[:, None] + DECAY * embed
        for x, slope, (mean, square) in zip((embed, soft, offset), (down, soft_down, offset_down), moments, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            x -= STEP * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        embed *= trained[:, None]
    return Model(embed @ (soft[:, 1] - soft[:, 0]), float(offset[1] - offset[0]))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded sample: labelled documents that are not held out, of each class the first in the order of a hash of the text."""
    known = only(labels, "doc_id", "toxic").where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = only(docs, "doc_id", "text").where(F.length("text").between(1, SAMPLE_LENGTH)).select("doc_id", F.xxhash64("text").alias("place")).join(known, "doc_id")
    # Ids first, so that only chosen texts move.
    chosen = [r for toxic, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in rows.where(F.col("toxic") == toxic).orderBy("place", "doc_id").limit(n).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["place"], r["toxic"]) for r in chosen], "doc_id long, place long, toxic int")
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows.
    found = only(docs, "doc_id", "text").withColumn("place", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "place"]).orderBy("toxic", "place", "doc_id").collect()
    return [r["text"] for r in found], [r["toxic"] for r in found]


def _rated(docs: DataFrame, model: Model, rows, schema) -> DataFrame:
    """Scores texts in batches; rows(part, scores) gives what comes out."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast((model.ngram.astype(np.float32), model.bias))  # of fixed size

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Model(*known.value), Generations(CACHED_WORDS)
        for part, texts in text_batches(it, most=SCORE_BYTES):
            split = [words_of(x.decode("utf-8", "replace")) for x in texts]
            missing = seen.missing({w for words in split for w in words})
            for i in range(0, len(missing), 20_000):
                seen.now.update(zip(missing[i : i + 20_000], model.word_scores(missing[i : i + 20_000]), strict=True))
            now = seen.now
            yield rows(part, [model.score([now[w] for w in words]) for words in split])

    return docs.mapInArrow(lean(rate), schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every document (doc_id, text) with score (0 to 1) and predicted (1 from 0.5 on).

    Only the text decides: equal texts score alike. Null, empty or wordless text scores by the bias alone. Every row gives
    one row; an empty table gives none; other columns are ignored.
    """

    def rows(part: pa.RecordBatch, scores: list[float]) -> pa.RecordBatch:
        return pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return _rated(only(docs, "doc_id", "text"), model, rows, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that score under 0.5: filtered where they are read, no row moves."""
    plain = docs.toDF(*("text" if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)))  # names may hold dots
    return _rated(plain, model, lambda part, scores: part.filter(pa.array([x < 0.5 for x in scores], pa.bool_())), plain.schema).toDF(*docs.columns)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*training_sample(docs, labels))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
