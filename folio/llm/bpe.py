"""Byte-level BPE by a pair occurrence index.

A batch's distinct pre-tokens are laid out as one row of symbols. An index maps every adjacent pair that a merge rule names
to all its positions; the active ranks are taken in ascending order, each merges at all its positions at once, and only the
lists of the pairs around them change. A rule's own symbol only occurs in later rules, so one ascending pass is enough.
Encodings of chunks are kept in a bounded store; a text's ids are its chunks' ids in turn.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folio.llm.util import Generations, bounded_batches, gathered, only, text_batches

#: Bytes of text whose new chunks are encoded together, and chunks that a worker keeps.
BATCH_TEXT_BYTES, CACHED_CHUNKS = 24 << 20, 400_000
#: The public pre-token pattern of this byte-level vocabulary (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beyond the six ASCII characters; where a text has some, it is split as a whole.
RARE_SPACE = "[\x1c-\x1f\x85\xa0  -     　]"
#: Characters beyond ASCII and accented Latin letters; without any, the pattern has a plain form.
NOT_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
PLAIN_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9À-ÖØ-öø-ÿ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: A word with the space before it, or a run of white space: no pre-token crosses these borders (see chunks()).
CHUNK = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?= [^ \t-\r])|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+(?=[ \t-\r])|[ \t-\r]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: visible Latin-1 stands for itself, the rest for code points from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(visible)]
    return {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile(b"(" + b"|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + b")") if self.special else None
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocabulary.items() if s.encode() not in self.special} | {i: s for s, i in self.special.items()}
        self.byte_ids = np.zeros(256, np.int32)
        for s, i in vocabulary.items():
            if len(s) == 1:
                self.byte_ids[alphabet[s]] = i
        rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]):
            rules.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        self.by_rank = {rank: (a, b, new) for (a, b), (rank, new) in rules.items()}
        order = sorted(rules)
        self.rule_keys = np.array([(a << 32) | b for a, b in order], np.int64)
        self.rule_ranks = np.array([rules[x][0] for x in order], np.int64)
        self.pre_token = regex.compile(PRE_TOKEN)
        self.rare = re.compile(RARE_SPACE)
        self.known = Generations(CACHED_CHUNKS)

    def ranks_of(self, symbols: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions among `at` whose pair with the next symbol has a rule, and the rules' ranks."""
        first, second = symbols[at].astype(np.int64), symbols[right[at]]
        keys = np.where((first < 0) | (second < 0), -1, (first << 32) | second)
        rule = np.minimum(np.searchsorted(self.rule_keys, keys), len(self.rule_keys) - 1)
        found = self.rule_keys[rule] == keys
        return at[found], self.rule_ranks[rule[found]]

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Encodes distinct pre-tokens together over one pair occurrence index.

        symbols holds all words with a border of -1 after each (no rule names it), left and right link the symbols that are
        alive. The index maps a pair, by its rule's rank, to arrays of positions; a position that an earlier merge took apart
        is found out by comparing symbols.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1)
        n = int(ends[-1]) if len(words) else 0
        symbols = np.full(n + 1, -1, np.int32)
        inner = np.ones(n + 1, bool)
        inner[ends - 1] = inner[n] = False
        symbols[inner] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        left, right = np.arange(-1, n, dtype=np.int32), np.minimum(np.arange(1, n + 2, dtype=np.int32), n)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            at, ranks = self.ranks_of(symbols, right, at)
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = 0
            for end in [*cuts.tolist(), len(at)]:
                rank = int(ranks[begin])
                if rank in index:
                    index[rank].append(at[begin:end])
                else:
                    index[rank] = [at[begin:end]]
                    heapq.heappush(active, rank)
                begin = end

        enter(np.arange(n, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            a, b, new = self.by_rank[rank]
            lists = index.pop(rank)
            own = lists[0] if len(lists) == 1 else np.concatenate(lists)
            own = own[(symbols[own] == a) & (symbols[right[own]] == b)]
            if not len(own):
                continue
            if a == b:  # in a run such as aaa every second pair merges, from the left
                own = np.sort(own)
                fresh = np.concatenate([[True], own[1:] != right[own[:-1]]])
                since = np.arange(len(own)) - np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
                own = own[since % 2 == 0]
            gone = right[own]
            after = right[gone]
            symbols[own], symbols[gone] = new, -2
            right[own], left[after] = after, own
            before = left[own]
            enter(np.unique(np.concatenate([own, before[before >= 0]])))
        ids = symbols[:n][symbols[:n] != -2]
        flat, out, begin = ids.tolist(), [], 0
        for end in np.flatnonzero(ids == -1).tolist():
            out.append(tuple(flat[begin:end]))
            begin = end + 1
        return out

    def chunks(self, text: bytes) -> list:
        """Splits at borders that no pre-token crosses, cheaply if the only white space is ASCII.

        A pre-token has white space at its start (one space before a word) or is all white space, so a word with one space
        before it stands alone; of a longer run of white space the last character goes to the word only if it is a space.
        """
        if self.special_split is not None and b"<|" in text and (parts := self.special_split.split(text))[1:]:
            return [x for i, part in enumerate(parts) if part for x in ([part] if i % 2 else self.chunks_of(part))]
        return self.chunks_of(text)

    def chunks_of(self, text: bytes) -> list:
        """Whole pre-tokens (str) of texts in ASCII and Latin letters; else chunks (bytes), or the pattern's pre-tokens of a text with rare white space."""
        decoded = text.decode("utf-8", "replace")
        if not NOT_PLAIN.search(decoded):
            return PLAIN_PRE_TOKEN.findall(decoded)
        if self.rare.search(decoded):
            return [x.encode() for x in self.pre_token.findall(decoded)]
        return CHUNK.findall(text)

    def learn(self, distinct: set) -> None:
        """Encodes the chunks that aren't known yet; the store stays bounded.

        Nothing here is part of a cycle, so the collector would only walk over the many new tuples in vain.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            self._learn(distinct)
        finally:
            if collects:
                gc.enable()

    def _learn(self, distinct: set) -> None:
        missing = self.known.missing(distinct)
        whole = [x for x in missing if isinstance(x, str)]
        words = {x: [x] if x in self.special or x.isspace() else [w.encode() for w in self.pre_token.findall(x.decode("utf-8", "replace"))] for x in missing if isinstance(x, bytes)}
        pieces = list({w for x in words.values() for w in x if w not in self.special})
        encoded = self.merge_all([x.encode() for x in whole] + pieces)
        self.known.now.update(zip(whole, encoded, strict=False))
        ids = dict(zip(pieces, encoded[len(whole) :], strict=True)) | {w: (i,) for w, i in self.special.items()}
        for x, parts in words.items():
            self.known.now[x] = ids[parts[0]] if len(parts) == 1 else tuple(i for w in parts for i in ids[w])

    def encode_batch(self, texts: list[bytes]) -> Iterator[list[int]]:
        """The ids of each text. Texts are split twice, so that only distinct chunks are ever held."""
        distinct: set = set()
        for text in texts:
            distinct.update(self.chunks(text))
        self.learn(distinct)
        known = self.known.now.__getitem__
        for text in texts:
            yield list(chain.from_iterable(map(known, self.chunks(text))))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text: the ids' bytes, with the replacement character for what isn't UTF-8."""
        found = b"".join(map(self.bytes_of.__getitem__, ids))
        return found.decode("utf-8", "replace").encode()


@cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def round_trip(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 and, with keep, the ids and decoded text.

    Null or empty text has no ids. Every row gives one row; an empty table gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def both_ways(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        decimal = [b"%d," % i for i in range(max(bpe.bytes_of) + 1)]
        for part, texts in gathered(text_batches(it), BATCH_TEXT_BYTES):
            found: tuple[list, ...] = ([], [], [], [], [])
            for ids in bpe.encode_batch(texts):
                decoded = bpe.decode(ids)
                row = (len(ids), hashlib.sha256(b"".join(map(decimal.__getitem__, ids))[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids, decoded.decode())
                for column, value in zip(found, row[: 5 if keep else 3], strict=False):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())[: 5 if keep else 3]
            names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")[: len(types) + 1]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()).combine_chunks(), *(pa.array(x, t) for x, t in zip(found, types, strict=False))], names=names)

    return only(docs, "doc_id", "text").mapInArrow(both_ways, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), keep=False)
