"""Best-fit packing by hierarchical residues.

Every partition packs its own pieces best-fit (longest first, each into the fullest sequence that still takes it) and emits
the nearly full sequences. What stays underfull travels on as one item each, as long as its tokens; groups of partitions are
merged, packed best-fit again, emit again, until the residue fits one task or no longer shrinks. A task's load is bounded at
every round, since the number of groups follows the number of items that are left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.util import Generations, Scratch, bounded_batches, gathered, lean, only, text_batches

SEQUENCE_TOKENS = 2048
#: Unfilled tokens that a sequence may have to be emitted before the last round.
SLACK = 8
#: Items that one task packs in a round, and chunk encodings that a worker keeps.
ROUND_ITEMS, CACHED_CHUNKS = 50_000, 700_000
#: Bytes of text whose new words are encoded together.
BATCH_TEXT_BYTES = 8 << 20

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
ITEM_SCHEMA = "full boolean, tokens int, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
PIECE_TYPE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED_TYPE = pa.struct([*PIECE_TYPE, ("offset", pa.int64())])
ITEM_TYPE = pa.schema([("full", pa.bool_()), ("tokens", pa.int32()), ("pieces", pa.list_(PLACED_TYPE))])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes texts to little-endian 32-bit ids, through a bounded store of the ids of their parts.

    Every distinct part is encoded by the tokenizers library. This tokenizer lower-cases, drops white space and splits
    words from other characters, and none of its steps reaches over ASCII white space, so the ids of a text are the ids of
    its chunks between white space in turn (parts of type bytes). A text of plain Latin letters and ASCII without
    apostrophes splits further, into lower-case words and the runs between them (parts of type str). New words go to the
    library many at a time, since a word's last id always ends in the word-end mark.
    """

    NOT_PLAIN = re.compile("[^\t-\r -&(-~À-ÖØ-öø-ÿ]|<\\|")
    PART = re.compile("[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ\t-\r ]+")
    WORDS_A_CALL = 64

    def __init__(self, path: str, cached: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if s.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[ends] = True
        self.known = Generations(cached or CACHED_CHUNKS)

    def _alone(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        calls = [words[i : i + self.WORDS_A_CALL] for i in range(0, len(words), self.WORDS_A_CALL)]
        for call, found in zip(calls, self.tokenizer.encode_batch_fast([" ".join(x) for x in calls], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends_word[ids]) + 1).tolist()]
            if len(cuts) != len(call) + 1:
                self.known.now.update(zip(call, self._alone(call), strict=True))
                continue
            packed = ids.tobytes()
            self.known.now.update((w, packed[4 * i : 4 * j]) for w, i, j in zip(call, cuts, cuts[1:], strict=False))

    def parts(self, text: bytes) -> list:
        decoded = text.decode("utf-8", "replace")
        return text.split() if self.NOT_PLAIN.search(decoded) else self.PART.findall(decoded.lower())

    def learn(self, parts: set) -> None:
        words, other = [], []
        for x in self.known.missing(parts):
            (words if isinstance(x, str) and x.isalpha() else other).append(x)
        self._learn_words(words)
        for i in range(0, len(other), 4096):
            some = other[i : i + 4096]
            self.known.now.update(zip(some, self._alone([x if isinstance(x, str) else x.decode("utf-8", "replace") for x in some]), strict=True))

    def encode_batch(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [self.parts(x) for x in texts]
        self.learn(set().union(*split))
        known = self.known.now
        for parts in split:
            yield b"".join(map(known.__getitem__, parts))


@cache
def chunk_encoder(path: str, cached: int | None = None) -> ChunkEncoder:
    return ChunkEncoder(path, cached)


class BestFit:
    """Sequences by their free tokens; finds the fullest that takes a length in a few machine steps."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free, self.mask = capacity, [], [[] for _ in range(capacity + 1)], 0

    def put(self, length: int, item: object) -> None:
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self.free[free].pop()
            if not self.free[free]:
                self.mask ^= 1 << free
        else:
            free, at = self.capacity, len(self.bins)
            self.bins.append([])
        self.bins[at].append(item)
        left = free - length
        if left:
            self.free[left].append(at)
            self.mask |= 1 << left


def pack(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best-fit decreasing of (tokens, pieces) items; the same items always pack alike."""
    fit = BestFit(capacity)
    for tokens, pieces in sorted(items, key=lambda x: (-x[0], [(p["doc_id"] is None, p["doc_id"] or 0, p["piece"]) for p in x[1][:1]])):
        fit.put(tokens, (tokens, pieces))
    out = []
    for held in fit.bins:
        at, placed = 0, []
        for _, pieces in held:
            for piece in pieces:
                placed.append(piece | {"offset": at})
                at += piece["length"]
        out.append((at, placed))
    return out


def _batches_of(packed: list[tuple[int, list]], capacity: int, slack: int, last: bool) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(packed), 2000):
        some = packed[begin : begin + 2000]
        yield pa.RecordBatch.from_pydict({"full": [last or t >= capacity - slack for t, _ in some], "tokens": [t for t, _ in some], "pieces": [p for _, p in some]}, schema=ITEM_TYPE)


def pieces_of(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = 0, cached: int | None = None, batch_bytes: int = BATCH_TEXT_BYTES) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut into pieces of `capacity` only where it is longer.

    `cached` (CACHED_CHUNKS) and `batch_bytes` trade a worker's memory for time, never results.
    """
    bounded_batches(docs.sparkSession)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = chunk_encoder(path, cached), np.asarray([end_id], "<u4").tobytes()
        for part, texts in gathered(text_batches(it), batch_bytes):
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode_batch(texts), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, i, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(out, PIECE_TYPE, strict=True)], names=[t.name for t in PIECE_TYPE])

    return only(docs, "doc_id", "text").mapInArrow(lean(cut), PIECE)


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, slack: int = SLACK, round_items: int = ROUND_ITEMS) -> DataFrame:
    """Assigns pieces (doc_id, piece, start, length <= capacity, ids_crc32) to sequences: adds sequence_id and offset.

    Rounds go on until the residue fits one task, or until a round no longer shrinks it (items over half a sequence that
    nothing fits beside), where what is left is emitted as it is.
    """
    scratch = Scratch(pieces.sparkSession, "packing")

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []
        for batch in it:
            held += [(x["length"], [x]) for x in batch.to_pylist()]
            if len(held) >= round_items:
                yield from _batches_of(pack(held, capacity), capacity, slack, False)
                held = []
        yield from _batches_of(pack(held, capacity), capacity, slack, False)

    def merged(last: bool):
        def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [(x["tokens"], x["pieces"]) for batch in it for x in batch.to_pylist()]
            yield from _batches_of(pack(items, capacity), capacity, slack, last)

        return again

    done, level = [], scratch.write(pieces.mapInArrow(lean(local), ITEM_SCHEMA), "round-0")

    def open_items(frame: DataFrame) -> int:
        """Underfull sequences, or a quarter of their pieces if that is more: what bounds a task's memory."""
        n, n_pieces = frame.where("NOT full").agg(F.count(F.lit(1)), F.sum(F.size("pieces"))).first()
        return max(n, -(-(n_pieces or 0) // 4))

    left, before, i = open_items(level), None, 0
    while left:
        groups = -(-left // round_items)
        last = groups == 1 or (before is not None and left > 0.98 * before)
        done.append(level.where("full"))
        # Dealt by a hash of the first piece: groups mix residues of all lengths, and a retried task finds the same items.
        residue = level.where("NOT full").repartition(groups, F.xxhash64(F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["piece"], F.lit(i)))
        i += 1
        level = scratch.write(residue.mapInArrow(lean(merged(last)), ITEM_SCHEMA), f"round-{i}")
        left, before = (0 if last else open_items(level)), left
    done.append(level.where("full"))
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    rows = out.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces").select("sequence_id", F.explode("pieces").alias("p"))
    return rows.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def packed(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE_TOKENS, cached: int | None = None, batch_bytes: int = BATCH_TEXT_BYTES, **options: int) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most `capacity` tokens; one row per piece.

    Null or empty text is the end id alone. Longer documents are cut into pieces of `capacity`, the last one shorter; very long
    texts are encoded whole. Repeated rows are packed each, with equal doc_id and piece; of items of one length the smaller
    doc_id goes first. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    return pack_pieces(scratch.write(pieces_of(docs, path or tokenizer_path(), capacity, 0, cached, batch_bytes), "pieces"), capacity, **options)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
