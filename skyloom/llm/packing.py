"""Best-fit packing of tokenised documents into sequences of bounded length.

The plan is made over counts: a histogram of piece lengths (at most `capacity` rows)
goes to the driver, lengths are placed from the longest down, and all pieces of a length
that fit the tightest remaining space move there at once. A plan record says which ranks
of a length take which run of sequences at which offset; there are at most about
capacity * ln(capacity) records, whatever the number of documents. Documents then take
their slots by joining the plan on their length and rank within it. Ranks are counted in about sqrt(n) salted
parts of each length, so a length that holds a third of all rows is no single task.

Null texts count as empty: a piece of just the end id. Repeated rows and null ids are
packed like any other row; an empty table gives an empty result. Texts of any length are
encoded whole and cut; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from functools import lru_cache
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.bpe import byte_letters
from skyloom.llm.common import in_slices, materialize, texts_of, whole_text

CAPACITY = 4096
END_ID = 1
MEMO_WORDS = 200_000
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Fixed value: how the vocabulary of this kind parts normalised text into pieces.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters whose lower case depends on their neighbours or is more than one letter.
UNSAFE = ("\u0130", "\u03a3")


class WordIds:
    """Ids of whole texts by a tokenizers file, piece by piece; pieces recur, so their ids are kept.

    The vocabulary composes, lower-cases and parts a text before it merges letters, and no
    merge crosses pieces. Texts where composing or lower-casing could move the borders, or
    that name a special token, go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.safe: set[str] = set()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.pieces: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def plain(self, text: str, low: str) -> bool:
        if text.isascii():
            return not ("<" in text and any(s in text for s in self.specials))
        new = set(text) - self.safe
        if new:
            # letters that this Python does not know may be classed otherwise by the library
            self.safe |= {c for c in new if c not in UNSAFE and category(c) != "Cn"}
            if new - self.safe:
                return False
        if "<" in text and any(s in text for s in self.specials):
            return False
        return is_normalized("NFC", text) and is_normalized("NFC", low)

    def word(self, raw: bytes) -> bytes:
        """Ids of one white-space separated word; words and their pieces are both kept."""
        out = b""
        for piece in PIECE.findall(raw.decode()):
            ids = self.pieces.get(piece)
            if ids is None:
                letters = piece.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
                if len(self.pieces) >= MEMO_WORDS:
                    self.pieces.clear()
                if len(ids) <= 256:
                    self.pieces[piece] = ids
            out += ids
        if len(self.words) >= MEMO_WORDS:
            self.words.clear()
        if len(out) <= 256:
            self.words[raw] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers. Words are parted at ASCII white space, which no piece holds."""
        low = text.lower()
        if not self.plain(text, low):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, new = self.words.get, self.word
        return b"".join([get(w) or new(w) for w in low.encode().split()])


@lru_cache(maxsize=2)
def load_words(path: str) -> WordIds:
    return WordIds(path)


def cut_documents(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = load_words(vocab_path), np.uint32(end_id).astype("<u4").tobytes()
        rows = []
        for k, text in enumerate(texts_of(batch, "the_text")):
            ids = words.encode(text) + end
            for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + capacity)]
                rows.append((k, n, start, len(part) // 4, zlib.crc32(part)))
        k, n, start, length, crc = zip(*rows)
        arrays = [batch.column("doc_id").take(pa.array(k)), pa.array(n, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("the_text")), work, PIECES)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, count, first sequence, offset).

    Ranks first rank .. first rank + count - 1 of that length go to consecutive sequences
    from the first one on, all at that offset.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # remaining space: runs (first sequence, count)
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        spaces = sorted((s for s in room if s >= length), reverse=True)
        while left:
            if spaces:
                space = spaces[-1]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop()
            else:  # new sequences, as many as it takes
                space, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = space // length  # a sequence takes all it can hold before the next one does
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for at, many, layers in ((first, full, each), (first + full, 1, rest)):
                if many and layers:
                    for layer in range(layers):
                        plan.append((length, rank, many, at, capacity - space + layer * length))
                        rank += many
                    if space > layers * length:
                        room.setdefault(space - layers * length, []).append((at, many))
            left -= full * each + rest
            used = full + bool(rest)
            if used < n:
                room.setdefault(space, []).append((first + used, n - used))
    return plan


def ranked(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """Adds rank (from 0) within length; each length is counted in about sqrt(n) parts."""
    parts = histogram.select("length", F.ceil(F.sqrt("n")).alias("parts"))
    salted = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("rid"), "parts")).drop("parts")
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("rid")
    return (
        salted.withColumn("nth", F.row_number().over(inside) - 1)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .drop("part", "nth", "before")
    )


def pack_documents(docs: DataFrame, vocab_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_documents(docs, vocab_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    pieces = materialize(pieces.withColumn("rid", F.monotonically_increasing_id()), "packing-pieces")
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = materialize(histogram, "packing-histogram")  # at most `capacity` rows
    plan = plan_slots({r["length"]: r["n"] for r in histogram.collect()}, capacity)
    slots = docs.sparkSession.createDataFrame(plan, "length long, first_rank long, n_ranks long, first_sequence long, offset long")
    if len(plan) <= BROADCAST_ROWS:  # it grows with the capacity, not with the documents
        slots = F.broadcast(slots)
    within = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_ranks"))
    placed = ranked(pieces, histogram).join(slots, "length").where(within)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"
    )


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing needs fewer sequences than this."""
    return math.ceil(sum(k * n for k, n in counts.items()) / capacity)
