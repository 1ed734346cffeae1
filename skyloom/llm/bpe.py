"""Byte-level BPE encoding and decoding of whole documents.

A word keeps its parts' boundaries, their ids and the ranks of adjacent pairs in
contiguous arrays. The smallest rank is searched by scanning, its boundary deleted, and
the two neighbouring ranks refreshed, until no pair can merge. Scanning is quadratic, so
words longer than `LONG_WORD` bytes take the same merges in the same order from a heap.

The pattern's tables of letters and digits are newer than those that the vocabulary is used
with. Characters that Python's own tables do not know are looked up with the vocabulary's
word breaker, one by one, and stand-ins of that kind take their places in the pattern.

Null texts encode to no ids and decode to the empty text. Rows are independent of each
other: repeated rows, null ids, empty tables and extra columns need no special care. Texts of
any length are encoded whole; a single long word costs n log n.
"""

from __future__ import annotations

import heapq
import json
from functools import cached_property, lru_cache
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import in_slices, map_texts, whole_text

LONG_WORD = 96
MEMO_WORDS = 200_000
#: Fixed value: how byte-level vocabularies of this kind part a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A letter, a digit and neither, for characters whose kind the pattern's tables do not tell as the vocabulary's own do.
STAND_INS = ("\u00e9", "\u0663", "\ue000")
NO_RANK = 1 << 60
PAIR = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        self.path, self.kinds = path, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab, ending = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + ending] for c in letters]  # a word's last byte
        self.pair_rank: dict[int, int] = {}  # left id * PAIR + right id
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_rank[vocab[a] * PAIR + vocab[b]] = rank
            self.merged.append(vocab[a + b])
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = specials
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.piece = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for token, i in vocab.items():
            self.piece[i] = bytes(byte_of[c] for c in (token.removesuffix(ending) if ending else token))
        for token, i in specials.items():
            self.piece[i] = token.encode()
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge_short(self, word: bytes) -> list[int]:
        bounds = list(range(len(word) + 1))
        ids = [*[self.first[b] for b in word[:-1]], self.last[word[-1]]]
        get, merged = self.pair_rank.get, self.merged
        ranks = [get(a * PAIR + b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            del bounds[i + 1], ids[i + 1], ranks[i]
            here = ids[i] = merged[low]
            if i:
                ranks[i - 1] = get(ids[i - 1] * PAIR + here, NO_RANK)
            if i < len(ranks):
                ranks[i] = get(here * PAIR + ids[i + 1], NO_RANK)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        ids = [*[self.first[b] for b in word[:-1]], self.last[word[-1]]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pair_rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * PAIR + ids[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(ids[a] * PAIR + ids[b], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def merged_ids(self, word: str) -> list[int]:
        raw = word.encode()
        return self.merge_long(raw) if len(raw) > LONG_WORD else self.merge_short(raw)

    def word_ids(self, word: str) -> tuple[int, ...]:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        ids = tuple(self.merged_ids(word))
        if len(word) <= LONG_WORD and (word.isascii() or "Cn" not in map(category, word)):
            self.memo[word] = ids
        return ids

    @cached_property
    def breaker(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def stand_in(self, c: str) -> str:
        """The character itself, or one that the pattern takes for the kind that the vocabulary's word breaker finds."""
        if category(c) != "Cn":
            return c
        if c not in self.kinds:
            kind = next((k for k, start in enumerate("a1") if len(self.breaker.pre_tokenize_str(start + c)) == 1), 2)
            self.kinds[c] = STAND_INS[kind]
        return self.kinds[c]

    def words(self, text: str) -> list[str]:
        """The words of a text that may hold characters of unsure kind."""
        return [text[m.start() : m.end()] for m in WORDS.finditer("".join(map(self.stand_in, text)))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, add = self.memo.get, out.extend
        for part in self.special_split.split(text) if self.special_split and any(s in text for s in self.specials) else (text,):
            if part in self.specials:
                out.append(self.specials[part])
                continue
            done = len(out)
            for word in WORDS.findall(part):
                ids = get(word)
                if ids is None:
                    if not word.isascii() and "Cn" in map(category, word):  # such words are never kept, so each is seen here
                        del out[done:]
                        for sure in self.words(part):
                            add(self.word_ids(sure))
                        break
                    ids = self.word_ids(word)
                add(ids)
        return out

    def decode(self, ids) -> str:
        piece = self.piece
        return b"".join([piece[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, ids array<int>."""

    def work(texts: list[str]) -> list[pa.Array]:
        bpe = load_bpe(vocab_path)
        found = [bpe.encode(t) for t in texts]
        bounds = np.cumsum([0, *map(len, found)])
        ids = np.fromiter(chain.from_iterable(found), "int32", bounds[-1])
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("the_text"))
    return map_texts(rows, work, "ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Per row of (doc_id, ids): the same, and decoded."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load_bpe(vocab_path)
        column = batch.column("ids")
        ids, bounds = column.flatten().to_numpy().tolist(), column.offsets.to_numpy()
        bounds = (bounds - bounds[0]).tolist()
        decoded = pa.array([bpe.decode(ids[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return in_slices(encoded.select("doc_id", "ids"), work, "doc_id long, ids array<int>, decoded string")
