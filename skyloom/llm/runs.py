"""Periodic runs of words, found by a dictionary of basic factors.

A run is a stretch of words that repeats with a smallest period q at least `power` times,
is at least `least` words long, and cannot be extended. Per text:

1. Factors of 1, 2, 4, ... words get names, equal ones the same name: a name of 2L words is
   the pair of the names of its halves. Factors that have no equal one within a quarter of
   the text are in no run and get no name, so the dictionary of an ordinary text ends early.
2. Each factor of L words looks for its successor, the next occurrence, within 2L. Where the
   successor's own successor is as far again, the three form an arithmetic progression and
   propose its difference as a period. In a run of period q with L/2 < q <= L the first words
   begin such a progression of difference q, so every run is proposed.
3. Proposals are extended to both sides by the names, from the longest factors down to single
   words; equal stretches keep their smallest period.

Texts that are null, empty or blank have no words and no runs. Rows are independent of each
other: repeated rows, null ids, empty tables and extra columns need no special care. Texts of
any length are searched whole, in n log n steps for their words and proposals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import map_texts, whole_text

LEAST, POWER = 6, 4
#: Words of several texts that are searched together; a longer text is searched by itself.
BATCH_WORDS = 200_000
RUNS = "array<struct<start:long,length:long,period:long>>"
SPACE = r"[\x20\x09-\x0D]+"


def word_numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, one after the other, each followed by a number of its own; and the texts' places.

    Equal words of one text have equal numbers, words of different texts different ones.
    """
    out: list[int] = []
    starts, free = [], 0
    for words in texts:
        starts.append(len(out))
        seen: dict[bytes, int] = {}
        give = seen.setdefault
        out += [give(w, free + k) for k, w in enumerate(words)]
        out.append(free + len(words))
        free += len(words) + 1
    return np.array(out, "int64"), np.array([*starts, len(out)], "int64")


class Factors:
    """The dictionary of basic factors of a number sequence; `near` bounds, for each place, how far an equal factor counts."""

    def __init__(self, numbers: np.ndarray, near: np.ndarray, longest: int):
        self.n, self.near = len(numbers), near
        self.names: list[np.ndarray] = []  # by level; -1 has no equal
        places, codes, length = np.arange(self.n), numbers, 1
        self.proposals: list[tuple[np.ndarray, np.ndarray]] = []
        while len(places) and length <= longest:
            names = self.name(places, codes, length)
            if not len(names):
                break
            held = self.names[-1]
            places = names[names + length < self.n]
            second = held[places + length]
            places, second = places[second >= 0], second[second >= 0]
            codes = held[places].astype("int64") * self.n + second
            length *= 2

    def name(self, places: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
        """Names the factors of a level, notes the periods they propose, and returns the places that have a name."""
        order = np.argsort(codes, kind="stable")
        at, sorted_codes = places[order], codes[order]
        equal = sorted_codes[1:] == sorted_codes[:-1]
        gap = np.where(equal, at[1:] - at[:-1], self.n)
        close = gap <= self.near[at[:-1]]
        named = np.zeros(len(at), bool)
        named[:-1] |= close
        named[1:] |= close
        number = np.concatenate([[0], np.cumsum(~equal)])
        level = np.full(self.n + 1, -1, "int64")
        level[at[named]] = number[named]
        self.names.append(level)
        after = np.zeros(self.n, "int64")
        after[at[:-1][close & (gap <= 2 * length)]] = gap[close & (gap <= 2 * length)]
        first = np.flatnonzero(after)
        first = first[after[first + after[first]] == after[first]]
        step = after[first]
        if len(first):  # neighbours with one difference propose one stretch
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1] + 1) | (step[1:] != step[:-1])
            self.proposals.append((first[new], step[new]))
        return np.sort(at[named])

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names = self.names[level]
        inside = (a >= 0) & (b < self.n)
        x, y = names[np.where(inside, a, self.n)], names[np.where(inside, b, self.n)]
        return (x >= 0) & (x == y)

    def extend(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many words after (before) places a and b are equal."""
        far = np.zeros(len(a), "int64")
        for level in range(len(self.names) - 1, -1, -1):
            length = 1 << level
            more = np.ones(len(a), bool)
            while more.any():  # more than once only at the top
                shift = -far - length if back else far
                more &= self.same(level, a + shift, b + shift)
                far[more] += length
        return far

    def runs(self, least: int, power: int) -> np.ndarray:
        """Rows (start, length, period), by start, then period."""
        if not self.proposals:
            return np.empty((0, 3), "int64")
        i, q = (np.concatenate(x) for x in zip(*self.proposals))
        before = self.extend(i, i + q, True)
        start, length = i - before, before + self.extend(i, i + q, False) + q
        found = np.stack([start, length, q], axis=1)[length >= np.maximum(least, power * q)]
        found = found[np.lexsort(found.T[::-1])]
        other = np.ones(len(found), bool)
        other[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        return found[other][np.lexsort((found[other, 2], found[other, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[np.ndarray]:
    """For each text, as words, its runs (start, length, period) by start, then period."""
    numbers, starts = word_numbers(texts)
    sizes = np.diff(starts) - 1
    factors = Factors(numbers, np.repeat(sizes // power, sizes + 1), max(1, int(sizes.max(initial=0)) // 2))
    found = factors.runs(least, power)
    bounds = np.searchsorted(found[:, 0], starts)
    out = [found[a:b].copy() for a, b in zip(bounds, bounds[1:])]
    for rows, s in zip(out, starts):
        rows[:, 0] -= s
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, "int64")
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    held = np.cumsum(edges[:-1]) > 0
    return b" ".join([w for w, gone in zip(words, held.tolist()) if not gone])


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """Per input row: doc_id, n_words, runs (start, length, period; words from 0), collapsed (the text without the repeats)."""

    def work(texts: list[str]) -> list[pa.Array]:
        counts, collapsed, bounds, found = [], [], [0], []
        batch: list[list[bytes]] = []

        def search() -> None:
            for words, runs in zip(batch, runs_of(batch, least, power)):
                collapsed.append(collapse(words, runs).decode())
                bounds.append(bounds[-1] + len(runs))
                found.append(runs)
            batch.clear()

        held = 0
        for t in texts:
            words = t.encode().split()
            if batch and held + len(words) > BATCH_WORDS:
                search()
                held = 0
            batch.append(words)
            held += len(words)
            counts.append(len(words))
        search()
        rows = np.concatenate([*found, np.empty((0, 3), "int64")])
        fields = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
        return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), fields), pa.array(collapsed, pa.string())]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("the_text"))
    return map_texts(rows, work, f"n_words long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, a part of the text repeated to its end where the id's checksum is a multiple of ten: what the query plants."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(checksum % 10 == 0, F.array_remove(F.split("text", SPACE), ""))
    rows = docs.select("doc_id", "text", words.alias("words"), F.floor(checksum / 10).alias("g"))
    n, words = F.size("words"), F.col("words")
    a = (F.col("g") % n).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))
