"""Text statistics, and ordered threshold rules learned from labelled documents.

`text_statistics` computes a document's features over its whole text. `learn_rules` fits
a decision list by sequential covering: conjunctions of thresholds are grown on two thirds
of the labelled rows by FOIL gain, pruned on the last third, and kept while they are
precise; the rows they cover are taken away and the next rule is sought. `verdict` turns
the list into one ordered conditional Spark expression.

The rules are fitted on at most `MAX_LABELLED` labelled documents (those with the smallest
hash of doc_id, one row of each); statistics and verdicts cover every row. Null texts have
no words and fail the base rule. Repeated rows and null ids are judged each on its own; an
empty table gives an empty result; without labels of both classes only the base rule decides.
Texts of any length are counted whole. Extra columns are ignored unless named in `payload`.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import DOC_COLUMNS, bounded_sample, map_texts

MAX_LABELLED = 20_000
MIN_WORDS = 50
SPACE = " \t\n\x0b\x0c\r"
SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines", "n_distinct")
#: What the rules may look at.
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "digit_ratio", "distinct_ratio", "n_words")
UPPER = re.compile(r"[A-Z]")
DIGIT = re.compile(r"[0-9]")


def statistics_of(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(SYMBOL.findall(text)), 0, 0, 0, 0, 0, 0)
    chars = len(text) - sum(map(text.count, SPACE))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "int64", n)
    repeated = 0
    if n > 3:
        base = len(number)
        windows = ids[:-2] * base + ids[1:-1]  # below n**2
        _, windows = np.unique(windows, return_inverse=True)
        _, which, times = np.unique(windows * base + ids[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[k : n - 2 + k] |= again
        repeated = int(marked.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        n,
        chars,
        len(SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        len(UPPER.findall(text)),
        len(DIGIT.findall(text)),
        len(lines),
        len(number),
    )


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = ()) -> DataFrame:
    """Per input row: doc_id, the counts, the ratios the rules use, base_failed, then `payload`."""

    def work(texts: list[str]) -> list[pa.Array]:
        return [pa.array(x, pa.int64()) for x in zip(*map(statistics_of, texts))]

    payload = tuple(c for c in payload if c != "doc_id")
    whole = text_col in payload  # then the text goes to Python and back once
    carried = [F.col(c).alias("the_text" if c == text_col else f"p_{c}") for c in payload]
    rows = docs.select(F.col(id_col).cast("long").alias("the_id"), *carried, *([] if whole else [F.col(text_col).cast("string").alias("the_text")]))
    counted = map_texts(rows, work, ", ".join(f"{c} long" for c in COUNTS), keep_text=whole)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counted.select(
        F.col("the_id").alias("doc_id"),
        *COUNTS,
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("word_chars", "n_words").alias("mean_word"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_digits", "word_chars").alias("digit_ratio"),
        ratio("n_distinct", "n_words").alias("distinct_ratio"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        *[F.col("the_text" if c == text_col else f"p_{c}").alias(c) for c in payload],
    )


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold


def covers(rule: list[Condition], x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, side, at in rule:
        out &= (x[name].to_numpy() > at) if side == ">" else (x[name].to_numpy() <= at)
    return out


def grow(x: pd.DataFrame, bad: np.ndarray, max_conditions: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < max_conditions and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name in x.columns:
            v, y = x[name].to_numpy()[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])  # between two different values
            if not len(cut):
                continue
            p_low = np.cumsum(y)[cut]
            n_low = cut + 1 - p_low
            for side, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(gain.argmax())
                if gain[k] > best_gain:
                    best, best_gain = (name, side, float((v[cut[k]] + v[cut[k] + 1]) / 2)), gain[k]
        if best is None:
            break
        rule.append(best)
        inside &= covers([best], x)
    return rule


def prune(rule: list[Condition], x: pd.DataFrame, bad: np.ndarray) -> list[Condition]:
    """The prefix of the rule that is worth most on held-back rows."""

    def worth(r: list[Condition]) -> float:
        inside = covers(r, x)
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn_rules(
    labelled: pd.DataFrame, *, label: str = "quality", max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.97, min_covered: int = 5, seed: int = 7
) -> list[list[Condition]]:
    """Ordered conjunctions, each of which rejects a document. `labelled`: FEATURES and the label (0 is bad)."""
    x, bad = labelled[list(FEATURES)].astype(float).reset_index(drop=True), (labelled[label].to_numpy() == 0)
    rules: list[list[Condition]] = []
    rng = np.random.default_rng(seed)
    while len(rules) < max_rules and bad.sum() >= min_covered and not bad.all():
        held = rng.random(len(x)) < 1 / 3
        rule = grow(x[~held], bad[~held], max_conditions)
        rule = prune(rule, x[held], bad[held]) if rule else rule
        inside = covers(rule, x) if rule else np.zeros(len(x), bool)
        if inside.sum() < min_covered or bad[inside].mean() < min_precision:
            break
        rules.append(rule)
        x, bad = x[~inside].reset_index(drop=True), bad[~inside]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True where a document is kept: the first rule that fits rejects it."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        fits = F.lit(True)
        for name, side, at in rule:
            fits = fits & ((F.col(name) > at) if side == ">" else (F.col(name) <= at))
        out = out.when(fits, False)
    return out.otherwise(True)


def labelled_rows(docs: DataFrame, labels: DataFrame, *, label: str = "quality", at_most: int = MAX_LABELLED) -> pd.DataFrame:
    """Statistics of at most `at_most` labelled documents; of rows that repeat an id, the one with the least statistics."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).dropna()
    y = bounded_sample(y.groupBy("doc_id").agg(F.max(label).alias(label)), "doc_id", at_most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")
    stats = text_statistics(texts, payload=(label,)).where("not base_failed")
    return stats.groupBy("doc_id").agg(F.min(F.struct(label, *FEATURES)).alias("x")).select("x.*").toPandas()


def quality_rules(docs: DataFrame, labels: DataFrame, *, payload: tuple[str, ...] = ()) -> DataFrame:
    """Per input row: doc_id, the statistics, base_failed, kept, then `payload`."""
    rules = learn_rules(labelled_rows(docs, labels))
    return text_statistics(docs, payload=payload).withColumn("kept", verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with the columns of documents."""
    return quality_rules(docs, labels, payload=DOC_COLUMNS).where("kept").select(*DOC_COLUMNS)
