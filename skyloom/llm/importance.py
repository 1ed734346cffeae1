"""Quality selection by importance resampling with hashed n-gram models.

Every document is a bag of hashed words and word pairs. Two generative models are counted
over whole documents: the target model over those labelled good and not toxic (at most
`MAX_TARGET`, those with the smallest hash of doc_id), the raw model over all. A document's log importance is the log ratio of the two models over its whole
text, its own counts taken out of both, so labelled documents have no advantage. Adding
Gumbel noise, fixed by a hash of id and text, and keeping the k largest samples k documents
without replacement in proportion to their importance. k is `keep_share` of the documents,
by default the share of good ones among the labelled.

The k-th largest key is found by narrowing a histogram, never by sorting all rows in one
task. Null texts have no n-grams and log importance 0. Rows repeating id and text get the
same key and are told apart by their place. Null ids are scored like any other; an empty
table gives an empty result; extra columns are ignored. Texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import SLICE_ROWS, bounded_sample, in_slices, materialize, texts_of, whole_text

FEATURES = 1 << 16
MAX_TARGET = 20_000
SMOOTHING = 1.0
MEMO_WORDS = 300_000
CUT_BINS, CUT_ROWS = 1024, 4096
_memo: dict[bytes, int] = {}


def features(text: str) -> np.ndarray:
    """Hash buckets of the text's words and word pairs, case kept."""
    words = text.encode().split()
    if not words:
        return np.empty(0, "int64")
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    h = np.empty(len(words), "uint64")
    for i, w in enumerate(words):
        v = _memo.get(w)
        if v is None:
            v = _memo[w] = xxhash.xxh3_64_intdigest(w)
        h[i] = v
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([h, pairs]) >> np.uint64(48)).astype("int64")


def forget() -> None:
    _memo.clear()


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n_target, n_raw) over rows of (text, target)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, FEATURES), "int64")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [features(t) for t in texts_of(part, "text")]
                both[1] += np.bincount(np.concatenate(found), minlength=FEATURES)
                target = [x for x, y in zip(found, part.column("target").to_pylist()) if y]
                if target:
                    both[0] += np.bincount(np.concatenate(target), minlength=FEATURES)
        forget()
        used = np.flatnonzero(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, both[0, used], both[1, used])], names=["feature", "n_target", "n_raw"])

    return rows.mapInArrow(work, "feature long, n_target long, n_raw long").groupBy("feature").agg(F.sum("n_target").alias("n_target"), F.sum("n_raw").alias("n_raw"))


def model_counts(counts: DataFrame) -> np.ndarray:
    """Target and raw counts per feature; at most FEATURES rows reach the driver."""
    n = np.zeros((2, FEATURES))
    for r in counts.collect():
        n[:, r["feature"]] = r["n_target"], r["n_raw"]
    return n


def log_ratio(found: np.ndarray, labelled: bool, n: np.ndarray, totals: np.ndarray) -> float:
    """log(target / raw) over a document's features, both models counted without the document."""
    if not len(found) or not totals[0]:
        return 0.0
    used, own = np.unique(found, return_counts=True)
    size = float(len(found))
    space = SMOOTHING * FEATURES
    target = np.maximum(n[0, used] - own * labelled, 0) + SMOOTHING
    raw = np.maximum(n[1, used] - own, 0) + SMOOTHING
    shift = np.log(max(totals[1] - size, 0) + space) - np.log(max(totals[0] - size * labelled, 0) + space)
    return float(own @ (np.log(target) - np.log(raw)) + size * shift)


def top_k(rows: DataFrame, k: int, key: str, tie: str) -> DataFrame:
    """Adds `kept`: whether the row is among the k with the largest key, ties by the smallest `tie`."""
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    inside, need, n = rows.select(key, tie), k, 0
    for column, sign in ((key, 1.0), (tie, -1.0)):
        v = F.col(column).cast("double") * sign
        low, high, n = inside.agg(F.min(v), F.max(v), F.count("*")).first()
        for _ in range(12):
            if n <= max(need, CUT_ROWS) or high <= low:
                break
            width = (high - low) / CUT_BINS
            place = F.least(F.lit(CUT_BINS - 1), F.floor((v - low) / width))
            hist = dict(inside.groupBy(place.alias("b")).count().collect())
            b = CUT_BINS - 1
            while b > 0 and hist.get(b, 0) < need:
                need -= hist.get(b, 0)
                b -= 1
            inside, n = inside.where(place == b), hist.get(b, 0)
            low, high = inside.agg(F.min(v), F.max(v)).first()
    # all that is left stays, however much it is; else it is a few thousand rows
    edge = inside if n <= need else inside.orderBy(F.col(key).desc(), F.col(tie)).limit(need)
    last = edge.agg(F.min(F.struct(F.col(key).alias("k"), (-F.col(tie)).alias("t"))).alias("last")).first()["last"]
    if last is None:
        return rows.withColumn("kept", F.lit(True))
    kept = (F.col(key) > F.lit(last["k"])) | ((F.col(key) == F.lit(last["k"])) & (-F.col(tie) >= F.lit(last["t"])))
    return rows.withColumn("kept", kept)


def resample(docs: DataFrame, labels: DataFrame, *, keep_share: float | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Per input row: doc_id, n_features, log_ratio, gumbel_key, kept."""
    spark = docs.sparkSession
    fine = F.col("quality") == 1
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), fine.alias("fine"), (fine & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).dropna()
    marks = materialize(marks.groupBy("doc_id").agg(F.max("fine").alias("fine"), F.max("good").alias("good")), "importance-labels")
    if keep_share is None:
        keep_share = marks.agg(F.avg(F.col("fine").cast("double"))).first()[0]
        keep_share = 1.0 if keep_share is None else keep_share
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    target = bounded_sample(marks.where("good").select("doc_id"), "doc_id", MAX_TARGET).withColumn("labelled", F.lit(True))
    target = F.broadcast(materialize(target, "importance-target"))
    texts = texts.join(target, "doc_id", "left").withColumn("target", F.coalesce("labelled", F.lit(False))).drop("labelled")
    counts = model_counts(feature_counts(texts.select("text", "target")))
    sent = spark.sparkContext.broadcast(counts)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = sent.value
        totals = n.sum(1)
        found = [features(t) for t in texts_of(batch, "text")]
        ratios = [log_ratio(x, y, n, totals) for x, y in zip(found, batch.column("target").to_pylist())]
        arrays = [*[batch.column(c) for c in ("rid", "doc_id", "noise")], pa.array([len(x) for x in found], pa.int64()), pa.array(ratios, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=["rid", "doc_id", "noise", "n_features", "log_ratio"])

    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (-F.log(-F.log(uniform))).alias("noise"), "text", "target")
    scored = in_slices(rows, work, "rid long, doc_id long, noise double, n_features long, log_ratio double", done=forget)
    scored = scored.select("rid", "doc_id", "n_features", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("gumbel_key"))
    scored = materialize(scored, "importance-scored")
    return top_k(scored, round(keep_share * scored.count()), "gumbel_key", "rid").drop("rid")
