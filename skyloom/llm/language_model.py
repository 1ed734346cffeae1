"""Document scoring by a gated recurrent language model trained on the corpus.

1. Words of all training documents are counted. The frequent ones (at most `HEAD_WORDS`)
   become ids; the model itself predicts the `MODEL_WORDS` most frequent, the end token
   always among them, and all others
   as one rare-word event shared out by their counts, so probabilities sum to one.
2. Each task trains its own copy of the model on all its training documents: truncated
   backpropagation over windows of `WINDOW` tokens, the state carried from window to window
   and reset where a document ends. The copies are averaged, weighted by tokens, in a tree
   of joins over blocks of parameters; `ROUNDS` rounds each take another share of the
   documents, so that every one is learned from once.
3. The output layer is factored: a softmax over frequency classes, then one over the words
   of the class.
4. Scoring runs every whole document from an empty state to its end. Words that have no id
   are looked up in the full count table by a join; frequent words never take part in it.

Null texts count as empty: just the end token. A null doc_id counts as the empty text when
documents are dealt out. Repeated rows are scored each on its own; an empty table gives an
empty result; with no training document the uniform base score is given. Extra columns are
ignored, texts of any length are read and scored whole. Tasks learn side by side, so scores
(not counts or base scores) also depend on how the input is parted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat
from operator import not_

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialize, whole_text

HEAD_WORDS = 60_000
CLASSES, CLASS_WORDS = 32, 64
MODEL_WORDS = CLASSES * CLASS_WORDS  # id 0 stands for all rarer words
HIDDEN, WINDOW, STREAMS = 16, 16, 512
UPDATES = 100  # windows of a pass, where there are tokens enough
ROUNDS, RATE = 3, 0.02
BLOCK, FAN = 1 << 14, 32
END = b""  # no word is empty
FLUSH = 400_000


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


# ---- the model: a dict of float32 arrays; states and activations hold one column per token


def shapes() -> dict[str, tuple[int, ...]]:
    h, g = HIDDEN, 3 * HIDDEN
    return {"x": (g, MODEL_WORDS), "b": (g, 1), "u": (g, h), "class_w": (CLASSES, h), "class_b": (CLASSES, 1), "word_w": (CLASSES, CLASS_WORDS, h), "word_b": (CLASSES, CLASS_WORDS, 1)}


def first_parameters(model_counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; the output starts at the words' own frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype("float32") for k, s in shapes().items()}
    counts = (model_counts + 0.1).reshape(CLASSES, CLASS_WORDS, 1)
    p["b"] = np.concatenate([np.full(HIDDEN, 1.0), np.zeros(2 * HIDDEN)]).astype("float32")[:, None]
    p["class_b"] = np.log(counts.sum(1) / counts.sum()).astype("float32")
    p["word_b"] = np.log(counts / counts.sum(1, keepdims=True)).astype("float32")
    p["class_w"] *= 0.3
    p["word_w"] *= 0.3
    return p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes()]).astype("float32")


def unflatten(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        n = math.prod(s)
        out[k] = v[at : at + n].reshape(s).astype("float32")
        at += n
    return out


def cell(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step from input terms x and state h: new state, gates and the recurrent candidate term."""
    k = HIDDEN
    a = p["u"] @ h
    gates, c = a[: 2 * k], a[2 * k :]
    gates += x[: 2 * k]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:k], gates[k:]
    n = r * c
    n += x[2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, c


def softmax(logits: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column the log probability of the goal, and the exponentials with their sums (in place)."""
    at = np.arange(len(goal))
    picked = logits[goal, at]
    top = logits.max() if len(goal) else 0.0
    if top > 60:  # else float32 holds the exponentials as they are
        low = logits.max(0)
        logits -= low
        picked = picked - low
    np.exp(logits, out=logits)
    total = logits.sum(0)
    return picked - np.log(total), logits, total


def columns(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(x, at, axis=1, mode="clip")


def by_class(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that puts the tokens of a class side by side, and each class' slice of it."""
    kinds = (targets // CLASS_WORDS).astype("int16")
    order = np.argsort(kinds, kind="stable")
    bounds = np.searchsorted(kinds[order], np.arange(CLASSES + 1))
    return order, [(c, slice(bounds[c], bounds[c + 1])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]


def log_probability(p: dict[str, np.ndarray], h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    out = softmax(p["class_w"] @ h + p["class_b"], targets // CLASS_WORDS)[0]
    order, slices = by_class(targets)
    sorted_h, words, logs = columns(h, order), targets[order] % CLASS_WORDS, np.empty(len(targets), out.dtype)
    for c, at in slices:
        logs[at] = softmax(p["word_w"][c] @ sorted_h[:, at] + p["word_b"][c], words[at])[0]
    out[order] += logs
    return out


def output_gradient(logits: np.ndarray, goal: np.ndarray, m: int) -> tuple[np.ndarray, float]:
    logs, d, total = softmax(logits, goal)
    d /= total * m
    d[goal, np.arange(len(goal))] -= 1 / m
    return d, -float(logs.sum())


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Over one window (steps x streams): gradients of the mean loss, the last state, the loss.

    `fresh` is 0 where a document begins, and so the state is reset.
    """
    steps, streams = inputs.shape
    k, ids = HIDDEN, inputs.ravel()
    x = columns(p["x"] + p["b"], ids).reshape(3 * k, steps, streams)
    saved, states = [], np.empty((k, steps, streams), "float32")
    for t in range(steps):
        before = h * fresh[t]
        h, z, r, n, c = cell(p, x[:, t], before)
        states[:, t] = h
        saved.append((before, z, r, n, c))
    flat, goal = states.reshape(k, -1), targets.ravel()
    m = len(goal)
    d, loss = output_gradient(p["class_w"] @ flat + p["class_b"], goal // CLASS_WORDS, m)
    g = {"class_w": d @ flat.T, "class_b": d.sum(1, keepdims=True), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
    dh_out = p["class_w"].T @ d
    order, slices = by_class(goal)
    sorted_h, words, dh_words = columns(flat, order), goal[order] % CLASS_WORDS, np.empty_like(flat)
    for c, at in slices:
        hc = sorted_h[:, at]
        d, more = output_gradient(p["word_w"][c] @ hc + p["word_b"][c], words[at], m)
        loss += more
        g["word_w"][c], g["word_b"][c] = d @ hc.T, d.sum(1, keepdims=True)
        dh_words[:, at] = p["word_w"][c].T @ d
    back = np.empty_like(order)
    back[order] = np.arange(m)
    dh_out += columns(dh_words, back)
    dh_out = dh_out.reshape(k, steps, streams)
    dx, du, dh = np.empty_like(x), np.zeros_like(p["u"]), np.zeros((k, streams), "float32")
    for t in range(steps - 1, -1, -1):
        before, z, r, n, c = saved[t]
        dh = dh + dh_out[:, t]
        da = np.empty((3 * k, streams), "float32")
        dz, dr, dn = da[:k], da[k : 2 * k], da[2 * k :]
        keep = dh * z
        np.subtract(dh, keep, out=dn)  # dh (1 - z)
        np.multiply(dn, z, out=dz)
        dz *= before - n
        dn *= 1 - n * n
        np.multiply(dn, c, out=dr)
        dr *= r
        dr *= 1 - r
        dx[:, t] = da
        dn *= r
        du += da @ before.T
        dh = (keep + p["u"].T @ da) * fresh[t]
    dx = dx.reshape(3 * k, -1)
    g["u"], g["b"] = du, dx.sum(1, keepdims=True)
    used = np.flatnonzero(np.bincount(ids, minlength=MODEL_WORDS))
    g["x"] = (used, np.stack([np.bincount(ids, row, MODEL_WORDS)[used] for row in dx]).astype("float32"))
    return g, h, loss


class Learner:
    """Adaptive steps: each parameter's gradient over the root of its running mean square."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = RATE):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        for name, d in g.items():
            if name == "x":  # only the columns of words that occurred
                cols, d = d
                s = columns(self.s["x"], cols) + d * d
                self.s["x"][:, cols] = s
                self.p["x"][:, cols] -= 2 * self.rate * d / (np.sqrt(s) + 1e-6)
                continue
            m, s = self.m[name], self.s[name]
            m *= 0.9
            m += 0.1 * d
            s *= 0.99
            s += 0.01 * d * d
            rate = self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.p[name] -= rate * m / (np.sqrt(s) + 1e-7)


def train(p: dict[str, np.ndarray], documents: list[np.ndarray], rate: float = RATE) -> tuple[dict[str, np.ndarray], float]:
    """One pass over all documents (ids of the model's words, the end token last); per-token loss."""
    text = np.concatenate(documents)
    end = documents[0][-1]
    streams = int(min(STREAMS, max(8, len(text) // (WINDOW * UPDATES))))
    steps = -(-len(text) // streams)
    text = np.resize(text, steps * streams).reshape(streams, steps).T.copy()  # the last stream is filled up from the start
    inputs = np.concatenate([np.roll(text[-1:], 1, axis=1), text[:-1]])  # a stream goes on where the one before ended
    fresh = (inputs != end).astype("float32")
    learner, h, loss = Learner(p, rate), np.zeros((HIDDEN, streams), "float32"), 0.0
    for at in range(0, steps, WINDOW):
        g, h, more = gradients(p, inputs[at : at + WINDOW], text[at : at + WINDOW], fresh[at : at + WINDOW], h)
        learner.step(g)
        loss += more
    return p, loss / text.size


def score_documents(p: dict[str, np.ndarray], documents: list[np.ndarray], side_by_side: int = 1024) -> np.ndarray:
    """Natural log probability of each whole document; documents of like length run side by side."""
    out = np.zeros(len(documents))
    order = np.argsort([-len(d) for d in documents], kind="stable")
    for at in range(0, len(order), side_by_side):
        some = order[at : at + side_by_side]
        out[some] = score_together(p, [documents[i] for i in some])
    return out


def score_together(p: dict[str, np.ndarray], documents: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(d) for d in documents])
    order = np.argsort(-sizes, kind="stable")
    out, sizes = np.zeros(len(documents)), sizes[order]
    end = documents[0][-1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.concatenate([documents[i] for i in order])
    h, total = np.zeros((HIDDEN, len(order)), "float32"), np.zeros(len(order))
    last = np.full(len(order), end)
    terms = p["x"] + p["b"]
    kept, goals, owners, held = [], [], [], 0
    for t in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, "left"))  # documents longer than t
        h = cell(p, columns(terms, last[:n]), h[:, :n])[0]
        last = text[starts[:n] + t]
        kept.append(h)
        goals.append(last)
        owners.append(np.arange(n))
        held += n
        if held >= 1 << 14 or t == sizes[0] - 1:
            who = np.concatenate(owners)
            total += np.bincount(who, log_probability(p, np.concatenate(kept, axis=1), np.concatenate(goals)), len(order))
            kept, goals, owners, held = [], [], [], 0
    out[order] = total
    return out


# ---- Spark


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over the rows' texts; the end token is the empty word."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                seen.update(tokens(text))
                if len(seen) >= FLUSH:
                    yield pd.DataFrame({"word": [w.decode() for w in seen], "c": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"word": [w.decode() for w in seen], "c": list(seen.values())})

    return texts.mapInPandas(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(words: DataFrame, at_most: int = HEAD_WORDS) -> list[tuple[str, int]]:
    """The most frequent words, down to a level of frequency that at most so many words reach."""
    level = F.floor(F.log2("c") * 16)
    levels = sorted(((r["level"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a few hundred
    total, low = 0, None
    for value, n in levels:
        if total + n > at_most:
            break
        total, low = total + n, value
    if low is None:
        return []
    head = [(r["word"], r["c"]) for r in words.where(level >= low).collect()]  # at most `at_most` rows
    return sorted(head, key=lambda x: (-x[1], x[0]))


def with_end(head: list[tuple[str, int]], words: DataFrame) -> list[tuple[str, int]]:
    """The head with the end token among the model's words: the last of them if it is not frequent enough."""
    end = words.where(F.col("word") == END.decode()).first()
    if end is None:  # no training document
        return head
    others = [x for x in head if x[0] != end["word"]]
    at = next((i for i, x in enumerate(head) if x[0] == end["word"]), len(others))
    others.insert(min(at, MODEL_WORDS - 2), (end["word"], end["c"]))
    return others


def model_ids(head_ids: np.ndarray) -> np.ndarray:
    """The model's ids of head ids (0: no head word): those beyond the model's words are 0."""
    return np.where(head_ids < MODEL_WORDS, head_ids, 0).astype("int64")


def encode(texts: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """Per row: rid, doc_id, held_out, share, ids (16-bit head ids, 0 for none), and the other words with their counts."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = sent.value.get
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                ids, rare, times = [], [], []
                for text in part["text"]:
                    words = tokens(text)
                    found = list(map(get, words, repeat(0)))
                    ids.append(np.fromiter(found, "<u2", len(found)).tobytes())
                    others = Counter(compress(words, map(not_, found)))
                    rare.append([w.decode() for w in others])
                    times.append(list(others.values()))
                yield part[["rid", "doc_id", "held_out", "share"]].assign(ids=ids, rare=rare, times=times)

    return texts.mapInPandas(work, "rid long, doc_id string, held_out boolean, share int, ids binary, rare array<string>, times array<long>")


def averaged(copies: DataFrame) -> np.ndarray | None:
    """The weighted mean of all tasks' parameters (part, block, weight, values), summed in a tree."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "<f4").astype("float64") * w for v, w in zip(frame["values"], frame["weight"]))
        weight = frame["weight"].sum()
        return pd.DataFrame({"part": [frame["part"].min() // FAN], "block": [frame["block"].iloc[0]], "weight": [weight], "values": [(total / weight).astype("<f4").tobytes()]})

    parts = copies.agg(F.max("part")).first()[0]
    if parts is None:
        return None
    while True:
        copies = copies.groupBy("block", F.floor(F.col("part") / FAN).alias("group")).applyInPandas(
            lambda key, frame: add(frame), "part long, block int, weight double, values binary"
        )
        if parts < FAN:
            break
        parts //= FAN
    return np.concatenate([np.frombuffer(r["values"], "<f4") for r in sorted(copies.collect(), key=lambda r: r["block"])])  # one model


def train_round(coded: DataFrame, weights: np.ndarray, number: int, end_id: int) -> np.ndarray:
    """All tasks train on this round's share of the documents; the averaged parameters."""
    spark = coded.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, seen = unflatten(sent.value.copy()), 0
        for frame in frames:
            documents = [model_ids(np.frombuffer(x, "<u2")) for x in frame["ids"]]
            p, _ = train(p, documents)
            seen += sum(map(len, documents))
        if seen:
            flat = flatten(p)
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "block": range(len(blocks)), "weight": float(seen), "values": blocks})

    mine = coded.where(~F.col("held_out") & (F.col("share") == number)).select("ids")
    found = averaged(materialize(mine.mapInPandas(work, "part long, block int, weight double, values binary"), "lm-round"))
    sent.unpersist()
    return weights if found is None else found


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    name = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").cast("string").alias("doc_id"),
        (F.pmod(F.crc32(name.cast("binary")), F.lit(10)) == 0).alias("held_out"),
        F.pmod(F.xxhash64(name, whole_text(text_col)), F.lit(ROUNDS)).cast("int").alias("share"),  # the round that learns from it
        whole_text(text_col).alias("text"),
    )
    words = materialize(count_words(rows.where("not held_out").select("text")), "lm-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = total["n"], total["v"]
    head = with_end(frequent_words(words), words)
    # ids from 1 in order of frequency; id 0 is every other word
    number = {w.encode(): i + 1 for i, (w, _) in enumerate(head)}
    counts = np.array([0, *[c for _, c in head]], "float64")
    model_counts = np.zeros(MODEL_WORDS)
    model_counts[: min(MODEL_WORDS, len(counts))] = counts[:MODEL_WORDS]
    n_model = int((model_counts > 0).sum())
    rest = n_train - model_counts.sum()
    model_counts[0] = rest
    log_base = math.log10(n_train + 0.1 * (n_words + 1))
    log_rest = math.log10(rest + 0.1 * (n_words - n_model + 1))
    end_id = number.get(END, 0)

    coded = materialize(encode(rows, number), "lm-coded")
    weights = flatten(first_parameters(model_counts))
    if end_id:
        for k in range(ROUNDS):
            weights = train_round(coded, weights, k, end_id)

    sent, logs = spark.sparkContext.broadcast(weights), np.log10(counts + 0.1)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = unflatten(sent.value.copy())
        for frame in frames:
            heads = [np.frombuffer(x, "<u2").astype("int64") for x in frame["ids"]]
            score = score_documents(p, [model_ids(x) for x in heads]) / math.log(10)
            yield frame[["rid", "doc_id", "held_out"]].assign(
                n_tokens=[len(x) for x in heads],
                n_head=[int((x > 0).sum()) for x in heads],
                n_rest=[int((model_ids(x) == 0).sum()) for x in heads],
                head_logs=[float(logs[x[x > 0]].sum()) for x in heads],
                rest_logs=[float(logs[x[x >= MODEL_WORDS]].sum()) for x in heads],
                raw_score=score,
            )

    scored = coded.select("rid", "doc_id", "held_out", "ids").mapInPandas(
        work, "rid long, doc_id string, held_out boolean, n_tokens long, n_head long, n_rest long, head_logs double, rest_logs double, raw_score double"
    )
    rare = (
        coded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
        .join(words, "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_logs"),
        )
    )
    none = F.lit(0.0)
    return scored.join(rare, "rid", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.coalesce("rare_logs", none) - F.col("n_tokens") * log_base).alias("base_score"),
        (F.col("raw_score") + F.col("rest_logs") + F.coalesce("rare_logs", none) - F.col("n_rest") * log_rest).alias("score"),
    )
