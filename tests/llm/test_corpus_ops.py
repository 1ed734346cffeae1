"""Operators over the whole corpus, against brute force, held-out likelihood and labels."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import common, exact_dedup, importance, language_model, near_dedup

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bits", [64, 3])
@pytest.mark.parametrize("which", ["documents", "odd_docs", "no_docs"])
def test_exact_dedup(request, which, bits):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], (r["text"] or "").translate(A_Z)) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    least = -(1 << 62)
    key = lambda x: tuple(map(str, x))
    want = sorted(((i, max(groups[t], key=lambda x: least if x is None else x), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=key)
    found = exact_dedup.exact_dedup(docs, capacity=16, hash_bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=key) == want
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) <= {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_directory_splits_only_overfull_ranges(spark):
    keys = spark.range(0, 4000).select(exact_dedup.text_key(F.col("id").cast("string")).alias("key"), F.lit(1).alias("n"))
    pages = exact_dedup.build_index(keys, capacity=64)
    sizes = {r["bucket"]: r["count"] for r in pages.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 64
    ranges = sorted((int(p) << (40 - int(d)), int(p) + 1 << (40 - int(d))) for d, p in (b.split(":") for b in sizes))
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    where = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            where[x].append(n)
    shared = Counter()
    for owners in where.values():
        for k, b in enumerate(owners):
            for a in owners[:k]:
                shared[a, b] += 1
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[top(b)] = top(a)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[top(n)] = min(i, least.get(top(n), i))
    return [(i, len(sets[n]), least.get(top(n))) for n, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("which", ["documents", "no_docs", "families"])
def test_near_duplicates(request, spark, which):
    if which == "families":  # chains and stars of edited copies
        rng, rows = np.random.default_rng(3), []
        for f in range(12):
            base = [f"w{rng.integers(4000)}" for _ in range(160)]
            for k in range(12):
                rows.append((f * 100 + k, " ".join(base)))
                if k % 3 < 2:
                    base = list(base)
                for j in rng.integers(0, 160, 1 + f % 5):
                    base[j] = f"x{rng.integers(10**6)}"
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(which)
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert found == sorted((i, n, c, i == c) for i, n, c in plain_components(rows))


def test_near_duplicates_of_long_texts_at_the_threshold(spark):
    """520 to 1,000 shingles, where sketches rule pairs out too: pairs from 0.73 to 0.77, equal to brute force."""
    rng, rows = np.random.default_rng(23), []
    for f in range(60):
        n = int(rng.integers(524, 1005))
        base = [f"f{f}w{k}" for k in range(n)]
        rows.append((f * 10, " ".join(base)))
        for c in range(1, 4):
            words, at = list(base), np.arange(5, n - 5, 5)
            for j in rng.choice(at, round(n / 35 + rng.integers(-1, 2)), replace=False):  # n / 35 changed words apart leave 0.75
                words[j] = f"f{f}c{c}x{j}"
            rows.append((f * 10 + c, " ".join(words)))
    sims = []
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    for f in range(60):
        a = sets[f * 10]
        sims += [len(a & sets[f * 10 + c]) / len(a | sets[f * 10 + c]) for c in range(1, 4)]
    assert all(len(x) > near_dedup.LONG for x in sets.values()) and sum(0.74 <= x <= 0.76 for x in sims) > 100 and min(sims) < 0.75 < max(sims)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted(plain_components(rows))


def test_near_duplicates_in_a_hot_template(spark):
    # all share a template at 0.72, which links none of them; planted pairs are at 0.76
    rng, rows, planted = np.random.default_rng(8), [], 60
    template = [f"t{k}" for k in range(204)]
    for k in range(3000):
        own = [f"o{k}x{j}" for j in range(39)]
        rows.append((k, " ".join(template + own)))
        if k < planted:
            kept = own[:6]
            rows.append((10_000 + k, " ".join(template + kept + [f"p{k}x{j}" for j in range(33)])))
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {i: i % 10_000 for i, _ in rows}


@pytest.mark.parametrize("n_docs", [900, 2500])
def test_near_duplicates_below_the_threshold(spark, monkeypatch, n_docs):
    # one base text, eight random words changed in each: most pairs are at 0.69, few linked
    rng, rows = np.random.default_rng(11), []
    base = [f"w{k}" for k in range(400)]
    for i in range(n_docs):
        words = list(base)
        for j in rng.choice(400, 8, replace=False):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    tried, confirm = [], near_dedup.confirm

    def counted(edges, *args, **kinds):
        tried.append(edges.count())
        return confirm(edges, *args, **kinds)

    monkeypatch.setattr(near_dedup, "confirm", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    # shingles with a changed word are a document's own, so two sets share what neither has lost
    has = np.ones((n_docs, 396), "float32")
    for i, text in rows:
        for k in (k for k, w in enumerate(text.split()) if w[0] == "x"):
            has[i, max(0, k - 4) : k + 1] = 0
    both = has @ has.T
    a, b = np.nonzero(np.triu(100 * both >= 75 * (2 * 396 - both), 1))
    root = list(range(n_docs))
    top = lambda x: x if root[x] == x else top(root[x])
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((top(x), top(y)))
        root[y] = x
    assert found == {i: top(i) for i in range(n_docs)}
    assert sum(tried) < n_docs + 12 * len(a), (tried, len(a))  # the pairs of documents are 400,000 and 3 million


def test_near_duplicates_without_ids(spark):
    words = [f"w{k}" for k in range(100)]
    near = lambda k: " ".join([*words[:-k], *[f"x{k}y{j}" for j in range(k)]])
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(None, near(1)), (7, near(2)), (9007199254740993, near(3)), (None, other), (None, other + " more"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = near_dedup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found) == Counter(
        [(None, 7, False), (7, 7, True), (9007199254740993, 7, False), (None, None, True), (None, None, False), (None, None, True), (None, None, True)]
    )
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.keep_one_of_each(docs).collect()]
    assert len(kept) == 4 and (7, near(2)) in kept and not any(t == near(1) for _, t in kept)


def test_near_duplicates_odd_rows(odd_docs):
    found = near_dedup.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["component_id"] == 1 and by_id[6]["component_id"] == 5 and by_id[None]["component_id"] is None
    kept = near_dedup.keep_one_of_each(odd_docs)
    assert kept.columns == list(common.DOC_COLUMNS) and {r["doc_id"] for r in kept.collect()} == set(by_id) - {6, 10} | {10}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (12, 60, 2000):
        same = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, n, dtype="uint64") * 2 + 1)
            cut = len(pool) // 5  # similarity 3/5
            a, b = near_dedup.signature(np.sort(pool[cut:])), near_dedup.signature(np.sort(pool[: len(pool) - cut]))
            same.append((a == b).mean())
        assert abs(np.mean(same) - 0.6) < 0.08


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    found = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert all(found.get(x, x) == top(x) for x in root)


# ---- language model


def test_lm_base_and_held_out_gain(documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]
    split = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    words = {i: [*t.encode().lower().split(), b""] for i, t in rows}
    c = Counter(w for i, ws in words.items() if not split[i] for w in ws)
    n, v = sum(c.values()), len(c)
    found = {r["doc_id"]: r for r in language_model.lm_scores(documents).collect()}
    assert len(found) == len(rows)
    for i, ws in words.items():
        r = found[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (split[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [found[i] for i in words if split[i]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.05 * sum(r["n_tokens"] for r in held)


def test_lm_trains_where_the_end_token_is_rare(spark, monkeypatch):
    # 2,400 words are in each document three times, so the end token is behind all of them
    rounds, train_round = [], language_model.train_round

    def counted(coded, weights, number, end_id):
        rounds.append(end_id)
        return train_round(coded, weights, number, end_id)

    monkeypatch.setattr(language_model, "train_round", counted)
    text = " ".join(f"w{k}" for k in range(2400))
    docs = spark.createDataFrame([(i, " ".join([text] * 3)) for i in range(12)], "doc_id long, text string")
    found = language_model.lm_scores(docs).collect()
    assert len(rounds) == language_model.ROUNDS and set(rounds) == {language_model.MODEL_WORDS - 1}
    assert all(math.isfinite(r["score"]) and r["n_tokens"] == r["n_known"] == 7201 for r in found)


def test_model_probabilities_sum_to_one():
    p = language_model.first_parameters(np.arange(language_model.MODEL_WORDS, 0, -1.0))
    h = np.random.default_rng(0).standard_normal((language_model.HIDDEN, 1)).astype("float32")
    every = np.arange(language_model.MODEL_WORDS)
    logs = language_model.log_probability(p, np.repeat(h, len(every), axis=1), every)
    assert abs(np.exp(logs.astype("float64")).sum() - 1) < 1e-4


def test_gradients_by_differences():
    rng = np.random.default_rng(5)
    p = {k: x * 3 for k, x in language_model.first_parameters(np.ones(language_model.MODEL_WORDS)).items()}
    inputs, targets = rng.integers(0, 90, (5, 4)), rng.integers(0, 90, (5, 4))
    fresh = np.ones((5, 4), "float32")
    fresh[2, 1] = 0
    h0 = np.zeros((language_model.HIDDEN, 4), "float32")
    g, _, _ = language_model.gradients(p, inputs, targets, fresh, h0)

    def loss():
        return language_model.gradients(p, inputs, targets, fresh, h0)[2] / targets.size

    for name in ("u", "b", "class_w", "word_w", "word_b", "x"):
        d = g[name]
        if name == "x":
            full = np.zeros_like(p["x"])
            full[:, d[0]] = d[1]
            d = full
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        keep = p[name][at]
        p[name][at] = keep + 1e-2
        up = loss()
        p[name][at] = keep - 1e-2
        down = loss()
        p[name][at] = keep
        assert abs((up - down) / 2e-2 - d[at]) < 0.05 * abs(d[at]) + 2e-4, name


def test_state_is_carried_over_whole_documents():
    p = language_model.first_parameters(np.ones(language_model.MODEL_WORDS))
    rng = np.random.default_rng(2)
    documents = [np.array([*rng.integers(1, 500, n), 7]) for n in (40, 3, 0, 700)]
    together = language_model.score_documents(p, documents)
    assert np.allclose(together, [language_model.score_documents(p, [d])[0] for d in documents], rtol=1e-4)


def test_lm_odd_rows(odd_docs, no_docs):
    found = language_model.lm_scores(odd_docs).collect()
    assert len(found) == odd_docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in found)
    assert language_model.lm_scores(no_docs).count() == 0


# ---- importance


def test_resampling_keeps_good_documents(spark):
    labels, documents = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("labels", "documents"))
    out = importance.resample(documents, labels)
    share = labels.agg(F.avg("quality")).first()[0]
    assert out.where("kept").count() == round(share * documents.count())
    n = {(r["quality"], r["kept"]): r["count"] for r in out.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_gumbel_keys_sample_in_proportion():
    rng = np.random.default_rng(0)
    w = np.log([0.5, 0.3, 0.2])
    first = [(w - np.log(-np.log(rng.random(3)))).argmax() for _ in range(4000)]
    assert np.allclose(np.bincount(first) / 4000, [0.5, 0.3, 0.2], atol=0.03)


@pytest.mark.parametrize("k", [0, 1, 137, 9_000, 20_000])
def test_top_k_is_exact(spark, k):
    rows = spark.range(0, 20_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(50)) * 1.0).alias("v"))
    want = sorted(((-r["v"], r["id"]) for r in rows.collect()))[:k]
    assert sorted(r["id"] for r in importance.top_k(rows, k, "v", "id").where("kept").collect()) == sorted(i for _, i in want)


def test_resampling_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    assert importance.resample(odd_docs, labels).count() == odd_docs.count()
    assert importance.resample(no_docs, labels).count() == 0
    assert importance.resample(odd_docs, labels.limit(0)).where("not kept").count() == 0


# ---- pipeline


def test_pipeline_stages(spark, documents):
    docs, ids = documents, {r["doc_id"] for r in documents.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == list(common.DOC_COLUMNS)
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= ids
        if name == "exact_dedup":
            texts = [r["text"].translate(A_Z) for r in docs.select("text").collect()]
            assert len(set(texts)) == len(texts)
            before_near = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "minhash_near_dedup":
            assert set(now) == {i for i, _, c in plain_components(before_near) if i == c}
        ids = set(now)
    assert docs.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == list(common.DOC_COLUMNS)
            stage(spark, docs, SF).count()
