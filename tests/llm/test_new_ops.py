"""Periodic runs, the Merkle manifest and source mixing, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyloom.llm import manifest, mixing, prefix, runs
from skyloom.llm.queries import op11_periodic_runs, op12_merkle_manifest, op13_source_mixing

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_runs_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 40))) for _ in range(rng.randint(0, 90))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // rng.randint(3, 10)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        assert [[tuple(r) for r in found.tolist()] for found in runs.runs_of(texts)] == [plain_runs(t) for t in texts]


def test_runs_of_strings_with_many_repeats():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    for words in (b, [b"x"] * 700, [b"x", b"y"] * 400 + [b"z"] + [b"x", b"y"] * 400):
        assert [tuple(r) for r in runs.runs_of([words])[0].tolist()] == plain_runs(words)


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "long_docs"])
def test_find_runs(request, which):
    docs = request.getfixturevalue(which)
    found = runs.find_runs(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = (r["text"] or "").encode().split()
        repeats = plain_runs(words) if len(words) < 5000 else None
        want.append((r["doc_id"], len(words), repeats, None if repeats is None else plain_collapsed(words, repeats)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:2] == w[:2] and (w[2] is None or g[2:] == w[2:])


@pytest.fixture(scope="module")
def long_docs(spark):
    period = " ".join(f"w{i}" for i in range(1000))
    texts = [" ".join([period] * 400), "lone " * 400_000, "x" * 2_000_000, " ".join(f"v{i}" for i in range(300_000)), "A b " * 3]
    return spark.createDataFrame([(i, t, "l", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_runs_of_very_long_texts(long_docs):
    found = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], len(r["collapsed"])) for r in runs.find_runs(long_docs).collect()}
    assert found[0][:2] == (400_000, [(0, 400_000, 1000)]) and found[1] == (400_000, [(0, 400_000, 1)], 4)
    assert found[2] == (1, [], 2_000_000) and found[3][:2] == (300_000, []) and found[4] == (6, [], 11)


def test_planted_repeats(spark):
    import zlib

    rows = [(i, " \n".join(f"w{i}-{k}" for k in range(i % 90))) for i in range(400)]
    got = {r["doc_id"]: r["text"] for r in runs.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words, h = t.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        assert got[i].split() == words


def plain_tree(nodes):
    """Levels from the nodes up."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def climb(levels, i, h):
    proof = ""
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        k = i % 8
        proof += "".join(run[:k] + run[k + 1 :])
        h, i = H(*run[:k], h, *run[k + 1 :]), i // 8
    return h, proof


def plain_manifest(rows, claimed):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(part, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, claimed(r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, (_, _, own, claim, r) in enumerate(groups[g]):
            h, below = climb(trees[g], i, claim)
            h, above = climb(top, n, h)
            out.append((r["doc_id"], own, trees[g][-1][0], top[-1][0], H(below + above), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "long_docs", "many_groups", "one_row", "one_group"])
def test_manifest(request, spark, which):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, tree string, run int, idx int, width int"
    extra = ("n", "t", 1, 2, 3)
    if which == "many_groups":
        docs = spark.createDataFrame([(i, f"Text {i % 50}", None if i % 11 == 0 else f"l{i % 77}" if i % 3 else "hot", None, i, *extra) for i in range(1500)], schema)
    elif which == "one_row":
        docs = spark.createDataFrame([(5, "A", None, None, None, *extra)], schema)
    elif which == "one_group":
        docs = spark.createDataFrame([(i // 2, "Bb", "l", None, i // 3, *extra) for i in range(65)], schema)
    else:
        docs = request.getfixturevalue(which)
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit("s"))
    claim = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    found = manifest.merkle_manifest(docs, claim).collect()
    rows = docs.select(*manifest.LEAF_COLUMNS).collect()
    want = plain_manifest(rows, lambda r: r["text"].lower() if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] % 2 == 0 else r["text"])
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], H(r["siblings"]), r["folded_root"], r["verified"]) for r in found), key=str)
    if which in ("odd_docs", "one_group"):  # equal ids with other texts stand by their leaves, each verified or not by its own claim
        assert Counter(x[:4] for x in got) == Counter(x[:4] for x in want)
    assert got == want


def test_manifest_leaves_the_session_as_it_was(spark, odd_docs):
    before = spark.conf.get(manifest._LIMIT)
    manifest.merkle_manifest(odd_docs, F.col("text"))
    assert spark.conf.get(manifest._LIMIT) == before and not {t.name for t in spark.catalog.listTables()} & {"merkle_starts", "merkle_nodes"}


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, capped, targets = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        targets = {s: most * sizes[s] for s in capped} | share
        if not above:
            return targets
        capped |= above


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "long_docs", "documents", "skewed", "silent"])
def test_mixing(request, spark, which):
    schema = "doc_id long, text string, source string, lang string, size int, key string, before long, target string"
    if which == "skewed":
        rng = random.Random(5)
        rows = [(rng.randrange(40) if k % 3 else 7, "w " * rng.randrange(60), rng.choice(["a", "a", "a", "b", "", None, "c", "é", "Z", "z"]), None, 1, "k", 2, "t") for k in range(3000)]
        docs = spark.createDataFrame(rows + [(1, "w " * 3, "tiny", None, 1, "k", 2, "t")], schema)
    elif which == "silent":
        docs = spark.createDataFrame([(k, None if k % 2 else " ", "s", None, 1, "k", 2, "t") for k in range(9)], schema)
    else:
        docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text", "source").collect()
    found = mixing.mix_sources(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in found) == Counter((r["doc_id"], size(r["text"]), r["source"]) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    targets = plain_targets(sizes) if rows else {}
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_prefix_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 50)
    rows = spark.range(3000).select((F.col("id") % 3 == 0).alias("g"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("o"), F.lit(2).alias("v"))
    found = prefix.prefix_sums(rows, ["g"], ["o"], "v").collect()
    for g in (True, False):
        mine = sorted((r["before"], r["o"]) for r in found if r["g"] is g)
        assert [b for b, _ in mine] == [2 * k for k in range(len(mine))] and [o for _, o in mine] == sorted(o for _, o in mine)


@pytest.mark.parametrize("query", [op11_periodic_runs, op12_merkle_manifest, op13_source_mixing])
def test_registered_queries_keep_every_row(spark, query):
    sf = "/root/testdata/sf0.001"
    assert query(spark, sf).select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
