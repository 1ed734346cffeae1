"""MinHash near-duplicates: one-permutation hashing, optimal densification, star edges.

1. A document's set holds its distinct five-word shingles (64-bit hashes). Documents with
   equal sets form a class, collapsed by grouping on a digest of the set; only class
   representatives go on.
2. One permutation: the hash space is cut into bins and each keeps its least hash. An empty
   bin borrows from a filled one, chosen by its own fixed order of bins (densification).
   Bands of `BAND_ROWS` bins are the buckets. A pair at the threshold shares one but for a
   probability of 4e-6.
3. A bucket emits a star: one centre joined to each member of another component. A set's
   parity vector (per hash bucket, whether an odd number of its shingles fall there) bounds
   how many shingles two sets can share, so most hopeless pairs never leave the join; the
   bound is safe. Of the edges that are left each node keeps its closest one, so a round
   has at most as many candidates as there are nodes. They are confirmed on full sets and
   the links contracted to components.
4. Buckets that still span components are then settled. Those of up to `SMALL` members are
   compared in full. Members of larger ones are compared wherever they share one of their
   rarest shingles, which every pair at the threshold does (`by_prefix`). All pairs that the
   bounds let pass are confirmed: no candidate is capped, no pair of a bucket left out.

The bounds are exact; only for long documents (over `LONG` shingles), whose parity vectors fill
up, a sketch of signature bytes also rules pairs out, at `ERRORS` standard errors (3e-7).

Texts that are null, empty or without words have an empty set, link with nothing and form
their own component. Rows with equal doc_id and text are alike: both carry the same
component. Rows with a null doc_id are class members like any other. Their component is
named by its least id that is not null; where there is none it stays null, and of such a
component the rows with the text of the least hash are kept. An empty table gives an empty
result, extra columns are ignored, and texts of any length take part whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import DOC_COLUMNS, in_slices, map_texts, materialize, small_side, texts_of, whole_text

WORDS, PERCENT = 5, 75
BINS, BAND_ROWS = 384, 6
#: Bits of a parity vector; shingles from which a set also has a sketch, the bytes of that,
#: and the distance in standard errors from the threshold at which a candidate is hopeless.
PARITY, LONG, SKETCH, ERRORS = 2048, 512, 128, 5.0
#: Rounds of stars, each from other centres: they join the bulk of a family before the rest is compared.
STARS = 2
#: Rows of one or two numbers up to which a side is broadcast, some ten megabytes; beyond that the joins are sorted and merged.
NARROW_ROWS = 500_000
#: Members up to which a bucket is compared in full.
SMALL = 8
#: Owners of a shingle that are compared in one task.
GROUP_ROWS = 1024
MEMO_WORDS = 400_000
_memo: dict[bytes, int] = {}
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    out = np.empty(len(words), "uint64")
    get = _memo.get
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _memo[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def shingle_set(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, "uint64")
    h = word_hashes(words)
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * ODD + h[i : i + n])
    return np.unique(out)


@lru_cache(maxsize=4)
def borrowing(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the bins for a value."""
    rng = np.random.default_rng(20_111)
    return np.argsort(rng.random((bins, bins)), axis=1).argsort(axis=1)


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    at = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype("int64")
    filled, first = np.unique(at, return_index=True)  # sorted hashes: the first of a bin is its least
    out = np.empty(bins, "uint64")
    out[filled] = shingles[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        lender = filled[borrowing(bins)[np.ix_(empty, filled)].argmin(axis=1)]
        out[empty] = out[lender]
    return out


def band_buckets(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    sig = sig.reshape(-1, rows)
    out = np.arange(1, len(sig) + 1, dtype="uint64") * ODD
    for k in range(rows):
        out = mix(out * ODD + sig[:, k])
    return out.view("int64")


def parity(shingles: np.ndarray) -> np.ndarray:
    """Of each of `PARITY` hash buckets, whether an odd number of shingles fall there; 64 to a word."""
    odd = np.bincount((shingles & np.uint64(PARITY - 1)).astype("int64"), minlength=PARITY).astype("uint8") & 1
    return np.packbits(odd, bitorder="little").view("int64")


def forget() -> None:
    _memo.clear()


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """Per input row: rid, doc_id, text_key, n_shingles, set_id (equal for equal sets; null for empty ones), buckets, parity, sketch."""

    def work(texts: list[str]) -> list[pa.Array]:
        sets = [shingle_set(t, width) for t in texts]
        signatures = [signature(s) if len(s) else None for s in sets]
        sketches = [g[:: BINS // SKETCH].astype("uint8").view("int8") if len(s) > LONG else None for s, g in zip(sets, signatures)]
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([None if g is None else band_buckets(g) for g in signatures], pa.list_(pa.int64())),
            pa.array([parity(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            pa.array(sketches, pa.list_(pa.int8())),
        ]

    text = whole_text(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("the_text"))
    return map_texts(rows, work, "n_shingles long, set_id binary, buckets array<long>, parity array<long>, sketch array<tinyint>", done=forget)


def confirm(edges: DataFrame, texts: DataFrame, *, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough. `texts`: node, text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = lru_cache(maxsize=256)(lambda t: shingle_set(t, width))
        linked = []
        for x, y in zip(texts_of(batch, "text_a"), texts_of(batch, "text_b")):
            x, y = known(x), known(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    pairs = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return in_slices(pairs.select("a", "b", "text_a", "text_b"), work, "a long, b long", done=forget).distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable over the edges (a, b), by large and small stars in turn."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = state(now)
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        if (then := state(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


#: What is known of a node wherever it may be compared.
TRAITS = ("n", "component", "parity", "sketch")


def distance(parity: str, other: str) -> Column:
    """Shingles in which two sets differ, at least: one for each hash bucket of different parity."""
    words = [F.bit_count(F.get(parity, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(PARITY // 64)]
    return sum(words[1:], words[0])  # spelled out, a fifth of the time of a loop over arrays


def possible(percent: int, prefix: str = "o_") -> Column:
    """Whether the set of a row can be similar enough to its other one, whose traits have the prefix."""
    n, m = F.col("n"), F.col(f"{prefix}n")
    apart = distance("parity", f"{prefix}parity")  # similar enough: 100 * shared >= percent * (n + m - shared), and 2 * shared <= n + m - apart
    near = (100 + percent) * (n + m - apart) >= 2 * percent * (n + m)
    goal = percent / 100
    agree = F.aggregate(F.zip_with("sketch", f"{prefix}sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, b: a + b) / SKETCH
    hopeless = F.coalesce(agree < goal - ERRORS * (goal * (1 - goal) / SKETCH) ** 0.5, F.lit(False))  # null where one has no sketch
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & near & ~hopeless


def others(rows: DataFrame, *key: str) -> DataFrame:
    """The rows as the other side of a comparison."""
    return rows.select(*key, *[F.col(c).alias(f"o_{c}") for c in rows.columns if c not in key])


def open_groups(rows: DataFrame, key: str) -> DataFrame:
    """Of the groups that span components: the key, the component with most rows as `main`, and rows."""
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("rows"))
    main = F.max_by("component", F.struct("rows", "component")).alias("main")
    return sizes.groupBy(key).agg(main, F.sum("rows").alias("rows"), F.count("*").alias("spanned")).where("spanned > 1").drop("spanned")


def open_members(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of buckets that span components, with their components."""
    rows = members.withColumn("component", F.col("node"))
    if labels is not None:
        rows = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(rows, "bucket-members")
    spans = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return rows.join(spans, "bucket")


def edge(node: str, other: str) -> list[Column]:
    return [F.greatest(node, other).alias("a"), F.least(node, other).alias("b")]


def stars(rows: DataFrame, tried: DataFrame | None, salt: int, percent: int) -> DataFrame:
    """For each node that can be similar to the centre of one of its buckets, the edge (a, b) to the closest."""
    # the hash leaves out the bucket, so that the buckets of a family propose the same edges
    middle = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(salt)), "node", *TRAITS)).alias("c"))
    middle = middle.select("bucket", "c.node", *[f"c.{c}" for c in TRAITS])
    met = rows.join(others(middle, "bucket"), "bucket").where((F.col("component") != F.col("o_component")) & possible(percent))
    closeness = (distance("parity", "o_parity") / (F.col("n") + F.col("o_n"))).alias("apart")
    edges = met.select("node", *edge("node", "o_node"), closeness)
    if tried is not None:
        edges = edges.join(tried, ["a", "b"], "left_anti")
    return edges.groupBy("node").agg(F.min(F.struct("apart", "a", "b")).alias("x")).select("x.a", "x.b").distinct()


def in_full(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the members of a bucket in different components that can be similar; for buckets of up to `SMALL`."""
    met = rows.join(others(rows, "bucket"), "bucket").where((F.col("node") > F.col("o_node")) & (F.col("component") != F.col("o_component")) & possible(percent))
    return met.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def by_prefix(rows: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """Edges (a, b) over all pairs of nodes in different components, but for those that are surely not similar.

    Put all shingles in one order, the rarest first. Sets of n <= m shingles at the threshold t
    share at least t (n + m) / (1 + t), so also one shingle among the first n - 2 t n / (1 + t) + 1
    of the smaller and the first m - t m + 1 of the larger; after the first shared one there must
    be enough left. Passages that thousands share come last in the order and pair nobody. Where a
    shingle's owners are mostly of one component, only the others are compared with it and with
    each other.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.view("int64") for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    nodes = materialize(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in TRAITS]), "prefix-nodes")
    mine = texts.join(nodes.select("node").hint("merge"), "node", "left_semi")
    sets = materialize(in_slices(mine, work, "node long, shingles array<long>", done=forget), "prefix-sets")
    each = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("owners")).where("owners > 1")
    ordered = each.join(common, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("owners", "shingle"))).alias("found"))
    # a set's own shingles come before all those it shares
    spots = ordered.select("node", "n", (F.col("n") - F.size("found")).alias("own"), F.posexplode("found").alias("k", "x"))
    spots = spots.select("node", "n", F.col("x.shingle").alias("shingle"), (F.col("own") + F.col("k") + 1).alias("at"))
    least = lambda part, whole: F.expr(f"({part} + {whole} - 1) div {whole}")
    spots = spots.where(F.col("at") <= F.col("n") - least(f"n * {percent}", 100) + 1)
    early = F.col("at") <= F.col("n") - least(f"n * {2 * percent}", 100 + percent) + 1
    spots = materialize(spots.withColumn("early", early).join(nodes.drop("n"), "node"), "prefix-spots")
    rare = materialize(spots.join(open_groups(spots, "shingle"), "shingle"), "prefix-open")
    need = least(f"(n + o_n) * {percent}", 100 + percent)
    enough = (F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at")) + 1 >= need) & (F.col("component") != F.col("o_component")) & possible(percent)
    smaller = F.struct("n", "node") < F.struct("o_n", "o_node")
    strays = rare.where("component <> main")
    # the smaller set's early spot meets any spot of the larger one; one of the two is a stray
    up = spread(strays.where("early"), rare, "shingle").where(smaller & enough)
    down = spread(strays, rare.where("early and component = main"), "shingle").where(~smaller & enough)
    return up.select(*edge("node", "o_node")).union(down.select(*edge("node", "o_node"))).distinct()


def spread(rows: DataFrame, with_rows: DataFrame, key: str) -> DataFrame:
    """The join of rows on a key: those of a group of `rows` rows are dealt over tasks, and met in each by all others."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("rows") / GROUP_ROWS).cast("int")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).repartition(n, key, "salt")
    right = others(with_rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), key, "salt").repartition(n, key, "salt")
    return left.join(right, [key, "salt"])


def links(members: DataFrame, texts: DataFrame, *, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) over all confirmed links between members of one bucket."""
    labels, tried = None, None
    for number in range(STARS + 1):
        rows = open_members(members, labels)
        if number < STARS:
            edges = stars(rows, tried, number, percent)
        else:
            large = F.col("size") > SMALL
            edges = in_full(rows.where(~large), percent).union(by_prefix(rows.where(large), texts, width=width, percent=percent)).distinct()
            edges = edges.join(tried, ["a", "b"], "left_anti")
        edges = materialize(edges, "candidates")
        found = materialize(confirm(edges, texts, width=width, percent=percent), "confirmed")
        if labels is None or not found.isEmpty():
            known = found if labels is None else found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = components(known)
        tried = edges if tried is None else tried.union(edges)
    return labels


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept, text_key."""
    prints = materialize(fingerprint(docs, id_col=id_col, text_col=text_col, width=width), "near-prints")
    usable = prints.where("n_shingles > 0")
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("text_key"))).alias("nameless")
    classes = usable.groupBy("set_id").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), nameless)
    classes = materialize(classes, "near-classes")  # a class goes by the place of one of its rows
    heads = usable.withColumnRenamed("rid", "node").join(small_side(classes.select("node"), NARROW_ROWS), "node", "left_semi")
    # a node is once in a bucket: the number of the band is part of its hash
    placed = heads.select("node", F.explode("buckets").alias("bucket"))
    shared = materialize(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-shared")
    members = materialize(placed.join(small_side(shared, NARROW_ROWS), "bucket").select("bucket", "size", "node"), "near-members")
    nodes = materialize(members.select("node").distinct(), "near-nodes")
    traits = heads.select("node", F.col("n_shingles").alias("n"), "parity", "sketch").join(small_side(nodes, NARROW_ROWS), "node", "left_semi")
    members = materialize(members.join(traits, "node"), "near-sketched")
    # the text of a node is that of its id and text key, whichever of several such rows it comes from
    named = materialize(usable.select(F.col("rid").alias("node"), F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key")).join(nodes, "node", "left_semi"), "near-named")
    texts = docs.select(F.col(id_col).cast("long").alias("the_id"), whole_text(text_col).alias("text"))
    texts = texts.join(small_side(named), F.xxhash64("text").eqNullSafe(F.col("its_key")) & F.col("the_id").eqNullSafe(F.col("its_id")))
    texts = materialize(texts.select("node", "text").dropDuplicates(["node"]), "near-texts")
    labels = links(members, texts, width=width, percent=percent)
    labels = labels.union(labels.select("component", "component").distinct())  # roots too
    # a component goes by its least id; where all are null, by its least text key
    kin = labels.join(classes, "node").groupBy("component").agg(F.min("least").alias("least"), F.min("nameless").alias("nameless"))
    kin = labels.join(kin, "component").select("node", F.struct("least", "nameless").alias("kin"))
    of_set = classes.join(kin, "node", "left").select("set_id", F.coalesce("kin", F.struct("least", "nameless")).alias("kin"))
    of_set = materialize(of_set.select("set_id", F.col("kin.least").alias("component_id"), F.col("kin.nameless").alias("nameless")), "near-components")
    columns = ["doc_id", "n_shingles", "component_id", "kept", "text_key"]
    first = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull() & (F.col("text_key") == F.col("nameless"))).otherwise(F.col("doc_id") == F.col("component_id"))
    placed = prints.where("n_shingles > 0").join(of_set, "set_id").withColumn("kept", first).select(*columns)
    alone = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_key")
    return placed.unionByName(alone)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with the columns of documents."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")).distinct()
    gone = small_side(materialize(gone, "near-gone"))
    here = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(whole_text("text")) == F.col("gone_text"))
    return docs.select(*DOC_COLUMNS).join(gone, here, "left_anti")
