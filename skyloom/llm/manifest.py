"""Merkle manifest of a dataset, and proofs that climb it by a recursive query.

1. A row's leaf is the digest of its columns. The leaves of a group (a language) stand by id;
   every `FAN` consecutive nodes become the digest of theirs until one is left, the subroot.
   The subroots, by group, become the root in the same way. Each level is a written table.
2. Every node but the root is stored as a row that names its parent and holds the digests of
   its siblings on the left and on the right.
3. A recursive query climbs from the leaves: at each level it folds the hash that a leaf is
   claimed to have with the siblings, and appends the siblings to the proof. Leaves with one
   parent share all siblings above it, so they travel as one row with a hash each.

Texts, sources, languages and counts that are null are part of the leaf as such; a null
language is a group of its own, the first. Null ids come first. Rows with equal ids stand by
their leaves, and equal rows are equal leaves. An empty table gives an empty result. Columns
other than those named are no part of the leaf; texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import UPPER, ascii_lower, materialize
from skyloom.llm.prefix import prefix_sums

FAN = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_LIMIT = "spark.sql.cteRecursionRowLimit"

CLIMB = """
    WITH RECURSIVE climb(tree, run, node, folds, proof) AS (
        SELECT tree, run, node, folds, proof FROM {starts}
        UNION ALL
        SELECT c.tree, c.run, n.parent,
               transform(c.folds, h -> unhex(sha2(lower(hex(concat(n.before, h, n.after))), 256))),
               concat(c.proof, n.before, n.after)
        FROM climb c JOIN {nodes} n ON c.node = n.node)
    SELECT tree, run, folds, proof FROM climb WHERE node = '{root}'"""


def digest(*parts: Column) -> Column:
    """Binary digest of binary digests, which are hashed as their hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))), 256))


def joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))


def left_of(array: Column, k: Column) -> Column:
    """The joined digests of an array before place k, from 0."""
    return joined(F.slice(array, F.lit(1), k))


def right_of(array: Column, k: Column) -> Column:
    return joined(F.slice(array, k + 2, F.size(array)))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Binary digest of the columns in their order: `-` for null, else byte count, colon, value."""
    texts = [c.cast("string") for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def levels_above(nodes: DataFrame, width: int, level: int = 0) -> list[DataFrame]:
    """The written levels over the nodes (tree, idx, width, node, digest) of a level, whose widest tree has `width` of them.

    `width` is the number of nodes in a node's level of its tree; where it is 1 the tree is complete.
    """
    found = []
    while width > 1:
        level, width = level + 1, -(-width // FAN)
        kids = F.sort_array(F.collect_list(F.struct("idx", "node", "digest"))).alias("kids")
        runs = nodes.where("width > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("run"), "width").agg(kids)  # at most FAN in a run
        above = runs.select(
            "tree",
            F.col("run").alias("idx"),
            F.ceil(F.col("width") / FAN).alias("width"),
            F.concat_ws(".", "tree", F.lit(f"{level}"), "run").alias("node"),
            digest(joined(F.col("kids.digest"))).alias("digest"),
            "kids",
        )
        nodes = materialize(above, f"merkle-level-{level}")
        found.append(nodes)
    return found


def node_rows(level: DataFrame) -> DataFrame:
    """(node, parent, before, after) for the nodes right below a level."""
    each = level.select(F.col("node").alias("parent"), F.col("kids.digest").alias("run"), F.posexplode("kids").alias("k", "kid"))
    return each.select("kid.node", "parent", left_of(F.col("run"), F.col("k")).alias("before"), right_of(F.col("run"), F.col("k")).alias("after"))


def climb(spark: SparkSession, starts: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """(tree, run, folds, proof) at the root, written, for the starts (tree, run, node, folds, proof).

    The session's limit on the rows of a recursive query is lifted while this one runs: it
    ends at the root, after as many rounds as there are levels.
    """
    names = {"starts": "merkle_starts", "nodes": "merkle_nodes"}
    before = spark.conf.get(_LIMIT)
    try:
        spark.conf.set(_LIMIT, "-1")
        starts.createOrReplaceTempView(names["starts"])
        nodes.createOrReplaceTempView(names["nodes"])
        return materialize(spark.sql(CLIMB.format(**names, root=root)), "merkle-climbed")
    finally:
        spark.conf.set(_LIMIT, before)
        for view in names.values():
            spark.catalog.dropTempView(view)


def merkle_manifest(docs: DataFrame, claimed_text: Column, *, id_col: str = "doc_id", group_col: str = "lang", leaf_columns: tuple[str, ...] = LEAF_COLUMNS, text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, leaf, subroot, root, siblings, folded_root (hex), verified.

    The tree is built of the rows as they are; `claimed_text` is the text that the proof is checked for.
    `siblings` is the whole proof, digests as hex text one after the other.
    """
    spark = docs.sparkSession
    columns = {c: F.col(c) for c in leaf_columns}
    known, name = F.col(group_col).isNotNull(), F.coalesce(F.col(group_col).cast("string"), F.lit(""))
    leaf, claim = leaf_digest(columns), leaf_digest(columns | {text_col: claimed_text})
    same = F.col(text_col).eqNullSafe(claimed_text)
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), known.alias("known"), name.alias("name"), leaf.alias("leaf"), F.when(~same, claim).alias("claim"))
    leaves = materialize(leaves.withColumn("one", F.lit(1)), "merkle-leaves")
    trees = materialize(leaves.groupBy("known", "name").agg(F.count("*").alias("width"), F.lit(1).alias("one")), "merkle-groups")
    trees = materialize(prefix_sums(trees, [], ["known", "name"], "one").withColumnRenamed("before", "tree").drop("one"), "merkle-trees")
    size = trees.agg(F.count("*").alias("trees"), F.max("width").alias("widest")).first()

    placed = prefix_sums(leaves, ["known", "name"], ["doc_id", "leaf"], "one").join(trees, ["known", "name"])
    run = F.expr(f"before div {FAN}").alias("run")
    members = F.sort_array(F.collect_list(F.struct("before", "doc_id", "leaf", F.coalesce("claim", "leaf").alias("claim")))).alias("members")
    runs = materialize(placed.groupBy("tree", "width", run).agg(members), "merkle-runs")  # at most FAN in a run

    # a run of leaves becomes its parent; a lone leaf is its own subroot
    lone = F.col("width") == 1
    node = F.when(lone, F.concat_ws(".", "tree", F.lit("0"), "run")).otherwise(F.concat_ws(".", "tree", F.lit("1"), "run"))
    leaf_array = F.col("members.leaf")
    up = F.when(lone, F.get(leaf_array, 0)).otherwise(digest(joined(leaf_array)))
    first = materialize(runs.select("tree", F.col("run").alias("idx"), F.ceil(F.col("width") / FAN).alias("width"), node.alias("node"), up.alias("digest")), "merkle-level-1")
    inner = levels_above(first, -(-(size["widest"] or 0) // FAN), 1)
    tops = [x.where("width = 1").select(F.col("tree").alias("idx"), "node", "digest") for x in [first, *inner]]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    subroots = materialize(subroots.withColumn("width", F.lit(size["trees"])).withColumn("tree", F.lit("root")), "merkle-subroots")
    outer = levels_above(subroots, size["trees"])
    root = (outer[-1] if outer else subroots).first()  # one row, none of an empty table

    no_kids = F.lit(None).cast("array<struct<idx:bigint,node:string,digest:binary>>")  # where all leaves are lone and in one group
    links = node_rows(first.where("false").withColumn("kids", no_kids))
    for level in [*inner, *outer]:
        links = links.unionByName(node_rows(level))
    links = materialize(links, "merkle-nodes")
    folds = F.transform("members", lambda m, k: digest(left_of(leaf_array, k), m["claim"], right_of(leaf_array, k)))
    starts = runs.select("tree", "run", node.alias("node"), F.when(lone, F.col("members.claim")).otherwise(folds).alias("folds"), F.lit("").cast("binary").alias("proof"))
    climbed = climb(spark, starts, links, root["node"] if root else "")

    each = runs.join(climbed, ["tree", "run"]).select("tree", "folds", "proof", leaf_array.alias("leaves"), F.posexplode("members").alias("k", "m"))
    each = each.join(subroots.select(F.col("idx").alias("tree"), F.col("digest").alias("subroot")), "tree")
    text = lambda c: F.lower(F.hex(c))
    out = each.select(
        F.col("m.doc_id").alias("doc_id"),
        text(F.col("m.leaf")).alias("leaf"),
        text(F.col("subroot")).alias("subroot"),
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"),
        text(F.concat(left_of(F.col("leaves"), F.col("k")), right_of(F.col("leaves"), F.col("k")), F.col("proof"))).alias("siblings"),
        text(F.get(F.col("folds"), F.col("k"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased where the id's checksum is a multiple of three: what the query tampers with."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(hit & text.rlike(f"[{UPPER}]"), ascii_lower(text)).otherwise(text)
