"""Runs and their products: newest complete run, provenance, manifests, resumption, files by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.scalar import clean_token


def complete_runs(runs: DataFrame, products: DataFrame, required: Sequence[str]) -> DataFrame:
    """The runs that have every required product (relational division)."""
    has = products.where(F.col("product").isin(list(required))).groupBy("run_id").agg(F.countDistinct("product").alias("n_has"))
    return runs.join(has.where(F.col("n_has") == len(set(required))).select("run_id"), "run_id", "left_semi")


def latest_complete_run(runs: DataFrame, products: DataFrame, required: Sequence[str], explicit: DataFrame | None = None) -> DataFrame:
    """Per target the newest complete run by (mtime, run_id); an explicit complete run overrides."""
    done = complete_runs(runs, products, required)
    newest = done.groupBy("target_id").agg(F.max(F.struct("mtime", "run_id")).alias("best"), F.count("*").alias("n_complete"))
    newest = newest.select("target_id", F.col("best.run_id").alias("run_id"), F.col("best.mtime").alias("mtime"), "n_complete")
    if explicit is None:
        return newest
    chosen = explicit.join(done.select("target_id", "run_id", "mtime"), ["target_id", "run_id"]).withColumnsRenamed({"run_id": "x_run", "mtime": "x_time"})
    joined = newest.join(chosen, "target_id", "left")
    return joined.select("target_id", F.coalesce("x_run", "run_id").alias("run_id"), F.coalesce("x_time", "mtime").alias("mtime"), "n_complete")


def missing_products(runs: DataFrame, products: DataFrame, required: Sequence[str]) -> DataFrame:
    """(run_id, missing): the required products that each run lacks."""
    has = products.groupBy("run_id").agg(F.collect_set(F.when(F.col("product").isin(list(required)), F.col("product"))).alias("has"))
    wanted = F.array(*[F.lit(p) for p in required])
    rows = runs.select("run_id").join(has, "run_id", "left").select("run_id", F.array_except(wanted, F.coalesce("has", F.array().cast("array<string>"))).alias("missing"))
    return rows.where(F.size("missing") > 0)


def resolve_provenance(explicit, recorded, message: str = "no upstream run is given or recorded") -> Column:
    return F.coalesce(explicit, recorded, F.raise_error(F.lit(message)).cast("string"))


def config_fingerprint(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def resume_pending(every: DataFrame, done: DataFrame, keys: Sequence[str], fingerprint: str | None = None) -> DataFrame:
    """Units of work without a valid checkpoint of the same fingerprint."""
    valid = done if fingerprint is None else done.where(F.col("fingerprint") == fingerprint)
    return every.join(valid.select(*keys).distinct(), list(keys), "left_anti")


def latest_product(products: DataFrame, arm: str, conventional: Sequence[str], explicit: str | None = None) -> DataFrame:
    """Per run one width product: the explicit name, else the first conventional one, else the only one that looks right."""
    name = F.lower("name")
    looks = name.rlike(f".*lsf.*{arm.lower()}.*")
    rank = F.when(name == (explicit or "").lower(), 0) if explicit else F.when(F.lit(False), 0)
    for k, c in enumerate(conventional):
        rank = rank.when(name == c.lower(), k + 1)
    ranked = products.withColumn("rank", rank.when(looks, 1000)).where("rank is not null")
    w = Window.partitionBy("run_id").orderBy("rank", "name")
    top = ranked.withColumn("nth", F.row_number().over(w)).withColumn("n_same", F.count("*").over(Window.partitionBy("run_id", "rank")))
    return top.where((F.col("nth") == 1) & ((F.col("rank") < 1000) | (F.col("n_same") == 1))).select("run_id", "name", "path")


#: The header keys that must agree between an arc and its maps.
MATCH_KEYS = ("OFNAME", "CAMERA", "IFUNAM", "BINNING", "BGRATNAM", "RGRATNAM")


def match_sidecars(arcs: DataFrame, files: DataFrame, kinds: Sequence[str] = ("wavemap", "slicemap", "posmap")) -> DataFrame:
    """(arc_id, kind, path, rule, n): a map of each kind by exact root, by unique root prefix, or by headers in the same folder.

    `arcs`: arc_id, dir, root and MATCH_KEYS; `files`: path, dir, root, kind and MATCH_KEYS. n other than 1 is an error of the caller's to raise.
    """
    a = arcs.select("arc_id", F.col("dir").alias("a_dir"), F.col("root").alias("a_root"), *[clean_token(k).alias(f"a_{k}") for k in MATCH_KEYS])
    f = files.where(F.col("kind").isin(list(kinds))).select("path", "dir", "root", "kind", *[clean_token(k).alias(k) for k in MATCH_KEYS])
    agree = F.lit(True)
    for k in MATCH_KEYS:
        agree = agree & (F.coalesce(F.col(k), F.lit("")).eqNullSafe(F.coalesce(F.col(f"a_{k}"), F.lit(""))) | (F.coalesce(F.col(k), F.lit("")) == "") | (F.coalesce(F.col(f"a_{k}"), F.lit("")) == ""))
    # exact roots by an equi-join; only kinds still missing look at the rest of their folder
    exact = a.join(f, (F.col("a_dir") == F.col("dir")) & (F.col("a_root") == F.col("root"))).withColumn("rule", F.lit(1))
    wanted = a.crossJoin(F.broadcast(a.sparkSession.createDataFrame([(k,) for k in kinds], "a_kind string")))  # a few kinds
    open_ = wanted.join(exact.select("arc_id", F.col("kind").alias("a_kind")).distinct(), ["arc_id", "a_kind"], "left_anti")
    rest = open_.join(f, (F.col("a_dir") == F.col("dir")) & (F.col("a_kind") == F.col("kind"))).drop("a_kind")
    rest = rest.withColumn("rule", F.when(F.col("root").startswith(F.col("a_root")), 2).when(agree, 3))
    same = exact.unionByName(rest.select(*exact.columns))
    w = Window.partitionBy("arc_id", "kind")
    best = same.where("rule is not null").withColumn("top", F.min("rule").over(w)).where("rule = top")
    return best.groupBy("arc_id", "kind", "rule").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Append runs with their settings and products as one JSON column."""
    packed = rows.select("target_id", "run_id", F.to_json(F.struct(*sorted(c for c in rows.columns if c not in ("target_id", "run_id")))).alias("manifest"), F.current_timestamp().alias("written"))
    packed.write.mode("append").parquet(path)


def read_manifest(df: DataFrame, schema: str) -> DataFrame:
    return df.select("target_id", "run_id", F.from_json("manifest", schema).alias("m")).select("target_id", "run_id", "m.*")
