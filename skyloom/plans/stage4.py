"""The registered queries of the later stages, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.scalar import deproject
from skyloom.operators import aggregates as A
from skyloom.operators import designed as D
from skyloom.operators import grids as G
from skyloom.operators import sampling as P
from skyloom.operators import windows as W
from skyloom.plans.stage2 import EVT, GRID, IMG, LINE, SPEC
from skyloom.sources import prepared as R
from skyloom.sources import views as V
from skyloom.sources.views import r6


def q_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four matched tables made one, counted per bin."""
    spec, keys = V.spec(spark, sf_dir), ("bin_id", "spaxel", "chan")
    part = lambda v: spec.select(*keys, v.cast("double").alias("value"))
    rows = R.assemble_companions(part(F.col("flux")), part(F.col("var") - 0.02), part((~F.col("good")).cast("int")), part(F.when(F.col("var") < 0.02, 0).otherwise(F.col("chan") % 5)), keys)
    return rows.groupBy("bin_id").agg(F.count("*").alias("n"), F.count("unc").alias("n_unc"), F.count_if("mask").alias("n_masked"), r6(F.sum("unc"), 5).alias("sum_unc"), r6(F.sum("flux"), 5).alias("sum_flux"), F.count_if(F.col("exposure") > 0).alias("n_exposed"))


COMPANIONS = f"""WITH {SPEC} SELECT bin_id, count(*) AS n, count(*) FILTER (var - 0.02 > 0) AS n_unc, count(*) FILTER (NOT good) AS n_masked, round(sum(sqrt(var - 0.02)) FILTER (var - 0.02 > 0), 5) AS sum_unc, round(sum(flux), 5) AS sum_flux,
    count(*) FILTER (var >= 0.02 AND chan % 5 > 0) AS n_exposed FROM spec GROUP BY 1"""


def second_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("bin_id"), (F.col("l_linenumber") - 1).cast("int").alias("ia"), F.round(100 * F.col("l_discount")).cast("int").alias("ib"), F.round(100 * F.col("l_tax")).cast("int").alias("jf")]
    return t.groupBy(*keys).agg(F.round(F.avg("l_quantity") / 0.99713, 10).alias("chi2"))


SURFACE2 = """grid2 AS (SELECT l_returnflag AS bin_id, CAST(l_linenumber - 1 AS INT) AS ia, CAST(round(100 * l_discount) AS INT) AS ib, CAST(round(100 * l_tax) AS INT) AS jf, round(avg(l_quantity) / 0.99713::DOUBLE, 10) AS chi2 FROM lineitem GROUP BY ALL)"""


def q_joint_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.joint_minimum(V.surfaces(spark, sf_dir), second_surface(spark, sf_dir), ("bin_id",))
    return found.select("bin_id", "ia", "ib", "jf", r6("j").alias("j"), "is_best")


JOINT = f"""WITH {GRID}, {SURFACE2}, a AS (SELECT *, chi2 - min(chi2) OVER (PARTITION BY bin_id) AS d FROM grid), b AS (SELECT *, chi2 - min(chi2) OVER (PARTITION BY bin_id) AS d FROM grid2),
    j AS (SELECT bin_id, ia, ib, jf, a.d + b.d AS j FROM a JOIN b USING (bin_id, ia, ib, jf)) SELECT bin_id, ia, ib, jf, round(j, 6) AS j, row_number() OVER (PARTITION BY bin_id ORDER BY j, ia, ib, jf) = 1 AS is_best FROM j"""


def q_basin_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.basin_weights(V.surfaces(spark, sf_dir), ("bin_id",))
    return found.select("bin_id", "ia", "ib", "jf", r6("delta").alias("delta"), r6("p", 8).alias("p"))


BASIN_WEIGHTS = f"""WITH RECURSIVE {GRID}, n AS (SELECT a.bin_id, a.ia, a.ib, a.jf, arg_min((b.ia, b.ib, b.jf), (b.chi2, b.ia, b.ib, b.jf)) AS t, min(b.chi2) < any_value(a.chi2) AS down
        FROM grid a JOIN grid b ON a.bin_id = b.bin_id AND abs(a.ia - b.ia) <= 1 AND abs(a.ib - b.ib) <= 1 AND abs(a.jf - b.jf) <= 1 AND (a.ia, a.ib, a.jf) <> (b.ia, b.ib, b.jf) GROUP BY ALL),
    w AS (SELECT bin_id, ia, ib, jf, ia AS ca, ib AS cb, jf AS cf FROM grid UNION ALL SELECT w.bin_id, w.ia, w.ib, w.jf, t[1], t[2], t[3] FROM w JOIN n ON n.bin_id = w.bin_id AND n.ia = ca AND n.ib = cb AND n.jf = cf WHERE down),
    e AS (SELECT w.bin_id, w.ia, w.ib, w.jf, ca, cb, cf FROM w JOIN n ON n.bin_id = w.bin_id AND n.ia = ca AND n.ib = cb AND n.jf = cf WHERE NOT down),
    d AS (SELECT e.*, chi2 - min(chi2) OVER (PARTITION BY bin_id, ca, cb, cf) AS delta FROM e JOIN grid USING (bin_id, ia, ib, jf))
    SELECT bin_id, ia, ib, jf, round(delta, 6) AS delta, round(exp(-0.5 * delta) / sum(exp(-0.5 * delta)) OVER (PARTITION BY bin_id, ca, cb, cf), 8) AS p FROM d"""

TRIALS = [(k, 30.0 * k, 60.0, -40.0 + 20.0 * k, 30.0 - 10.0 * k) for k in range(6)]


def q_score_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial disks scored over three bins of weighted pixels against the state surfaces."""
    t = V.table(spark, sf_dir, "lineitem")
    members = t.groupBy(F.lit("demo").alias("target_id"), F.col("l_returnflag").alias("bin_id"), (F.col("l_partkey") % 50 - 25).alias("x"), (F.col("l_suppkey") % 10 - 5).alias("y")).agg(F.sum("l_quantity").alias("weight"))
    trials = spark.createDataFrame([("demo", *row) for row in TRIALS], "target_id string, trial int, pa double, incl double, vsys_a double, vsys_b double")
    nodes = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("v")) for a, b in ((10.0, 80.0), (60.0, 120.0))])
    found = D.score_trials(trials.withColumn("nodes", nodes), members, V.surfaces(spark, sf_dir), (-300.0, -200.0), (-500.0, -400.0))
    return found.select("trial", r6("score", 5).alias("score"), "n_bins")


SCORE_TRIALS = f"""WITH {GRID}, m AS (SELECT l_returnflag AS bin_id, l_partkey % 50 - 25 AS x, l_suppkey % 10 - 5 AS y, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2, 3),
    t(trial, pa, incl, va, vb) AS (VALUES {", ".join(map(str, TRIALS))}), r AS (SELECT trial, bin_id, w, va, vb, radians(incl) AS i, x * cos(radians(pa)) + y * sin(radians(pa)) AS mj, (-x * sin(radians(pa)) + y * cos(radians(pa))) / cos(radians(incl)) AS mn FROM m, t),
    v AS (SELECT trial, bin_id, w, va, vb, sin(i) * cos(atan2(mn, mj)) * CASE WHEN sqrt(mj * mj + mn * mn) <= 10 THEN 8.0 * sqrt(mj * mj + mn * mn) ELSE 80 + 0.8 * (sqrt(mj * mj + mn * mn) - 10) END AS u FROM r),
    b AS (SELECT trial, bin_id, (sum(w * (va + u)) / sum(w) + 300) / 100 AS pa, (sum(w * (vb + u)) / sum(w) + 500) / 100 AS pb FROM v GROUP BY 1, 2),
    s AS (SELECT bin_id, ia, ib, min(chi2) AS chi2 FROM grid GROUP BY 1, 2, 3),
    c AS (SELECT trial, b.bin_id, sum((1 - abs(pa - floor(pa) - i)) * (1 - abs(pb - floor(pb) - j)) * chi2) AS chi2 FROM b CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j) JOIN s ON s.bin_id = b.bin_id AND s.ia = floor(pa) + i AND s.ib = floor(pb) + j GROUP BY 1, 2)
    SELECT trial, round(sum(chi2), 5) AS score, count(*) AS n_bins FROM c GROUP BY 1"""


def q_radial_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = V.image(spark, sf_dir).withColumns({"x": F.col("x") - 25.0, "y": F.col("y") - 15.0})
    profile = D.radial_profile(img, 4.0, 25.0, 50.0)
    r, theta = deproject("x", "y", F.lit(25.0), F.lit(50.0))
    cover = D.ring_coverage(img.select("target_id", r.alias("r"), theta.alias("theta")), 4.0)
    return profile.join(cover.drop("n"), ["target_id", "ring"]).select("ring", r6("median", 3).alias("median"), r6("minus", 3).alias("minus"), r6("plus", 3).alias("plus"), "n", "n_sectors", r6("coverage").alias("coverage"), "poor")


RADIAL = f"""WITH {IMG}, r AS (SELECT value, (x - 25.0) * cos(radians(25)) + (y - 15.0) * sin(radians(25)) AS mj, (-(x - 25.0) * sin(radians(25)) + (y - 15.0) * cos(radians(25))) / cos(radians(50)) AS mn FROM img),
    p AS (SELECT CAST(floor(sqrt(mj * mj + mn * mn) / 4) AS INT) AS ring, value, CAST(floor((atan2(mn, mj) + CASE WHEN atan2(mn, mj) < 0 THEN 2 * pi() ELSE 0 END) / (2 * pi() / 8)) AS INT) AS sector FROM r),
    q AS (SELECT ring, quantile_cont(value, [0.16, 0.5, 0.84]) AS q, count(value) AS n, count(DISTINCT sector) AS n_sectors FROM p GROUP BY 1)
    SELECT ring, round(q[2], 3) AS median, round(q[2] - q[1], 3) AS minus, round(q[3] - q[2], 3) AS plus, n, n_sectors, round(n_sectors / 8, 6) AS coverage, n_sectors / 8 < 0.5 AS poor FROM q"""


def q_mc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.events(spark, sf_dir).select((F.col("spaxel") % 10).alias("bin_id"), F.col("arm").alias("quantity"), (F.col("day") % 3).alias("layer"), "value")
    found = D.mc_summary(rows, ("bin_id",))
    return found.select("bin_id", "quantity", "layer", *[r6(c, 4).alias(c) for c in ("median", "minus", "plus")], "n")


MC = f"""WITH {EVT}, q AS (SELECT spaxel % 10 AS bin_id, arm AS quantity, day % 3 AS layer, quantile_cont(value, [0.16, 0.5, 0.84]) AS q, count(*) AS n FROM evt GROUP BY 1, 2, 3)
    SELECT bin_id, quantity, layer, round(q[2], 4) AS median, round(q[2] - q[1], 4) AS minus, round(q[3] - q[2], 4) AS plus, n FROM q"""


def q_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light-weighted populations of suppliers, all parts being templates."""
    meta = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("template_id"), (F.col("p_size") / 10).alias("log_age"), (F.col("p_retailprice") / 1000).alias("metal"), (F.col("p_partkey") % 11 == 0).alias("is_gas"))
    weights = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bin_id"), (F.col("l_linenumber") % 2).alias("component"), F.col("l_partkey").alias("template_id"), F.col("l_quantity").alias("weight"))
    found = D.population_summary(weights, meta, ("bin_id", "component"))
    shares = A.achieved_fraction(weights.withColumn("requested", F.lit(0.5)), ("bin_id",))
    return found.join(shares.select("bin_id", "fraction", "warn"), "bin_id").select("bin_id", "component", *[r6(c).alias(c) for c in ("log_age", "metal", "light", "edge_fraction", "fraction")], "warn")


POPULATIONS = """WITH meta AS (SELECT p_partkey AS template_id, p_size / 10 AS log_age, p_retailprice / 1000 AS metal, p_partkey % 11 = 0 AS gas FROM part),
    e AS (SELECT min(log_age) AS a0, max(log_age) AS a1, min(metal) AS m0, max(metal) AS m1 FROM meta), w AS (SELECT l_suppkey AS bin_id, l_linenumber % 2 AS component, l_partkey AS template_id, l_quantity AS weight FROM lineitem),
    f AS (SELECT bin_id, sum(weight) FILTER (component = 0) / sum(weight) AS fraction FROM w GROUP BY 1)
    SELECT bin_id, component, round(sum(weight * log_age) / sum(weight), 6) AS log_age, round(sum(weight * metal) / sum(weight), 6) AS metal, round(sum(weight), 6) AS light,
        round(coalesce(sum(weight) FILTER (log_age IN (a0, a1) OR metal IN (m0, m1)), 0) / sum(weight), 6) AS edge_fraction, round(any_value(fraction), 6) AS fraction, abs(any_value(fraction) - 0.5) > 0.02 AS warn
    FROM w JOIN meta USING (template_id) JOIN f USING (bin_id), e WHERE NOT gas GROUP BY 1, 2"""


def q_mock_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.strata(V.line(spark, sf_dir), {"flux": (-20000.0, 0.0, 20000.0), "var": (10.0, 30.0)})
    return A.recovery_probability(rows.withColumn("recovered", F.col("mask")), ("s_flux", "s_var")).select("s_flux", "s_var", r6("probability").alias("probability"), "n")


MOCK = f"""WITH {LINE} SELECT (flux >= -20000)::INT + (flux >= 0)::INT + (flux >= 20000)::INT AS s_flux, (var >= 10)::INT + (var >= 30)::INT AS s_var, round(avg(CASE WHEN mask THEN 1.0 ELSE 0 END), 6) AS probability, count(*) AS n FROM line GROUP BY 1, 2"""


def q_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.surfaces(spark, sf_dir).withColumn("status", F.when(F.col("chi2") > 60, 1).when(F.col("chi2") < 25, 2).otherwise(0)).withColumn("boundary", F.col("jf") == 8)
    found = G.state_summary(rows.withColumn("chi2", F.when(F.col("status") == 0, F.col("chi2"))), ("bin_id",))
    return found.select("bin_id", "n_states", "n_failures", "n_fit_failures", "n_mismatches", "n_boundary", F.col("best.ia").alias("best_ia"), F.col("best.ib").alias("best_ib"), F.col("best.jf").alias("best_jf"), F.col("first_failure.ia").alias("fail_ia"), F.col("first_failure.ib").alias("fail_ib"))


STATE_SUMMARY = f"""WITH {GRID}, s AS (SELECT *, CASE WHEN chi2 > 60 THEN 1 WHEN chi2 < 25 THEN 2 ELSE 0 END AS st FROM grid)
    SELECT bin_id, count(*) AS n_states, count(*) FILTER (st <> 0) AS n_failures, count(*) FILTER (st = 1) AS n_fit_failures, count(*) FILTER (st = 2) AS n_mismatches, count(*) FILTER (jf = 8) AS n_boundary,
        arg_min(ia, (chi2, ia, ib, jf)) FILTER (st = 0) AS best_ia, arg_min(ib, (chi2, ia, ib, jf)) FILTER (st = 0) AS best_ib, arg_min(jf, (chi2, ia, ib, jf)) FILTER (st = 0) AS best_jf,
        arg_min(ia, (ia, ib, jf)) FILTER (st <> 0) AS fail_ia, arg_min(ib, (ia, ib, jf)) FILTER (st <> 0) AS fail_ib FROM s GROUP BY 1"""


def q_coverage_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.spec(spark, sf_dir).withColumn("good", F.col("good") & (F.col("flux") > 0.2)).select("bin_id", F.col("spaxel"), "chan", "good")
    return W.coverage_extremes(rows.withColumn("target_id", F.col("bin_id")).withColumn("bin_id", F.col("spaxel"))).select(F.col("target_id").alias("label"), "bin_id")


COVERAGE = f"""WITH {SPEC}, s AS (SELECT bin_id AS label, spaxel AS bin_id, min(chan) AS lo, max(chan) AS hi FROM spec WHERE good AND flux > 0.2 GROUP BY 1, 2)
    SELECT DISTINCT label, bin_id FROM (SELECT label, unnest([arg_min(bin_id, (lo, bin_id)), arg_min(bin_id, (-hi, bin_id)), arg_min(bin_id, (lo - hi, bin_id))]) AS bin_id FROM s GROUP BY 1)"""


def q_direct_or_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.likelihood_weights(V.surfaces(spark, sf_dir), ("bin_id",)).withColumn("cell", (F.col("ia") * 11 + F.col("ib")) * 9 + F.col("jf"))
    return D.direct_or_sampled(rows, 500, limit=200, keys=("bin_id",))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_companions": COMPANIONS, "q_joint_minimum": JOINT, "q_basin_weights": BASIN_WEIGHTS, "q_score_trials": SCORE_TRIALS, "q_radial_profile": RADIAL, "q_mc_summary": MC, "q_populations": POPULATIONS,
    "q_mock_calibration": MOCK, "q_state_summary": STATE_SUMMARY, "q_coverage_extremes": COVERAGE,
}
