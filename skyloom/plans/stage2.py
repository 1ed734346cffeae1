"""The registered queries over bins and spectra, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import aggregates as A
from skyloom.operators import filters as L
from skyloom.operators import grids as G
from skyloom.operators import sampling as P
from skyloom.operators import sorts as S
from skyloom.sources import registry as R
from skyloom.sources import views as V
from skyloom.sources.views import r6

SPEC = """spec AS (SELECT label AS bin_id, vec_id AS spaxel, pos AS chan, CAST(4800.0 + 10.0 * pos AS DOUBLE) AS wave, CAST(embedding[pos + 1] AS DOUBLE) AS flux,
    CAST(0.01 + 0.002 * ((vec_id * 7 + pos * 3) % 11) AS DOUBLE) AS var, (vec_id + pos) % 13 <> 0 AS good FROM embeddings, range(0, 64) r(pos))"""
LINE = """line AS (SELECT l_suppkey AS bin_id, l_partkey AS spaxel, l_partkey // 50 AS y, l_partkey % 50 AS x,
    (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS chan, l_extendedprice * (1 - l_discount) - 30000 AS flux, l_quantity AS var,
    l_returnflag = 'R' AS mask, l_tax > 0 AS exposed, l_linenumber AS linenumber, round(l_discount, 2) AS discount, l_returnflag AS flag FROM lineitem)"""
GRID = """grid AS (SELECT l_returnflag AS bin_id, CAST(l_linenumber - 1 AS INT) AS ia, CAST(round(100 * l_discount) AS INT) AS ib, CAST(round(100 * l_tax) AS INT) AS jf,
    round(avg(l_extendedprice) / 997.13::DOUBLE, 10) AS chi2 FROM lineitem GROUP BY ALL)"""
EVT = """evt AS (SELECT event_type AS arm, user_id AS spaxel, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS t, value,
    CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 / 24) AS INT) AS day FROM events)"""
COADD = SPEC + """, m AS (SELECT DISTINCT bin_id, spaxel FROM spec), sizes AS (SELECT bin_id, count(*) AS n_members FROM m GROUP BY 1),
    c AS (SELECT bin_id, chan, max(wave) AS wave, count(*) FILTER (good) AS n_contrib, sum(flux * 0.09) FILTER (good) AS f, sqrt(sum(var * 0.0081) FILTER (good)) AS u FROM spec GROUP BY 1, 2),
    coadd AS (SELECT c.bin_id, chan, wave, n_contrib, n_contrib >= greatest(1, ceil(0.5 * n_members)) AS good, CASE WHEN n_contrib >= greatest(1, ceil(0.5 * n_members)) THEN f END AS flux,
        CASE WHEN n_contrib >= greatest(1, ceil(0.5 * n_members)) THEN u END AS unc FROM c JOIN sizes USING (bin_id))"""  # fmt: skip


def spec_coadd(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = V.spec(spark, sf_dir)
    members = spec.select("target_id", "arm", "spaxel", "bin_id").distinct()
    return A.coadd_bins(spec.drop("bin_id"), members, pixel_area=0.09, min_members=0.5, pixel=("spaxel",))


def q_min_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coadd, achieved signal to noise in a rest window, quality flags."""
    found = L.sn_qc(A.achieved_sn(spec_coadd(spark, sf_dir), 4700.0, 5000.0, 0.04, min_channels=5), min_channels=5, extreme=2.0, factor=3.0)
    values = ("median_flux", "median_unc", "min_unc", "p05_unc", "negative_fraction", "legacy", "signed", "sn")
    return found.select("bin_id", "n_good", *[r6(c).alias(c) for c in values], "positive", "nonpositive", "extreme", "disagreement")


MIN_SLICE = f"""WITH {COADD},
    w AS (SELECT bin_id, count(*) AS n_good, median(flux) AS median_flux, median(unc) AS median_unc, min(unc) AS min_unc, quantile_cont(unc, 0.05) AS p05_unc,
        avg(CASE WHEN flux < 0 THEN 1.0 ELSE 0.0 END) AS negative_fraction, median(flux / unc) AS legacy
        FROM coadd WHERE good AND unc > 0 AND wave BETWEEN 4700.0 * 1.04 AND 5000.0 * 1.04 GROUP BY 1),
    s AS (SELECT *, median_flux / median_unc AS signed, median_flux > 0 AS positive FROM w)
    SELECT bin_id, n_good, round(median_flux, 6) AS median_flux, round(median_unc, 6) AS median_unc, round(min_unc, 6) AS min_unc, round(p05_unc, 6) AS p05_unc,
        round(negative_fraction, 6) AS negative_fraction, round(legacy, 6) AS legacy, round(signed, 6) AS signed, CASE WHEN positive THEN round(signed, 6) END AS sn, positive,
        NOT positive AS nonpositive, abs(signed) > 2.0 OR abs(legacy) > 2.0 AS extreme,
        greatest(abs(signed), abs(legacy)) > 1 AND greatest(abs(signed), abs(legacy)) > 3.0 * greatest(least(abs(signed), abs(legacy)), 1e-12) AS disagreement FROM s"""


def q_coadd_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items coadded by part and supplier: a part is a pixel, of the first supplier that has it."""
    rows = V.line(spark, sf_dir).withColumn("good", ~F.col("mask")).withColumn("wave", F.col("chan") * 1.0)
    members = rows.groupBy("target_id", "arm", "spaxel").agg(F.min("bin_id").alias("bin_id"))
    found = A.coadd_bins(rows.drop("bin_id"), members, min_members=0.01, pixel=("spaxel",))
    return found.select("bin_id", "chan", r6("flux", 4).alias("flux"), r6("unc", 4).alias("unc"), "good", "n_contrib", "n_members")


COADD_LARGE = f"""WITH {LINE}, m AS (SELECT spaxel, min(bin_id) AS bin_id FROM line GROUP BY 1), z AS (SELECT bin_id, count(*) AS n_members FROM m GROUP BY 1),
    c AS (SELECT m.bin_id, chan, count(*) FILTER (NOT mask) AS n_contrib, sum(flux) FILTER (NOT mask) AS f, sqrt(sum(var) FILTER (NOT mask)) AS u FROM line JOIN m USING (spaxel) GROUP BY 1, 2)
    SELECT bin_id, chan, CASE WHEN n_contrib >= greatest(1, ceil(0.01 * n_members)) THEN round(f, 4) END AS flux, CASE WHEN n_contrib >= greatest(1, ceil(0.01 * n_members)) THEN round(u, 4) END AS unc,
        n_contrib >= greatest(1, ceil(0.01 * n_members)) AS good, n_contrib, n_members FROM c JOIN z USING (bin_id)"""


def q_hard_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.hard_masks(V.line(spark, sf_dir), w0=9050.0, w1=9700.0, min_good_fraction=0.6, bad_channel_fraction=0.36)
    return rows.groupBy("y", "x").agg(
        F.count("*").alias("n"), F.count_if("instrument_good").alias("n_instrument"), F.count_if("covered").alias("n_covered"), F.count_if("base_good").alias("n_base"), F.count_if("good").alias("n_good"),
        F.max("good_spaxel").alias("good_spaxel"), r6(F.max("coverage_fraction")).alias("coverage_fraction"), r6(F.max("good_fraction")).alias("good_fraction"), r6(F.sum("bad_fraction"), 4).alias("sum_bad"),
    )


HARD_MASKS = f"""WITH {LINE},
    a AS (SELECT *, 9000.0 + 10.0 * chan BETWEEN 9050.0 AND 9700.0 AS ins, exposed AND var > 0 AND NOT mask AS base FROM line),
    s AS (SELECT y, x, coalesce(avg(CASE WHEN exposed THEN 1.0 ELSE 0 END) FILTER (ins), 0) AS cov, coalesce(avg(CASE WHEN base THEN 1.0 ELSE 0 END) FILTER (ins), 0) AS gf FROM a GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN max(cov) OVER () >= 0.6 THEN cov >= 0.6 ELSE cov > 0 END AS core, gf >= 0.6 AS gs FROM s),
    j AS (SELECT a.*, cov, gf, core, gs FROM a JOIN k USING (y, x)),
    c AS (SELECT chan, 1.0 - avg(CASE WHEN base THEN 1.0 ELSE 0 END) FILTER (core) AS bad FROM j GROUP BY 1)
    SELECT y, x, count(*) AS n, count(*) FILTER (ins) AS n_instrument, count(*) FILTER (exposed) AS n_covered, count(*) FILTER (base) AS n_base,
        count(*) FILTER (base AND ins AND bad <= 0.36 AND gs) AS n_good, max(gs) AS good_spaxel, round(max(cov), 6) AS coverage_fraction, round(max(gf), 6) AS good_fraction, round(sum(bad), 4) AS sum_bad
    FROM j JOIN c USING (chan) GROUP BY 1, 2"""


def q_window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = V.spec(spark, sf_dir)
    channels = spec.groupBy("target_id", "arm", "bin_id", "chan", "wave").agg((F.avg(F.col("good").cast("int")) >= 0.92).alias("good"))
    found = L.window_coverage(channels, 5000.0, 5600.0, 0.0, keys=("target_id", "arm", "bin_id"))
    return found.select("bin_id", "good_min", "good_max", r6("envelope_fraction").alias("envelope_fraction"), r6("usable_channel_fraction").alias("usable_channel_fraction"), "truncated_blue", "truncated_red", "usable_min", "usable_max", "n_requested", "n_good")


WINDOW_COVERAGE = f"""WITH {SPEC}, c AS (SELECT bin_id, chan, wave, avg(CASE WHEN good THEN 1.0 ELSE 0 END) >= 0.92 AS good FROM spec GROUP BY 1, 2, 3),
    d AS (SELECT bin_id, min(wave) FILTER (good) AS good_min, max(wave) FILTER (good) AS good_max, count(*) FILTER (wave BETWEEN 5000 AND 5600) AS n_requested,
        count(*) FILTER (wave BETWEEN 5000 AND 5600 AND good) AS n_good, min(wave) FILTER (wave BETWEEN 5000 AND 5600 AND good) AS usable_min, max(wave) FILTER (wave BETWEEN 5000 AND 5600 AND good) AS usable_max FROM c GROUP BY 1)
    SELECT bin_id, good_min, good_max, round(least(1.0, greatest(0.0, (least(good_max, 5600.0) - greatest(good_min, 5000.0)) / 600.0)), 6) AS envelope_fraction,
        round(n_good / n_requested, 6) AS usable_channel_fraction, good_min - 5000.0 > 5 AS truncated_blue, 5600.0 - good_max > 5 AS truncated_red, usable_min, usable_max, n_requested, n_good FROM d"""


def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.collapse(V.spec(spark, sf_dir), ("spaxel",)).join(A.collapse(V.spec(spark, sf_dir), ("spaxel",), "mean").withColumnRenamed("value", "mean"), "spaxel").select("spaxel", r6("value").alias("value"), r6("mean").alias("mean"))


COLLAPSE = f"WITH {SPEC} SELECT spaxel, round(median(flux) FILTER (good), 6) AS value, round(avg(flux) FILTER (good), 6) AS mean FROM spec GROUP BY 1"


def q_continuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.continuum_window(V.spec(spark, sf_dir).withColumn("good_wave", F.col("chan") % 9 != 0), 5000.0, 5300.0, 0.0, 0.9, ("spaxel",))
    return found.select("spaxel", r6("valid_fraction").alias("valid_fraction"), r6("signal").alias("signal"), r6("noise").alias("noise"), "valid")


CONTINUUM = f"""WITH {SPEC}, c AS (SELECT spaxel, avg(CASE WHEN good THEN 1.0 ELSE 0 END) AS vf, median(flux) FILTER (good) AS s, sqrt(median(var) FILTER (good)) AS n
    FROM spec WHERE wave BETWEEN 5000 AND 5300 AND chan % 9 <> 0 GROUP BY 1)
    SELECT spaxel, round(vf, 6) AS valid_fraction, CASE WHEN vf >= 0.9 THEN round(s, 6) END AS signal, CASE WHEN vf >= 0.9 THEN round(n, 6) END AS noise, vf >= 0.9 AS valid FROM c"""


def q_window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.operators.joins import scan_windows

    found = S.rank_windows(scan_windows(spec_coadd(spark, sf_dir), 4800.0, 5430.0, 150.0, 30.0, min_channels=5, extreme=2.0), 12)
    return found.select("window_id", r6("center").alias("center"), "n_native", "n_evaluable", "n_positive", r6("positive_fraction").alias("positive_fraction"), r6("median_sn").alias("median_sn"), r6("p10_sn").alias("p10_sn"), r6("extreme_fraction").alias("extreme_fraction"))


WINDOW_SCAN = f"""WITH {COADD}, win AS (SELECT i AS window_id, CAST(4875.0 + 30.0 * i AS DOUBLE) AS center FROM range(0, 17) r(i)),
    b AS (SELECT window_id, center, bin_id, count(*) AS n_good, median(flux) / median(unc) AS signed, median(flux) > 0 AS positive
        FROM win JOIN coadd ON wave BETWEEN center - 75 AND center + 75 WHERE good AND unc > 0 GROUP BY 1, 2, 3),
    nat AS (SELECT window_id, count(DISTINCT chan) AS n_native FROM win JOIN coadd ON wave BETWEEN center - 75 AND center + 75 GROUP BY 1)
    SELECT window_id, center, n_native, count(*) FILTER (n_good >= 5) AS n_evaluable, count(*) FILTER (n_good >= 5 AND positive) AS n_positive,
        round(count(*) FILTER (n_good >= 5 AND positive) / count(*) FILTER (n_good >= 5), 6) AS positive_fraction, round(median(signed) FILTER (n_good >= 5 AND positive), 6) AS median_sn,
        round(quantile_cont(signed, 0.1) FILTER (n_good >= 5 AND positive), 6) AS p10_sn, round(count(*) FILTER (n_good >= 5 AND abs(signed) > 2.0) / count(*) FILTER (n_good >= 5), 6) AS extreme_fraction
    FROM b JOIN nat USING (window_id) GROUP BY 1, 2, 3 HAVING median_sn IS NOT NULL ORDER BY positive_fraction DESC, median(signed) FILTER (n_good >= 5 AND positive) DESC, window_id LIMIT 12"""


def q_weights_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.light_weights(V.image(spark, sf_dir), ("bin_id",), "value")
    shear = A.weighted_mean_shear(rows, ("bin_id",), "value2", "weight")
    return A.bin_centroids(rows, ("bin_id",)).join(shear, "bin_id").select("bin_id", "npix", *[r6(c).alias(c) for c in ("x_mean", "y_mean", "x_light", "y_light")], r6("mean", 2).alias("mean"), r6("shear", 2).alias("shear"))


IMG = """img AS (SELECT CAST(c_custkey // 50 AS INT) AS y, CAST(c_custkey % 50 AS INT) AS x, c_acctbal AS value, v2 AS value2, c_nationkey AS bin_id
    FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS v2 FROM orders GROUP BY 1) USING (c_custkey))"""
WEIGHTS_CENTROIDS = f"""WITH {IMG}, w AS (SELECT *, CASE WHEN sum(greatest(value, 0)) OVER b > 0 THEN greatest(value, 0) / sum(greatest(value, 0)) OVER b ELSE 1.0 / count(*) OVER b END AS w FROM img WINDOW b AS (PARTITION BY bin_id)),
    m AS (SELECT bin_id, sum(w * value2) / sum(w) AS mean FROM w WHERE w > 0 AND value2 IS NOT NULL GROUP BY 1),
    h AS (SELECT bin_id, any_value(mean) AS mean, sqrt(sum(w * (value2 - mean) ** 2) / sum(w)) AS shear FROM w JOIN m USING (bin_id) WHERE w > 0 AND value2 IS NOT NULL GROUP BY 1),
    c AS (SELECT bin_id, count(*) AS npix, avg(x) AS x_mean, avg(y) AS y_mean, sum(w * x) / sum(w) AS x_light, sum(w * y) / sum(w) AS y_light FROM w GROUP BY 1)
    SELECT bin_id, npix, round(x_mean, 6) AS x_mean, round(y_mean, 6) AS y_mean, round(x_light, 6) AS x_light, round(y_light, 6) AS y_light, round(mean, 2) AS mean, round(shear, 2) AS shear FROM c JOIN h USING (bin_id)"""


def q_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = A.bin_capacity(V.line(spark, sf_dir), ("bin_id",), A.summed_sn("log10", 0.1), F.col("flux") + 30000, F.col("unc") * 1000)
    scatter = A.capacity_scatter(bins, 200.0, ())
    return bins.crossJoin(F.broadcast(scatter)).select("bin_id", "npix", r6("sn", 5).alias("sn"), r6("capacity", 3).alias("capacity"), r6("scatter", 4).alias("scatter"), "n_single")


CAPACITY = f"""WITH {LINE}, b AS (SELECT bin_id, count(*) AS npix, sum(flux + 30000) / (sqrt(sum(var * 1e6)) * (1 + 0.1 * log10(greatest(count(*), 1)))) AS sn FROM line GROUP BY 1),
    c AS (SELECT *, greatest(sn, 0) ** 2 AS capacity FROM b)
    SELECT bin_id, npix, round(sn, 5) AS sn, round(capacity, 3) AS capacity, round(100 * sqrt(avg(CASE WHEN npix > 1 THEN ((capacity - 200) / 200) ** 2 END) OVER ()), 4) AS scatter, count(*) FILTER (npix = 1) OVER () AS n_single FROM c"""


def q_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.line(spark, sf_dir)
    return A.value_counts(rows, "linenumber", ("flag",)).join(A.binary_counts(rows, "mask", ("flag",)).withColumnRenamed("n", "n_all"), "flag").join(A.exposure_summary(rows, "exposure", ("flag",)).select("flag", "n_positive", r6("positive_fraction").alias("positive_fraction")), "flag")


FLAG_COUNTS = f"""WITH {LINE}, a AS (SELECT flag, count(*) FILTER (NOT mask) AS n_zero, count(*) FILTER (mask) AS n_set, count(*) AS n_all, count(*) FILTER (exposed) AS n_positive,
    round(count(*) FILTER (exposed) / count(*), 6) AS positive_fraction FROM line GROUP BY 1) SELECT flag, linenumber, count(*) AS n, n_zero, n_set, n_all, n_positive, positive_fraction FROM line JOIN a USING (flag) GROUP BY ALL"""


def q_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.line(spark, sf_dir)
    upper = A.shared_upper_limit(rows.where("linenumber < 4"), rows.where("linenumber >= 4"), 0.95, ("discount",), "flux")
    intervals = A.group_interval(rows, ("discount",), "flux")
    found = A.robust_limits(rows, "flux", keys=("discount",)).join(upper, "discount").join(intervals, "discount")
    return found.select("discount", "n", *[r6(c).alias(c) for c in ("lo", "hi", "upper", "median", "minus", "plus")])  # exact to six digits


LIMITS = f"""WITH {LINE}, p AS (SELECT discount, count(*) AS n, quantile_cont(flux, [0.02, 0.16, 0.5, 0.84, 0.95, 0.98]) AS q FROM line GROUP BY 1)
    SELECT discount, n, round(q[1], 6) AS lo, round(q[6], 6) AS hi, round(q[5], 6) AS upper, round(q[3], 6) AS median, round(q[3] - q[2], 6) AS minus, round(q[4] - q[3], 6) AS plus FROM p"""


def q_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_complete_run(*V.runs(spark, sf_dir), ("1", "2")).select("target_id", "run_id", "n_complete")


LATEST_RUN = """WITH c AS (SELECT l_orderkey AS run_id FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 2)
    SELECT o_custkey AS target_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, count(*) AS n_complete FROM orders JOIN c ON o_orderkey = run_id GROUP BY 1"""


def q_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, products = V.runs(spark, sf_dir)
    done = R.complete_runs(runs, products, ("1", "2", "3"))
    todo = R.resume_pending(runs.select("run_id"), done, ("run_id",))
    return todo.join(R.missing_products(runs, products, ("1", "2", "3")), "run_id").select("run_id", F.array_join(F.array_sort("missing"), ",").alias("missing"))


PENDING = """WITH p AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS k FROM lineitem), w AS (SELECT o_orderkey AS run_id, k FROM orders, (VALUES (1), (2), (3)) v(k))
    SELECT run_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS missing FROM (SELECT run_id, k FROM w ANTI JOIN p USING (run_id, k)) GROUP BY 1"""


def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.profile_over(V.surfaces(spark, sf_dir), ("bin_id",)).select("bin_id", "ia", "ib", "jf", r6("chi2").alias("chi2"), r6("delta").alias("delta"))


PROFILE = f"WITH {GRID}, p AS (SELECT bin_id, ia, ib, min(chi2) AS chi2, arg_min(jf, (chi2, jf)) AS jf FROM grid GROUP BY 1, 2, 3) SELECT bin_id, ia, ib, jf, round(chi2, 6) AS chi2, round(chi2 - min(chi2) OVER (PARTITION BY bin_id), 6) AS delta FROM p"


def q_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.functions.scalar import edge_warning, grid_edge_distance

    best = S.best_state(V.surfaces(spark, sf_dir), ("bin_id",))
    at = ("ia", "ib", "jf")
    return best.select("bin_id", *at, r6("chi2").alias("chi2"), grid_edge_distance(at, (7, 11, 9)).alias("edge_distance"), edge_warning(at, (7, 11, 9), 1).alias("edge_warning"))


BEST = f"""WITH {GRID}, b AS (SELECT bin_id, arg_min((ia, ib, jf), (chi2, ia, ib, jf)) AS s, min(chi2) AS chi2 FROM grid GROUP BY 1), c AS (SELECT bin_id, s[1] AS ia, s[2] AS ib, s[3] AS jf, chi2 FROM b)
    SELECT bin_id, ia, ib, jf, round(chi2, 6) AS chi2, least(ia, 6 - ia, ib, 10 - ib, jf, 8 - jf) AS edge_distance, least(ia, 6 - ia, ib, 10 - ib, jf, 8 - jf) <= 1 AS edge_warning FROM c"""


def q_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mass_cell_counts(P.likelihood_weights(V.surfaces(spark, sf_dir), ("bin_id",)), (0.5, 0.9, 0.99), ("bin_id",))


WEIGHTED = GRID + """, d AS (SELECT *, chi2 - min(chi2) OVER (PARTITION BY bin_id) AS delta FROM grid), wt AS (SELECT *, exp(-0.5 * delta) AS w, exp(-0.5 * delta) / sum(exp(-0.5 * delta)) OVER (PARTITION BY bin_id) AS p FROM d)"""
MASS = f"""WITH {WEIGHTED}, c AS (SELECT bin_id, round(sum(p) OVER (PARTITION BY bin_id ORDER BY w DESC, ia, ib, jf ROWS UNBOUNDED PRECEDING), 12) AS cum FROM wt)
    SELECT bin_id, least(count(*), 1 + count(*) FILTER (cum < 0.5)) AS n_0_5, least(count(*), 1 + count(*) FILTER (cum < 0.9)) AS n_0_9, least(count(*), 1 + count(*) FILTER (cum < 0.99)) AS n_0_99 FROM c GROUP BY 1"""


def q_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.likelihood_weights(V.surfaces(spark, sf_dir), ("bin_id",))
    return P.effective_states(rows, ("bin_id",)).join(P.effective_sample_size(rows, ("bin_id",)), "bin_id").select("bin_id", r6("effective_states").alias("effective_states"), r6("ess").alias("ess"))


ESS = f"WITH {WEIGHTED} SELECT bin_id, round(1 / sum(p * p), 6) AS effective_states, round(sum(w) ** 2 / sum(w * w), 6) AS ess FROM wt GROUP BY 1"


def q_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.likelihood_weights(V.surfaces(spark, sf_dir), ("bin_id",)).withColumn("x", F.col("ia") + 0.05 * F.col("ib") + 0.001 * F.col("jf"))
    found = P.weighted_quantiles(rows, (0.16, 0.5, 0.84), ("bin_id",))
    return found.select("bin_id", *[r6(c).alias(c) for c in found.columns[1:]])


QUANTILES = f"""WITH {WEIGHTED}, c AS (SELECT bin_id, ia + 0.05 * ib + 0.001 * jf AS x, w FROM wt),
    s AS (SELECT bin_id, x, sum(w) OVER o / sum(w) OVER (PARTITION BY bin_id) AS c FROM c WINDOW o AS (PARTITION BY bin_id ORDER BY x ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, lag(c) OVER o AS c0, lag(x) OVER o AS x0 FROM s WINDOW o AS (PARTITION BY bin_id ORDER BY x)),
    q AS (SELECT bin_id, q, coalesce(min(CASE WHEN c >= q AND c0 < q THEN x0 + (x - x0) * (q - c0) / (c - c0) END), max(CASE WHEN c0 IS NULL AND c >= q THEN x END), max(x)) AS v FROM l, (VALUES (0.16), (0.5), (0.84)) t(q) GROUP BY 1, 2)
    SELECT bin_id, round(max(v) FILTER (q = 0.16), 6) AS q_16, round(max(v) FILTER (q = 0.5), 6) AS q_50, round(max(v) FILTER (q = 0.84), 6) AS q_84 FROM q GROUP BY 1"""


def q_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.basins(V.surfaces(spark, sf_dir), ("bin_id",)).select("bin_id", "ia", "ib", "jf", "m_ia", "m_ib", "m_jf")


BASINS = f"""WITH RECURSIVE {GRID}, n AS (SELECT a.bin_id, a.ia, a.ib, a.jf, arg_min((b.ia, b.ib, b.jf), (b.chi2, b.ia, b.ib, b.jf)) AS t, min(b.chi2) < any_value(a.chi2) AS down
        FROM grid a JOIN grid b ON a.bin_id = b.bin_id AND abs(a.ia - b.ia) <= 1 AND abs(a.ib - b.ib) <= 1 AND abs(a.jf - b.jf) <= 1 AND (a.ia, a.ib, a.jf) <> (b.ia, b.ib, b.jf) GROUP BY ALL),
    w AS (SELECT bin_id, ia, ib, jf, ia AS ca, ib AS cb, jf AS cf FROM grid UNION ALL
        SELECT w.bin_id, w.ia, w.ib, w.jf, t[1], t[2], t[3] FROM w JOIN n ON n.bin_id = w.bin_id AND n.ia = ca AND n.ib = cb AND n.jf = cf WHERE down)
    SELECT w.bin_id, w.ia, w.ib, w.jf, ca AS m_ia, cb AS m_ib, cf AS m_jf FROM w JOIN n ON n.bin_id = w.bin_id AND n.ia = ca AND n.ib = cb AND n.jf = cf WHERE NOT down"""


def q_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.likelihood_weights(V.surfaces(spark, sf_dir), ("bin_id",)).withColumn("cell", (F.col("ia") * 11 + F.col("ib")) * 9 + F.col("jf"))
    return P.draw_states(rows, 1000, seed=7, keys=("bin_id",))


def q_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = A.group_interval(V.events(spark, sf_dir), ("arm", "day")).select("arm", F.col("day").alias("batch"), (F.col("median") - F.col("minus")).alias("p16"), F.col("median").alias("p50"), (F.col("median") + F.col("plus")).alias("p84"))
    found = P.quantile_convergence(batches, ("arm",), 0.3, 5.0, passes=2)
    return found.select("arm", "batch", r6("change").alias("change"), r6("tolerance").alias("tolerance"), "converged", "passes", "done")


CONVERGENCE = f"""WITH {EVT}, b AS (SELECT arm, day AS batch, quantile_cont(value, [0.16, 0.5, 0.84]) AS q FROM evt GROUP BY 1, 2),
    c AS (SELECT arm, batch, greatest(abs(q[1] - lag(q[1]) OVER o), abs(q[2] - lag(q[2]) OVER o), abs(q[3] - lag(q[3]) OVER o)) AS ch, greatest(5.0, 0.3 * greatest(q[3] - q[1], 0)) AS tol, lag(batch) OVER o IS NULL AS f FROM b WINDOW o AS (PARTITION BY arm ORDER BY batch)),
    d AS (SELECT arm, batch, CASE WHEN NOT f THEN ch END AS change, tol AS tolerance, NOT f AND ch < tol AS converged FROM c),
    e AS (SELECT *, count(*) FILTER (NOT converged) OVER (PARTITION BY arm ORDER BY batch ROWS UNBOUNDED PRECEDING) AS i FROM d)
    SELECT arm, batch, round(change, 6) AS change, round(tolerance, 6) AS tolerance, converged, count(*) FILTER (converged) OVER k AS passes, count(*) FILTER (converged) OVER k >= 2 AS done FROM e WINDOW k AS (PARTITION BY arm, i ORDER BY batch ROWS UNBOUNDED PRECEDING)"""


def q_false_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    evt = V.events(spark, sf_dir)
    observed = evt.where("spaxel % 10 = 0").select("arm", F.col("event_id").cast("string").alias("obs_id"), F.col("value").alias("statistic"))
    mocks = evt.where("spaxel % 10 <> 0").select("arm", F.col("value").alias("statistic"))
    recovery = A.recovery_probability(evt.withColumn("recovered", F.col("value") > 50), ("arm",)).select("arm", r6("probability").alias("recovery"))
    return A.false_positive_probability(observed, mocks, ("arm",)).join(recovery, "arm").select("arm", "obs_id", r6("probability", 8).alias("probability"), "n_mocks", "recovery")


FALSE_POSITIVE = f"""WITH {EVT}, m AS (SELECT arm, value, count(*) OVER (PARTITION BY arm) AS n FROM evt WHERE spaxel % 10 <> 0), r AS (SELECT arm, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS recovery FROM evt GROUP BY 1),
    o AS (SELECT arm, event_id, value FROM evt WHERE spaxel % 10 = 0)
    SELECT arm, event_id::VARCHAR AS obs_id, round((count(*) FILTER (m.value >= o.value) + 1) / (any_value(n) + 1), 8) AS probability, any_value(n) AS n_mocks, any_value(recovery) AS recovery FROM o JOIN m USING (arm) JOIN r USING (arm) GROUP BY 1, 2"""


def q_lsf_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.group_rms(V.line(spark, sf_dir).withColumn("one", F.lit(1)), "linenumber", "discount", ("one",), "flux")
    return found.select("level", r6("rms", 4).alias("rms"), "n_groups")


LSF_GROUPS = f"""WITH {LINE}, m AS (SELECT linenumber, discount, median(flux) AS m, GROUPING(linenumber) AS a, GROUPING(discount) AS b FROM line GROUP BY CUBE (linenumber, discount))
    SELECT CASE WHEN a = 0 AND b = 0 THEN 'pair' WHEN a = 0 THEN 'first' ELSE 'second' END AS level, round(sqrt(avg(m * m)), 4) AS rms, count(*) AS n_groups FROM m WHERE a + b < 2 GROUP BY 1
    UNION ALL SELECT 'all', round(sqrt(avg(flux * flux)), 4), count(*) FROM line"""

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_min_slice": MIN_SLICE, "q_coadd_large": COADD_LARGE, "q_hard_masks": HARD_MASKS, "q_window_coverage": WINDOW_COVERAGE, "q_collapse": COLLAPSE, "q_continuum": CONTINUUM,
    "q_window_scan": WINDOW_SCAN, "q_weights_centroids": WEIGHTS_CENTROIDS, "q_capacity": CAPACITY, "q_flag_counts": FLAG_COUNTS, "q_limits": LIMITS, "q_latest_run": LATEST_RUN, "q_pending": PENDING,
    "q_profile": PROFILE, "q_best": BEST, "q_mass": MASS, "q_ess": ESS, "q_quantiles": QUANTILES, "q_basins": BASINS, "q_convergence": CONVERGENCE, "q_false_positive": FALSE_POSITIVE, "q_lsf_groups": LSF_GROUPS,
}
