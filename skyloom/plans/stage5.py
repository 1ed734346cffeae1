"""The registered queries over tables of bins, sets, headers, products and designed stages, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import flags as Q
from skyloom.functions import scalar as X
from skyloom.operators import aggregates as A
from skyloom.operators import designed as D
from skyloom.operators import filters as L
from skyloom.operators import grids as G
from skyloom.operators import images as I
from skyloom.operators import joins as J
from skyloom.operators import sampling as P
from skyloom.operators import sorts as S
from skyloom.plans.stage2 import GRID, IMG, SPEC
from skyloom.plans.stage4 import SURFACE2, second_surface
from skyloom.sources import prepared as R
from skyloom.sources import registry as G2
from skyloom.sources import views as V
from skyloom.sources.scratch import shared_dir
from skyloom.sources.views import r6


def q_bins_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per bin: sizes, signal to noise, scale, chi2 against the mean, validity."""
    spec = V.spec(spark, sf_dir)
    key = ("bin_id",)
    members = spec.select("bin_id", "spaxel").distinct()
    geometry = A.bin_geometry(members, members.where("spaxel % 3 = 0"), 0.09, key)
    scale = A.normalize_scale(spec.where("good"), key).select("bin_id", r6("scale").alias("scale"))
    chi2 = A.total_chi2(spec.where("good").withColumn("zero", F.lit(0.0)), key, "flux", "zero", "unc").select("bin_id", r6("chi2", 4).alias("chi2"), F.col("n").alias("n_samples"))
    sn = spec.where("good").groupBy("bin_id").agg((F.avg("flux") * 100).alias("sn"), F.count("*").alias("n_good"))
    whole = A.sn_summary(sn, ()).select("n_valid", r6("median_sn").alias("median_sn"), r6("max_sn").alias("max_sn"))
    few = L.enough_pixels(spec, 2_950, key).select("bin_id", F.lit(True).alias("too_few"))
    rows = D.final_table(geometry, scale, chi2, sn.select("bin_id", r6("sn").alias("sn")), few, keys=key)
    return rows.crossJoin(F.broadcast(whole)).select("bin_id", "n_a", "n_b", r6("area").alias("area"), r6("coverage").alias("coverage"), "scale", "chi2", "n_samples", "sn", "too_few", "n_valid", "median_sn", "max_sn")


BINS_TABLE = f"""WITH {SPEC}, m AS (SELECT DISTINCT bin_id, spaxel FROM spec), g AS (SELECT bin_id, count(*) AS n_a, count(*) FILTER (spaxel % 3 = 0) AS n_b FROM m GROUP BY 1),
    b AS (SELECT bin_id, median(abs(flux)) AS sc, sum(flux * flux / var) AS chi2, count(*) AS n, avg(flux) * 100 AS sn FROM spec WHERE good GROUP BY 1), w AS (SELECT count(*) AS n_valid, median(sn) AS md, max(sn) AS mx FROM b)
    SELECT bin_id, n_a, n_b, round(n_a * 0.09::DOUBLE, 6) AS area, round(n_b / n_a, 6) AS coverage, round(sc, 6) AS scale, round(chi2, 4) AS chi2, n AS n_samples, round(sn, 6) AS sn, CASE WHEN n < 2950 THEN true END AS too_few, n_valid, round(md, 6) AS median_sn, round(mx, 6) AS max_sn
    FROM g JOIN b USING (bin_id), w"""


def q_spaxel_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure and coverage by spaxel, checks of each spectrum, bad fraction of its channels, inside a radius and outside masked ranges."""
    spec = V.spec(spark, sf_dir).withColumns({"good_wave": F.col("chan") % 5 != 0, "exposure": F.when(F.col("good"), F.col("var") * 100).otherwise(0.0), "good_spaxel": F.col("spaxel") % 4 != 0})
    ranges = spark.createDataFrame([(4900.0, 4950.0), (5200.0, 5210.0)], "lo double, hi double")
    left = L.apply_range_masks(spec, ranges, (4820.0, 5400.0)).where(L.positive_finite("flux")).groupBy("spaxel").agg(F.count("*").alias("n_left"))
    bad = R.with_bad_fraction(spec).groupBy("spaxel").agg(r6(F.sum("bad_fraction"), 5).alias("bad"))
    broken = {"unc": F.when((F.col("spaxel") % 17 != 3) | (F.col("chan") % 10 != 1), F.col("unc")).otherwise(0.0), "wave": F.when((F.col("spaxel") % 19 == 5) & (F.col("chan") == 30), 4800.0).otherwise(F.col("wave"))}
    valid = L.validate_spectrum(spec.withColumns(broken), ("spaxel",), 60).select("spaxel", "n_good", "n_invalid", "n_not_rising", "valid")
    rows = A.exposure_map(spec, ("spaxel",)).join(left, "spaxel", "left").join(bad, "spaxel").join(valid, "spaxel")
    return rows.select("spaxel", r6("exposure").alias("exposure"), r6("coverage_fraction").alias("coverage_fraction"), "n_left", "bad", "n_good", "n_invalid", "n_not_rising", "valid", L.aperture_clip_radius(F.col("spaxel") % 50 - 25, F.col("spaxel") % 7, 20.0).alias("inside"))


SPAXEL_MAPS = f"""WITH {SPEC}, a AS (SELECT *, CASE WHEN good THEN var * 100 ELSE 0 END AS e FROM spec), c AS (SELECT chan, 1 - avg(CASE WHEN good THEN 1.0 ELSE 0 END) FILTER (spaxel % 4 <> 0) AS bad FROM spec GROUP BY 1),
    s AS (SELECT spaxel, median(e) FILTER (chan % 5 <> 0) AS exposure, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END) FILTER (chan % 5 <> 0) AS cf, count(*) FILTER (good) AS n_good, sum(bad) AS bad,
        count(*) FILTER (good AND spaxel % 17 = 3 AND chan % 10 = 1) AS n_invalid, max(CASE WHEN spaxel % 19 = 5 THEN 1 ELSE 0 END) AS n_not_rising, count(*) FILTER (wave BETWEEN 4820 AND 5400 AND NOT wave BETWEEN 4900 AND 4950 AND NOT wave BETWEEN 5200 AND 5210 AND flux > 0) AS n_left FROM a JOIN c USING (chan) GROUP BY 1)
    SELECT spaxel, round(exposure, 6) AS exposure, round(cf, 6) AS coverage_fraction, nullif(n_left, 0) AS n_left, round(bad, 5) AS bad, n_good, n_invalid, n_not_rising, n_good >= 60 AND n_invalid = 0 AND n_not_rising = 0 AS valid, sqrt((spaxel % 50 - 25) ** 2 + (spaxel % 7) ** 2) <= 20 AS inside FROM s"""


def q_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightest pixels, worst bins, examples, pixels nearest to the centre, and numbered ids, in one table."""
    img = V.image(spark, sf_dir)
    kind = lambda name, d, key, value: d.select(F.lit(name).alias("what"), key.cast("string").alias("key"), r6(value.cast("double")).alias("value"))
    y_x = F.concat_ws(",", "y", "x")
    bright = kind("brightest", S.brightest(img, ("bin_id",)), F.concat_ws(",", "bin_id", "y", "x"), F.col("value"))
    bins = img.groupBy("bin_id").agg(F.avg("value").alias("legacy"), F.count("*").alias("n_good"), F.avg("value").alias("sn")).withColumns({"target_id": F.lit("demo"), "odd": F.col("bin_id") % 2 == 1})
    worst = kind("worst", S.worst_bins(bins, 5), F.col("bin_id"), F.col("legacy"))
    shown = S.example_bins(bins, "odd", 4, ("target_id",)).select(F.inline("examples"))
    examples = kind("example", shown, F.col("bin_id"), F.col("sn"))
    centre = kind("centre", S.nearest_zero_pixel(img.withColumns({"x_arcsec": (F.col("x") - 20.3) * 0.3, "y_arcsec": (F.col("y") - 1.2) * 0.3}), ("target_id",)), y_x, F.col("r"))
    ids = kind("id", S.contiguous_ids(img.where("bin_id % 3 = 1"), ("target_id",)), F.col("bin_id"), F.col("new_id"))
    middle = kind("centroid", A.weighted_centroid(img, ("bin_id",), 0.5), F.col("bin_id"), F.col("y") + F.col("x") / 1000)
    return bright.union(worst).union(examples).union(centre).union(ids).union(middle)


PICKS = f"""WITH {IMG}, b AS (SELECT bin_id, avg(value) AS legacy FROM img GROUP BY 1), lim AS (SELECT bin_id, quantile_cont(value, 0.5) AS lim, count(*) AS n FROM img WHERE value > 0 GROUP BY 1)
    SELECT 'brightest' AS what, concat_ws(',', bin_id, y, x) AS key, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY value DESC, y, x) AS n FROM img WHERE value > 0) WHERE n = 1
    UNION ALL (SELECT 'worst', bin_id::VARCHAR, round(legacy, 6) FROM b ORDER BY legacy, bin_id LIMIT 5) UNION ALL (SELECT 'example', bin_id::VARCHAR, round(legacy, 6) FROM b WHERE bin_id % 2 = 1 ORDER BY bin_id LIMIT 4)
    UNION ALL (SELECT 'centre', concat_ws(',', y, x), round(sqrt(((x - 20.3::DOUBLE) * 0.3::DOUBLE) ** 2 + ((y - 1.2::DOUBLE) * 0.3::DOUBLE) ** 2), 6) FROM img ORDER BY sqrt(((x - 20.3::DOUBLE) * 0.3::DOUBLE) ** 2 + ((y - 1.2::DOUBLE) * 0.3::DOUBLE) ** 2), y, x LIMIT 1)
    UNION ALL SELECT 'id', bin_id::VARCHAR, (row_number() OVER (ORDER BY bin_id) - 1)::DOUBLE FROM (SELECT DISTINCT bin_id FROM img WHERE bin_id % 3 = 1)
    UNION ALL SELECT 'centroid', bin_id::VARCHAR, round(sum(value * y) / sum(value) + sum(value * x) / sum(value) / 1000, 6) FROM img JOIN lim USING (bin_id) WHERE value > 0 AND value >= lim AND n >= 3 GROUP BY 2"""


def q_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions, differences and intersections of runs' products, keys of headers, first places of flags, and their meanings."""
    o, li = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    every, present = o.select(F.col("o_orderkey").alias("run_id")), li.where("l_linenumber = 3").select(F.col("l_orderkey").alias("run_id"))
    arms = S.union_arms(li.where("l_returnflag = 'A'").select("l_orderkey"), li.where("l_returnflag = 'N'").select("l_orderkey")).groupBy("component").agg(F.count("*").alias("n"))
    count = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    heads = V.headers(spark, sf_dir)
    names = F.element_at(F.array(*[F.lit(k) for k in list(Q.FLAGS)[:5]]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    flags = S.distinct_flags(li.select(F.col("l_suppkey").alias("run_id"), F.lit("t").alias("target_id"), names.alias("flag"), F.col("l_orderkey").alias("seq"), F.col("l_linestatus").alias("detail")))
    told = Q.describe_flags(flags).where("length(description) > 55")
    messages = S.top_messages(li.select((F.col("l_returnflag") != "N").cast("int").alias("status"), F.col("l_shipdate").cast("date").cast("string").alias("message")), 3)
    return (
        arms.select(F.concat(F.lit("arm "), F.col("component")).alias("what"), "n").union(count("difference", S.difference(every, present))).union(count("pending", S.pending(every, present, ("run_id",))))
        .union(count("both", S.intersect_masks(every, present.distinct(), ("run_id",)))).union(count("keys", S.header_key_union(heads.where("key = 'GRATING' and file_id % 3 = 0").select(F.col("value").alias("key")), heads.where("key in ('GRATING', 'CTYPE') and file_id % 50 = 1").select(F.col("value").alias("key"))))).union(count("flags", flags)).union(count("described", told))
        .union(flags.agg(F.sum("seq")).select(F.lit("first places"), F.col("sum(seq)"))).union(messages.select(F.concat(F.lit("message "), F.col("message")), "n"))
    )


#: Places of the flags whose meaning takes more than a few words.
LONG_FLAGS = ", ".join(str(k) for k, text in enumerate(list(Q.FLAGS.values())[:5]) if len(text) > 55)
SETS = f"""WITH d AS (SELECT DISTINCT o_orderkey FROM orders), p AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 3), f AS (SELECT l_suppkey, l_linenumber % 5 AS k, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2)
    SELECT 'arm 0' AS what, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'arm 1', count(*) FROM lineitem WHERE l_returnflag = 'N'
    UNION ALL SELECT 'difference', count(*) FROM d ANTI JOIN p ON o_orderkey = l_orderkey UNION ALL SELECT 'pending', count(*) FROM orders ANTI JOIN p ON o_orderkey = l_orderkey UNION ALL SELECT 'both', count(*) FROM orders SEMI JOIN p ON o_orderkey = l_orderkey
    UNION ALL SELECT 'keys', count(*) FROM (SELECT p_brand FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_brand FROM part WHERE p_partkey % 50 = 1 UNION SELECT p_type FROM part WHERE p_partkey % 50 = 1) UNION ALL SELECT 'flags', count(*) FROM f UNION ALL SELECT 'described', count(*) FROM f WHERE k IN ({LONG_FLAGS}) UNION ALL SELECT 'first places', sum(seq)::BIGINT FROM f
    UNION ALL (SELECT 'message ' || l_shipdate::DATE::VARCHAR, count(*) FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_shipdate::DATE ORDER BY count(*) DESC, l_shipdate::DATE LIMIT 3)"""


def q_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's header against its neighbour's: calibration rules, the spectral axis, where its settings come from, which product holds its widths."""
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("GRATING"), F.substring("p_type", 1, 3).alias("CAMERA"), F.col("p_size").cast("string").alias("BINNING"), F.lit("ifu").alias("IFUNAM"), F.col("p_retailprice").cast("string").alias("CWAVE"))
    a = p.select("id", *[F.col(c).alias(f"s_{c}") for c in p.columns[1:]])
    b = p.select((F.col("id") + 1).alias("id"), *[F.col(c).alias(f"a_{c}") for c in p.columns[1:]])
    broken = J.match_calibration(a.join(b, "id").withColumn("want", F.col("s_GRATING")), "want", 0.05).select("id", "violation")
    cards = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in {"NAXIS": F.lit("3"), "CTYPE1": F.lit("RA---TAN"), "CTYPE2": F.when(F.col("id") % 3 == 0, "AWAV-LOG").otherwise("DEC--TAN"), "CTYPE3": F.when(F.col("id") % 3 == 1, "WAVE"), "CD3_3": F.lit("0.5")}.items()])
    axes = X.spectral_axis(p.select("id", F.inline(cards)), keys=("id",))
    from_ = p.select("id", G2.resolve_provenance(F.when(F.col("id") % 2 == 0, F.lit("given")), F.lit("recorded")).alias("upstream"))
    products = p.select(F.col("id").alias("run_id"), F.explode(F.when(F.col("id") % 4 == 0, F.array(F.lit("arc_lsf_red.dat"), F.lit("lsf_red.parquet"))).when(F.col("id") % 4 == 1, F.array(F.lit("my_lsf_model_red.dat"))).otherwise(F.array(F.lit("x_lsf_red_1"), F.lit("x_lsf_red_2")))).alias("name")).withColumn("path", F.col("name"))
    widths = G2.latest_product(products, "red", ("lsf_red.parquet",)).select(F.col("run_id").alias("id"), F.col("name").alias("product"))
    return p.select("id").join(broken, "id", "left").join(axes, "id").join(from_, "id").join(widths, "id", "left")


CALIBRATIONS = """WITH p AS (SELECT p_partkey AS id, p_brand AS g, upper(trim(left(p_type, 3))) AS c, p_size AS b, p_retailprice AS w FROM part)
    SELECT s.id, CASE WHEN a.id IS NULL THEN NULL WHEN s.c <> a.c THEN 'camera' WHEN a.g <> s.g THEN 'arc grating' WHEN s.b <> a.b THEN 'binning' WHEN abs(s.w - a.w) > 0.05 THEN 'central wavelength' END AS violation,
        CASE s.id % 3 WHEN 0 THEN 2 ELSE 3 END AS axis, CASE s.id % 3 WHEN 0 THEN 1 ELSE 0 END AS place, CASE WHEN s.id % 2 = 0 THEN 'given' ELSE 'recorded' END AS upstream,
        CASE s.id % 4 WHEN 0 THEN 'lsf_red.parquet' WHEN 1 THEN 'my_lsf_model_red.dat' END AS product FROM p s LEFT JOIN p a ON a.id = s.id - 1"""


def q_arm_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wavelengths that two arms share, by bin."""
    spec = V.spec(spark, sf_dir)
    got = J.common_wave_interval(spec.where("wave < 5200"), spec.withColumn("wave", F.col("wave") + 3.0 * F.col("bin_id")).where("wave > 5100"), 60.0, 200, ("bin_id",))
    return got.select("bin_id", r6("lo").alias("lo"), r6("hi").alias("hi"), "n_a", "n_b", "reason", "used")


ARM_OVERLAP = f"""WITH {SPEC}, a AS (SELECT * FROM spec WHERE good AND wave < 5200), b AS (SELECT bin_id, wave + 3.0 * bin_id AS wave FROM spec WHERE good AND wave + 3.0 * bin_id > 5100),
    s AS (SELECT bin_id, greatest(la, lb) AS lo, least(ha, hb) AS hi FROM (SELECT bin_id, min(wave) AS la, max(wave) AS ha FROM a GROUP BY 1) JOIN (SELECT bin_id, min(wave) AS lb, max(wave) AS hb FROM b GROUP BY 1) USING (bin_id)),
    n AS (SELECT s.*, (SELECT count(*) FROM a WHERE a.bin_id = s.bin_id AND wave BETWEEN lo AND hi) AS n_a, (SELECT count(*) FROM b WHERE b.bin_id = s.bin_id AND wave BETWEEN lo AND hi) AS n_b FROM s),
    r AS (SELECT *, CASE WHEN hi - lo < 60 THEN 'overlap too narrow' WHEN least(n_a, n_b) < 200 THEN 'too few channels' ELSE 'common interval' END AS reason FROM n)
    SELECT bin_id, round(lo, 6) AS lo, round(hi, 6) AS hi, n_a, n_b, reason, reason = 'common interval' AS used FROM r"""


def q_designed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored cells against basins, reweighted by the other arm, with finer fractions and differences, by bin."""
    states = V.surfaces(spark, sf_dir).withColumns({"va": F.col("ia") * 10.0, "vb": F.col("ib") * 5.0})
    key = ("bin_id",)
    wanted = states.select("bin_id").distinct().select("bin_id", F.lit(31.0).alias("wa"), F.lit(22.0).alias("wb"))
    anchor = D.anchor_cell(states, wanted, key)
    weighted = D.basin_weights(V.surfaces(spark, sf_dir), key)
    apart = D.selected_vs_global(anchor, weighted, key).select("bin_id", r6("to_global").alias("to_global"))
    fine = D.fine_fractions(anchor.select("bin_id", (F.col("jf") / 10.0).alias("f")), 0.1, 0.05).groupBy("bin_id").agg(F.count("*").alias("n_fine"), r6(F.max("f")).alias("top"))
    edge = D.on_fraction_edge(anchor.select("bin_id", F.col("jf").alias("f")), states.select("bin_id", F.col("jf").alias("f")).distinct(), key).select("bin_id", F.lit(True).alias("on_edge"))
    other = second_surface(spark, sf_dir)
    cell = F.concat_ws(",", "ia", "ib", "jf")
    evaluated = P.likelihood_weights(V.surfaces(spark, sf_dir), key).select("bin_id", cell.alias("cell"), F.col("p").alias("weight"))
    again = D.reweight(evaluated, other.withColumn("cell", cell), key).groupBy("bin_id").agg(r6(F.max("p"), 8).alias("top_weight"), F.count("*").alias("n_cells"))
    off = D.difference_of(S.best_state(V.surfaces(spark, sf_dir), key), S.best_state(other, key), ("ia", "ib", "jf"), key)
    parts = (fine, edge, again, off)
    return D.final_table(anchor.select("bin_id", "ia", "ib", "jf").join(apart, "bin_id"), *parts, keys=key)


DESIGNED = f"""WITH {GRID}, {SURFACE2}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY (ia * 10.0 - 31) ** 2 + (ib * 5.0 - 22) ** 2, ia, ib, chi2, jf) AS n FROM grid) WHERE n = 1),
    l AS (SELECT bin_id, min(chi2) AS least, min(jf) AS j0, max(jf) AS j1 FROM grid GROUP BY 1),
    fi AS (SELECT bin_id, count(*) AS n_fine, round(max(f), 6) AS top FROM (SELECT bin_id, round(jf / 10.0::DOUBLE + k * 0.05::DOUBLE, 12) AS f FROM a, range(-2, 3) r(k)) WHERE f > 0 AND f < 1 GROUP BY 1),
    w1 AS (SELECT *, exp(-0.5 * (chi2 - min(chi2) OVER (PARTITION BY bin_id))) AS w FROM grid), w2 AS (SELECT *, exp(-0.5 * (chi2 - min(chi2) OVER (PARTITION BY bin_id))) AS w FROM grid2),
    rw AS (SELECT bin_id, round(max(w1.w * w2.w) / sum(w1.w * w2.w), 8) AS top_weight, count(*) AS n_cells FROM w1 JOIN w2 USING (bin_id, ia, ib, jf) GROUP BY 1),
    b1 AS (SELECT bin_id, arg_min((ia, ib, jf), (chi2, ia, ib, jf)) AS s FROM grid GROUP BY 1), b2 AS (SELECT bin_id, arg_min((ia, ib, jf), (chi2, ia, ib, jf)) AS s FROM grid2 GROUP BY 1)
    SELECT bin_id, a.ia, a.ib, a.jf, round(a.chi2 - least, 6) AS to_global, n_fine, top, CASE WHEN a.jf <= j0 OR a.jf >= j1 THEN true END AS on_edge, top_weight, n_cells, b1.s[1] - b2.s[1] AS d_ia, b1.s[2] - b2.s[2] AS d_ib, b1.s[3] - b2.s[3] AS d_jf
    FROM a JOIN l USING (bin_id) LEFT JOIN fi USING (bin_id) JOIN rw USING (bin_id) JOIN b1 USING (bin_id) JOIN b2 USING (bin_id)"""


def q_components_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer radii, sides of disks, velocities of bins against their centroids, and shifts under other settings, by nation."""
    img = V.image(spark, sf_dir).withColumn("target_id", F.col("bin_id").cast("string"))
    peaks = img.select("target_id", (F.col("x") - 25.0).alias("r"), (F.col("value") / 2000).alias("significance"))
    outer = D.outer_radius(peaks, 1.5, 0.7).select("target_id", r6("r").alias("r"), r6("r_out").alias("r_out"))
    fits = img.select("target_id", F.concat_ws(",", "y", "x").alias("bin_id"), (F.col("x") - 24.5).alias("s"), F.col("value").alias("v"))
    labels = D.label_components(fits).groupBy("target_id").agg(F.count_if(F.col("label") == "disk").alias("n_disk"), F.count_if(F.col("label") == "counter").alias("n_counter"))
    v = F.sin(F.col("x") / 9.0) * 100.0 + F.col("y")
    mean = D.centroid_vs_integrated(img.withColumn("weight", F.lit(1.0)), v, ("target_id",)).select("target_id", r6("mean").alias("mean"), r6("difference").alias("difference"))
    variants = img.select("target_id", F.lit("q").alias("quantity"), F.element_at(F.array(F.lit("base"), F.lit("wide"), F.lit("narrow")), (F.col("x") % 3 + 1).cast("int")).alias("variant"), "value")
    variants = variants.groupBy("target_id", "quantity", "variant").agg(F.max("value").alias("value"))
    shifts = D.robustness_summary(variants, ("wide", "narrow"), "base").select("target_id", r6("shift_wide").alias("shift_wide"), r6("shift_narrow").alias("shift_narrow"))
    return outer.join(labels, "target_id").join(mean, "target_id").join(shifts, "target_id")


COMPONENTS_LABELS = f"""WITH {IMG}, i AS (SELECT *, bin_id::VARCHAR AS target_id, concat_ws(',', y, x) AS b FROM img),
    o AS (SELECT target_id, max(abs(x - 25.0)) FILTER (value / 2000 >= 2)::DOUBLE AS r FROM i GROUP BY 1), f AS (SELECT target_id, sign(first(value ORDER BY abs(x - 24.5) DESC, b)) * sign(first(x - 24.5 ORDER BY abs(x - 24.5) DESC, b)) AS s FROM i GROUP BY 1),
    l AS (SELECT target_id, count(*) FILTER (sign(value) * sign(x - 24.5) * s > 0) AS n_disk, count(*) FILTER (sign(value) * sign(x - 24.5) * s < 0) AS n_counter FROM i JOIN f USING (target_id) GROUP BY 1),
    m AS (SELECT target_id, avg(sin(x / 9.0::DOUBLE) * 100 + y) AS mean, sin(avg(x) / 9.0::DOUBLE) * 100 + avg(y) AS c FROM i GROUP BY 1),
    v AS (SELECT target_id, max(value) FILTER (x % 3 = 0) AS b, max(value) FILTER (x % 3 = 1) AS w, max(value) FILTER (x % 3 = 2) AS n FROM i GROUP BY 1)
    SELECT target_id, round(r, 6) AS r, round(1.5::DOUBLE + 0.7::DOUBLE * greatest(0, round_even((r - 1.5::DOUBLE) / 0.7::DOUBLE, 0)), 6) AS r_out, n_disk, n_counter, round(mean, 6) AS mean, round(mean - c, 6) AS difference, round(w - b, 6) AS shift_wide, round(n - b, 6) AS shift_narrow
    FROM o JOIN l USING (target_id) JOIN m USING (target_id) JOIN v USING (target_id)"""


def q_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared samples, bin spectra, membership, line fits and a manifest written to the shared folder and read again."""
    where = f"{shared_dir(spark)}/skyloom/trip-{uuid.uuid4().hex}"
    spec = V.spec(spark, sf_dir).withColumns({"y": F.floor(F.col("spaxel") / 50).cast("int"), "x": (F.col("spaxel") % 50).cast("int"), "mask": ~F.col("good"), "flags": F.lit(0), "exposure": F.lit(1.0), "good_spaxel": F.col("spaxel") % 4 != 0})
    R.write_prepared(spec, f"{where}/prepared")
    back = R.read_prepared(spark, f"{where}/prepared", "BL")
    sums = back.groupBy(F.lit("prepared").alias("what")).agg(F.count("*").alias("n"), r6(F.sum("flux") + F.sum("bad_fraction"), 3).alias("total"))
    R.write_table(spec.select("target_id", "arm", "bin_id", "spaxel", "chan", "flux", "unc", "good"), f"{where}/spectra", ("target_id", "arm"))
    spectra = R.read_bin_spectra(spark, f"{where}/spectra", "BL", 10).groupBy(F.lit("spectra").alias("what")).agg(F.count("*").alias("n"), r6(F.sum("unc"), 3).alias("total"))
    pixels = spec.select("target_id", "y", "x").distinct()
    lost = R.misplaced_coordinates(pixels.where("x % 10 <> 3"), pixels).agg(F.lit("misplaced").alias("what"), F.count("*").alias("n"), F.lit(0.0).alias("total"))
    kinds = R.profile_tables({"pixels": pixels})
    profile = spark.createDataFrame([(f"{t}.{c} {k}", n, 0.0) for t, c, k, n in kinds], "what string, n long, total double")
    model = spark.createDataFrame([("t", "a", [0.001, 1.0], 4000.0, 5000.0)], "target_id string, arm string, coeffs array<double>, support_min double, support_max double")
    widths = R.line_width_table(model, 101).groupBy(F.lit("widths").alias("what")).agg(F.count("*").alias("n"), r6(F.sum("fwhm"), 3).alias("total"))
    R.write_lines(spec.where("chan = 7").select("bin_id", "spaxel", "flux"), f"{where}/lines")
    lines = spark.read.option("header", True).schema("bin_id int, spaxel long, flux double").csv(f"{where}/lines").groupBy(F.lit("lines").alias("what")).agg(F.count("*").alias("n"), r6(F.sum("flux"), 3).alias("total"))
    G2.write_manifest(pixels.select("target_id", F.concat_ws(",", "y", "x").alias("run_id"), "x"), f"{where}/manifest")
    told = G2.read_manifest(spark.read.parquet(f"{where}/manifest"), "x int").groupBy(F.lit("manifest").alias("what")).agg(F.count("*").alias("n"), F.sum("x").cast("double").alias("total"))
    template = spec.where("chan < 20").select(F.col("spaxel").alias("template_id"), F.col("chan").alias("pix"), "wave", F.col("flux").alias("value"), F.when(F.col("chan") > 3, 2.0 + F.col("chan") * 0.0).alias("fwhm"))
    template.write.parquet(f"{where}/templates")
    again = R.read_templates(spark, f"{where}/templates").groupBy(F.lit("templates").alias("what")).agg(F.count("*").alias("n"), r6(F.sum("fwhm"), 3).alias("total"))
    keys = ("bin_id", "spaxel", "chan")
    part = lambda c: spec.select(*keys, F.col(c).cast("double").alias("value"))
    whole = R.assemble_extensions(part("flux"), part("unc"), mask=part("mask").where("chan % 2 = 0"), keys=keys).groupBy(F.lit("extensions").alias("what")).agg(F.count_if("mask").alias("n"), r6(F.sum("var"), 3).alias("total"))
    arc = R.arc_pixels(part("flux"), part("wave"), part("chan"), part("x"), keys).groupBy(F.lit("arc").alias("what")).agg(F.count("*").alias("n"), r6(F.sum(F.col("value") + F.col("pos") + F.col("slice_id")), 3).alias("total"))
    return sums.union(spectra).union(lost).union(profile).union(widths).union(lines).union(told).union(again).union(whole).union(arc)


ROUND_TRIP = f"""WITH {SPEC}, c AS (SELECT chan, 1 - avg(CASE WHEN good THEN 1.0 ELSE 0 END) FILTER (spaxel % 4 <> 0) AS bad FROM spec GROUP BY 1), p AS (SELECT DISTINCT spaxel // 50 AS y, spaxel % 50 AS x FROM spec)
    SELECT 'prepared' AS what, count(*) AS n, round(sum(flux) + sum(bad), 3) AS total FROM spec JOIN c USING (chan) UNION ALL SELECT 'spectra', count(*), round(sum(sqrt(var)), 3) FROM spec UNION ALL SELECT 'misplaced', count(*), 0 FROM p WHERE x % 10 = 3
    UNION ALL SELECT 'pixels.' || c, count(*), 0 FROM p, (VALUES ('target_id string'), ('y int'), ('x int')) v(c) GROUP BY 1 UNION ALL SELECT 'widths', 101, 101 * 5.5 UNION ALL SELECT 'lines', count(*), round(sum(flux), 3) FROM spec WHERE chan = 7
    UNION ALL SELECT 'manifest', count(*), sum(x)::DOUBLE FROM p UNION ALL SELECT 'templates', count(*), 2.0 * count(*) FROM spec WHERE chan < 20
    UNION ALL SELECT 'extensions', count(*) FILTER (NOT good AND chan % 2 = 0), round(sum(var), 3) FROM spec UNION ALL SELECT 'arc', count(*), round(sum(flux + spaxel % 50 + chan), 3) FROM spec"""


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_bins_table": BINS_TABLE, "q_spaxel_maps": SPAXEL_MAPS, "q_picks": PICKS, "q_sets": SETS, "q_calibrations": CALIBRATIONS, "q_arm_overlap": ARM_OVERLAP, "q_designed": DESIGNED, "q_components_labels": COMPONENTS_LABELS,
    "q_round_trip": ROUND_TRIP,
}
