"""The registered queries over axes, skies, disks, arcs, templates and noise, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import scalar as X
from skyloom.operators import aggregates as A
from skyloom.operators import joins as J
from skyloom.operators import lines as L
from skyloom.operators import windows as W
from skyloom.plans.stage1 import FILLED_CTE, FIR_WINDOW, RESID_CTE
from skyloom.plans.stage2 import IMG, SPEC
from skyloom.sources import views as V
from skyloom.sources.views import r6


def q_wave_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media, widths, supports and windows at a wavelength for each part."""
    t = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (3000.0 + F.col("p_partkey") % 6000 + F.col("p_retailprice") / 1000).alias("w"), (F.col("p_retailprice") / 500).alias("d"))
    low, high = X.unconstrained_edges("w", F.col("w") + 500, 4000.0, 8000.0)
    axis = X.wave_axis("w", 1.0, 1.25, F.col("id") % 7 + 2)
    return t.select(
        "id", r6(X.vac_to_air("w")).alias("air"), r6(X.air_to_vac(X.vac_to_air("w")), 5).alias("back"), r6(X.convert_medium("w", "vacuum", "air") - X.vac_to_air("w")).alias("same"),
        r6(X.fwhm_to_sigma("d")).alias("sigma"), r6(X.sigma_to_fwhm("d")).alias("fwhm"), r6(X.quadrature_diff("d", 1.5)).alias("quad"), X.quadrature_violation("d", 1.5).alias("coarser"),
        r6(X.poly_eval(F.array(F.lit(1e-7), F.lit(-0.001), F.lit(3.0)), "w")).alias("poly"), r6(X.support_filter("w", "d", 4000.0, 8000.0)).alias("supported"), r6(low).alias("below"), r6(high).alias("above"),
        r6(X.width_in_template_frame("w", 0.04, lambda w: 1.2 + w * 1e-4, "vacuum", "vacuum")).alias("rest_width"), r6(F.element_at(axis, -1)).alias("last_wave"), F.size(axis).alias("n_wave"),
        X.safe_fir_window(F.col("id") % 60, 31, 2).alias("fir_window"), r6(X.velocity_support("d", 300.0, 60.0)).alias("velocity"), r6(X.to_angstrom("d", F.lit("nm"))).alias("angstrom"),
        X.psf_choice(F.when(F.col("id") % 3 == 0, F.col("d")), F.when(F.col("id") % 2 == 0, F.lit(0.9)))["source"].alias("psf_source"),
    )


WAVE_AXES = """WITH t AS (SELECT p_partkey AS id, 3000.0::DOUBLE + p_partkey % 6000 + p_retailprice::DOUBLE / 1000 AS w, p_retailprice::DOUBLE / 500 AS d FROM part), n AS (SELECT *, (1e4::DOUBLE / w) ** 2 AS s2 FROM t),
    f AS (SELECT *, 1 + 8.34254e-5::DOUBLE + 2.406147e-2::DOUBLE / (130 - s2) + 1.5998e-4::DOUBLE / (38.9::DOUBLE - s2) AS n, least(31, id % 60 - 1)::INT AS fw FROM n),
    g AS (SELECT *, greatest(fw - (1 - fw % 2), 5) AS fir FROM f)
    SELECT id, round(w / n, 6) AS air, round(w, 5) AS back, 0.0::DOUBLE AS same, round(d / sqrt(8 * ln(2)), 6) AS sigma, round(d * sqrt(8 * ln(2)), 6) AS fwhm, CASE WHEN d >= 1.5 THEN round(sqrt(d * d - 2.25::DOUBLE), 6) END AS quad,
        d * d - 2.25 < -1e-6 * greatest(d * d, 2.25) AS coarser, round((1e-7::DOUBLE * w - 0.001::DOUBLE) * w + 3, 6) AS poly, CASE WHEN w BETWEEN 4000 AND 8000 THEN round(d, 6) END AS supported, round(greatest(0, 4000 - w), 6) AS below,
        round(greatest(0, w + 500 - 8000), 6) AS above, round((1.2::DOUBLE + w * 1.04::DOUBLE * 1e-4::DOUBLE) / 1.04::DOUBLE, 6) AS rest_width, round(w + (id % 7 + 1) * 1.25::DOUBLE, 6) AS last_wave, id % 7 + 2 AS n_wave,
        CASE WHEN fir < id % 60 THEN fir END AS fir_window, round(d + 1200 + 240, 6) AS velocity, round(d * 10, 6) AS angstrom,
        CASE WHEN id % 3 = 0 AND d > 0 THEN 'configuration' WHEN id % 2 = 0 THEN 'header' ELSE 'unavailable' END AS psf_source FROM g"""


def q_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four centre estimates a target: offsets, separations, pixels and back, brightness units."""
    c = V.table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 4).cast("long").alias("target_id"), (F.col("c_custkey") % 4).alias("id"), (150.0 + F.col("c_custkey") % 13 * 0.0013).alias("ra"), (2.0 + F.col("c_custkey") % 11 * 0.0017).alias("dec"),
    )
    wcs = {k: F.lit(v) for k, v in {"crval1": 150.0, "crval2": 2.0, "crpix1": 20.5, "crpix2": 30.5, "cd11": -0.0003, "cd12": 0.00001, "cd21": 0.00002, "cd22": 0.0004}.items()}
    px, py = X.world_to_pixel("ra", "dec", wcs)
    rows = c.withColumns({"px": px, "py": py})
    ra, dec = X.pixel_to_world("px", "py", wcs)
    dx, dy = X.tangent_offsets("ra", "dec", 150.0, 2.0)
    rows = rows.select("target_id", "id", r6(dx, 4).alias("dx"), r6(dy, 4).alias("dy"), r6(ra, 7).alias("ra_again"), r6(dec, 7).alias("dec_again"), r6(X.pixel_area(wcs["cd11"], wcs["cd21"], wcs["cd12"], wcs["cd22"])).alias("area"),
                       X.surface_brightness_scale(F.when(F.col("id") == 0, "erg/s/cm2/arcsec2").otherwise("erg/s/cm2"), F.lit(0.09)).alias("scale"))
    far = J.pairwise_separation(c, 15.0).select("target_id", r6("separation", 4).alias("separation"), "warn")
    return rows.join(far, "target_id")


SKY = """WITH c AS (SELECT c_custkey // 4 AS target_id, c_custkey % 4 AS id, 150.0::DOUBLE + c_custkey % 13 * 0.0013::DOUBLE AS ra, 2.0::DOUBLE + c_custkey % 11 * 0.0017::DOUBLE AS dec FROM customer),
    t AS (SELECT *, radians(ra - 150) AS a, radians(dec) AS d, radians(2.0::DOUBLE) AS d0 FROM c),
    u AS (SELECT *, cos(d) * cos(a) * cos(d0) + sin(d) * sin(d0) AS x, cos(d) * sin(a) AS y, sin(d) * cos(d0) - cos(d) * cos(a) * sin(d0) AS z FROM t),
    p AS (SELECT a.target_id, max(degrees(2 * asin(sqrt(sin((b.d - a.d) / 2) ** 2 + cos(a.d) * cos(b.d) * sin((b.a - a.a) / 2) ** 2))) * 3600) AS s FROM t a JOIN t b ON a.target_id = b.target_id AND a.id < b.id GROUP BY 1)
    SELECT target_id, id, round(degrees(atan2(y, x)) * 3600, 4) AS dx, round(degrees(atan2(z, sqrt(x * x + y * y))) * 3600, 4) AS dy, round(ra, 7) AS ra_again, round(dec, 7) AS dec_again,
        round(sqrt(0.0003::DOUBLE ** 2 + 0.00002::DOUBLE ** 2) * sqrt(0.00001::DOUBLE ** 2 + 0.0004::DOUBLE ** 2) * 3600 * 3600, 6) AS area, CASE WHEN id = 0 THEN 0.09::DOUBLE ELSE 1.0::DOUBLE END AS scale,
        round(coalesce(s, 0), 4) AS separation, coalesce(s > 15, false) AS warn FROM u LEFT JOIN p USING (target_id)"""


def q_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclination, the signed axis, ring grids and names of media for each part."""
    t = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (0.25 + F.col("p_partkey") % 70 * 0.01).alias("q"), (F.col("p_partkey") % 41 - 20.0).alias("x"), (F.col("p_partkey") % 37 - 18.0).alias("y"))
    ring = X.ring_grid(0.8, 4.0 + F.col("id") % 9, 1.5, 0.7)
    medium = F.element_at(F.array(F.lit(" Vac"), F.lit("AIR "), F.lit("auto")), (F.col("id") % 3 + 1).cast("int"))
    return t.select(
        "id", r6(X.inclination("q", 0.2)).alias("inclination"), r6(X.signed_pa_coordinate("x", "y", 30.0)).alias("along"), F.size(ring["radii"]).alias("n_rings"), r6(F.element_at(ring["radii"], -1)).alias("last_ring"),
        X.normalize_medium(medium).alias("medium"), r6(X.component_statistic("x", "y")).alias("statistic"),
    )


DISK = """WITH t AS (SELECT p_partkey AS id, 0.25::DOUBLE + p_partkey % 70 * 0.01::DOUBLE AS q, p_partkey % 41 - 20.0::DOUBLE AS x, p_partkey % 37 - 18.0::DOUBLE AS y FROM part),
    r AS (SELECT *, greatest(0, round_even((4.0::DOUBLE + id % 9 - 1.2::DOUBLE) / 0.7::DOUBLE, 0)) AS n FROM t)
    SELECT id, round(degrees(acos(sqrt(least(1, greatest(0, (q * q - 0.04::DOUBLE) / 0.96::DOUBLE))))), 6) AS inclination, round(x * cos(radians(30)) + y * sin(radians(30)), 6) AS along, CAST(n + 1 AS INT) AS n_rings,
        round(1.2::DOUBLE + n * 0.7::DOUBLE, 6) AS last_ring, CASE id % 3 WHEN 0 THEN 'vacuum' WHEN 1 THEN 'air' ELSE 'auto' END AS medium, round(x - y, 6) AS statistic FROM r"""


def wcs_row(spark: SparkSession, scale: float, crpix1: float, crpix2: float) -> DataFrame:
    values = ("demo", 150.0, 2.0, crpix1, crpix2, -scale / 3600, 0.0, 0.0, scale / 3600)
    return spark.createDataFrame([values], "target_id string, " + ", ".join(f"{c} double" for c in J.WCS_COLUMNS))


def q_transfer_wcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of one grid carried to another through both sky projections."""
    img = V.image(spark, sf_dir).withColumn("good", F.col("value") > 0)
    a, b = wcs_row(spark, 0.3, 25.0, 12.0), wcs_row(spark, 0.303, 25.37, 11.71)
    got = J.transfer_membership(img.drop("bin_id"), img, a, b, scale=0.3, max_distance=0.12)
    check = J.check_sampling(a, b, 0.015).select("target_id", r6("difference").alias("difference"), "same")
    return got.join(check, "target_id").select("y", "x", "bin_id", r6("match_distance", 5).alias("match_distance"), "difference", "same")


TRANSFER_WCS = f"""WITH {IMG}, p AS (SELECT y, x, (x + 1 - 25.37::DOUBLE) * 0.303::DOUBLE / 0.3::DOUBLE + 24 AS px, (y + 1 - 11.71::DOUBLE) * 0.303::DOUBLE / 0.3::DOUBLE + 11 AS py FROM img WHERE value > 0),
    n AS (SELECT y, x, CAST(round_even(px, 0) AS INT) AS xi, CAST(round_even(py, 0) AS INT) AS yi, 0.3 * sqrt((px - round_even(px, 0)) ** 2 + (py - round_even(py, 0)) ** 2) AS d FROM p)
    SELECT n.y, n.x, img.bin_id, round(d, 5) AS match_distance, round(1.01::DOUBLE ** 2 - 1, 6) AS difference, false AS same FROM n JOIN img ON img.y = yi AND img.x = xi WHERE d <= 0.12"""


def spec_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean spectrum of each label as a template."""
    return V.spec(spark, sf_dir).groupBy(F.col("bin_id").alias("template_id"), F.col("chan").alias("pix"), "wave").agg((5.0 + F.avg("flux")).alias("value"), F.lit(12.0).alias("fwhm"))


FIT_LOW, FIT_HIGH, VELSCALE, PADDING = 5000.0, 5250.0, 600.0, 900.0


def q_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates cropped, smoothed to the data's width, rebinned and normalised."""
    found = L.prepare_templates(spec_templates(spark, sf_dir), FIT_LOW, FIT_HIGH, VELSCALE, PADDING, lambda w: 20.0 + (w - 5000.0) * 0.004, least=10)
    return found.select("template_id", "pix", r6("wave", 5).alias("wave"), r6("value").alias("value"))


TEMPLATES = f"""WITH {SPEC}, k AS (SELECT exp({PADDING}::DOUBLE / 299792.458::DOUBLE) AS pad, {VELSCALE}::DOUBLE / 299792.458::DOUBLE AS st),
    b AS (SELECT {FIT_LOW} / pad AS lo, {FIT_HIGH} * pad AS hi, st FROM k),
    t AS (SELECT bin_id AS template_id, chan AS pix, wave, 5.0 + avg(flux) AS value FROM spec, b WHERE wave BETWEEN lo - 5 AND hi + 5 GROUP BY 1, 2, 3),
    s AS (SELECT *, sqrt((20.0 + (wave - 5000) * 0.004::DOUBLE) ** 2 - 144) / sqrt(8 * ln(2)) AS s FROM t),
    g AS (SELECT a.template_id, a.pix, a.wave, sum(exp(-0.5 * ((o.wave - a.wave) / a.s) ** 2) * o.value) / sum(exp(-0.5 * ((o.wave - a.wave) / a.s) ** 2)) AS value
        FROM s a JOIN s o ON a.template_id = o.template_id AND abs(o.wave - a.wave) <= 4 * a.s GROUP BY ALL),
    o AS (SELECT i AS pix, lo * exp(i * st) AS l, lo * exp((i + 1) * st) AS r, lo * exp((i + 0.5::DOUBLE) * st) AS wave FROM b, range(0, 1000) x(i) WHERE i < floor(ln(hi / lo) / st + 1e-9)),
    m AS (SELECT template_id, o.pix, any_value(o.wave) AS wave, sum((least(r, g.wave + 5) - greatest(l, g.wave - 5)) * value) / sum(least(r, g.wave + 5) - greatest(l, g.wave - 5)) AS value
        FROM g JOIN o ON g.wave + 5 > l AND g.wave - 5 < r GROUP BY 1, 2)
    SELECT template_id, pix, round(wave, 5) AS wave, round(value / avg(value) FILTER (wave BETWEEN {FIT_LOW} AND {FIT_HIGH}) OVER (PARTITION BY template_id), 6) AS value FROM m"""


def q_lag_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of samples a lag apart, the step of each spectrum in velocity, differences along it."""
    spec = V.spec(spark, sf_dir)
    pairs = J.lag_pairs(spec.where("good").withColumn("z", F.col("flux")), 4, ("bin_id",)).groupBy("bin_id", "lag").agg(F.count("*").alias("n"), r6(F.sum(F.col("z0") * F.col("z1")), 4).alias("product"))
    step = X.velocity_scale(spec, ("bin_id", "spaxel")).groupBy("bin_id").agg(r6(F.max("velscale"), 4).alias("velscale"))
    rise = W.consecutive_diff(spec, ("bin_id", "spaxel"), "chan", "flux").groupBy("bin_id").agg(F.count_if(F.col("diff") > 0).alias("n_rising"))
    return pairs.join(step, "bin_id").join(rise, "bin_id")


LAG_PRODUCTS = f"""WITH {SPEC}, p AS (SELECT a.bin_id, lag, count(*) AS n, round(sum(a.flux * b.flux), 4) AS product FROM spec a, range(0, 5) l(lag) JOIN spec b ON b.spaxel = a.spaxel AND b.chan = a.chan + lag WHERE a.good AND b.good GROUP BY 1, 2),
    s AS (SELECT bin_id, spaxel, ln(wave) - lag(ln(wave)) OVER w AS d, flux > lag(flux) OVER w AS up FROM spec WINDOW w AS (PARTITION BY spaxel ORDER BY chan)),
    v AS (SELECT bin_id, spaxel, 299792.458 * median(d) AS v FROM s GROUP BY 1, 2), m AS (SELECT bin_id, round(max(v), 4) AS velscale FROM v GROUP BY 1), r AS (SELECT bin_id, count(*) FILTER (up) AS n_rising FROM s GROUP BY 1)
    SELECT * FROM p JOIN m USING (bin_id) JOIN r USING (bin_id)"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as detector columns of an arc frame: labels are slices, a line every 90 Angstrom."""
    spec = V.spec(spark, sf_dir)
    wave = F.col("wave") + (F.col("spaxel") % 10) * 0.5
    off = wave - 90.0 * F.round(wave / 90.0)
    return spec.select("target_id", "arm", F.col("chan").alias("y"), F.col("spaxel").alias("x"), (F.col("flux") + 60.0 * F.exp(-0.5 * F.pow(off / 13.0, 2))).alias("arc"), wave.alias("wave"), F.col("bin_id").alias("slice_id"), (F.col("spaxel") % 40).cast("double").alias("pos"))


def q_arc_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc spectra by slice and position, binned on the detector's own step."""
    return L.arc_spectra(arcs(spark, sf_dir), 3).select("slice_id", "position_bin", "k", r6("wave").alias("wave"), r6("value").alias("value"), r6("step").alias("step"))


ARC = SPEC + """, w AS (SELECT chan AS y, spaxel AS x, bin_id AS slice_id, CAST(spaxel % 40 AS DOUBLE) AS pos, flux, wave + spaxel % 10 * 0.5::DOUBLE AS wave FROM spec),
    a AS (SELECT *, flux + 60 * exp(-0.5 * ((wave - 90 * round(wave / 90)) / 13) ** 2) AS arc FROM w), l AS (SELECT min(wave) AS lo, max(wave) AS hi FROM a),
    d AS (SELECT abs(wave - lag(wave) OVER (PARTITION BY x ORDER BY y)) AS dy, abs(wave - lag(wave) OVER (PARTITION BY y ORDER BY x)) AS dx FROM a),
    s AS (SELECT greatest(median(dy) FILTER (dy > 0), median(dx) FILTER (dx > 0)) AS step FROM d),
    e AS (SELECT slice_id, list_distinct(quantile_cont(pos, [0.0, 1.0 / 3, 2.0 / 3, 1.0])) AS e FROM a GROUP BY 1),
    p AS (SELECT a.*, step, lo, least(greatest(len(list_filter(e, lambda v: v <= pos)) - 1, 0), greatest(len(e) - 2, 0)) AS position_bin, CAST(floor((wave - lo) / step + 0.5) AS INT) AS k FROM a, l, s, e WHERE a.slice_id = e.slice_id),
    b AS (SELECT slice_id, position_bin, k, median(arc) AS v, count(*) AS n, any_value(lo) AS lo, any_value(step) AS step FROM p GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(n) OVER g AS np, count(*) OVER g AS nb, lead(k) OVER o AS k2, lead(v) OVER o AS v2 FROM b WINDOW g AS (PARTITION BY slice_id, position_bin), o AS (PARTITION BY slice_id, position_bin ORDER BY k)),
    f AS (SELECT *, unnest(range(k, coalesce(k2, k + 1))) AS kk FROM c WHERE np >= 20 AND nb >= 10),
    arc AS (SELECT slice_id, position_bin, CAST(kk AS INT) AS k, lo + kk * step AS wave, coalesce(v + (v2 - v) * (kk - k) / (k2 - k), v) AS value, step FROM f)"""
ARC_BINS = f"WITH {ARC} SELECT slice_id, position_bin, k, round(wave, 6) AS wave, round(value, 6) AS value, round(step, 6) AS step FROM arc"


def q_arc_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of arc lines over wavelength and their scatter, by slice and position. No SQL: peaks are picked in order; q_line_fits checks the fits, tests a frame of known width."""
    fit, lines, scatter = L.arc_widths(arcs(spark, sf_dir), half=4, distance=3, order=1)
    wide = scatter.groupBy("target_id", "arm").pivot("level", ["all", "first", "second", "pair"]).agg(F.first("rms"))
    counts = lines.groupBy("target_id", "arm").agg(F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"), F.percentile("y", F.lit(0.5)).alias("median_fwhm"))
    return fit.select("target_id", "arm", "coeffs", "x_mean", "support_min", "support_max").join(counts, ["target_id", "arm"]).join(wide, ["target_id", "arm"])


def q_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of the faintest spaxels: the scale of their variance and the correlation of neighbouring channels."""
    samples = V.spec(spark, sf_dir).withColumns({"y": F.floor(F.col("spaxel") / 50).cast("int"), "x": (F.col("spaxel") % 50).cast("int")})
    image = A.collapse(samples).withColumn("good", F.lit(True))
    summary, correlation = L.noise_characterization(samples, image, percent=30.0, at_most=1 << 40, window=FIR_WINDOW, clip=3.0, max_lag=5)
    found = summary.join(correlation, ["target_id", "arm"])
    return found.select("lag", r6("correlation").alias("correlation"), "n_rows", r6("variance_scale").alias("variance_scale"), "n_spaxels", "n_samples")


NOISE = f"""WITH {SPEC}, {FILLED_CTE}, {RESID_CTE}, i AS (SELECT spaxel, median(flux) FILTER (good) AS v FROM spec GROUP BY 1), sel AS (SELECT spaxel FROM i WHERE v <= (SELECT quantile_cont(v, 0.3) FROM i)),
    z AS (SELECT zz.* FROM zz SEMI JOIN sel USING (spaxel)), pr AS (SELECT a.spaxel, lag, corr(a.z, b.z) AS r FROM z a, range(0, 6) l(lag) JOIN z b ON b.spaxel = a.spaxel AND b.chan = a.chan + lag GROUP BY 1, 2 HAVING count(*) >= 10),
    m AS (SELECT lag, median(r) AS r, count(*) AS n_rows FROM pr GROUP BY 1), c AS (SELECT median(z) AS mid FROM z), v AS (SELECT (1.4826 * median(abs(z - mid))) ** 2 AS vs, count(DISTINCT spaxel) AS n_spaxels, count(*) AS n_samples FROM z, c)
    SELECT lag, round(r / (SELECT r FROM m WHERE lag = 0), 6) AS correlation, n_rows, round(vs, 6) AS variance_scale, n_spaxels, n_samples FROM m, v"""

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_wave_axes": WAVE_AXES, "q_sky": SKY, "q_disk": DISK, "q_transfer_wcs": TRANSFER_WCS, "q_templates": TEMPLATES, "q_lag_products": LAG_PRODUCTS, "q_arc_bins": ARC_BINS, "q_noise": NOISE,
}
