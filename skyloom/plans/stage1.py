"""The registered queries over images, residuals, rebinning, likelihood grids and headers, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.scalar import fraction_grid, grid_table
from skyloom.operators import aggregates as A
from skyloom.operators import grids as G
from skyloom.operators import images as I
from skyloom.operators import joins as J
from skyloom.operators import sorts as S
from skyloom.operators import windows as W
from skyloom.plans.stage2 import COADD, IMG, LINE, SPEC, spec_coadd
from skyloom.sources import views as V
from skyloom.sources.scratch import materialize
from skyloom.sources.views import r6


def projected(spark: SparkSession, sf_dir: str, ax: float, bx: float, ay: float, by: float) -> DataFrame:
    """The image's pixels with their place in another pixel grid, by an affine toy projection."""
    img = V.image(spark, sf_dir)
    return img.select("target_id", "y", "x", (F.col("x") * ax + bx).alias("px"), (F.col("y") * ay + by).alias("py"), F.lit(True).alias("good"))


def q_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = J.nearest_members(projected(spark, sf_dir, 0.98, 0.3, 1.02, -0.2), V.image(spark, sf_dir).select("target_id", "y", "x", "bin_id"), 0.3, 0.1234)
    whole = J.transfer_fraction(near, 0.1234)
    found = near.where("match_distance <= 0.1234").join(whole, "target_id")
    bins = A.bin_capacity(V.image(spark, sf_dir).withColumn("signal", F.col("value")).withColumn("noise", F.lit(100.0)), ("bin_id",))
    return J.bin_values_on_map(found, bins, ("bin_id",)).select("y", "x", "bin_id", r6("match_distance").alias("match_distance"), r6("fraction").alias("fraction"), "n_inside", r6("sn", 4).alias("sn"))


TRANSFER = f"""WITH {IMG}, n AS (SELECT a.y, a.x, b.bin_id, hypot_ AS d FROM (SELECT y, x, CAST(round_even(1.02 * y - 0.2, 0) AS INT) AS yi, CAST(round_even(0.98 * x + 0.3, 0) AS INT) AS xi,
        0.3 * sqrt((1.02 * y - 0.2 - round_even(1.02 * y - 0.2, 0)) ** 2 + (0.98 * x + 0.3 - round_even(0.98 * x + 0.3, 0)) ** 2) AS hypot_ FROM img) a JOIN img b ON b.y = yi AND b.x = xi),
    f AS (SELECT avg(CASE WHEN d <= 0.1234 THEN 1.0 ELSE 0 END) AS fraction, count(*) AS n_inside FROM n), c AS (SELECT bin_id, sum(value) / sqrt(sum(10000.0)) AS sn FROM img GROUP BY 1)
    SELECT y, x, bin_id, round(d, 6) AS match_distance, round(fraction, 6) AS fraction, n_inside, round(sn, 4) AS sn FROM n JOIN c USING (bin_id), f WHERE d <= 0.1234"""


def q_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.reproject_bilinear(projected(spark, sf_dir, 0.9731, 0.4127, 0.9877, 0.3119), V.image(spark, sf_dir))
    return found.select("y", "x", "overlap", r6("value", 4).alias("value"))


REPROJECT = f"""WITH {IMG}, m AS (SELECT max(y) AS ym, max(x) AS xm FROM img), p AS (SELECT y, x, 0.9731 * x + 0.4127 AS px, 0.9877 * y + 0.3119 AS py FROM img),
    o AS (SELECT p.*, px BETWEEN 0 AND xm AND py BETWEEN 0 AND ym AS overlap FROM p, m),
    c AS (SELECT y, x, CAST(floor(py) AS INT) + dy AS sy, CAST(floor(px) AS INT) + dx AS sx, (CASE WHEN dy = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) * (CASE WHEN dx = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) AS w
        FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dy, dx) WHERE overlap),
    s AS (SELECT c.y, c.x, sum(w * coalesce(i.value, 0)) AS value FROM c LEFT JOIN img i ON i.y = sy AND i.x = sx WHERE w > 0 GROUP BY 1, 2)
    SELECT y, x, overlap, round(value, 4) AS value FROM o LEFT JOIN s USING (y, x)"""


def q_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = V.image(spark, sf_dir).withColumn("value", F.when(F.col("value") > -500, F.col("value")))
    return I.smooth_image(img, 1.0).select("y", "x", r6("smooth", 4).alias("smooth"))


K1 = "k AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS w FROM (SELECT i - 4 AS d FROM range(0, 9) r(i)))"
SMOOTH_CTE = """m AS (SELECT max(y) AS ym, max(x) AS xm FROM img), b0 AS (SELECT y, x, CASE WHEN value > -500 THEN value ELSE 0 END AS num, CASE WHEN value > -500 THEN 1.0 ELSE 0 END AS den FROM img),
    b1 AS (SELECT a.y, a.x, sum(w * b.num) AS num, sum(w * b.den) AS den FROM b0 a, m, k JOIN b0 b ON b.y = least(ym, greatest(0, a.y + d)) AND b.x = a.x GROUP BY 1, 2),
    b2 AS (SELECT a.y, a.x, sum(w * b.num) AS num, sum(w * b.den) AS den FROM b1 a, m, k JOIN b1 b ON b.x = least(xm, greatest(0, a.x + d)) AND b.y = a.y GROUP BY 1, 2)"""
SMOOTH = f"WITH {IMG}, {K1}, {SMOOTH_CTE} SELECT y, x, CASE WHEN den > 1e-12 THEN round(num / den, 4) END AS smooth FROM b2"


def signal_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.image(spark, sf_dir).select("target_id", "arm", "y", "x", F.col("value").alias("signal"), (1000.0 + 10.0 * F.col("bin_id")).alias("noise"), (F.col("value") > -800).alias("good"), (F.col("value") > -800).alias("valid"))


def q_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.smoothed_significance(signal_image(spark, sf_dir), 1.0).select("y", "x", r6("significance").alias("significance"))


SIG_CTE = """v AS (SELECT y, x, value AS s, 1000.0 + 10.0 * bin_id AS n FROM img WHERE value > -800),
    sig AS (SELECT a.y, a.x, sum(ky.w * kx.w * b.s) / sqrt(sum((ky.w * kx.w * b.n) ** 2)) AS significance FROM v a, k ky, k kx JOIN v b ON b.y = a.y - ky.d AND b.x = a.x - kx.d GROUP BY 1, 2)"""
SIGNIFICANCE = f"WITH {IMG}, {K1}, {SIG_CTE} SELECT y, x, round(significance, 6) AS significance FROM sig"


def q_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = materialize(V.image(spark, sf_dir), "image")
    masked = lambda c: I.robust_normalize(img.select("target_id", "y", "x", F.col(c).alias("value"), F.col(c).isNotNull().alias("mask")), ("target_id",)).where("mask")
    found = I.registration_shift(masked("value"), masked("value2"), 4)
    return found.select("ly", "lx", r6("dy", 5).alias("dy"), r6("dx", 5).alias("dx"), r6("correlation").alias("correlation"), "n")


SHIFT = f"""WITH {IMG}, s AS (SELECT median(value) AS ma, median(value2) AS mb FROM img), d AS (SELECT 1.4826 * median(abs(value - ma)) AS sa, 1.4826 * median(abs(value2 - mb)) FILTER (value2 IS NOT NULL) AS sb FROM img, s),
    a AS (SELECT y, x, (value - ma) / sa AS v FROM img, s, d), b AS (SELECT y, x, (value2 - mb) / sb AS v FROM img, s, d WHERE value2 IS NOT NULL),
    l AS (SELECT i - 4 AS ly, j - 4 AS lx FROM range(0, 9) r(i), range(0, 9) q(j)),
    p AS (SELECT ly, lx, sum(a.v * b.v) AS s, count(*) AS n FROM l, b JOIN a ON a.y = b.y + ly AND a.x = b.x + lx GROUP BY 1, 2),
    c AS (SELECT ly, lx, s / n AS c, n FROM p WHERE n > greatest(9, 0.1 * (SELECT n FROM p WHERE ly = 0 AND lx = 0))),
    e AS (SELECT *, lag(c) OVER (PARTITION BY lx ORDER BY ly) AS y0, lead(c) OVER (PARTITION BY lx ORDER BY ly) AS y1, lag(c) OVER (PARTITION BY ly ORDER BY lx) AS x0, lead(c) OVER (PARTITION BY ly ORDER BY lx) AS x1 FROM c)
    SELECT ly, lx, round(ly + CASE WHEN y0 IS NULL OR y1 IS NULL OR y0 - 2 * c + y1 = 0 THEN 0 ELSE greatest(-1.0, least(1.0, 0.5 * (y0 - y1) / (y0 - 2 * c + y1))) END, 5) AS dy, round(lx + CASE WHEN x0 IS NULL OR x1 IS NULL OR x0 - 2 * c + x1 = 0 THEN 0 ELSE greatest(-1.0, least(1.0, 0.5 * (x0 - x1) / (x0 - 2 * c + x1))) END, 5) AS dx,
        round(c, 6) AS correlation, n FROM e ORDER BY c DESC, ly, lx LIMIT 1"""


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.connected_components(V.image(spark, sf_dir).where("value > 5000"), width=50).select("y", "x", "label")


COMPONENTS = f"""WITH RECURSIVE {IMG}, p AS (SELECT y, x, y * 50 + x AS id FROM img WHERE value > 5000),
    e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
    r AS (SELECT id AS src, id FROM p UNION SELECT r.src, e.b FROM r JOIN e ON e.a = r.id)
    SELECT y, x, min(src)::BIGINT AS label FROM r JOIN p USING (id) GROUP BY 1, 2"""


def q_aperture(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = signal_image(spark, sf_dir)
    centers = img.groupBy("target_id", "arm").agg(F.floor(F.max("y") / 2).alias("cy"), F.lit(25).alias("cx"))
    return I.analysis_aperture(img, centers, threshold=18.0, sigma=1.0, grow=2, max_distance=40.0).select("y", "x")


APERTURE = f"""WITH RECURSIVE {IMG}, {K1}, {SIG_CTE}, p AS (SELECT y, x, y * 1048576 + x AS id FROM sig WHERE significance >= 18.0),
    e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.y - b.y) + abs(a.x - b.x) = 1), r AS (SELECT id AS src, id FROM p UNION SELECT r.src, e.b FROM r JOIN e ON e.a = r.id),
    l AS (SELECT y, x, min(src) AS label FROM r JOIN p USING (id) GROUP BY 1, 2), c AS (SELECT floor(max(y) / 2) AS cy, 25 AS cx FROM img),
    b AS (SELECT label FROM l, c GROUP BY label ORDER BY min(sqrt((y - cy) ** 2 + (x - cx) ** 2)), label LIMIT 1)
    SELECT DISTINCT v.y, v.x FROM v JOIN l ON abs(v.y - l.y) + abs(v.x - l.x) <= 2 JOIN b USING (label)"""


def q_adaptive_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of about equal capacity: seeds along a Morton curve, then three rounds of assignment to the nearest generator."""
    pixels = V.image(spark, sf_dir).select("target_id", "y", "x", F.greatest(F.col("value"), F.lit(1.0)).alias("signal"), F.lit(1000.0).alias("noise"))
    found = I.bin_table(I.adaptive_bins(pixels, 15.0))
    return found.select("bin_id", "npix", *[r6(c).alias(c) for c in ("sn", "capacity", "x_mean", "y_mean", "radius")], "single")


def assignment_sql(before: str, after: str) -> str:
    """CTEs of one round: the generators of the bins in `before` (y, x, bin_id), and in `after` each pixel's least d^2 - r^2."""
    d = "pow(x - gx, 2) + pow(y - gy, 2) - r * r"
    return f"""{after}_g AS MATERIALIZED (SELECT bin_id, avg(x) AS gx, avg(y) AS gy, sqrt(count(*) / pi()) * 0.5 AS r FROM {before} GROUP BY 1),
    {after} AS MATERIALIZED (SELECT p.y, p.x, arg_min(bin_id, ({d}, bin_id)) AS bin_id FROM pix p, {after}_g GROUP BY 1, 2)"""


MORTON = " + ".join(f"(((x >> {b}) & 1)::BIGINT << {2 * b}) + (((y >> {b}) & 1)::BIGINT << {2 * b + 1})" for b in range(12))
ADAPTIVE_BINS = f"""WITH {IMG}, pix AS MATERIALIZED (SELECT y, x, greatest(value, 1.0) AS s, 1000.0::DOUBLE AS n FROM img),
    b0 AS MATERIALIZED (SELECT y, x, CAST(floor(sum(pow(s / n, 2)) OVER (ORDER BY {MORTON}) / 225.0 - 1e-9) AS BIGINT) AS bin_id FROM pix),
    {assignment_sql("b0", "b1")}, {assignment_sql("b1", "b2")}, {assignment_sql("b2", "b3")},
    f AS (SELECT b3.y, b3.x, s, n, dense_rank() OVER (ORDER BY bin_id) - 1 AS bin_id FROM b3 JOIN pix USING (y, x)),
    t AS (SELECT bin_id, count(*) AS npix, sum(s) / sqrt(sum(n * n)) AS sn, avg(x) AS xm, avg(y) AS ym FROM f GROUP BY 1)
    SELECT CAST(bin_id AS INT) AS bin_id, npix, round(sn, 6) AS sn, round(greatest(sn, 0) ** 2, 6) AS capacity, round(xm, 6) AS x_mean, round(ym, 6) AS y_mean, round(sqrt(npix / pi()), 6) AS radius, npix = 1 AS single FROM t"""


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = V.spec(spark, sf_dir)
    return J.interp_gaps(spec.withColumn("masked", F.when(F.col("good"), F.col("flux"))), ("target_id", "arm", "spaxel"), "masked")


FILLED_CTE = """g AS (SELECT spaxel, bin_id, chan, flux, sqrt(var) AS unc, good, CASE WHEN good THEN flux END AS m FROM spec),
    h AS (SELECT *, last_value(CASE WHEN good THEN chan END IGNORE NULLS) OVER a AS c0, last_value(m IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN good THEN chan END IGNORE NULLS) OVER z AS c1, first_value(m IGNORE NULLS) OVER z AS v1 FROM g
        WINDOW a AS (PARTITION BY spaxel ORDER BY chan ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY spaxel ORDER BY chan ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    fill AS (SELECT spaxel, bin_id, chan, flux, unc, good, coalesce(m, v0 + (v1 - v0) * (chan - c0) / nullif(c1 - c0, 0), v0, v1) AS filled FROM h)"""


def q_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled, and each bin's channel medians as a curve read between its channels."""
    gaps = filled(spark, sf_dir)
    nodes = gaps.where("chan % 8 = 7").groupBy("bin_id", "chan").agg(A.median("filled").alias("v")).select("bin_id", (F.col("chan") * 1.0).alias("r"), "v")
    points = gaps.select("bin_id", "spaxel", "chan", "filled", (F.col("chan") * 1.0).alias("r"))
    return J.interp_curve(points, nodes, ("bin_id",)).select("spaxel", "chan", r6("filled").alias("filled"), r6("v").alias("v"))


INTERP = f"""WITH {SPEC}, {FILLED_CTE}, n0 AS (SELECT bin_id, chan * 1.0 AS r, median(filled) AS v FROM fill WHERE chan % 8 = 7 GROUP BY 1, 2), n1 AS (SELECT * FROM n0 UNION ALL SELECT DISTINCT bin_id, 0.0, 0.0 FROM n0),
    seg AS (SELECT bin_id, r AS r0, v AS v0, lead(r) OVER w AS r1, lead(v) OVER w AS v1 FROM n1 WINDOW w AS (PARTITION BY bin_id ORDER BY r))
    SELECT spaxel, chan, round(filled, 6) AS filled, round(v0 + coalesce((v1 - v0) * (chan - r0) / (r1 - r0), 0), 6) AS v FROM fill LEFT JOIN seg ON fill.bin_id = seg.bin_id AND chan >= r0 AND (chan < r1 OR (r1 IS NULL AND chan = r0))"""

FIR_WINDOW = 11


def q_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.highpass_residuals(V.spec(spark, sf_dir), FIR_WINDOW, 2, 3.0).select("spaxel", "chan", r6("z").alias("z"))


FIR = "fir(edge, lag, w) AS (VALUES " + ", ".join(f"({k - FIR_WINDOW // 2}, {j - k}, {float(x)!r}::DOUBLE)" for k, row in enumerate(W.fir_coefficients(FIR_WINDOW, 2)) for j, x in enumerate(row)) + ")"
RESID_CTE = f"""{FIR}, q AS (SELECT *, CASE WHEN chan < 5 THEN chan - 5 WHEN chan > 58 THEN chan - 58 ELSE 0 END AS edge FROM fill),
    sm AS (SELECT q.spaxel, q.chan, sum(w * f.filled) AS smooth FROM q JOIN fir USING (edge) JOIN fill f ON f.spaxel = q.spaxel AND f.chan = q.chan + lag GROUP BY 1, 2),
    z0 AS (SELECT spaxel, chan, (flux - smooth) / unc AS z FROM fill JOIN sm USING (spaxel, chan) WHERE good), z1 AS (SELECT spaxel, median(z) AS mid FROM z0 GROUP BY 1),
    z2 AS (SELECT spaxel, any_value(mid) AS mid, 1.4826 * median(abs(z - mid)) AS sc FROM z0 JOIN z1 USING (spaxel) GROUP BY 1), zz AS (SELECT z0.* FROM z0 JOIN z2 USING (spaxel) WHERE sc <= 0 OR abs(z - mid) <= 3.0 * sc)"""
RESIDUALS = f"WITH {SPEC}, {FILLED_CTE}, {RESID_CTE} SELECT spaxel, chan, round(z, 6) AS z FROM zz"


def q_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = W.highpass_residuals(V.spec(spark, sf_dir), FIR_WINDOW, 2, 3.0)
    return A.spectral_correlation(z, 5).select("lag", r6("correlation").alias("correlation"), "n_rows")


CORRELATION = f"""WITH {SPEC}, {FILLED_CTE}, {RESID_CTE}, pr AS (SELECT a.spaxel, lag, corr(a.z, b.z) AS r, count(*) AS n FROM zz a, range(0, 6) l(lag) JOIN zz b ON b.spaxel = a.spaxel AND b.chan = a.chan + lag GROUP BY 1, 2 HAVING count(*) >= 10),
    m AS (SELECT lag, median(r) AS r, count(*) AS n_rows FROM pr GROUP BY 1) SELECT lag, round(r / (SELECT r FROM m WHERE lag = 0), 6) AS correlation, n_rows FROM m"""

LOG_LOW, LOG_STEP, LOG_N = 4810.0, 0.0035, 34


def q_rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spectrum on a logarithmic grid; each fifth has every other channel masked."""
    spectra = V.spec(spark, sf_dir).withColumn("good", F.expr("good and (spaxel % 5 <> 4 or chan % 2 = 0)"))
    found = J.overlap_rebin(spectra, LOG_LOW, LOG_STEP, LOG_N, keys=("spaxel",))
    return found.select("spaxel", "pix", r6("flux").alias("flux"), r6("unc").alias("unc"), r6("coverage").alias("coverage"), (F.round("coverage", 6) >= 0.5).alias("half"))


REBIN = f"""WITH {SPEC}, s AS (SELECT * REPLACE (good AND (spaxel % 5 <> 4 OR chan % 2 = 0) AS good), lead(wave) OVER w AS up, lag(wave) OVER w AS down FROM spec WINDOW w AS (PARTITION BY spaxel ORDER BY wave)),
    e AS (SELECT *, wave - coalesce(wave - down, up - wave) / 2 AS e0, wave + coalesce(up - wave, wave - down) / 2 AS e1 FROM s),
    p AS (SELECT i AS pix, {LOG_LOW} * exp(i * {LOG_STEP}) AS l, {LOG_LOW} * exp((i + 1) * {LOG_STEP}) AS r FROM range(0, {LOG_N}) t(i)), a AS (SELECT DISTINCT spaxel FROM spec),
    o AS (SELECT spaxel, pix, sum(least(r, e1) - greatest(l, e0)) AS so, sum((least(r, e1) - greatest(l, e0)) * flux) AS sf, sum((least(r, e1) - greatest(l, e0)) ** 2 * var) AS sv FROM e JOIN p ON e0 < r AND e1 > l WHERE good GROUP BY 1, 2)
    SELECT spaxel, pix, round(sf / so, 6) AS flux, round(sqrt(sv) / so, 6) AS unc, round(coalesce(so, 0) / (r - l), 6) AS coverage, round(coalesce(so, 0) / (r - l), 6) >= 0.5 AS half FROM a CROSS JOIN p LEFT JOIN o USING (spaxel, pix)"""


def q_likelihood_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins against pairs of all bins' coadds as templates, over a grid of fractions."""
    spectra = spec_coadd(spark, sf_dir).where("good").select("bin_id", F.col("chan").alias("pix"), "flux", "unc")
    nodes = spectra.select(F.col("bin_id").alias("node"), "pix", F.col("flux").alias("model"))
    fractions = grid_table(spark, f=fraction_grid(0.1, 0.9, 0.1))
    grid = G.two_component_grid(spectra, nodes, fractions, ("bin_id",))
    return grid.select("bin_id", "a", "b", "i_f", F.abs(r6("chi2", 4)).alias("chi2"), "status", "n_pix")


LIKELIHOOD_GRID = f"""WITH {COADD}, d AS (SELECT bin_id, chan AS pix, flux, 1 / (unc * unc) AS w FROM coadd WHERE good), t AS (SELECT bin_id AS node, chan AS pix, flux AS m FROM coadd WHERE good),
    s AS (SELECT bin_id, sum(w * flux * flux) AS s, count(*) AS n_pix FROM d GROUP BY 1), o AS (SELECT bin_id, node, sum(w * flux * m) AS d, sum(w * m * m) AS m FROM d JOIN t USING (pix) GROUP BY 1, 2),
    x AS (SELECT bin_id, a.node AS a, b.node AS b, sum(w * a.m * b.m) AS mab FROM d JOIN t a USING (pix) JOIN t b USING (pix) GROUP BY 1, 2, 3), f AS (SELECT i AS i_f, round(0.1 + 0.1 * i, 12) AS f FROM range(0, 9) r(i)),
    g AS (SELECT x.bin_id, x.a, x.b, i_f, s, n_pix, f * p.d + (1 - f) * q.d AS dd, f * f * p.m + 2 * f * (1 - f) * mab + (1 - f) * (1 - f) * q.m AS mm
        FROM x JOIN o p ON p.bin_id = x.bin_id AND p.node = a JOIN o q ON q.bin_id = x.bin_id AND q.node = b JOIN s ON s.bin_id = x.bin_id, f)
    SELECT bin_id, a, b, i_f, abs(round(s - greatest(dd, 0) ** 2 / mm, 4)) AS chi2, 0 AS status, n_pix FROM g"""


def q_one_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bin's best template among all single spectra."""
    spectra = spec_coadd(spark, sf_dir).where("good").select("bin_id", F.col("chan").alias("pix"), "flux", "unc")
    nodes = V.spec(spark, sf_dir).select(F.col("spaxel").alias("node"), F.col("chan").alias("pix"), F.col("flux").alias("model"))
    return G.one_component_fit(spectra, nodes, ("bin_id",)).select("bin_id", "node", r6("chi2", 4).alias("chi2"), r6("amplitude").alias("amplitude"), "n_pix")


ONE_COMPONENT = f"""WITH {COADD}, d AS (SELECT bin_id, chan AS pix, flux, 1 / (unc * unc) AS w FROM coadd WHERE good), t AS (SELECT spaxel AS node, chan AS pix, flux AS m FROM spec),
    s AS (SELECT bin_id, sum(w * flux * flux) AS s, count(*) AS n_pix FROM d GROUP BY 1), o AS (SELECT bin_id, node, sum(w * flux * m) AS d, sum(w * m * m) AS m FROM d JOIN t USING (pix) GROUP BY 1, 2),
    oc AS (SELECT bin_id, node, s - greatest(d, 0) ** 2 / m AS chi2, greatest(d, 0) / m AS amp, n_pix FROM o JOIN s USING (bin_id))
    SELECT bin_id, node, round(chi2, 4) AS chi2, round(amp, 6) AS amplitude, n_pix FROM oc QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY chi2, node) = 1"""


def q_polyfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.robust_polyfit(V.line(spark, sf_dir), 1, 2.0, 1, ("bin_id",), "chan", "flux")
    return found.select("bin_id", r6(F.col("coeffs")[0], 3).alias("slope"), r6(F.col("coeffs")[1], 3).alias("level"), r6("x_mean").alias("x_mean"), "n", r6("scale", 3).alias("scale"), "support_min", "support_max")


POLYFIT = f"""WITH {LINE}, c AS (SELECT bin_id, chan, flux, avg(chan) OVER (PARTITION BY bin_id) AS xm FROM line), f AS (SELECT bin_id, regr_slope(flux, chan - xm) AS s, regr_intercept(flux, chan - xm) AS i FROM c GROUP BY 1),
    d AS (SELECT c.*, flux - i - s * (chan - xm) AS d FROM c JOIN f USING (bin_id)), m AS (SELECT bin_id, median(d) AS mid FROM d GROUP BY 1), k AS (SELECT bin_id, any_value(mid) AS mid, 1.4826 * median(abs(d - mid)) AS sc FROM d JOIN m USING (bin_id) GROUP BY 1),
    k2 AS (SELECT d.bin_id, chan, flux, xm FROM d JOIN k USING (bin_id) WHERE abs(d - mid) <= 2.0 * sc), f2 AS (SELECT bin_id, regr_slope(flux, chan - xm) AS s, regr_intercept(flux, chan - xm) AS i, count(*) AS n, any_value(xm) AS xm, min(chan) AS lo, max(chan) AS hi FROM k2 GROUP BY 1),
    d2 AS (SELECT k2.bin_id, flux - i - s * (chan - k2.xm) AS d FROM k2 JOIN f2 USING (bin_id)), m2 AS (SELECT bin_id, median(d) AS mid FROM d2 GROUP BY 1), s2 AS (SELECT bin_id, 1.4826 * median(abs(d - mid)) AS scale FROM d2 JOIN m2 USING (bin_id) GROUP BY 1)
    SELECT bin_id, round(s, 3) AS slope, round(i, 3) AS level, round(xm, 6) AS x_mean, n, round(scale, 3) AS scale, lo::DOUBLE AS support_min, hi::DOUBLE AS support_max FROM f2 JOIN s2 USING (bin_id)"""


def q_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's header keys against those of the file before it."""
    a = V.headers(spark, sf_dir)
    b = a.select((F.col("file_id") + 1).alias("file_id"), "key", "value")
    return J.match_headers(a, b, rtol=0.01, atol=0.0)


HEADERS = """WITH h AS (SELECT p_partkey AS file_id, unnest(['CTYPE', 'COMMENT', 'GRATING', 'CWAVE']) AS key, unnest([p_type, p_name, p_brand, p_retailprice::VARCHAR]) AS value FROM part),
    j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.key, b.key) AS key, a.value AS va, b.value AS vb FROM h a FULL JOIN (SELECT file_id + 1 AS file_id, key, value FROM h) b ON a.file_id = b.file_id AND a.key = b.key)
    SELECT * FROM (SELECT file_id, key, CASE WHEN va IS NULL AND vb IS NULL THEN NULL WHEN va IS NULL THEN 'missing in a' WHEN vb IS NULL THEN 'missing in b'
        WHEN try_cast(va AS DOUBLE) IS NOT NULL AND try_cast(vb AS DOUBLE) IS NOT NULL THEN CASE WHEN abs(try_cast(va AS DOUBLE) - try_cast(vb AS DOUBLE)) > 0.01 * abs(try_cast(vb AS DOUBLE)) THEN 'number' END
        WHEN upper(trim(va)) <> upper(trim(vb)) THEN 'text' END AS reason FROM j) WHERE reason IS NOT NULL"""


def q_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    k = F.col("p_size")
    wide = p.select(
        F.col("p_partkey").alias("file_id"), F.when(k % 5 == 0, "AWAV").otherwise("WAVE").alias("CTYPE"), F.when(k % 7 == 0, "vacuum wavelength").alias("CTYPE_COMMENT"), F.when(k % 3 == 0, "T").when(k % 3 == 1, "F").alias("VACUUM"),
        F.when(k % 4 == 0, "HELIOCENT").when(k % 4 == 1, "BARYCENT").when(k % 4 == 2, "TOPOCENT").alias("SPECSYS"),
    )
    return J.check_conventions(wide, "auto", "heliocentric")


CONVENTIONS = """WITH c AS (SELECT p_partkey AS file_id, CASE WHEN p_size % 5 = 0 THEN 'air' WHEN p_size % 7 = 0 THEN 'vacuum' WHEN p_size % 3 = 0 THEN 'vacuum' WHEN p_size % 3 = 1 THEN 'air' END AS medium,
    CASE p_size % 4 WHEN 0 THEN 'heliocentric' WHEN 1 THEN 'barycentric' WHEN 2 THEN 'topocentric' END AS seen FROM part)
    SELECT file_id, medium, 'heliocentric' AS frame, CASE WHEN medium IS NULL THEN 'medium undecided' WHEN seen <> 'heliocentric' THEN 'frame contradicts the header' END AS error, coalesce(medium <> 'vacuum', false) AS conversion_required FROM c"""


def q_low_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = V.image(spark, sf_dir).withColumn("good", F.col("bin_id") % 2 == 0)
    return S.low_flux_selection(img, 20.0, 40, ("target_id",)).select("y", "x", r6("value", 2).alias("value"))


LOW_FLUX = f"""WITH {IMG}, g AS (SELECT * FROM img WHERE bin_id % 2 = 0), l AS (SELECT *, row_number() OVER (ORDER BY y, x) - 1 AS k, count(*) OVER () AS n FROM g WHERE value <= (SELECT quantile_cont(value, 0.2) FROM g)),
    p AS (SELECT DISTINCT CAST(floor(i * ((SELECT any_value(n) FROM l) - 1) / 39.0) AS BIGINT) AS k FROM range(0, 40) r(i))
    SELECT y, x, round(value, 2) AS value FROM l WHERE n <= 40 OR k IN (SELECT k FROM p)"""

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_transfer": TRANSFER, "q_reproject": REPROJECT, "q_smooth": SMOOTH, "q_significance": SIGNIFICANCE, "q_shift": SHIFT, "q_components": COMPONENTS, "q_aperture": APERTURE, "q_interp": INTERP, "q_residuals": RESIDUALS,
    "q_adaptive_bins": ADAPTIVE_BINS, "q_correlation": CORRELATION, "q_rebin": REBIN, "q_likelihood_grid": LIKELIHOOD_GRID, "q_one_component": ONE_COMPONENT, "q_polyfit": POLYFIT, "q_headers": HEADERS, "q_conventions": CONVENTIONS, "q_low_flux": LOW_FLUX,
}
