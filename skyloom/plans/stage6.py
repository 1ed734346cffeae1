"""The registered queries over single fits, preflights and flags of the grid stage, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import flags as Q
from skyloom.functions import scalar as X
from skyloom.operators import grids as G
from skyloom.operators import images as I
from skyloom.operators import joins as J
from skyloom.operators import lines as L
from skyloom.operators import windows as W
from skyloom.plans.stage1 import K1
from skyloom.plans.stage2 import COADD, IMG, LINE, SPEC, spec_coadd
from skyloom.plans.stage3 import ARC, arcs
from skyloom.sources import views as V
from skyloom.sources.scratch import materialize
from skyloom.sources.views import r6


def shifted_templates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, axes): three templates, the means of every third spaxel, as they are and smoothed, at shifts of -2 to 2 channels."""
    spec = V.spec(spark, sf_dir).where("good")
    raw = spec.groupBy((F.col("spaxel") % 3).cast("int").alias("template"), "chan").agg(F.avg("flux").alias("m"))
    beside = lambda d: raw.select("template", (F.col("chan") + d).alias("chan"), F.col("m").alias(f"m{d + 1}"))
    smooth = raw.join(beside(-1), ["template", "chan"]).join(beside(1), ["template", "chan"]).select("template", "chan", ((F.col("m0") + 2 * F.col("m") + F.col("m2")) / 4).alias("m"))
    both = raw.withColumn("sigma", F.lit(0.0)).unionByName(smooth.withColumn("sigma", F.lit(1.0)))
    both = both.withColumn("shift", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    node = ((F.col("shift") + 2) * 6 + F.col("sigma") * 3 + F.col("template")).cast("int").alias("node")
    nodes = materialize(both.select(node, "template", "sigma", F.col("shift").cast("double").alias("velocity"), (F.col("chan") + F.col("shift")).alias("pix"), F.col("m").alias("model")), "shifted-templates")
    return nodes.select("node", "pix", "model"), nodes.select("node", "velocity", "sigma", "template").distinct()


TEMPLATES = """t AS (SELECT CAST(spaxel % 3 AS INT) AS template, chan, avg(flux) AS m FROM spec WHERE good GROUP BY 1, 2),
    sm AS (SELECT a.template, a.chan, (b.m + 2 * a.m + c.m) / 4 AS m FROM t a JOIN t b ON b.template = a.template AND b.chan = a.chan - 1 JOIN t c ON c.template = a.template AND c.chan = a.chan + 1),
    tt AS (SELECT template, 0.0::DOUBLE AS sigma, chan, m FROM t UNION ALL SELECT template, 1.0::DOUBLE, chan, m FROM sm),
    n AS (SELECT template, sigma, v::DOUBLE AS velocity, chan + v AS pix, m FROM tt, range(-2, 3) r(v))"""


def q_single_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bin's best velocity, dispersion and template within the grid's velocities and a margin, and its profile over velocity."""
    spectra = spec_coadd(spark, sf_dir).where("good").select("bin_id", F.col("chan").alias("pix"), "flux", "unc")
    nodes, axes = shifted_templates(spark, sf_dir)
    best, profile = G.single_fit(spectra, nodes, axes, G.velocity_bounds([-1.0, 1.0], 0.5), ("bin_id",))
    over = profile.select("bin_id", F.col("velocity").alias("v"), r6("chi2", 4).alias("profile"))
    found = best.select("bin_id", "velocity", "sigma", "template", r6("chi2", 4).alias("chi2"), r6("amplitude", 5).alias("amplitude"), "n_pix", "success")
    return found.join(over, "bin_id", "left")


SINGLE_FIT = f"""WITH {COADD}, {TEMPLATES}, d AS (SELECT bin_id, chan AS pix, flux, 1 / (unc * unc) AS w FROM coadd WHERE good), s AS (SELECT bin_id, sum(w * flux * flux) AS s, count(*) AS n_pix FROM d GROUP BY 1),
    o AS (SELECT bin_id, template, sigma, velocity, sum(w * flux * m) AS d, sum(w * m * m) AS m FROM d JOIN n USING (pix) WHERE velocity BETWEEN -1.5 AND 1.5 GROUP BY ALL HAVING sum(w * flux * m) > 0),
    cc AS (SELECT bin_id, template, sigma, velocity, s - d * d / m AS chi2, d / m AS amplitude, n_pix FROM o JOIN s USING (bin_id)),
    b AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY chi2, velocity, sigma, template) = 1), p AS (SELECT bin_id, velocity AS v, min(chi2) AS profile FROM cc GROUP BY 1, 2)
    SELECT bin_id, velocity, sigma, template, round(chi2, 4) AS chi2, round(amplitude, 5) AS amplitude, n_pix, chi2 IS NOT NULL AS success, v, round(profile, 4) AS profile
    FROM (SELECT DISTINCT bin_id FROM d) LEFT JOIN b USING (bin_id) LEFT JOIN p USING (bin_id)"""


def q_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fits that come before a grid, where bins cover stretches of the axis and the templates end too early for the last of them."""
    lo = F.col("bin_id") * 6
    spectra = spec_coadd(spark, sf_dir).where(F.col("good") & F.col("chan").between(lo, lo + 19)).select("target_id", "bin_id", F.col("chan").alias("pix"), "flux", "unc")
    nodes, axes = shifted_templates(spark, sf_dir)
    middle = X.grid_table(spark, f=X.uniform_grid(0.1, 0.4, 4)).where("i_f = 2")
    verdict, single, corners = L.coverage_preflight(materialize(spectra, "short-spectra"), nodes.where("pix < 44"), axes, G.velocity_bounds([-2.0, 2.0], 1.0), middle)
    corner = lambda a, b: F.max(F.when((F.col("va") == a) & (F.col("vb") == b), r6("chi2", 4)))
    at = corners.groupBy("bin_id").agg(corner(-2, -2).alias("ll"), corner(-2, 2).alias("lh"), corner(2, -2).alias("hl"), corner(2, 2).alias("hh"))
    fits = single.select("bin_id", "velocity", "sigma", "template", r6("chi2", 4).alias("chi2"))
    return verdict.select("bin_id", "one_component", "n_corners", "ready").join(fits, "bin_id").join(at, "bin_id", "left")


PREFLIGHT = f"""WITH {COADD}, {TEMPLATES}, d AS (SELECT bin_id, chan AS pix, flux, 1 / (unc * unc) AS w FROM coadd WHERE good AND chan BETWEEN bin_id * 6 AND bin_id * 6 + 19),
    e AS (SELECT bin_id, min(pix) AS lo, max(pix) AS hi FROM d GROUP BY 1),
    picked AS (SELECT first(bin_id ORDER BY lo, bin_id) AS bin_id FROM e UNION SELECT first(bin_id ORDER BY hi DESC, bin_id) FROM e UNION SELECT first(bin_id ORDER BY lo - hi, bin_id) FROM e),
    k AS (SELECT * FROM n WHERE pix < 44), s AS (SELECT bin_id, sum(w * flux * flux) AS s FROM d SEMI JOIN picked USING (bin_id) GROUP BY 1),
    o AS (SELECT bin_id, template, sigma, velocity, sum(w * flux * m) AS d, sum(w * m * m) AS m FROM d SEMI JOIN picked USING (bin_id) JOIN k USING (pix) GROUP BY ALL),
    b AS (SELECT bin_id, template, sigma, velocity, s - d * d / m AS chi2 FROM o JOIN s USING (bin_id) WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY chi2, velocity, sigma, template) = 1),
    ends AS (SELECT * FROM k WHERE abs(velocity) = 2 AND sigma = 0 AND template = 0),
    mm AS (SELECT bin_id, a.velocity AS va, b.velocity AS vb, sum(w * a.m * b.m) AS m FROM d SEMI JOIN picked USING (bin_id) JOIN ends a USING (pix) JOIN ends b USING (pix) GROUP BY ALL),
    q AS (SELECT o.bin_id, o.velocity AS v, o.d, o.m FROM o WHERE abs(velocity) = 2 AND sigma = 0 AND template = 0),
    cc AS (SELECT mm.bin_id, va, vb, s - greatest(0.3 * x.d + 0.7 * y.d, 0) ** 2 / (0.09 * x.m + 0.42 * mm.m + 0.49 * y.m) AS chi2
        FROM mm JOIN q x ON x.bin_id = mm.bin_id AND x.v = va JOIN q y ON y.bin_id = mm.bin_id AND y.v = vb JOIN s ON s.bin_id = mm.bin_id),
    g AS (SELECT bin_id, count(chi2) AS n, max(chi2) FILTER (va = -2 AND vb = -2) AS ll, max(chi2) FILTER (va = -2 AND vb = 2) AS lh, max(chi2) FILTER (va = 2 AND vb = -2) AS hl, max(chi2) FILTER (va = 2 AND vb = 2) AS hh FROM cc GROUP BY 1)
    SELECT bin_id, chi2 IS NOT NULL AS one_component, coalesce(n, 0) AS n_corners, chi2 IS NOT NULL AND coalesce(n, 0) >= 4 AS ready, velocity, sigma, template, round(chi2, 4) AS chi2,
        round(ll, 4) AS ll, round(lh, 4) AS lh, round(hl, 4) AS hl, round(hh, 4) AS hh FROM picked LEFT JOIN b USING (bin_id) LEFT JOIN g USING (bin_id)"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(spectra, nodes): the bins' means over even and over odd spaxels."""
    spec = V.spec(spark, sf_dir).where("good").groupBy("target_id", "bin_id", F.col("chan").alias("pix"))
    mean = lambda odd: F.avg(F.when(F.col("spaxel") % 2 == odd, F.col("flux")))
    found = materialize(spec.agg((0.2 + mean(0)).alias("flux"), (0.2 + mean(1)).alias("model")), "halves")
    return found.select("target_id", "bin_id", "pix", "flux", F.lit(0.1).alias("unc")), found.select(F.col("bin_id").cast("int").alias("node"), "pix", "model")


def q_fit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of a small grid for every bin, behind its preflight, and the best one refitted."""
    spectra, nodes = halves(spark, sf_dir)
    fractions = X.grid_table(spark, f=X.uniform_grid(0.1, 0.4, 4))
    axes = nodes.select("node", F.col("node").cast("double").alias("velocity"), F.lit(0.0).alias("sigma"), F.lit(0).alias("template")).distinct()
    keys = ["target_id", "bin_id"]
    grid = materialize(L.gated_grid(spectra, nodes, axes, (0.0, 9.0), fractions), "fit-states")
    refit = G.best_state_refit(grid, spectra, nodes, keys)
    asked = J.state_grid(spectra.select(*keys).distinct(), fractions).groupBy(*keys).agg(F.count("*").alias("n_asked"))
    mixed = F.col("a") != F.col("b")
    states = grid.groupBy(*keys).agg(F.count("*").alias("n_states"), r6(F.avg("chi2"), 3).alias("mean_chi2"))
    rows = refit.join(asked, keys).join(states, keys)
    return rows.select("bin_id", "n_asked", "n_states", "mean_chi2", "a", "b", F.when(mixed, r6("f")).alias("f"), r6("chi2", 4).alias("chi2"), r6("chi2_again", 4).alias("chi2_again"), r6("amplitude", 5).alias("amplitude"))


FIT_STATES = f"""WITH {SPEC}, h AS (SELECT bin_id, chan AS pix, 0.2 + avg(flux) FILTER (spaxel % 2 = 0) AS flux, 0.2 + avg(flux) FILTER (spaxel % 2 = 1) AS m FROM spec WHERE good GROUP BY 1, 2),
    s AS (SELECT bin_id, sum(100 * flux * flux) AS s FROM h GROUP BY 1), o AS (SELECT d.bin_id, t.bin_id AS node, sum(100 * d.flux * t.m) AS d FROM h d JOIN h t USING (pix) GROUP BY 1, 2),
    g AS (SELECT a.bin_id AS a, b.bin_id AS b, sum(100 * a.m * b.m) AS m FROM h a JOIN h b USING (pix) GROUP BY 1, 2), f AS (SELECT i AS i_f, 0.1 + 0.1 * i AS f FROM range(0, 4) r(i)),
    c AS (SELECT s.bin_id, g.a, g.b, i_f, f, s, f * x.d + (1 - f) * y.d AS d, f * f * p.m + 2 * f * (1 - f) * g.m + (1 - f) * (1 - f) * q.m AS m
        FROM g JOIN o x ON x.node = g.a JOIN o y ON y.node = g.b AND y.bin_id = x.bin_id JOIN s ON s.bin_id = x.bin_id JOIN g p ON p.a = g.a AND p.b = g.a JOIN g q ON q.a = g.b AND q.b = g.b, f),
    k AS (SELECT *, s - greatest(d, 0) ** 2 / m AS chi2, greatest(d, 0) / m AS amplitude FROM c), t AS (SELECT bin_id, count(*) AS n_states, round(avg(chi2), 3) AS mean_chi2 FROM k GROUP BY 1)
    SELECT bin_id, 4 AS n_asked, n_states, mean_chi2, CAST(a AS INT) AS a, CAST(b AS INT) AS b, CASE WHEN a <> b THEN round(f, 6) END AS f, round(chi2, 4) AS chi2, round(chi2, 4) AS chi2_again, round(amplitude, 5) AS amplitude
    FROM k JOIN t USING (bin_id) QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY chi2, a, b, i_f) = 1"""


def q_stage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid stage's flags for each line number, over suppliers as bins."""
    rows = V.line(spark, sf_dir).groupBy("linenumber", "bin_id").agg(
        F.lit(0.25).alias("requested"), F.avg(F.col("mask").cast("int")).alias("achieved"), (F.min("discount") < 0.02).alias("one_component_ok"),
        F.count_if((F.col("exposure") == 0) & F.col("mask")).alias("n_failed"), F.count_if((F.col("discount") == 0.1) & (F.col("var") > 45)).alias("n_boundary"),
    )
    found = Q.stage_flags(rows, 0.2, ("linenumber",))
    return Q.describe_flags(found).select("linenumber", "flag", "n_bins", (F.length("description") > 20).alias("described"))


STAGE_FLAGS = f"""WITH {LINE}, b AS (SELECT linenumber, bin_id, avg(CASE WHEN mask THEN 1.0 ELSE 0 END) AS a, min(discount) < 0.02 AS ok, count(*) FILTER (NOT exposed AND mask) AS nf, count(*) FILTER (discount = 0.1 AND var > 45) AS nb FROM line GROUP BY 1, 2),
    c AS (SELECT linenumber, count(*) FILTER (abs(a - 0.25) > 0.2) AS c1, count(*) FILTER (NOT ok) AS c2, count(*) FILTER (nf > 0) AS c3, count(*) FILTER (nb > 0) AS c4 FROM b GROUP BY 1)
    SELECT linenumber, flag, n_bins, true AS described FROM (SELECT linenumber, 'RH3_FRACTION_CONSTRAINT_WARNING' AS flag, c1 AS n_bins FROM c UNION ALL SELECT linenumber, 'RH3_ONE_COMPONENT_FAILURES', c2 FROM c
    UNION ALL SELECT linenumber, 'RH3_GRID_FIT_FAILURES', c3 FROM c UNION ALL SELECT linenumber, 'RH3_SIGMA_BOUNDARY_STATES', c4 FROM c) WHERE n_bins > 0"""

def q_line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc lines on a sloping ground fitted in every slice and position, at their known places."""
    spectra = materialize(L.arc_spectra(arcs(spark, sf_dir), 3).withColumn("value", F.col("value") + 0.01 * F.col("wave")), "arc-spectra")
    near = F.abs(F.col("wave") - 90.0 * F.round(F.col("wave") / 90.0)) < F.col("step") / 2
    keys = ("slice_id", "position_bin")
    fits = W.line_fit(spectra.where(near).select(*keys, "k"), spectra.select(*keys, "k", "wave", "value", "step"), 4, keys)
    return fits.select(*keys, "peak", r6("centre", 3).alias("centre"), r6("sigma", 3).alias("sigma"), r6("fwhm", 2).alias("fwhm"), r6("amplitude", 2).alias("amplitude"))


# each round looks at a grid of centres and widths around the best so far, amplitude and ground in closed form, and narrows it
LINE_FITS = f"""WITH RECURSIVE {ARC}, sp AS (SELECT slice_id, position_bin, k, wave, value + 0.01 * wave AS value, step FROM arc),
    pk AS (SELECT row_number() OVER (ORDER BY slice_id, position_bin, k) AS id, slice_id, position_bin, k AS peak, wave AS w0, step FROM sp WHERE abs(wave - 90 * round(wave / 90)) < step / 2),
    x AS MATERIALIZED (SELECT id, (sp.wave - w0) / pk.step AS u, value AS y FROM pk JOIN sp USING (slice_id, position_bin) WHERE abs(sp.k - peak) <= 4),
    big AS MATERIALIZED (SELECT id FROM x GROUP BY 1 HAVING count(*) >= 7),
    z AS (SELECT id, 0 AS round, 0.0::DOUBLE AS mu, 2.15::DOUBLE AS sg, 1.0::DOUBLE AS half, 0.0::DOUBLE AS amp FROM big
        UNION ALL SELECT id, round + 1, b.mu, b.sg, half * 0.4, b.amp FROM (
            SELECT id, round, half, arg_min({{'mu': mu, 'sg': sg, 'amp': ey / ee}}, yy - ey * ey / ee) AS b FROM (
                SELECT g.id, g.round, g.half, mu, sg, var_pop(y) - covar_pop(y, u) ** 2 / var_pop(u) AS yy, covar_pop(y, exp(-0.5 * ((u - mu) / sg) ** 2)) - covar_pop(y, u) * covar_pop(exp(-0.5 * ((u - mu) / sg) ** 2), u) / var_pop(u) AS ey,
                    var_pop(exp(-0.5 * ((u - mu) / sg) ** 2)) - covar_pop(exp(-0.5 * ((u - mu) / sg) ** 2), u) ** 2 / var_pop(u) AS ee
                FROM (SELECT z.id, z.round, z.half, greatest(-1.5, least(1.5, z.mu + 0.15 * z.half * i)) AS mu, greatest(0.15, least(8, z.sg + 0.2 * z.half * j)) AS sg FROM z, range(-10, 11) a(i), range(-10, 11) b(j) WHERE round < 24) g JOIN x ON x.id = g.id
                GROUP BY ALL) WHERE ey > 0 GROUP BY ALL))
    SELECT slice_id, position_bin, peak, round(w0 + mu * step, 3) AS centre, round(sg * step, 3) AS sigma, round(sg * step * 2.3548200450309493, 2) AS fwhm, round(amp, 2) AS amplitude
    FROM z JOIN pk USING (id) WHERE round = 24 AND sg * 2.3548200450309493 BETWEEN 0.25 AND 20"""

def q_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image against itself moved by two rows and a column: contrasts, shift, overlap, difference, and the centre with its verdict."""
    img = V.image(spark, sf_dir).withColumn("mask", F.col("value") > -900).select("target_id", "y", "x", "value", "mask")
    moved = img.withColumns({"y": F.col("y") + 2, "x": F.col("x") + 1}).where("x < 50")
    keys = ("target_id",)
    found = I.register_pair(img, moved, 4, contrast=0.5, keys=keys)
    apart = I.difference_image(img, moved, keys).groupBy(*keys).agg(F.sum("difference").alias("sum_difference"), F.count("*").alias("n_difference"))
    centre = I.center_agreement(img, 1.0, 5.0, keys)
    names = ("contrast_a", "contrast_b", "correlation", "overlap_fraction", "rms_difference")
    shown = [r6(c).alias(c) for c in names] + [r6(c, 4).alias(c) for c in ("dy", "dx", "top", "cy", "cx", "separation", "sum_difference")]
    return found.join(apart, "target_id").join(centre, "target_id").select("target_id", *shown, "valid", "reason", "n_difference", "y", "x", "n_bright", "warn")


def smooth_sql(table: str, value: str, name: str) -> str:
    """CTEs that end in `name` (y, x, sm): the value smoothed with the kernel k over all rows of the table, edges held."""
    ends = f"(SELECT max(y) AS ym, max(x) AS xm FROM {table})"
    return f"""{name}0 AS (SELECT y, x, coalesce({value}, 0) AS num, CASE WHEN {value} IS NULL THEN 0 ELSE 1.0 END AS den FROM {table}),
    {name}1 AS (SELECT a.y, a.x, sum(w * b.num) AS num, sum(w * b.den) AS den FROM {name}0 a, {ends} m, k JOIN {name}0 b ON b.y = least(ym, greatest(0, a.y + d)) AND b.x = a.x GROUP BY 1, 2),
    {name}2 AS (SELECT a.y, a.x, sum(w * b.num) AS num, sum(w * b.den) AS den FROM {name}1 a, {ends} m, k JOIN {name}1 b ON b.x = least(xm, greatest(0, a.x + d)) AND b.y = a.y GROUP BY 1, 2),
    {name} AS (SELECT y, x, num / den AS sm FROM {name}2 WHERE den > 1e-12)"""


def contrast_sql(smooth: str, name: str) -> str:
    return f"""{name}0 AS (SELECT sm, median(sm) OVER () AS md FROM {smooth} SEMI JOIN used USING (y, x)),
    {name} AS (SELECT greatest(0, (quantile_cont(sm, 0.99) - any_value(md)) / (1.4826 * median(abs(sm - md)))) AS contrast FROM {name}0)"""


REGISTER = f"""WITH {IMG}, {K1}, ia AS (SELECT y, x, CASE WHEN value > -900 THEN value END AS v FROM img), ib AS (SELECT y + 2 AS y, x + 1 AS x, v FROM ia WHERE x + 1 < 50),
    ab AS (SELECT y, x, ia.v AS va, ib.v AS vb FROM ia FULL JOIN ib USING (y, x)), used AS (SELECT * FROM ab WHERE va IS NOT NULL AND vb IS NOT NULL),
    {smooth_sql("ab", "va", "sa")}, {smooth_sql("ab", "vb", "sb")}, {contrast_sql("sa", "ca")}, {contrast_sql("sb", "cb")},
    md AS (SELECT y, x, va, vb, median(va) OVER () AS ma, median(vb) OVER () AS mb FROM used), sc AS (SELECT 1.4826 * median(abs(va - ma)) AS ka, 1.4826 * median(abs(vb - mb)) AS kb FROM md),
    n AS (SELECT y, x, (va - ma) / ka AS a, (vb - mb) / kb AS b FROM md, sc), l AS (SELECT i - 4 AS ly, j - 4 AS lx FROM range(0, 9) r(i), range(0, 9) q(j)),
    p AS (SELECT ly, lx, sum(u.a * v.b) / count(*) AS c, count(*) AS n FROM l, n v JOIN n u ON u.y = v.y + ly AND u.x = v.x + lx GROUP BY 1, 2),
    cc AS (SELECT * FROM p WHERE n > greatest(9, 0.1 * (SELECT n FROM p WHERE ly = 0 AND lx = 0))),
    e AS (SELECT *, lag(c) OVER (PARTITION BY lx ORDER BY ly) AS y0, lead(c) OVER (PARTITION BY lx ORDER BY ly) AS y1, lag(c) OVER (PARTITION BY ly ORDER BY lx) AS x0, lead(c) OVER (PARTITION BY ly ORDER BY lx) AS x1 FROM cc),
    best AS (SELECT c, ly + CASE WHEN y0 IS NULL OR y1 IS NULL THEN 0 ELSE greatest(-1.0, least(1.0, 0.5 * (y0 - y1) / (y0 - 2 * c + y1))) END AS dy, lx + CASE WHEN x0 IS NULL OR x1 IS NULL THEN 0 ELSE greatest(-1.0, least(1.0, 0.5 * (x0 - x1) / (x0 - 2 * c + x1))) END AS dx
        FROM e ORDER BY c DESC, ly, lx LIMIT 1),
    df AS (SELECT sqrt(avg((a - b) ** 2)) AS rms, sum(a - b) AS total, count(*) AS n FROM n), o AS (SELECT count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL) / count(va) AS part FROM ab),
    {smooth_sql("img", "value", "si")}, top AS (SELECT y, x, sm FROM si ORDER BY sm DESC, y, x LIMIT 1), lim AS (SELECT quantile_cont(sm, 0.9) AS lim FROM si WHERE sm > 0),
    ct AS (SELECT sum(sm * y) / sum(sm) AS cy, sum(sm * x) / sum(sm) AS cx, count(*) AS n_bright FROM si, lim WHERE sm >= lim),
    vd AS (SELECT CASE WHEN least(ca.contrast, cb.contrast) < 0.5 THEN 'low contrast' WHEN greatest(abs(best.dy), abs(best.dx)) >= 3.25 THEN 'shift at the limit' ELSE 'ok' END AS reason FROM ca, cb, best)
    SELECT 'demo' AS target_id, round(ca.contrast, 6) AS contrast_a, round(cb.contrast, 6) AS contrast_b, round(best.c, 6) AS correlation, round(part, 6) AS overlap_fraction, round(rms, 6) AS rms_difference, CASE WHEN reason = 'ok' THEN round(best.dy, 4) END AS dy, CASE WHEN reason = 'ok' THEN round(best.dx, 4) END AS dx,
        round(top.sm, 4) AS top, round(cy, 4) AS cy, round(cx, 4) AS cx, round(sqrt((cy - top.y) ** 2 + (cx - top.x) ** 2), 4) AS separation, round(total, 4) AS sum_difference, reason = 'ok' AS valid, reason, df.n AS n_difference, top.y AS y, top.x AS x, n_bright,
        sqrt((cy - top.y) ** 2 + (cx - top.x) ** 2) > 5 AS warn FROM ca, cb, best, df, o, top, ct, vd"""

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
ORACLES = {"q_single_fit": SINGLE_FIT, "q_preflight": PREFLIGHT, "q_fit_states": FIT_STATES, "q_stage_flags": STAGE_FLAGS, "q_line_fits": LINE_FITS, "q_register": REGISTER}
