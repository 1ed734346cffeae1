"""Line widths, noise and prepared templates on made-up tables of known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import flags, scalar
from skyloom.operators import aggregates as A
from skyloom.operators import images
from skyloom.operators import lines as L
from skyloom.operators import windows as W


@pytest.fixture(scope="module")
def arc_frame(spark):
    """Four lines of sigma 0.5 in three slices of 16 columns, noise 1 on a ground of 10."""
    rng, (ny, nx) = np.random.default_rng(3), (180, 48)
    wave, arc = 8400 + 0.2 * np.arange(ny), np.full((ny, nx), 10.0)
    for centre in (8407.0, 8414.0, 8421.0, 8428.0):
        arc += (500 * np.exp(-0.5 * ((wave - centre) / 0.5) ** 2))[:, None]
    arc += rng.normal(0, 1, arc.shape)
    rows = [("t", "a", y, x, float(arc[y, x]), float(wave[y]), x // 16, float(x % 16), 8402.0, 8433.0) for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(rows, "target_id string, arm string, y int, x int, arc double, wave double, slice_id int, pos double, low double, high double")


def test_arc_widths(arc_frame):
    fit, lines, scatter = L.arc_widths(arc_frame, n_positions=2, half=8, distance=10, order=1)
    model, found = fit.first(), lines.where("kept").collect()
    assert len(found) >= 6 and abs(np.median([r["y"] for r in found]) - 0.5 * 2.354820045) < 0.25
    assert 8402 <= model["support_min"] < model["support_max"] <= 8433
    assert {r["level"] for r in scatter.collect()} == {"all", "first", "second", "pair"} and all(r["rms"] < 0.05 for r in scatter.collect())
    assert {round(r["x"]) for r in found} == {8407, 8414, 8421, 8428}


def test_line_fits_on_a_steep_noisy_ground(spark):
    """Widths within one percent, among samples of one and a half to eight steps of sigma, beside lines without a fit."""
    rng, k = np.random.default_rng(8), np.arange(200)
    rows, truth = [], {}
    for g in range(40):
        sigma, centre = rng.uniform(0.25, 0.9), 8420 + rng.uniform(-0.1, 0.1)
        wave = 8400 + 0.2 * k
        value = 900 - 35.0 * (wave - 8420) + 4000 * np.exp(-0.5 * ((wave - centre) / sigma) ** 2) + rng.normal(0, 4, len(k))
        truth[g] = (sigma, centre)
        rows += [(g, int(i), float(w), float(v), 0.2) for i, w, v in zip(k, wave, value)]
    rows += [(100, int(i), 8400 + 0.2 * int(i), 5.0 - abs(int(i) - 100), 0.2) if i != 100 else (100, 100, 8420.0, -50.0, 0.2) for i in k]  # a dip
    rows += [(101, i, 8400 + 0.2 * i, float(i == 2), 0.2) for i in range(6)]  # too short
    pixels = spark.createDataFrame(rows, "g int, k int, wave double, value double, step double").repartition(4)
    peaks = spark.createDataFrame([(g, 100 if g != 101 else 2) for g in [*truth, 100, 101]], "g int, k int")
    found = {r["g"]: r for r in W.line_fit(peaks, pixels, 12, ("g",)).collect()}
    assert set(found) == set(truth)
    for g, (sigma, centre) in truth.items():
        assert found[g]["sigma"] == pytest.approx(sigma, rel=0.01) and found[g]["centre"] == pytest.approx(centre, abs=0.01)
        assert found[g]["amplitude"] == pytest.approx(4000, rel=0.02) and 0.3 < found[g]["chi_proxy"] < 3


def test_gauss_newton_stops_at_its_bounds():
    u = np.tile(np.arange(-6.0, 7.0), (3, 1))
    y = np.stack([np.exp(-0.5 * ((u[0] - 2.4) / 2.0) ** 2), np.exp(-0.5 * (u[1] / 30) ** 2), -np.exp(-0.5 * (u[2] / 1.0) ** 2)])
    low, high = np.array([0.0, -1.5, 0.15, -np.inf, -np.inf]), np.array([np.inf, 1.5, 8.0, np.inf, np.inf])
    p, r = W.gaussian_fits(u, y, np.ones(u.shape, bool), np.tile([1.0, 0, 1, 0, 0], (3, 1)), low, high)
    assert p[0, 1] == 1.5 and p[1, 2] == 8.0 and p[2, 0] == 0.0 and np.isfinite(r).all()
    assert ((p >= low) & (p <= high)).all()


def test_too_few_lines_are_an_error(arc_frame):
    with pytest.raises(Exception, match="arc lines"):
        L.arc_widths(arc_frame, n_positions=2, half=8, distance=10, order=1, min_lines=60)


def test_noise_of_white_spectra(spark):
    rng = np.random.default_rng(4)
    rows = [("t", "a", y, x, k, float(20 + 2 * w + 0.5 * w * w + rng.normal()), 1.0, True) for y in range(6) for x in range(7) for k, w in enumerate(np.linspace(-1, 1, 101))]
    samples = spark.createDataFrame(rows, "target_id string, arm string, y int, x int, chan int, flux double, unc double, good boolean")
    image = A.collapse(samples).withColumn("good", F.lit(True))
    summary, correlation = L.noise_characterization(samples, image, percent=50, at_most=20, window=21, max_lag=5)
    s, c = summary.first(), {r["lag"]: r["correlation"] for r in correlation.collect()}
    assert s["n_spaxels"] == 20 and s["n_samples"] > 100 and 0.6 < s["variance_scale"] < 1.2
    assert c[0] == 1.0 and max(abs(c[k]) for k in range(1, 6)) < 0.25


def test_correlation_of_gapped_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(s, k, float(v)) for s in range(3) for k, v in enumerate(rng.normal(size=60)) if rng.random() > 0.3]
    got = {r["lag"]: (r["correlation"], r["n_rows"]) for r in A.spectral_correlation(spark.createDataFrame(rows, "spaxel int, chan int, z double"), 3, ()).collect()}
    z = {(s, k): v for s, k, v in rows}
    for lag in range(4):
        each = []
        for s in range(3):
            pairs = [(v, z[s, k + lag]) for (r, k), v in z.items() if r == s and (s, k + lag) in z]
            each.append(np.corrcoef(np.array(pairs).T)[0, 1])
        assert abs(got[lag][0] - np.median(each)) < 1e-9 and got[lag][1] == 3


def test_smooth_array_keeps_parabolas(spark):
    rows = spark.createDataFrame([([float(k * k - 3 * k) for k in range(25)],), ([1.0, 2.0],)], "v array<double>")
    long, short = [r[0] for r in rows.select(W.smooth_array(F.col("v"), 7, 2)).collect()]
    assert np.allclose(long, [k * k - 3 * k for k in range(25)]) and short is None


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_robust_fit_of_any_order(spark, order):
    rng = np.random.default_rng(order)
    c = rng.normal(size=order + 1)
    x = rng.uniform(-2, 2, 300)
    y = np.polyval(c, x) + rng.normal(0, 1e-3, 300)
    y[:5] += 50
    fit, rows = A.robust_polyfit(spark.createDataFrame([("t", float(a), float(b)) for a, b in zip(x, y)], "target_id string, x double, y double"), order, with_rows=True)
    f = fit.first()
    at = np.linspace(-2, 2, 9)
    assert np.allclose(np.polyval(f["coeffs"], at - f["x_mean"]), np.polyval(c, at), atol=5e-3)
    assert rows.where("not kept").count() >= 5


def test_templates_beyond_their_support_are_an_error(spark):
    rows = spark.range(2).select("id", F.posexplode(F.sequence(F.lit(4800), F.lit(5200))).alias("pix", "w"))
    rows = rows.select(F.col("id").alias("template_id"), "pix", F.col("w").cast("double").alias("wave"), (2 + F.sin(F.col("w") / 7)).alias("value"), F.lit(1.5).alias("fwhm"))
    good = L.prepare_templates(rows, 4850.0, 5150.0, 60.0, 300.0, lambda w: F.lit(2.5))
    inside = good.where("wave between 4850 and 5150").groupBy("template_id").agg(F.avg("value").alias("m")).collect()
    assert len(inside) == 2 and all(abs(r["m"] - 1) < 1e-9 for r in inside)
    for width, said in ((lambda w: F.when(w > 5000, 2.5), "support"), (lambda w: F.lit(1.0), "coarser")):
        with pytest.raises(Exception, match=said):
            L.prepare_templates(rows, 4850.0, 5150.0, 60.0, 300.0, width).count()


def test_spectral_axis_and_velocity_scale(spark):
    cards = [("f", "CTYPE1", "RA"), ("f", "CTYPE2", "awav"), ("g", "CTYPE1", "x"), ("g", "NAXIS", "3"), ("g", "CD3_3", "1"), ("h", "CTYPE1", "FREQ")]
    heads = spark.createDataFrame(cards, "file_id string, key string, value string")
    assert {r["file_id"]: r["axis"] for r in scalar.spectral_axis(heads).collect()} == {"f": 2, "g": 3, "h": 1}
    assert {r["file_id"]: r["axis"] for r in scalar.spectral_axis(heads, strict=True).collect()} == {"f": 2, "g": None, "h": None}
    waves = spark.createDataFrame([("t", k, 5000 * float(np.exp(k * 1e-4))) for k in range(9)] + [("u", 0, 1.0), ("u", 1, 2.0)], "target_id string, chan int, wave double")
    found = {r["target_id"]: r["velscale"] for r in scalar.velocity_scale(waves).collect()}
    assert abs(found["t"] - 29.9792458) < 1e-6 and found["u"] is None
    assert scalar.velocity_scale(waves, configured=50.0).first()["velscale"] == 50.0


def test_flags(spark):
    rows = spark.createDataFrame([("t", 0.5, 0.51, True, 0, 2), ("t", 0.5, 0.6, False, 0, 0)], "target_id string, requested double, achieved double, one_component_ok boolean, n_failed int, n_boundary int")
    raised = {r["flag"]: r["n_bins"] for r in flags.stage_flags(rows, 0.02).collect()}
    assert raised == {"RH3_FRACTION_CONSTRAINT_WARNING": 1, "RH3_ONE_COMPONENT_FAILURES": 1, "RH3_SIGMA_BOUNDARY_STATES": 1}
    known = spark.createDataFrame([("MC_NOT_CONVERGED",)], "flag string")
    assert "Monte Carlo" in flags.describe_flags(known).first()["description"]
    with pytest.raises(Exception, match="unknown flag"):
        flags.describe_flags(spark.createDataFrame([("NO_SUCH",)], "flag string")).collect()


def test_preflight_and_optional_correlation(spark):
    one = spark.createDataFrame([("t", "1", True), ("t", "2", True), ("t", "3", False)], "target_id string, bin_id string, ok boolean")
    corners = spark.createDataFrame([("t", b, 1.0 if k or b == "1" else None) for b in "123" for k in range(4)], "target_id string, bin_id string, chi2 double")
    assert {r["bin_id"]: r["ready"] for r in L.preflight(one, corners).collect()} == {"1": True, "2": False, "3": False}
    bins = spark.createDataFrame([("t", "a", 1)], "target_id string, arm string, bin_id int")
    lags = spark.createDataFrame([("t", "a", k, 1.0 / (1 + k)) for k in range(3)], "target_id string, arm string, lag int, correlation double")
    assert L.optional_correlation(bins, lags).first()["lags"] == [1.0, 0.5, 1 / 3] and L.optional_correlation(bins, None).first()["lags"] is None


def test_power_assign_looks_as_far_as_it_must(spark):
    from skyloom.operators import images

    rng = np.random.default_rng(2)
    generators = [("t", i, float(x), float(y), float(r)) for i, (x, y, r) in enumerate(zip(rng.uniform(0, 300, 12), rng.uniform(0, 90, 12), rng.uniform(0, 6, 12)))]
    pixels = [("t", y, x) for y in range(0, 90, 7) for x in range(0, 300, 11)]
    g = spark.createDataFrame(generators, "target_id string, bin_id int, gx double, gy double, r double")
    found = images.power_assign(spark.createDataFrame(pixels, "target_id string, y int, x int"), g).collect()
    for row in found:
        assert row["bin_id"] == min(((row["x"] - x) ** 2 + (row["y"] - y) ** 2 - r * r, i) for _, i, x, y, r in generators)[1]
    assert len(found) == len(pixels)


def test_sidecars_by_root_prefix_and_headers(spark):
    from skyloom.sources import registry

    keys = ", ".join(f"{k} string" for k in registry.MATCH_KEYS)
    head = ("o", "c", "i", "b", "g", "r")
    arcs = spark.createDataFrame([("1", "d", "arc1", *head), ("2", "d", "arc2", *head)], f"arc_id string, dir string, root string, {keys}")
    files = [("p1", "d", "arc1", "wavemap", *head), ("p2", "d", "arc2_x", "wavemap", *head), ("p3", "d", "other", "slicemap", "o", "c", "i", "b", None, "r"), ("p4", "e", "arc1", "posmap", *head)]
    found = registry.match_sidecars(arcs, spark.createDataFrame(files, f"path string, dir string, root string, kind string, {keys}")).collect()
    assert {(r["arc_id"], r["kind"], r["path"], r["rule"], r["n"]) for r in found} == {("1", "wavemap", "p1", 1, 1), ("2", "wavemap", "p2", 2, 1), ("1", "slicemap", "p3", 3, 1), ("2", "slicemap", "p3", 3, 1)}


def test_image_scale_keeps_an_image_spread(spark):
    from skyloom.operators.aggregates import mad_scale

    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in rng.normal(5, 2, 1501)] + [("b", v) for v in (1.0, 1.0, 1.0, 4.0, None, float("nan"))] + [("c", 3.0)]
    image = spark.createDataFrame(rows, "target_id string, value double")
    found = {r["target_id"]: tuple(r)[1:] for r in images.image_scale(image, ["target_id"]).select("target_id", "n", "median", "scale").collect()}
    plain = mad_scale(image, ["target_id"], fallback_std=True).select("target_id", "n", "median", "scale").collect()
    assert len(found) == 3 and all(found[r["target_id"]] == pytest.approx(tuple(r)[1:]) for r in plain)
    pixels = spark.createDataFrame([("a", 0, k, float(k)) for k in range(20)], "target_id string, y int, x int, value double").withColumn("mask", F.lit(True))
    plan = images.robust_normalize(pixels, ["target_id"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan  # that one holds all values of an image in one task


def test_power_assign_meets_few_generators(spark):
    pixels = spark.createDataFrame([("t", y, x) for y in range(70) for x in range(60)] + [("t", 900, 700)], "target_id string, y int, x int")
    nodes = [("t", k, float((7 * k) % 60), float((7 * k) // 60), 0.5 + 0.1 * (k % 4)) for k in range(600)]
    generators = spark.createDataFrame(nodes, "target_id string, bin_id int, gx double, gy double, r double")
    met = images.met_in_cells(pixels, generators, ["target_id"], images.first_cell(0.65))
    assert met.count() / pixels.count() < 30  # 300 with cells of 16 pixels
    gx, gy, r = (np.array([n[k] for n in nodes]) for k in (2, 3, 4))
    got = images.power_assign(pixels, generators).collect()
    assert len(got) == 4201  # the far one, too
    for p in got:
        d = (p["x"] - gx) ** 2 + (p["y"] - gy) ** 2 - r * r
        assert d[p["bin_id"]] <= d.min() + 1e-9
