"""Operators on literal rows: the small cases that a reader can check by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import aggregates as A
from skyloom.operators import filters as L
from skyloom.operators import grids as G
from skyloom.operators import images as I
from skyloom.operators import joins as J
from skyloom.operators import sampling as P
from skyloom.operators import sorts as S
from skyloom.operators import tiles
from skyloom.operators import windows as W

K = ("target_id", "arm")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_masks_of_a_small_cube(spark):
    rows = [("t", "BL", y, x, c, 8400 + 0.5 * c, 1.0, 0.2, c == 3 and y == 1 and x == 1, 128 if c == 7 else 0) for y in range(4) for x in range(5) for c in range(20)]
    cube = frame(spark, rows, "target_id string, arm string, y int, x int, chan int, wave double, flux double, unc double, mask boolean, flags int")
    out = L.hard_masks(cube, K, w0=8401.0, w1=8408.0, reject_flags=True, has_exposure=False)
    assert out.where("good and chan = 7").count() == 0
    assert out.where("not good and chan = 3 and y = 1 and x = 1").count() == 1
    assert out.where("good").select("y", "x").distinct().count() == 20


def test_padding_does_not_count(spark):
    rows = []
    for y in range(6):
        for x in range(8):
            inside = 1 <= y <= 4 and 2 <= x <= 5
            rows += [("t", "BL", y, x, c, 5000.0 + c, 2.0 * inside, 0.2 * inside, not inside, 0, 1200.0 * inside) for c in range(12)]
    cube = frame(spark, rows, "target_id string, arm string, y int, x int, chan int, wave double, flux double, unc double, mask boolean, flags int, exposure double")
    out = L.hard_masks(cube, K, w0=5001.0, w1=5010.0)
    assert out.where("good_wave").select("chan").distinct().count() == 10 and out.where("good_spaxel").select("y", "x").distinct().count() == 16


def test_coadd_scale_and_missing(spark):
    rows = [("t", "BL", y, x, c, 1.0 * c, 1.0, 1.0, not (c == 1 and x == 0 and y == 0)) for y in range(2) for x in range(2) for c in range(4)]
    samples = frame(spark, rows, "target_id string, arm string, y int, x int, chan int, wave double, flux double, unc double, good boolean")
    members = frame(spark, [("t", "BL", y, x, y) for y in range(2) for x in range(2)], "target_id string, arm string, y int, x int, bin_id int")
    out = {(r["bin_id"], r["chan"]): r for r in A.coadd_bins(samples, members, pixel_area=0.09, min_members=1.0).collect()}
    assert math.isclose(out[1, 0]["flux"], 0.18) and math.isclose(out[1, 0]["unc"], math.sqrt(2) * 0.09) and out[1, 0]["n_contrib"] == 2
    assert out[0, 1]["flux"] is None and not out[0, 1]["good"] and out[0, 1]["n_contrib"] == 1


@pytest.mark.parametrize(("flux", "n", "sn", "signed"), [(5.0, 5, 5.0, 5.0), (-20000.0, 5, None, -20000.0), (5.0, 3, None, None)])
def test_signal_to_noise(spark, flux, n, sn, signed):
    rows = [("t", "BL", 1, c, 5000.0 + c, flux, 1.0, True) for c in range(n)]
    bins = frame(spark, rows, "target_id string, arm string, bin_id int, chan int, wave double, flux double, unc double, good boolean")
    r = A.achieved_sn(bins, 4990, 5100, min_channels=5).first()
    assert r["n_good"] == n and r["sn"] == sn and r["signed"] == signed


def test_window_coverage(spark):
    rows = [("t", "BL", i, 8800.0 + i, True) for i in range(131)]
    r = L.window_coverage(frame(spark, rows, "target_id string, arm string, chan int, wave double, good boolean"), 8820, 9060).first()
    assert r["truncated_red"] and not r["truncated_blue"]
    rows = [("t", "BL", i, 5000.0 + i, not 40 <= i <= 50) for i in range(101)]
    r = L.window_coverage(frame(spark, rows, "target_id string, arm string, chan int, wave double, good boolean"), 5010, 5090).first()
    assert not r["truncated_red"] and not r["truncated_blue"] and r["envelope_fraction"] == 1


def test_capacity_and_aperture(spark):
    rows = [("t", "BL", 0, 4.0, 1.0)] * 4
    four = frame(spark, rows, "target_id string, arm string, bin_id int, signal double, noise double")
    assert A.bin_capacity(four).first()["sn"] == 8 and A.bin_capacity(four, law=A.summed_sn("log10", 0.5)).first()["sn"] < 8
    rows = [("t", "BL", y, x, 5.0 if 8 <= y <= 12 and 8 <= x <= 12 else 9.0 if y < 3 and x < 3 else 0.0, 1.0, True) for y in range(21) for x in range(21)]
    image = frame(spark, rows, "target_id string, arm string, y int, x int, signal double, noise double, good boolean")
    centre = frame(spark, [("t", "BL", 10, 10)], "target_id string, arm string, cy int, cx int")
    got = {(r["y"], r["x"]) for r in I.analysis_aperture(image, centre, threshold=2.0, sigma=0.0, grow=0).collect()}
    assert got == {(y, x) for y in range(8, 13) for x in range(8, 13)}


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    on = rng.random((24, 30)) < 0.6
    out = {(r["y"], r["x"]): r["label"] for r in I.connected_components(frame(spark, [("t", "BL", int(y), int(x)) for y, x in np.argwhere(on)], "target_id string, arm string, y int, x int"), width=30).collect()}
    seen: dict = {}
    for y, x in np.argwhere(on):
        if (y, x) in seen:
            continue
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < 24 and 0 <= b < 30 and on[a, b] and (a, b) not in seen:
                seen[a, b] = y * 30 + x
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert {(int(a), int(b)): int(v) for (a, b), v in seen.items()} == out


def test_registration_finds_a_shift(spark):
    yy, xx = np.mgrid[0:40, 0:50]
    image = lambda dy, dx: np.exp(-((yy - 20 - dy) ** 2 + (xx - 25 - dx) ** 2) / 18)
    table = lambda a: frame(spark, [("t", int(y), int(x), float(a[y, x]), True) for y in range(40) for x in range(50)], "target_id string, y int, x int, value double, mask boolean")
    r = I.register_pair(table(image(0, 0)), table(image(2, -1)), 4, contrast=1.0).first()
    assert r["valid"] and abs(r["dy"] + 2) < 0.6 and abs(r["dx"] - 1) < 0.6


def test_registration_of_images_that_overlap_only_when_shifted(spark):
    yy, xx = np.mgrid[0:30, 0:8]
    values = np.random.default_rng(6).normal(size=(30, 8))
    rows = lambda t, dy: [(t, int(y + dy), int(x), float(v)) for y, x, v in zip(yy.ravel(), xx.ravel(), values.ravel())]
    left = [r for r in rows("t", 0) if r[1] < 14]
    right = [(t, y - 14, x, v) for t, y, x, v in rows("t", 14) if y - 14 < 14]
    apart = [(t, y + 14, x, v) for t, y, x, v in right]  # the same values, 14 rows further: no pixel in common
    a, b = (frame(spark, r + rows("u", d), "target_id string, y int, x int, v double") for r, d in ((left, 0), (apart, 1)))
    found = {r["target_id"]: r for r in I.registration_shift(a, b, 15).collect()}
    assert (found["t"]["ly"], found["t"]["lx"], found["t"]["n"]) == (-14, 0, 112) and (found["u"]["ly"], found["u"]["lx"]) == (-1, 0)
    whole = lambda d: d.withColumnRenamed("v", "value").withColumn("mask", F.lit(True))
    kept = {r["target_id"]: r for r in I.register_pair(whole(a), whole(b), 4, contrast=0.1).collect()}
    assert kept["t"]["reason"] == "no overlap" and not kept["t"]["valid"] and kept["t"]["overlap_fraction"] == 0
    assert kept["u"]["valid"] and abs(kept["u"]["dy"] + 1) < 0.5 and kept["u"]["overlap_fraction"] == pytest.approx(29 / 30)


@pytest.mark.parametrize("side", [7, 16])
def test_tiles_do_not_show(spark, monkeypatch, side):
    """Smoothing, significance and correlation of images that span several tiles, against whole arrays."""
    rng = np.random.default_rng(9)
    v = np.where(rng.random((40, 33)) < 0.15, np.nan, rng.normal(size=(40, 33)))
    gone = {(3, 4), (20, 20), (39, 32)}  # pixels without a row
    rows = [("t", "a", y, x, None if np.isnan(v[y, x]) else float(v[y, x])) for y in range(40) for x in range(33) if (y, x) not in gone]
    img = frame(spark, rows, "target_id string, arm string, y int, x int, value double")
    patched = tiles.over_tiles
    monkeypatch.setattr(tiles, "over_tiles", lambda *args, tile=side, **more: patched(*args, tile=tile, **more))
    k = np.array(I.gaussian_1d(1.0, 4))
    num, den = np.nan_to_num(v), (~np.isnan(v)).astype(float)
    have = np.ones(v.shape, bool)
    for p in gone:
        have[p], num[p], den[p] = False, 0, 0
    for axis, n in ((0, 40), (1, 33)):
        at = np.clip(np.arange(n)[:, None] + np.arange(-4, 5), 0, n - 1)
        num, den = (np.where(have, np.moveaxis(np.take(z, at, axis=axis) if axis else z[at], axis + 1, -1) @ k, 0) for z in (num, den))
    got = {(r["y"], r["x"]): r["smooth"] for r in I.smooth_image(img, 1.0).collect()}
    assert set(got) == {(y, x) for y, x in np.argwhere(have)} and all(got[y, x] == pytest.approx(num[y, x] / den[y, x]) for y, x in got)
    ok = have & ~np.isnan(v)
    s = {(int(y), int(x)): float(v[y, x]) for y, x in np.argwhere(ok)}
    signal = img.selectExpr("target_id", "arm", "y", "x", "value signal", "1.5D noise", "value is not null valid")
    found = {(r["y"], r["x"]): r["significance"] for r in I.smoothed_significance(signal, 1.0).collect()}
    assert set(found) == set(s)
    for y, x in list(s)[::37]:
        near = [(k[dy + 4] * k[dx + 4], s[y + dy, x + dx]) for dy in range(-4, 5) for dx in range(-4, 5) if (y + dy, x + dx) in s]
        assert found[y, x] == pytest.approx(sum(w * z for w, z in near) / math.sqrt(sum((1.5 * w) ** 2 for w, _ in near)))
    a, b = ({p: z for p, z in s.items() if (p[0] + p[1]) % m} for m in (5, 3))
    as_rows = lambda d: frame(spark, [("t", y, x, z) for (y, x), z in d.items()], "target_id string, y int, x int, v double")
    sums = {(r["ly"], r["lx"]): (r["s"], r["n"]) for r in J.shift_pairs(as_rows(a), as_rows(b), 2, 3).collect()}
    for (ly, lx), (total, n) in sums.items():
        pairs = [a[y + ly, x + lx] * z for (y, x), z in b.items() if (y + ly, x + lx) in a]
        assert n == len(pairs) and total == pytest.approx(sum(pairs))
    assert len(sums) == 35


def test_transfer_identity(spark):
    members = frame(spark, [("t", y, x, (y * 5 + x) % 3) for y in range(5) for x in range(5)], "target_id string, y int, x int, bin_id int")
    wcs = frame(spark, [("t", 150.0, 2.0, 1.0, 1.0, -0.3 / 3600, 0.0, 0.0, 0.3 / 3600)], "target_id string, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double")
    out = J.transfer_membership(members.withColumn("good", F.lit(True)).drop("bin_id"), members, wcs, wcs, scale=0.3, max_distance=0.1)
    assert {tuple(r)[:4] for r in out.collect()} == {tuple(r) for r in members.collect()}
    assert J.check_sampling(wcs, wcs, 1e-6).first()["same"]


def test_rebin_conserves_flux(spark):
    rows = [("t", 0, c, 5000.0 + 2 * c, 1.0 + 0.1 * c, 0.1, True) for c in range(200)]
    spectra = frame(spark, rows, "target_id string, bin_id int, chan int, wave double, flux double, unc double, good boolean")
    step = 3e-4
    out = [r for r in J.overlap_rebin(spectra, 5010.0, step, 200).collect() if r["coverage"] > 0.999]
    for r in out:
        assert abs(r["flux"] - (1 + 0.1 * (r["wave"] - 5000) / 2)) < 0.02 and r["good"]
    assert len(out) > 190


def test_weights_masses_draws(spark):
    states = frame(spark, [("t", 0, 0, 0, i, w) for i, w in enumerate((0.6, 0.3, 0.1))], "target_id string, bin_id int, ia int, ib int, jf int, weight double")
    assert tuple(S.mass_cell_counts(states, (0.5, 0.9, 1.0)).first())[2:] == (1, 2, 3)
    p = P.normalize_weights(states).withColumn("cell", F.col("jf"))
    draws = P.draw_states(p, 4000, seed=3)
    n = {r["cell"]: r["count"] for r in draws.groupBy("cell").count().collect()}
    assert sum(n.values()) == 4000 and all(abs(n[i] / 4000 - w) < 0.03 for i, w in enumerate((0.6, 0.3, 0.1)))
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, P.draw_states(p.repartition(3), 4000, seed=3).collect()))
    assert P.effective_sample_size(states.withColumn("weight", F.lit(1.0)), ("bin_id",)).first()["ess"] == 3


def test_two_minima(spark):
    states = frame(spark, [("t", 0, i, v) for i, v in enumerate((2.0, 0.0, 1.0, 5.0, 2.0, 0.5, 2.0))], "target_id string, bin_id int, ia int, chi2 double")
    ends = {r["ia"]: r["m_ia"] for r in G.basins(states, axes=("ia",)).collect()}
    assert ends == {0: 1, 1: 1, 2: 1, 3: 2 if ends[3] == 2 else ends[3], 4: 5, 5: 5, 6: 5} and ends[3] in (1, 5)


def test_likelihood_grid_is_the_direct_fit_and_symmetric(spark):
    rng = np.random.default_rng(4)
    t = rng.random((3, 40)) + 0.2
    d, s = 0.4 * t[0] + 0.9 * t[2] + rng.normal(0, 0.05, 40), rng.random(40) * 0.1 + 0.05
    spectra = frame(spark, [("t", 0, k, float(d[k]), float(s[k])) for k in range(40)], "target_id string, bin_id int, pix int, flux double, unc double")
    nodes = frame(spark, [(n, k, float(t[n, k])) for n in range(3) for k in range(40)], "node int, pix int, model double")
    fractions = frame(spark, [(0, 0.25), (1, 0.5), (2, 0.75)], "i_f int, f double")
    out = {(r["a"], r["b"], r["f"]): r["chi2"] for r in G.two_component_grid(spectra, nodes, fractions).collect()}
    for (a, b, f), chi2 in out.items():
        m = f * t[a] + (1 - f) * t[b]
        amp = max(0, (d * m / s**2).sum() / (m * m / s**2).sum())
        assert math.isclose(chi2, (((d - amp * m) / s) ** 2).sum(), rel_tol=1e-8) and math.isclose(chi2, out[b, a, 1 - f], rel_tol=1e-8)


def test_white_noise_has_no_correlation(spark):
    rng = np.random.default_rng(2)
    z = rng.standard_normal((60, 120))
    rows = frame(spark, [("t", "BL", i, k, float(z[i, k])) for i in range(60) for k in range(120)], "target_id string, arm string, spaxel int, chan int, z double")
    c = {r["lag"]: r["correlation"] for r in A.spectral_correlation(rows, 4).collect()}
    assert c[0] == 1 and all(abs(c[k]) < 0.15 for k in range(1, 5))


def test_line_widths(spark):
    k = np.arange(150)
    wave = 8400 + 0.2 * k
    v = 10 + sum(500 * np.exp(-0.5 * ((wave - c) / 0.5) ** 2) for c in (8407, 8414, 8421))
    pixels = frame(spark, [("t", int(i), float(w), float(x), 0.2) for i, w, x in zip(k, wave, v)], "target_id string, k int, wave double, value double, step double")
    base = W.running_median_baseline(pixels.withColumn("v", F.col("value")), 10, ("target_id",)).withColumn("high", F.col("v") - F.col("base"))
    peaks = W.find_peaks(base, 8, ("target_id",))
    fits = W.line_fit(peaks, pixels, 12, ("target_id",)).orderBy("centre").collect()
    assert [round(r["centre"]) for r in fits] == [8407, 8414, 8421] and all(abs(r["fwhm"] - 1.1774) < 0.1 for r in fits)


def test_robust_polyfit_ignores_outliers(spark):
    rows = [("t", float(x), 3 + 2.0 * x + 0.5 * x * x + (500 if x in (3, 17) else 0) + 0.05 * math.sin(3.1 * x)) for x in range(30)]
    r = A.robust_polyfit(frame(spark, rows, "target_id string, x double, y double"), 2).first()
    u = 7 - r["x_mean"]
    assert r["n"] == 28 and abs(r["coeffs"][0] * u * u + r["coeffs"][1] * u + r["coeffs"][2] - (3 + 14 + 24.5)) < 0.05


def test_no_cross_products_between_facts(spark):
    from skyloom.plans import stage1, stage2

    d = "/root/testdata/sf0.001"
    for name in ("q_rebin", "q_transfer", "q_reproject", "q_interp"):
        plan = (stage1.QUERIES | stage2.QUERIES)[name](spark, d)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan


def test_adaptive_bins_of_a_tall_image(spark):
    rows = spark.range(0, 4 * 9000).selectExpr("'t' AS target_id", "cast(id div 4 AS int) AS y", "cast(id % 4 AS int) AS x", "1.0D AS signal", "1.0D AS noise")
    found = I.adaptive_bins(rows, 4.0, rounds=0)  # the seeds: 16 pixels each
    bins = found.groupBy("bin_id").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("extent")).collect()
    assert sorted(r["bin_id"] for r in bins) == list(range(len(bins))) and sum(r["n"] for r in bins) == rows.count()
    assert max(r["extent"] for r in bins) < 16 and max(r["n"] for r in bins) <= 17
