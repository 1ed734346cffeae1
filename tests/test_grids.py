"""Profile likelihoods by block products, single fits over dispersions and templates, and the preflight before a grid."""

from __future__ import annotations

import numpy as np
import pytest

from skyloom.operators import grids as G
from skyloom.operators import lines as L


@pytest.fixture(scope="module")
def problem(spark):
    """Three bins of 60 pixels, one of them with gaps, and 289 models, some of which lack pixels."""
    rng = np.random.default_rng(4)
    models = {i: {p: float(v) for p, v in enumerate(rng.normal(1, 0.4, 60)) if i % 5 or p > 20} for i in range(289)}
    bins = {f"b{k}": {p: (float(rng.normal(1, 0.3)), float(rng.uniform(0.1, 0.5))) for p in range(60) if k or p % 3} for k in range(3)}
    spectra = spark.createDataFrame([(k, p, *x) for k, ps in bins.items() for p, x in ps.items()], "bin_id string, pix int, flux double, unc double").repartition(3)
    nodes = spark.createDataFrame([(i, p, v) for i, ps in models.items() for p, v in ps.items()], "node int, pix int, model double").repartition(3)
    return bins, models, spectra, nodes


def dense(pixels, n=60):
    out = np.zeros(n)
    for p, v in pixels.items():
        out[p] = v
    return out


def test_block_products_of_289_models(problem):
    bins, models, spectra, nodes = problem
    m = np.array([dense(models[i]) for i in range(289)])
    found = G.template_moments(spectra, nodes, ("bin_id",), pairs=True).toPandas()
    assert len(found) == 3 * 289 * 290 // 2 and (found["a"] <= found["b"]).all() and not found.duplicated(["bin_id", "a", "b"]).any()
    for k, pixels in bins.items():
        w, f = dense({p: 1 / u**2 for p, (_, u) in pixels.items()}), dense({p: x for p, (x, _) in pixels.items()})
        d, gram = m @ (w * f), (m * w) @ m.T
        rows = found[found["bin_id"] == k]
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        assert np.allclose(rows["mab"], gram[a, b]) and np.allclose(rows["maa"], gram[a, a]) and np.allclose(rows["mbb"], gram[b, b])
        assert np.allclose(rows["da"], d[a]) and np.allclose(rows["db"], d[b]) and np.allclose(rows["s"], (w * f * f).sum()) and set(rows["n_pix"]) == {len(pixels)}


def test_shares_and_blocks_do_not_matter(problem, monkeypatch):
    _, _, spectra, nodes = problem
    few = nodes.where("node < 20")
    want = G.one_component_fit(spectra, few, ("bin_id",)).toPandas().sort_values("bin_id")
    monkeypatch.setattr(G, "BLOCK_NODES", 3)
    monkeypatch.setattr(G, "SHARE_BINS", 1)
    got = G.one_component_fit(spectra, few, ("bin_id",)).toPandas().sort_values("bin_id")
    assert np.allclose(want.drop(columns="bin_id").astype(float), got.drop(columns="bin_id").astype(float)) and list(want["node"]) == list(got["node"])
    pairs = G.template_moments(spectra, few, ("bin_id",), pairs=True).toPandas()
    assert len(pairs) == 3 * 210 and not pairs.duplicated(["bin_id", "a", "b"]).any()


@pytest.fixture(scope="module")
def moved(spark):
    """Bins that are one template at a known shift and width; states over 9 shifts, 2 widths, 2 templates."""
    x = np.arange(80)
    line = lambda t, v, s: 1 + (0.8 if t else -0.6) * np.exp(-0.5 * ((x - 40 - v - 3 * t) / (3 + 2 * s)) ** 2)
    states = [(n, float(v), float(s), t) for n, (v, s, t) in enumerate((v, s, t) for v in range(-4, 5) for s in (0, 1) for t in (0, 1))]
    nodes = spark.createDataFrame([(n, int(p), float(y)) for n, v, s, t in states for p, y in enumerate(line(t, v, s))], "node int, pix int, model double")
    axes = spark.createDataFrame(states, "node int, velocity double, sigma double, template int")
    truth = {"a": (2.0, 1.0, 0), "b": (-3.0, 0.0, 1), "far": (4.0, 0.0, 0)}
    rows = [("t", k, int(p), 2.5 * float(y), 0.1) for k, (v, s, t) in truth.items() for p, y in enumerate(line(t, v, s))]
    rows += [("t", "lone", 500 + p, 1.0, 0.1) for p in range(90)]
    return truth, spark.createDataFrame(rows, "target_id string, bin_id string, pix int, flux double, unc double"), nodes, axes


def test_single_fit_over_velocity_dispersion_and_template(moved):
    truth, spectra, nodes, axes = moved
    bounds = G.velocity_bounds([-2.0, 2.0], 1.5)
    best, profile = G.single_fit(spectra, nodes, axes, bounds)
    found = {r["bin_id"]: r for r in best.collect()}
    assert set(found) == {*truth, "lone"} and not found["lone"]["success"] and found["lone"]["chi2"] is None
    for k in ("a", "b"):
        assert (found[k]["velocity"], found[k]["sigma"], found[k]["template"]) == truth[k] and found[k]["success"]
        assert found[k]["amplitude"] == pytest.approx(2.5) and abs(found[k]["chi2"]) < 1e-6
    assert found["far"]["velocity"] <= 3 and found["far"]["chi2"] > 1 and found["b"]["at_bound"] and not found["a"]["at_bound"]
    rows = profile.collect()
    assert {r["velocity"] for r in rows} == {-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0} and len(rows) == 21


def test_grid_runs_only_behind_its_preflight(spark, moved, monkeypatch):
    _, spectra, nodes, axes = moved
    fractions = spark.createDataFrame([(0, 0.25), (1, 0.5), (2, 0.75)], "i_f int, f double")
    bounds = G.velocity_bounds([-4.0, 4.0], 0.5)
    covered = spectra.where("bin_id <> 'lone'")
    verdict, single, corners = L.coverage_preflight(covered, nodes, axes, bounds, fractions.where("i_f = 1"))
    rows = verdict.collect()
    assert {r["bin_id"] for r in rows} == {"a"} and all(r["ready"] and r["n_corners"] == 4 for r in rows)  # all bins are alike: the first stands for all
    assert {(r["va"], r["vb"]) for r in corners.collect()} == {(a, b) for a in (-4.0, 4.0) for b in (-4.0, 4.0)} and single.count() == 1
    corner_nodes = nodes.join(axes.where("velocity in (-4, 4) and sigma = 0 and template = 0").select("node"), "node")
    grid = L.gated_grid(covered, nodes.join(corner_nodes.select("node").distinct(), "node"), axes, bounds, fractions)
    assert grid.count() == 3 * 4 * 3
    ran = []
    monkeypatch.setattr(G, "two_component_grid", lambda *a, keep=G.two_component_grid: ran.append(a[2].count()) or keep(*a))
    with pytest.raises(RuntimeError, match="bin_id lone .single fit False, 0 corners"):
        L.gated_grid(spectra, nodes, axes, bounds, fractions)
    assert ran == [1] or ran == []  # the corners at most; never the grid of all fractions
