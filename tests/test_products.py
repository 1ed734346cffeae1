"""Products that grow by runs, width models of several forms, draws until they settle, basins on two grids."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import scalar as S
from skyloom.operators import designed as D
from skyloom.operators import sampling as P
from skyloom.sources import prepared as R
from skyloom.sources import registry
from skyloom.streaming import resume

SCHEMA = "target_id string, bin_id string, fingerprint string, ia int, chi2 double"


def states(spark, rows):
    return spark.createDataFrame([("t", b, f, i, float(c)) for b, f, cs in rows for i, c in enumerate(cs)], SCHEMA)


def product(spark, at):
    return sorted((r["bin_id"], r["ia"], r["chi2"]) for r in resume.read_consolidated(spark, f"{at}/product", SCHEMA).collect())


def test_a_killed_consolidation_runs_again_to_the_same_product(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}"
    run = lambda: resume.consolidate_available(spark, f"{at}/checkpoints", SCHEMA, f"{at}/product", f"{at}/progress", "now").awaitTermination()
    first = states(spark, [("a", "now", [3, 1, 2]), ("b", "old", [9, 9])])
    first.repartition(3).write.mode("append").parquet(f"{at}/checkpoints")
    from pyspark.sql.readwriter import DataFrameWriter

    keep = DataFrameWriter.parquet

    def dies(self, path, *args, **more):
        keep(self, path, *args, **more)
        raise RuntimeError("killed after the batch was written")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(DataFrameWriter, "parquet", keep)
    run()
    assert product(spark, at) == [("a", 0, 3.0), ("a", 1, 1.0), ("a", 2, 2.0)]
    run()  # nothing is new
    states(spark, [("b", "now", [5, 4]), ("a", "now", [8, 7, 6])]).write.mode("append").parquet(f"{at}/checkpoints")
    run()
    assert product(spark, at) == [("a", 0, 8.0), ("a", 1, 7.0), ("a", 2, 6.0), ("b", 0, 5.0), ("b", 1, 4.0)]
    whole = resume.read_consolidated(spark, f"{at}/product", SCHEMA)
    every = spark.createDataFrame([("t", b) for b in "abc"], "target_id string, bin_id string")
    todo = registry.resume_pending(every, whole.select("target_id", "bin_id", "fingerprint").distinct(), ("target_id", "bin_id"), "now")
    assert [r["bin_id"] for r in todo.collect()] == ["c"]
    one = spark.createDataFrame([("t", "a", 9.5)], "target_id string, bin_id string, chi2 double")
    found = {r["bin_id"]: r for r in R.consolidated(whole, one, axes=("ia",)).collect()}
    assert (found["a"]["chi2_two"], found["a"]["ia"], found["a"]["delta"]) == (6.0, 2, 3.5) and found["b"]["delta"] is None


WIDTHS = "target_id string, arm string, coeffs array<double>, support_min double, support_max double, model_wave array<double>, model_fwhm array<double>, line_wavelengths array<double>, line_fwhms array<double>"


def widths(spark, *rows, **more):
    return R.line_width_table(spark.createDataFrame([("t", "a", *r) for r in rows], WIDTHS), **more)


def test_width_models_prefer_coefficients_then_grids_then_lines(spark):
    wave = [5000.0 + 10 * k for k in range(8)]
    line = [1 + 1e-3 * w for w in wave]
    both = widths(spark, ([2.0], 5000.0, 5100.0, wave, line, wave, line), n=11).toPandas()
    assert set(both["form"]) == {"polynomial"} and len(both) == 11 and set(both["fwhm"]) == {2.0}
    no_ends = widths(spark, ([2.0], None, None, wave, line, wave[:5], line[:5]), order=1).toPandas()  # no support, so the grid, within the lines
    assert set(no_ends["form"]) == {"grid"} and list(no_ends["wave"].sort_values()) == wave[:5]
    odd = widths(spark, (None, None, None, wave, line[:4], [*wave, 9000.0], [*line, -1.0]), n=5, order=1).toPandas().sort_values("wave")  # arrays of two lengths are no grid
    assert set(odd["form"]) == {"lines"} and np.allclose(odd["wave"], np.linspace(5000, 5070, 5)) and np.allclose(odd["fwhm"], 1 + 1e-3 * odd["wave"])
    cut = widths(spark, (None, 5005.0, 5065.0, wave, [*line[:4], float("nan"), *line[5:]], None, None)).toPandas()
    assert sorted(cut["wave"]) == [5010.0, 5020.0, 5030.0, 5050.0, 5060.0]


@pytest.mark.parametrize(
    ("row", "message"),
    [
        ((None, None, None, None, None, [1.0, 2.0, 3.0], [1.0, 1.0, 1.0]), "no usable form"),
        (([1.0], 5.0, 5.0, None, None, None, None), "invalid support"),
        (([float("nan")], 5.0, 6.0, None, None, None, None), "invalid support or coefficients"),
        (([-1.0], 5.0, 6.0, None, None, None, None), "fewer than four"),
        ((None, 0.0, 1.0, [5.0, 6.0, 7.0, 8.0], [1.0, 1.0, 1.0, 1.0], None, None), "fewer than four"),
    ],
)
def test_unusable_width_models_are_errors(spark, row, message):
    with pytest.raises(Exception, match=message):
        widths(spark, row, order=1).collect()


def test_missing_template_widths_come_from_the_template_then_from_all(spark, tmp_path):
    rows = [("a", k, 5000.0 + k, 1.0, w) for k, w in enumerate([2.0, None, 4.0])] + [("b", k, 5000.0 + k, 1.0, None) for k in range(2)] + [("c", 0, 5000.0, 1.0, 10.0)]
    spark.createDataFrame(rows, "template_id string, pix int, wave double, value double, fwhm double").write.parquet(str(tmp_path / "t"))
    found = {(r["template_id"], r["pix"]): r["fwhm"] for r in R.read_templates(spark, str(tmp_path / "t")).collect()}
    assert found == {("a", 0): 2.0, ("a", 1): 3.0, ("a", 2): 4.0, ("b", 0): 4.0, ("b", 1): 4.0, ("c", 0): 10.0}


def test_draws_go_on_until_they_settle_or_run_out(spark):
    rows = [("t", "narrow", i, 1.0 if i == 3 else 0.0, 3.0 + i) for i in range(6)]
    rows += [("t", "wide", i, 1 / 400, float(i)) for i in range(400)]
    cells = spark.createDataFrame(rows, "target_id string, bin_id string, cell int, p double, x double")
    last, history = P.sample_until_converged(cells, "x", least=100, batch=50, most=320, fraction=0.01, passes=2)
    found = {r["bin_id"]: r for r in last.collect()}
    assert (found["narrow"]["n_draws"], found["narrow"]["converged"]) == (320, False)  # no spread: no change is below no tolerance
    settled, _ = P.sample_until_converged(cells, "x", least=100, batch=50, most=2000, fraction=0.2, floor=0.5, passes=2)
    got = {r["bin_id"]: r for r in settled.collect()}
    assert got["narrow"]["converged"] and got["narrow"]["n_draws"] == 200 and got["narrow"]["p50"] == 6.0
    assert got["wide"]["converged"] and got["wide"]["n_draws"] < 2000 and not got["wide"]["at_limit"] and abs(got["wide"]["p50"] - 200) < 40
    steps = sorted(r["n_draws"] for r in history.where("bin_id = 'wide'").collect())
    assert steps == [100, 150, 200, 250, 300, 320] and found["wide"]["at_limit"] == (not found["wide"]["converged"])
    draws = P.draw_states(cells.where("bin_id = 'wide'"), 320)
    parts = P.draw_states(cells.where("bin_id = 'wide'"), 100).unionByName(P.draw_states(cells.where("bin_id = 'wide'"), 320, first=100))
    assert {tuple(r) for r in draws.collect()} == {tuple(r) for r in parts.collect()}


def test_inclination_prior_against_fine_quadrature(spark):
    q, qe, q0, q0e = 0.55, 0.06, 0.2, 0.03
    z = np.array([math.sqrt(2) * _erfinv(2 * (k + 0.5) / 600 - 1) for k in range(600)])
    a, b = np.clip(q + qe * z[:, None], 1e-4, 1), np.clip(q0 + q0e * z[None, :], 0, 0.999)
    incl = np.degrees(np.arccos(np.sqrt(np.clip((a * a - b * b) / (1 - b * b), 0, 1)))).ravel()
    targets = spark.createDataFrame([("t", q, qe, q0, q0e)], "target_id string, q double, qe double, q0 double, q0e double")
    r = P.inclination_prior(targets, 4000).first()
    assert [r["p16"], r["p50"], r["p84"]] == pytest.approx(list(np.quantile(incl, [0.16, 0.5, 0.84])), abs=0.1)


def test_inclination_prior_of_many_targets(spark):
    """One row a target without a row a draw; repeated, NULL and NaN rows as the plain aggregate has them."""
    rows = [(k, 0.2 + 0.7 * k / 3000, 0.001 * (k % 90), 0.2, 0.03) for k in range(3000)]
    rows += [(7, 0.9, 0.1, 0.1, 0.05), (7, 0.3, 0.02, 0.3, 0.01), (8, None, 0.1, 0.2, 0.03), (9, 0.4, float("nan"), 0.2, 0.03), (None, 0.5, 0.1, 0.2, 0.03), (-1, 0.5, 0.1, None, 0.03)]
    targets = spark.createDataFrame(rows, "target_id long, q double, qe double, q0 double, q0e double")
    found = P.inclination_prior(targets, 50)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    draws = targets.select("*", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("d"))
    u, v = (F.lit(0.5) + F.col("d") * s for s in P.PLASTIC)
    radius, turn = F.sqrt(-2 * F.log(u - F.floor(u))), 2 * F.pi() * (v - F.floor(v))
    q = F.least(F.lit(1.0), F.greatest(F.lit(1e-4), F.col("q") + F.col("qe") * radius * F.cos(turn)))
    q0 = F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("q0") + F.col("q0e") * radius * F.sin(turn)))
    plain = draws.groupBy("target_id").agg(F.percentile(S.inclination(q, q0), F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("p"))
    want = {r["target_id"]: r["p"] for r in plain.collect()}
    got = {r["target_id"]: [r["p16"], r["p50"], r["p84"]] for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def _erfinv(y):
    lo, hi = -6.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return lo


def test_basins_of_two_grids_are_matched(spark):
    bowl = lambda x, centres: min((x - c) ** 2 + d for c, d in centres)
    fine = [("t", "b", i, bowl(i, [(4, 0), (20, 1), (33, 2)])) for i in range(40)]
    coarse = [("t", "b", i, bowl(2 * i, [(4, 0), (20, 1)])) for i in range(20)]
    frame = lambda rows: spark.createDataFrame([(t, b, i, float(c)) for t, b, i, c in rows], "target_id string, bin_id string, ia int, chi2 double")
    # the second coarse basin holds two fine ones, the first a cell of its neighbour's, where the grids draw the border otherwise
    found = D.grid_resolution_compare(frame(coarse), frame(fine), 2, axes=("ia",)).first()
    assert (found["n_coarse"], found["n_fine"], found["n_matched"], found["n_split"]) == (2, 3, 2, 2) and 0.6 < found["agreement"] < 1
    same = D.grid_resolution_compare(frame(fine), frame(fine), 1, axes=("ia",)).first()
    assert same["agreement"] == 1 and same["n_matched"] == 3 and same["n_split"] == 0

