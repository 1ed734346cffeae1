"""Scalar functions against closed forms."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import scalar as S


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_axes_and_media(spark):
    r = one(spark, S.wave_axis(F.lit(5000.0), F.lit(1), F.lit(2.0), F.lit(4)), S.air_to_vac(S.vac_to_air(F.lit(5500.0))), S.vac_to_air(F.lit(5500.0)), S.to_angstrom(F.lit(550.0), F.lit("nm")))
    assert r[0] == [5000, 5002, 5004, 5006]
    assert math.isclose(r[1], 5500.0, rel_tol=1e-9) and 5498.4 < r[2] < 5498.5 and r[3] == 5500
    with pytest.raises(ValueError):
        S.convert_medium(F.lit(1.0), "air", "water")


def test_widths_and_polynomials(spark):
    r = one(spark, S.sigma_to_fwhm(S.fwhm_to_sigma(F.lit(3.0))), S.quadrature_diff(F.lit(5.0), F.lit(4.0)), S.quadrature_diff(F.lit(4.0), F.lit(5.0)), S.poly_eval(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(2.0)), S.support_filter(F.lit(5.0), F.lit(1.0), F.lit(6.0), F.lit(7.0)))
    assert math.isclose(r[0], 3.0) and r[1] == 3.0 and r[2] is None and r[3] == 11.0 and r[4] is None


def test_sky_round_trip(spark):
    wcs = {k: F.lit(v) for k, v in {"crval1": 150.0, "crval2": 2.0, "crpix1": 10.0, "crpix2": 12.0, "cd11": -8e-5, "cd12": 1e-6, "cd21": 2e-6, "cd22": 8e-5}.items()}
    ra, dec = S.pixel_to_world(F.lit(3.0), F.lit(20.0), wcs)
    x, y = S.world_to_pixel(ra, dec, wcs)
    dx, dy = S.tangent_offsets(ra, dec, F.lit(150.0), F.lit(2.0))
    r = one(spark, x, y, F.hypot(dx, dy), S.sky_separation(ra, dec, F.lit(150.0), F.lit(2.0)))
    assert math.isclose(r[0], 3.0, abs_tol=1e-6) and math.isclose(r[1], 20.0, abs_tol=1e-6) and math.isclose(r[2], r[3], rel_tol=1e-6)


def test_disks(spark):
    nodes = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("v")) for a, b in ((0.8, 80.0), (1.6, 120.0))])
    r = one(spark, S.inclination(F.lit(1.0), F.lit(0.2)), S.ring_grid(F.lit(0.8), F.lit(4.55), space=0.8), *[S.interpolate_nodes(F.lit(v), nodes) for v in (0.0, 0.4, 0.8, 1.2, 2.0)])
    assert r[0] == 0 and math.isclose(r[1]["radii"][-1], 4.8) and r[1]["delta"] == 0.4
    assert [v if v is None else round(v, 9) for v in r[2:]] == [0, 40, 80, 100, None]


def test_grids_and_weights(spark):
    assert S.fraction_grid(0.1, 0.9, 0.1) == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9] and S.uniform_grid(-400, 400, 17)[8] == 0
    edges = S.log_grid_edges(5000, 6000, 60)
    assert all(math.isclose(b / a, math.exp(60 / S.LIGHT_KM_S)) for a, b in zip(edges, edges[1:]))
    r = one(spark, S.relative_likelihood(F.lit(2.0)), S.relative_likelihood(F.lit(float("inf"))), S.noise_factor(F.lit(10), "log10", 0.5), S.surface_brightness_scale(F.lit("erg / arcsec 2"), F.lit(0.09)), S.grid_edge_distance([F.lit(2), F.lit(5)], (7, 7)))
    assert math.isclose(r[0], math.exp(-1)) and r[1] == 0 and r[2] == 1.5 and r[3] == 0.09 and r[4] == 1


def test_names(spark):
    header = {"CTYPE": F.lit("AWAV"), "SPECSYS": F.lit("HELIOCENT")}
    r = one(spark, S.medium_of(header), S.frame_of(header), S.normalize_medium(F.lit(" Vac ")), S.psf_choice(F.lit(None).cast("double"), F.lit(-1.0), F.lit(0.9)), S.safe_fir_window(F.lit(20), 31, 2))
    assert r[:3] == ("air", "heliocentric", "vacuum") and r[3]["fwhm"] == 0.9 and r[3]["source"] == "header" and r[4] == 19
