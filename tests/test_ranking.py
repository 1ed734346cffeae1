"""Percentiles, ranks and running sums over large groups, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import aggregates as A
from skyloom.operators import ranking as R
from skyloom.operators import sorts as S

FRACTIONS = {"a": 0.0, "b": 0.02, "c": 0.16, "d": 0.5, "e": 0.84, "f": 0.98, "g": 1.0}


def quantiles(values):
    return [float(x) for x in np.quantile(values, list(FRACTIONS.values()))]


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_percentiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 2500).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 9.0]), "heavy": 10 ** rng.uniform(-30, 30, 1500), "odd": rng.normal(size=7), None: rng.normal(size=400), "constant": np.full(900, 2.5)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r["k"]: r for r in R.exact_percentiles(df, ["k"], "v", FRACTIONS, accuracy).collect()}
    assert set(found) == {*groups, "empty"}
    for k, vs in groups.items():
        assert [found[k][c] for c in FRACTIONS] == pytest.approx(quantiles(vs), rel=1e-12), k
        assert (found[k]["n"], found[k]["lowest"], found[k]["highest"]) == (len(vs), vs.min(), vs.max())
    assert found["empty"]["n"] == 0 and all(found["empty"][c] is None for c in FRACTIONS)
    whole = R.exact_percentiles(df, [], "v", FRACTIONS, accuracy).collect()
    assert len(whole) == 1 and [whole[0][c] for c in FRACTIONS] == pytest.approx(quantiles(np.concatenate(list(groups.values()))), rel=1e-12)


def test_a_million_rows_of_one_key_stay_apart(spark, monkeypatch):
    """What is left of one key's 10^6 rows for one task: a thousandth of them."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    (row,) = R.exact_percentiles(rows, ["k"], "v", {"p": 0.5, "q": 0.95}).collect()
    assert (row["p"], row["q"], row["n"]) == ((n - 1) / 2, pytest.approx(0.95 * (n - 1)), n)
    assert R.percentile_pieces(rows, ["k"], "v", [0.5, 0.95]).count() <= 2 * 10 * n / R.ACCURACY + 10
    monkeypatch.setattr(R, "RANGE_ROWS", 100_000)
    seen = []
    keep = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    mocks = rows.select("k", F.col("v").alias("statistic"))
    observed = spark.createDataFrame([("hot", str(i), float(i)) for i in (0, 10, n // 2, n - 1)], "k string, obs_id string, statistic double")
    got = {r["obs_id"]: r["probability"] for r in A.false_positive_probability(observed, mocks, ["k"]).collect()}
    assert got == {str(i): pytest.approx((n - i + 1) / (n + 1)) for i in (0, 10, n // 2, n - 1)}
    parts = [r["count"] for r in seen[-1].groupBy("part").count().collect()]
    assert len(parts) >= 10 and max(parts) <= 2 * R.RANGE_ROWS


def test_false_positive_with_ties_and_empty_strata(spark):
    rng = np.random.default_rng(2)
    mocks = [(f"s{i % 3}", float(rng.integers(0, 12))) for i in range(700)] + [("s1", None), (None, 3.0)]
    seen = [(f"s{i % 5}", f"o{i}", float(rng.integers(-1, 14))) for i in range(60)] + [("s0", "none", None)]
    got = {r["obs_id"]: (r["probability"], r["n_mocks"]) for r in A.false_positive_probability(spark.createDataFrame(seen, "s string, obs_id string, statistic double"), spark.createDataFrame(mocks, "s string, statistic double"), ["s"]).collect()}
    want = {}
    for s, i, v in seen:
        mine = [m for t, m in mocks if t == s and m is not None]
        if mine and v is not None:
            want[i] = ((sum(m >= v for m in mine) + 1) / (len(mine) + 1), len(mine))
    assert got == want


def test_first_examples_and_ids(spark):
    rows = [("t", "r", i * 7 % 501, i, float(i)) for i in range(501)]
    bins = spark.createDataFrame(rows, "target_id string, arm string, bin_id int, n_good int, sn double").repartition(6)
    (got,) = S.example_bins(bins, "bin_id > 3", 5).collect()
    assert [x["bin_id"] for x in got["examples"]] == [4, 5, 6, 7, 8]
    ids = S.contiguous_ids(bins.where("bin_id % 3 = 0").union(bins.where("bin_id = 9")))
    assert sorted((r["bin_id"], r["new_id"]) for r in ids.collect()) == [(3 * k, k) for k in range(167)]
