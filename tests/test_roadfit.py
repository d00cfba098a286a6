import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.operators import fit, intensity, roadfit, simulate

G = np.array([0.55, 0.30, 0.15])
ROAD = np.array([[0.0, 300.0, 900.0], [300.0, 0.0, 600.0], [900.0, 600.0, 0.0]])
NEAR = np.array([[0.0, 10.0, 20.0], [10.0, 0.0, 12.0], [20.0, 12.0, 0.0]])


def _edges(spark, seconds):
    return spark.createDataFrame([(i, j, float(seconds[i][j])) for i in range(len(seconds)) for j in range(len(seconds)) if i != j], "i int, j int, travel_time_s double")


def _counts(seconds, mu, alpha, beta, kernel, steps, seed, dispersion=None):
    w = simulate.road_weight_matrix(seconds, beta)
    return simulate.counts(w, simulate.Params(np.array(mu), alpha, np.array(kernel)), steps, seed, "negbin" if dispersion else "poisson", dispersion)["y_true"]


def test_table_fit_equals_the_array_fit(spark):
    y = _counts(ROAD, [0.6, 0.9, 0.5], 0.35, 1.2e-3, G, 180, 3)
    want = fit.fit_road(ROAD, G, y)
    got = roadfit.fit_road(simulate.panel_of(spark, y), _edges(spark, ROAD), G)
    assert got.converged and got.dispersion is None
    assert abs(got.loglik - want["loglik"]) < 0.02 and got.loglik >= want["loglik"] - 0.02
    assert abs(got.alpha - want["alpha"]) < 0.01
    mu = np.array([r["mu"] for r in got.mu.orderBy("cell").collect()])
    assert np.abs(mu - want["mu"]).max() < 0.02
    lam = mu[:, None] + got.alpha * (simulate.road_weight_matrix(ROAD, got.beta) @ fit.history(y, G))
    assert abs(fit.loglik(y, lam) - got.loglik) < 1e-6


def test_slopes_vanish_at_a_given_decay(spark):
    y = _counts(ROAD, [0.6, 0.9, 0.5], 0.35, 1.2e-3, G, 120, 5)
    x = simulate.road_weight_matrix(ROAD, 1.2e-3) @ fit.history(y, G)
    for p, false_rate in ((1.0, 0.0), (0.7, 0.4)):
        got = roadfit.fit_road(simulate.panel_of(spark, y), _edges(spark, ROAD), G, beta=1.2e-3, p=p, false_rate=false_rate, tol=1e-12)
        mu = np.array([r["mu"] for r in got.mu.orderBy("cell").collect()])
        lam = p * (mu[:, None] + got.alpha * x) + false_rate
        r = p * (y / lam - 1)
        assert got.converged and abs((r * x).sum()) < 1e-2 and np.abs(r.sum(1)[mu > 1e-9]).max() < 1e-6
        assert abs(fit.loglik(y, lam) - got.loglik) < 1e-6


def test_recovery_of_the_road_model():
    """The accuracy asked of five seeds: medians, and four of five within wider bounds."""
    errors = []
    for seed in (3, 5, 7, 11, 13):
        f = fit.fit_road(ROAD, G, _counts(ROAD, [0.6, 0.9, 0.5], 0.35, 1.2e-3, G, 180, seed))
        errors.append((np.abs(f["mu"] - [0.6, 0.9, 0.5]).mean(), abs(f["alpha"] - 0.35), abs(f["beta"] - 1.2e-3)))
    e = np.array(errors)
    assert (np.median(e, axis=0) <= [0.25, 0.15, 6e-4]).all(), e
    assert ((e <= [0.35, 0.22, 9e-4]).all(1)).sum() >= 4, e


def test_recovery_of_the_dispersion(spark):
    got = [fit.fit_road(NEAR, np.array([0.6, 0.2]), _counts(NEAR, [0.20, 0.25, 0.15], 0.15, 0.08, [0.6, 0.2], 120, seed, 20.0), family="negbin")["dispersion"] for seed in (0, 1, 2)]
    assert 0.2 * 20 <= np.median(got) <= 5 * 20, got
    y = _counts(NEAR, [2.0, 2.5, 1.5], 0.15, 0.08, [0.6, 0.2], 300, 0, 3.0)
    f = roadfit.fit_road(simulate.panel_of(spark, y), _edges(spark, NEAR), [0.6, 0.2], beta=0.08, family="negbin")
    assert f.converged and 2.0 < f.dispersion < 4.5


def test_defined_results(spark):
    empty = spark.createDataFrame([], "cell int, t int, y bigint")
    with pytest.raises(ValueError):
        roadfit.fit_road(empty, _edges(spark, ROAD), G)
    with pytest.raises(ValueError):
        roadfit.fit_road(empty, _edges(spark, ROAD), G, family="other")
    quiet = simulate.panel_of(spark, np.zeros((3, 10), int)).withColumn("x", F.lit("clash"))
    f = roadfit.fit_road(quiet, _edges(spark, ROAD), G)
    assert f.loglik <= 0 and {r["mu"] for r in f.mu.collect()} == {0.0}
    with pytest.raises(ValueError):
        roadfit.backtest(quiet, _edges(spark, ROAD), G, 8, 7)


def test_backtest_and_forecast_equal_arrays(spark):
    y = _counts(ROAD, [0.6, 0.9, 0.5], 0.35, 1.2e-3, G, 100, 7)
    b = roadfit.backtest(simulate.panel_of(spark, y), _edges(spark, ROAD), G, 90, 7, beta=1.2e-3)
    mu = np.array([r["mu"] for r in b["fit"].mu.orderBy("cell").collect()])
    lam = simulate.expected_observed(simulate.road_weight_matrix(ROAD, 1.2e-3), simulate.Params(mu, b["fit"].alpha, G), y[:, :90], 7)
    assert abs(b["nll"] + fit.loglik(y[:, 90:97], lam) / 21) < 1e-9


def test_sparse_weights_equal_a_matrix(spark, monkeypatch):
    w = simulate.road_weight_matrix(ROAD, 1.2e-3)
    e = simulate.edges_from(intensity.road_weights(_edges(spark, ROAD), 1.2e-3), [0, 1, 2])
    h = np.random.default_rng(0).random((3, 5))
    assert np.allclose(e @ h, w @ h) and np.allclose(e @ h[:, 0], w @ h[:, 0]) and len(e) == 3
    assert simulate.World(np.zeros((3, 2)), e).weights.shape == (3, 3)
    p = simulate.Params(np.array([0.6, 0.9, 0.5]), 0.35, G)
    assert (simulate.counts(e, p, 50, 1)["y_true"] == simulate.counts(w, p, 50, 1)["y_true"]).all()
    monkeypatch.setattr(simulate, "ARRAY_EDGES", 5)
    with pytest.raises(ValueError):
        simulate.edges_from(intensity.road_weights(_edges(spark, ROAD), 1.2e-3), [0, 1, 2])
    monkeypatch.setattr(simulate, "ARRAY_VALUES", 5)
    with pytest.raises(ValueError):
        simulate.matrix_of(simulate.panel_of(spark, np.ones((3, 2), int)), [0, 1, 2], 2)
