import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcast import cli
from loomcast.functions import stats
from loomcast.operators import evaluate, fit, intensity, likelihood, marks, simulate
from loomcast.sources import simulation
from loomcast.streaming.daily import daily_counts

G = np.array([0.55, 0.30, 0.15])
ROAD = np.array([[0.0, 300.0, 900.0], [300.0, 0.0, 600.0], [900.0, 600.0, 0.0]])


def _value(spark, column):
    return spark.range(1).select(column).first()[0]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 60), st.floats(0.05, 50), st.floats(0.05, 50))
def test_log_probabilities(spark, y, mean, k):
    got = spark.range(1).select(stats.poisson_logpmf(F.lit(y), F.lit(mean)), stats.negbin_logpmf(F.lit(y), F.lit(mean), k)).first()
    assert math.isclose(got[0], y * math.log(mean) - mean - math.lgamma(y + 1), rel_tol=1e-10, abs_tol=1e-10)
    want = math.lgamma(y + k) - math.lgamma(k) - math.lgamma(y + 1) + k * (math.log(k) - math.log(k + mean)) + y * (math.log(mean) - math.log(k + mean))
    assert math.isclose(got[1], want, rel_tol=1e-9, abs_tol=1e-9)


def test_limits_of_log_probabilities(spark):
    near = spark.createDataFrame([(y, m) for y, m in ((0, 0.5), (1, 2.0), (5, 4.0), (9, 10.0), (3, 0.1))], "y int, m double")
    for a, b in near.select(stats.poisson_logpmf(F.col("y"), F.col("m")), stats.negbin_logpmf(F.col("y"), F.col("m"), 1e6)).collect():
        assert abs(a - b) < 1e-3
    assert _value(spark, stats.negbin_logpmf(F.lit(0), F.lit(0.0), 2.0)) == 0
    with pytest.raises(ValueError):
        stats.negbin_logpmf(F.lit(0), F.lit(1.0), 0)


def test_exact_observation(spark):
    one = lambda t, o, p, f: _value(spark, stats.observed_logpmf(F.lit(t), F.lit(o), p, f))
    assert abs(one(2, 1, 0.5, 1.0) - (math.log(0.75) - 1)) < 1e-10
    assert one(2, 3, 0.5, 0.0) == -math.inf and one(2, 1, 1.0, 0.5) == -math.inf
    assert abs(one(2, 1, 0.5, 0.0) - math.log(0.5)) < 1e-12
    assert abs(one(2, 3, 1.0, 0.5) - (math.log(0.5) - 0.5)) < 1e-12
    assert abs(sum(math.exp(one(3, o, 0.7, 0.4)) for o in range(12)) - 1) < 1e-6
    rows = spark.createDataFrame([(2, 1)] * 3 + [(0, 0)], "y_true int, y_obs int")
    got = likelihood.observed_loglik_exact(rows, 0.5, 1.0).first()[0]
    assert abs(got - (3 * (math.log(0.75) - 1) - 1)) < 1e-10
    assert abs(fit.observed_loglik(np.array([[2, 1], [0, 0]]), np.array([3, 1]), 0.5, 1.0) - got) < 1e-10


def test_links_and_kernels(spark):
    assert abs(_value(spark, stats.softplus(F.lit(-700.0)))) < 1e-300 and _value(spark, stats.softplus(F.lit(700.0))) == 700
    assert _value(spark, stats.sigmoid(F.lit(0.0))) == 0.5 and stats.inverse_softplus(1000.0) == 1000
    assert abs(sum(stats.lag_kernel(6, 0.7)) - 1) < 1e-12 and stats.lag_kernel(2, 0.5, False)[0] == 1
    stats.check_kernel_fn(lambda d: np.exp(-d))
    for bad, error in ((lambda d: [1], TypeError), (lambda d: d[:1], ValueError), (lambda d: d - 5, ValueError), (lambda d: d / 0 * np.nan, ValueError)):
        with pytest.raises(error), np.errstate(all="ignore"):
            stats.check_kernel_fn(bad)


def _edges(spark, seconds):
    return spark.createDataFrame([(i, j, float(seconds[i][j])) for i in range(len(seconds)) for j in range(len(seconds))], "i int, j int, travel_time_s double")


def test_one_step_uses_target_to_source_times(spark):
    p = simulate.panel_of(spark, np.array([[2], [1]]))
    mu = F.when(F.col("cell") == 0, 0.1).otherwise(0.2)
    w = intensity.road_weights(_edges(spark, [[0, 10], [5, 0]]), 0.1)
    got = {r["cell"]: r["lam"] for r in intensity.next_step(p, w, [1.0], mu, 0.5, 1).collect()}
    assert abs(got[0] - (0.1 + 0.5 * (2 + math.exp(-1)))) < 1e-12 and abs(got[1] - (0.2 + 0.5 * (1 + 2 * math.exp(-0.5)))) < 1e-12
    with pytest.raises(ValueError):
        intensity.next_step(p, w, [1.0], mu, -0.5, 1)


def test_diagonal_is_one_and_added(spark):
    nb = spark.createDataFrame([(0, 1, 5.0), (1, 1, 7.0)], "i int, j int, travel_time_s double")
    rows = {(r["i"], r["j"]): r["w"] for r in intensity.road_weights(nb, kernel=lambda d: d * 0 + 0.25).collect()}
    assert rows == {(0, 1): 0.25, (0, 0): 1.0, (1, 1): 1.0}
    with pytest.raises(ValueError):
        intensity.check_weights(spark.createDataFrame([(0, 0, -1.0)], "i int, j int, w double"))


def test_in_sample_equals_matrices(spark):
    y = simulate.counts(simulate.road_weight_matrix(ROAD, 1.2e-3), simulate.Params(np.array([0.6, 0.9, 0.5]), 0.35, G), 40, 1)["y_true"]
    out = intensity.in_sample(simulate.panel_of(spark, y), intensity.road_weights(_edges(spark, ROAD), 1.2e-3), G, F.lit(0.7), 0.35)
    want = 0.7 + 0.35 * simulate.road_weight_matrix(ROAD, 1.2e-3) @ fit.history(y, G)
    for r in out.collect():
        assert abs(r["lam"] - want[r["cell"], r["t"]]) < 1e-12
    ll = likelihood.loglik(out).first()[0]
    assert abs(ll - fit.loglik(y, want)) < 1e-8
    nb = likelihood.loglik(out, "negbin", 3.0).first()[0]
    assert abs(nb - fit.loglik(y, want, 3.0)) < 1e-8
    with pytest.raises(ValueError):
        likelihood.loglik(out, "negbin")
    with pytest.raises(ValueError):
        likelihood.loglik(out, "other", 1.0)


def test_mean_field_forecast_both_ways(spark, monkeypatch):
    one = simulate.panel_of(spark, np.array([[0, 2]]))
    mu, w = spark.createDataFrame([(0, 1.0)], "cell int, mu double"), spark.createDataFrame([(0, 0, 1.0)], "i int, j int, w double")
    assert [r["lam"] for r in intensity.roll_forward(one, w, [1.0], mu, 0.5, 3, 2).orderBy("k").collect()] == [2.0, 2.0, 2.0]
    y = np.random.default_rng(0).poisson(1.0, (3, 8))
    wm = simulate.road_weight_matrix(ROAD, 1e-3)
    mus = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.3)], "cell int, mu double")
    want = simulate.expected_observed(wm, simulate.Params(np.array([0.1, 0.2, 0.3]), 0.4, G, 0.8, 0.3), y, 3)
    for limit in (10**6, 0):
        monkeypatch.setattr(intensity, "DRIVER_CELLS", limit)
        got = intensity.roll_forward(simulate.panel_of(spark, y), simulate.edges_of(spark, wm), G, mus, 0.4, 3, 8, scale=0.8, offset=0.3)
        for r in got.collect():
            assert abs(r["lam"] - want[r["cell"], r["k"] - 1]) < 1e-12


def test_summaries(spark):
    paths = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 3), (0, 0, 2, 2), (1, 0, 2, 4)], "path int, cell int, k int, y int")
    rows = likelihood.path_summary(paths, (0.0, 0.5, 1.0)).orderBy("k").collect()
    assert [(r["mean"], r["quantiles"]) for r in rows] == [(2.0, [1.0, 2.0, 3.0]), (3.0, [2.0, 3.0, 4.0])]
    rows = spark.createDataFrame([(1.0, 0.0, 1.0), (5.0, 1.0, 2.0)], "y double, lo double, hi double")
    assert likelihood.coverage(rows).first()[0] == 0.5
    assert likelihood.errors(rows.select("y", F.lit(2.0).alias("lam"))).first()[:] == (math.sqrt(5.0), 2.0)
    last = simulate.panel_of(spark, np.array([[9, 1, 3]]))
    assert intensity.trailing_mean(last, 2, F.lit(0.0), 1.0, 2).first()["feature"] == 2.0


def test_marks(spark):
    p = simulate.panel_of(spark, np.zeros((2, 2)))
    m = p.select("cell", "t", (F.col("cell") + F.col("t")).cast("int").alias("mark"))
    marks.require_marks(p, m, 3)
    assert marks.one_hot(m, 3).where("cell = 1 and t = 1").first()["onehot"] == [0.0, 0.0, 1.0]
    for bad, n in ((m, 2), (m.where("cell = 0"), 3), (m.withColumn("mark", F.col("mark") - 1), 3), (m.withColumn("mark", F.lit("x")), 3)):
        with pytest.raises(ValueError):
            marks.require_marks(p, bad, n)


def test_simulation_is_reproducible(spark):
    p = simulate.Params(np.full(3, 0.5), 0.4, G, 0.8, 0.3)
    w = simulate.random_world(3, 1).weights
    assert np.allclose(w.sum(1), 1)
    out = simulate.simulate_seeds(spark, w, p, 20, [4, 4, 9])
    assert out.count() == 120
    y = simulate.counts(w, p, 20, 9)
    for r in out.where("seed = 9").collect():
        assert (r["y_true"], r["y_obs"]) == (y["y_true"][r["location"], r["time"]], y["y_obs"][r["location"], r["time"]])
    rng, again = np.random.default_rng(9), np.zeros((3, 20), int)  # the stream's order: counts, thinning, clutter
    for t in range(20):
        h = sum((G[k] * again[:, t - 1 - k] for k in range(min(3, t))), np.zeros(3))
        again[:, t] = rng.poisson(p.mu + p.alpha * (w @ h))
    assert (again == y["y_true"]).all() and (rng.binomial(again, 0.8) + rng.poisson(0.3, again.shape) == y["y_obs"]).all()
    a, b = (sorted(map(tuple, simulate.predictive_paths(spark, w, p, y["y_true"], 3, 6, 2).collect())) for _ in range(2))
    assert a == b and len(a) == 54
    with pytest.raises(ValueError):
        simulate.counts(w, p, 0, 1)
    with pytest.raises(ValueError):
        simulate.counts(w, p, 5, 1, "negbin")
    with pytest.raises(ValueError):
        simulate.Params(np.ones(1), -1.0, G)


def test_recovery(spark):
    p = simulate.Params(np.array([0.6, 0.9, 0.5]), 0.35, G)
    rows = fit.recover_seeds(spark, ROAD, p, 1.2e-3, 180, (3, 5, 7, 11, 13))
    m = evaluate.recovery_medians(rows).first()
    assert m[0] <= 0.25 and m[1] <= 0.15 and m[2] <= 6e-4
    assert rows.where("loglik < loglik_init - 1e-6").count() == 0
    nb = simulate.Params(np.array([0.20, 0.25, 0.15]), 0.15, np.array([0.6, 0.2]))
    seconds = np.array([[0, 10, 20], [10, 0, 12], [20, 12, 0]], float)
    rows = fit.recover_seeds(spark, seconds, nb, 0.08, 120, (0, 1, 2), "negbin", 20.0)
    assert rows.where("dispersion is null or loglik < loglik_init - 1e-6").count() == 0


def test_lag_decay_fit():
    w = simulate.random_world(6, 2, 0.5).weights
    truth = simulate.Params(np.full(6, 0.5), 0.6, np.array(stats.lag_kernel(6, 0.8)))
    errs, corr = [], []
    for seed in (1, 2, 3):
        y = simulate.counts(w, truth, 160, seed)["y_true"]
        f = fit.fit_lag_decay(w, 6, y)
        errs.append(abs(f["alpha"] - 0.6) / 0.6)
        corr.append(np.corrcoef(f["kernel"], truth.kernel)[0, 1])
        assert f["loglik"] >= f["loglik_init"] - 1e-6
    assert np.median(errs) < 0.6 and np.median(corr) > 0.9


def test_gradient_is_zero_at_the_fit_and_distributed_agrees(spark):
    w = simulate.random_world(4, 3, 0.5).weights
    y = simulate.counts(w, simulate.Params(np.full(4, 0.8), 0.4, G), 150, 1)["y_true"]
    x = w @ fit.history(y, G)
    f = fit.fit_alpha_mu(w, G, y)
    lam = f["mu"][:, None] + f["alpha"] * x
    assert np.abs((y / lam - 1).sum(1)).max() < 1e-3 and abs(((y / lam - 1) * x).sum()) < 1e-3
    rows = intensity.in_sample(simulate.panel_of(spark, y), simulate.edges_of(spark, w), G, F.lit(1.0), 0.0)
    mu, alpha, _ = fit.fit_linear_distributed(rows.select("cell", "y", "x"), steps=10)
    assert abs(alpha - f["alpha"]) < 1e-4 and all(abs(r["mu"] - f["mu"][r["cell"]]) < 1e-4 for r in mu.collect())
    zero = fit.fit_alpha_mu(w, G, np.zeros((4, 20)))
    assert zero["alpha"] >= 0 and (zero["mu"] >= 0).all()
    a, m = fit.ridge_fit(rows)
    xd, yd = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    assert abs(a.first()[0] - max((xd * yd).sum() / ((xd * xd).sum() + 1e-6), 0)) < 1e-9 and m.count() == 4


def test_distributed_fit_converges_on_sparse_cells(spark):
    rng = np.random.default_rng(4)
    w = simulate.random_world(30, 4, 0.5).weights
    for alpha in (0.0, 0.3):
        y = simulate.counts(w, simulate.Params(np.where(np.arange(30) % 3, 0.02, rng.uniform(0.05, 1, 30)), alpha, G), 120, 6)["y_true"]
        x = w @ fit.history(y, G)
        rows = spark.createDataFrame([(i, int(y[i, t]), float(x[i, t])) for i in range(30) for t in range(120)], "cell int, y int, x double")
        f = fit.fit_distributed(rows)
        mu = np.array([r["mu"] for r in f["mu"].orderBy("cell").collect()])
        lam = np.maximum(mu[:, None] + f["alpha"] * x, 1e-12)
        g, ga = (y / lam - 1).sum(1), ((y / lam - 1) * x).sum()
        assert f["result"]["success"] and np.abs(g[mu > 0]).max() < 1e-5 and g[mu == 0].max(initial=-1) <= 0
        assert abs(ga) < 1e-2 if f["alpha"] > 0 else ga <= 0
        array = fit.fit_alpha_mu(w, G, y, steps=500)
        assert f["loglik"] >= (y * np.log(np.maximum(array["mu"][:, None] + array["alpha"] * x, 1e-12)) - array["mu"][:, None] - array["alpha"] * x).sum() - 1e-6
    assert not fit.fit_distributed(rows, steps=1)["result"]["success"]
    with pytest.warns(UserWarning, match="step limit"):
        fit.fit_linear_distributed(rows, steps=1)


def test_observation_fit(spark):
    rng = np.random.default_rng(0)
    y = rng.poisson(3.0, 4000)
    obs = rng.binomial(y, 0.6) + rng.poisson(0.5, 4000)
    f = fit.fit_observation(spark.createDataFrame([*zip(y.tolist(), obs.tolist())], "y_true int, y_obs int"))
    assert abs(f["p_detect"] - 0.6) < 0.05 and abs(f["false_rate"] - 0.5) < 0.1 and f["loglik"] >= f["loglik_init"]


def test_backtest_and_synthetic_evaluation(spark):
    y = simulate.counts(simulate.road_weight_matrix(np.array([[0.0, 10], [10, 0]]), 0.1), simulate.Params(np.array([0.15, 0.1]), 0.3, np.array([0.6, 0.2])), 50, 2)["y_true"]
    for family in ("poisson", "negbin"):
        assert math.isfinite(evaluate.backtest(np.array([[0.0, 10], [10, 0]]), np.array([0.6, 0.2]), y, 40, 5, family)["nll"])
    with pytest.raises(ValueError):
        evaluate.backtest(ROAD, G, y, 48, 5)
    out = evaluate.evaluate_synthetic(spark, evaluate.EvalConfig(n_paths=20))
    assert set(out["metrics"]) == {"nll_test", "rmse", "mae", "coverage"} and 0 <= out["metrics"]["coverage"] <= 1


def test_commands(spark, tmp_path, capsys):
    w, p = simulate.random_world(3, 0, 0.5), simulate.Params(np.full(3, 0.5), 0.3, G, 0.8, 0.2)
    out = simulate.simulate_seeds(spark, w.weights, p, 30, [1])
    simulation.save_simulation(out, str(tmp_path / "s"), w.to_dict(), p.to_dict())
    (tmp_path / "y_obs.csv").write_text("0,1,0,2\n3,0,0,1\n")
    (tmp_path / "c.json").write_text(json.dumps({"path": str(tmp_path)}))

    def run(*args):
        assert cli.main(list(args)) == 0
        return capsys.readouterr().out.strip().splitlines()[-1]

    assert run("version") == "0.1.0"
    assert json.loads(run("data", "counts-load", "--config", str(tmp_path / "c.json"))) == {"n_locations": 2, "n_steps": 4, "total": 7, "mobility_nnz": 2, "mobility_source": "identity"}
    for name in ("fit-kernel", "fit-observed"):
        f = json.loads(run("sim", name, "--parquet", str(tmp_path / "s")))
        assert f["loglik"] >= f["loglik_init"] - 1e-6 and "success" in f
    f = json.loads(run("sim", "forecast-observed", "--y-obs", str(tmp_path / "y_obs.csv"), "--horizon", "2", "--n-paths", "5", "--q", "0.1,0.9"))
    assert set(f) == {"meta", "fit", "predict"} and np.array(f["predict"]["quantiles"]).shape == (2, 2, 2) and np.array(f["predict"]["mean"]).shape == (2, 2)
    path = json.loads(run("paper", "generate-artifacts", "--out-dir", str(tmp_path / "art"), "--seed", "1"))["path"]
    assert json.load(open(path))["config"]["seed"] == 1 and (tmp_path / "art/synthetic_eval_seed1.manifest.json").exists()


def test_streamed_panel_equals_the_table(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 05:00:00' + make_interval(0,0,0,0,id) as ts, cast(id % 3 as int) as cell from range(200)")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily_counts(stream, lateness="30 days").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_counts(df).collect()))
