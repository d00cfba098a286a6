"""Commands: ``python -m loomcast COMMAND ...``; results are JSON on stdout."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomcast
from loomcast.functions.stats import lag_kernel
from loomcast.operators import evaluate, fit, simulate, spatial
from loomcast.session import local_session
from loomcast.sources import bundle, events, grids, simulation


@dataclass(frozen=True)
class CountsConfig:
    path: str
    mobility_path: str | None = None
    value: str = "events"


def _summary(p: DataFrame) -> dict:
    r = p.agg(F.count_distinct("cell"), F.count_distinct("t"), F.sum("y")).first()
    return {"n_locations": r[0], "n_steps": r[1], "total": r[2]}


def _substrate(spark: SparkSession, a: argparse.Namespace) -> dict:
    s = bundle.build(spark, simulation.config_from_json(bundle.SubstrateConfig, a.config))
    return {"grid_cells": s.grid.count(), "neighbours_nnz": s.neighbours.count(), "poi": s.poi is not None}


def _cell_id(spark: SparkSession, a: argparse.Namespace) -> dict:
    point = spark.createDataFrame([(a.lon, a.lat)], "lon double, lat double")
    return {"cell_id": spatial.point_to_cell(point, grids.load_shape(spark, a.grid)).first()["cell"]}


def _loaded(held: events.Loaded) -> dict:
    return _summary(held.panel) | {"mobility_nnz": held.mobility.count(), "mobility_source": held.mobility_source}


def _load_counts(spark: SparkSession, a: argparse.Namespace) -> dict:
    c = simulation.config_from_json(CountsConfig, a.config)
    return _loaded(events.load_counts(spark, c.path, c.mobility_path))


def _load_events(spark: SparkSession, a: argparse.Namespace) -> dict:
    c = simulation.config_from_json(CountsConfig, a.config)
    return _loaded(events.load_events(spark, c.path, c.value, c.mobility_path)) | {"value": c.value}


def _ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = events.ingest_jsonl(spark, a.input)
    events.write_events(rows, a.output)
    return {"rows": rows.count(), "output": a.output}


def _arrays(spark: SparkSession, path: str, y: str) -> tuple[simulate.World, simulate.Params, np.ndarray]:
    rows, world, params = simulation.load_simulation(spark, path)
    n = rows.agg(F.max("time")).first()[0] + 1
    w, p = simulate.World.from_dict(world), simulate.Params.from_dict(params)
    return w, p, simulate.matrix_of(rows.withColumnsRenamed({"location": "cell", "time": "t"}), range(len(w.xy)), n, y)


def _fit_result(f: dict) -> dict:
    return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in f.items() if k != "result"} | {"success": f["result"]["success"], "message": f["result"]["message"]}


def _fit_kernel(spark: SparkSession, a: argparse.Namespace) -> dict:
    w, p, y = _arrays(spark, a.parquet, "y_true")
    return _fit_result(fit.fit_lag_decay(w.weights, len(p.kernel), y))


def _fit_observed(spark: SparkSession, a: argparse.Namespace) -> dict:
    w, p, y = _arrays(spark, a.parquet, "y_obs")
    return _fit_result(fit.fit_alpha_mu(w.weights, p.kernel, y, p=p.p_detect, false_rate=p.false_rate))


def _forecast(spark: SparkSession, a: argparse.Namespace) -> dict:
    q = tuple(float(x) for x in a.q.split(","))
    if not all(0 <= x <= 1 for x in q):
        raise SystemExit("quantiles must be between 0 and 1")
    p = events.read_count_matrix(spark, a.y_obs)
    cells = sorted(r["cell"] for r in p.select("cell").distinct().collect())
    y = simulate.matrix_of(p, cells, p.agg(F.max("t")).first()[0] + 1)
    world = simulate.random_world(len(cells), 0)
    f, out = evaluate.observed_fit_sample_summarize(spark, world, np.array(lag_kernel(a.n_lags, a.beta)), y, a.horizon, a.n_paths, a.seed, a.p_detect, a.false_rate, q)
    rows = out.orderBy("cell", "k").collect()
    shape = (len(cells), a.horizon)
    mean = np.array([r["mean"] for r in rows]).reshape(shape)
    quantiles = np.array([r["quantiles"] for r in rows]).reshape(*shape, len(q)).transpose(2, 0, 1)
    meta = {"n_locations": len(cells), "n_steps_history": y.shape[1], "horizon": a.horizon, "n_paths": a.n_paths, "seed": a.seed, "q": list(q), "p_detect": a.p_detect, "false_rate": a.false_rate}
    result = {"meta": meta, "fit": _fit_result(f), "predict": {"mean": mean.tolist(), "quantiles": quantiles.tolist()}}
    if a.out:
        Path(a.out).write_text(json.dumps(result))
    return result


def _artifacts(spark: SparkSession, a: argparse.Namespace) -> dict:
    from loomcast.artifacts import synthetic_eval

    return {"path": str(synthetic_eval(spark, a.out_dir, a.seed))}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomcast")
    groups = top.add_subparsers(required=True)
    groups.add_parser("version").set_defaults(run=None)

    def command(group: str, name: str, run, *options: tuple) -> None:  # noqa: ANN001
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(required=True)
        p = made[group].add_parser(name)
        for flag, kind, default in options:
            p.add_argument(flag, type=kind, required=default is ..., default=None if default is ... else default)
        p.set_defaults(run=run)

    made: dict = {}
    command("substrate", "build", _substrate, ("--config", str, ...))
    command("spatial", "cell-id", _cell_id, ("--grid", str, ...), ("--lon", float, ...), ("--lat", float, ...))
    command("data", "counts-load", _load_counts, ("--config", str, ...))
    command("data", "events-load", _load_events, ("--config", str, ...))
    command("data", "ingest-events-jsonl", _ingest, ("--input", str, ...), ("--output", str, ...))
    command("sim", "fit-kernel", _fit_kernel, ("--parquet", str, ...))
    command("sim", "fit-observed", _fit_observed, ("--parquet", str, ...))
    command("sim", "forecast-observed", _forecast, ("--y-obs", str, ...), ("--horizon", int, 20), ("--n-paths", int, 200), ("--n-lags", int, 6), ("--beta", float, 1.0), ("--seed", int, 0), ("--p-detect", float, 1.0), ("--false-rate", float, 0.0), ("--q", str, "0.05,0.5,0.95"), ("--out", str, None))
    command("paper", "generate-artifacts", _artifacts, ("--out-dir", str, ...), ("--seed", int, 0))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.run is None:
        print(loomcast.__version__)
        return 0
    print(json.dumps(a.run(SparkSession.getActiveSession() or local_session(), a)))
    return 0


