"""JSON artefacts of evaluations, each with a manifest."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from loomcast.operators.evaluate import EvalConfig, evaluate_synthetic


def _revision() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def synthetic_eval(spark: SparkSession, out_dir: str, seed: int = 0) -> Path:
    """Writes ``synthetic_eval_seed{n}.json`` and its manifest; returns the former's path."""
    root = Path(out_dir)
    root.mkdir(parents=True, exist_ok=True)
    result = evaluate_synthetic(spark, EvalConfig(seed=seed))
    path = root / f"synthetic_eval_seed{seed}.json"
    path.write_text(json.dumps(result))
    manifest = {"artifact": path.name, "gitSha": _revision(), "seed": seed, "configSummary": result["config"], "generatedAtUtc": datetime.now(UTC).isoformat()}
    (root / f"synthetic_eval_seed{seed}.manifest.json").write_text(json.dumps(manifest))
    return path
