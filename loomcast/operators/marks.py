"""Categorical marks aligned to a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_faults(panel: DataFrame, marks: DataFrame, n_marks: int) -> DataFrame:
    """One row: pairs of the panel without a mark, marks outside the panel, negative marks, marks of n_marks or more."""
    both = panel.select("cell", "t", F.lit(1).alias("p")).join(marks.select("cell", "t", "mark", F.lit(1).alias("m")), ["cell", "t"], "full")
    return both.agg(
        F.count_if(F.col("m").isNull()).alias("missing"),
        F.count_if(F.col("p").isNull()).alias("outside"),
        F.count_if(F.col("mark") < 0).alias("negative"),
        F.count_if(F.col("mark") >= n_marks).alias("too_great"),
    )


def require_marks(panel: DataFrame, marks: DataFrame, n_marks: int) -> None:
    if dict(marks.dtypes)["mark"] not in ("int", "bigint", "smallint", "tinyint"):
        raise ValueError("marks must be integers")
    faults = {k: v for k, v in mark_faults(panel, marks, n_marks).first().asDict().items() if v}
    if faults:
        raise ValueError(f"marks don't fit the panel: {faults}")


def one_hot(marks: DataFrame, n_marks: int) -> DataFrame:
    """Adds ``onehot``: array<float> of length n_marks."""
    return marks.withColumn("onehot", F.transform(F.sequence(F.lit(0), F.lit(n_marks - 1)), lambda k: (k == F.col("mark")).cast("float")))
