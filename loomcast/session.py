"""Session defaults, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for local runs and tests; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the defaults of this package."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("loomcast")
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) gets a temporary one where none is named; on a cluster, whose executors don't share such a
    folder, that raises RuntimeError. Blocks survive the loss of any executor.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomcast-checkpoint-"))
    return df.checkpoint(eager=True)
