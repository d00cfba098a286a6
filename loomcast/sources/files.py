"""Small files beside tables, on whatever file system a path names."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """FileNotFoundError if there is none. For files that fit the driver: metadata, configurations, small matrices."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    system, at = _at(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, at = _at(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def lines_hash(spark: SparkSession, path: str) -> str:
    """Hash of a text file's lines with their numbers of occurrences, computed where the lines lie; FileNotFoundError if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    digest = F.sha2("value", 256)
    halves = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    row = spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(f"h{k}") for k, h in enumerate(halves)]).first()
    return hashlib.sha256("\0".join(map(str, row)).encode()).hexdigest()
