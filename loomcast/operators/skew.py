"""Per-key results where a few keys hold most rows (problem 1).

A frequent-items sketch over the key column finds the heavy keys. Rows of heavy keys are picked by a broadcast join with
that bounded list and reduced in two salted phases; all other rows take the ordinary shuffle; the two parts are united.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy if the sketch estimates at least this share of all rows; hence there are at most 1 / share heavy keys.
HEAVY_SHARE = 0.001
#: Items the sketch tracks: its error is under rows / (0.75 * tracked), far below HEAVY_SHARE.
TRACKED = 16384


def heavy_hitters(df: DataFrame, key: str, *, share: float = HEAVY_SHARE, tracked: int = TRACKED) -> tuple[int, list]:
    """Number of rows, and the keys estimated to hold at least ``share`` of them (no more than 1 / share keys).

    One pass over the key column alone; the sketch is built map-side and merged, its size is fixed. Null and NaN keys
    are never reported. Table empty: ``(0, [])``.
    """
    kind = df.schema[key].dataType
    nan = f" AND NOT isnan(`{key}`)" if isinstance(kind, (T.DoubleType, T.FloatType)) else ""
    most = min(tracked, int(1 / share) + 1)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(CASE WHEN `{key}` IS NOT NULL{nan} THEN `{key}` END, {most}, {tracked})").alias("top")).first()
    return row["n"], [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] >= share * row["n"]]


def skewed_aggregate(df: DataFrame, key: str, measures: Mapping[str, tuple[str, str]], *, share: float = HEAVY_SHARE, salts: int = 32, heavy: list | None = None) -> DataFrame:
    """Aggregate ``df`` by ``key`` without a few heavy keys holding up the rest.

    ``measures`` maps an output name to ``(kind, column)``, kind being count, sum, min, max or count_distinct; count with
    column ``*`` counts rows. Returns ``key``, the measures, and ``is_heavy``. Columns of ``df`` beyond the key and
    the measured ones are ignored, whatever their names. ``heavy``: the keys, where a sketch was taken before.

    Defined results: null keys form a group of their own (as in SQL); nulls are left out of sum, min, max and
    count_distinct and a sum over nulls only is null; an empty table gives no rows; ties and repeated rows count as they lie.
    """
    heavy = heavy_hitters(df, key, share=share)[1] if heavy is None else heavy
    columns = sorted({c for _, c in measures.values() if c != "*"})
    rows = df.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__m_{c}") for c in columns])
    spark, kind = df.sparkSession, df.schema[key].dataType
    keys = F.broadcast(spark.createDataFrame([(k,) for k in heavy], T.StructType([T.StructField("__k", kind)])))
    parts = []
    for rows_of, salted, is_heavy in ((rows.join(keys, "__k", "left_semi"), True, True), (rows.join(keys, "__k", "left_anti"), False, False)):
        if salted and not heavy:
            continue
        parts.append(_two_phase(rows_of, measures, salts if salted else 0).withColumn("is_heavy", F.lit(is_heavy)))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumnRenamed("__k", key)


_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_SECOND = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _salt(rows: DataFrame, salts: int) -> Column:
    """By the measured columns; without any by the partition, as the key alone would give all its rows one salt."""
    columns = [F.col(c) for c in rows.columns if c != "__k"]
    return F.pmod(F.xxhash64(*columns or [F.spark_partition_id()]), F.lit(salts))


def _two_phase(rows: DataFrame, measures: Mapping[str, tuple[str, str]], salts: int) -> DataFrame:
    """count_distinct goes by (key, value) first, so that one key's values are spread too; the rest by (key, salt)."""
    plain = {n: m for n, m in measures.items() if m[0] != "count_distinct"}
    first = [_FIRST[k](F.lit(1) if c == "*" else F.col(f"__m_{c}")).alias(n) for n, (k, c) in plain.items()]
    first = first or [F.count(F.lit(1)).alias("__n")]
    if salts:
        salted = rows.withColumn("__s", _salt(rows, salts))
        out = salted.groupBy("__k", "__s").agg(*first).groupBy("__k").agg(*[_SECOND[k](n).alias(n) for n, (k, _) in plain.items()] or [F.sum("__n").alias("__n")])
    else:
        out = rows.groupBy("__k").agg(*first)
    for name, (kind, column) in measures.items():
        if kind == "count_distinct":
            values = rows.groupBy("__k", f"__m_{column}").agg(F.lit(1)).groupBy("__k").agg(F.count(f"__m_{column}").alias(name))
            out = out.join(values.withColumnRenamed("__k", "__k2"), F.col("__k").eqNullSafe(F.col("__k2"))).drop("__k2")
    return out.select("__k", *measures)


def keys_over_share(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of ``df`` (rows without a key count in the total): ``key, n``."""
    rows, heavy = heavy_hitters(df, key)
    counts = skewed_aggregate(df, key, {"n": ("count", "*")}, heavy=heavy)
    return counts.where(F.col(key).isNotNull() & (F.col("n") >= F.lit(share * rows))).select(key, "n")


def salted_join(large: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, *, how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join on ``on`` in which one key of ``large`` may hold a third of all rows.

    A sketch finds the hot keys of ``large`` (at most 1 / HEAVY_SHARE). A row with a hot key takes the salt that its
    ``spread`` expression hashes to, and rows of ``small`` with that key are repeated for every salt; all other rows
    are shuffled once, as they are. The salt is a pure function of the row, hence recomputed alike after an executor is
    lost. ``how``: inner, left, left_semi or left_anti. Null keys match nothing, as in SQL.
    """
    key = F.xxhash64(*on)
    hot = heavy_hitters(large.select(key.alias("key")), "key")[1]
    is_hot = key.isin(hot) if hot else F.lit(False)
    left = large.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    if hot:
        small = small.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    else:
        small = small.withColumn("__salt", F.lit(0))
    return left.join(small, [*on, "__salt"], how).drop("__salt")
