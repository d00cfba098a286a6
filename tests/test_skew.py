import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomcast.operators import skew


def test_totals_equal_brute_force_with_hot_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7] * 500 + [None] * 20 + list(range(100))), rng.choice([None, *range(5)]), "x") for _ in range(4000)]
    df = spark.createDataFrame(rows, "k int, v bigint, is_heavy string")  # an extra column named like an output
    out = {r["k"]: r for r in skew.skewed_aggregate(df, "k", {"n": ("count", "*"), "total": ("sum", "v"), "kinds": ("count_distinct", "v"), "top": ("max", "v")}).collect()}
    n, values = Counter(k for k, _, _ in rows), defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            values[k].append(v)
    assert set(out) == set(n)
    for k, r in out.items():
        v = values[k]
        assert (r["n"], r["total"], r["kinds"], r["top"]) == (n[k], sum(v) if v else None, len(set(v)), max(v) if v else None)
    assert out[7]["is_heavy"]


def test_only_distinct_counts_and_empty_table(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "k int, v int")
    assert [tuple(r)[:2] for r in skew.skewed_aggregate(df, "k", {"d": ("count_distinct", "v")}).collect()] == [(1, 2)]
    assert skew.skewed_aggregate(df.where("k > 5"), "k", {"n": ("count", "*")}).collect() == []
    assert skew.keys_over_share(df.where("k > 5"), "k", 0.01).collect() == []


def test_share_counts_rows_without_key(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(2,)] * 9 + [(None,)] * 981, "k bigint")
    assert [r["k"] for r in skew.keys_over_share(df, "k", 0.01).collect()] == [1]


def test_double_keys_with_nan(spark):
    df = spark.createDataFrame([(float("nan"),)] * 5 + [(1.5,)] * 5, "k double")
    assert skew.heavy_hitters(df, "k") == (10, [1.5])


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (3, "b"), (6, "c"), (None, "n")], "k int, s string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.salted_join(big, small, ["k"], F.col("v"), how=how)
        want = big.join(small, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert skew.salted_join(big.where("v > 10000"), small, ["k"], F.col("v")).count() == 0


def test_counts_alone_are_salted_within_a_key(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("__k"))
    assert rows.select(skew._salt(rows, 32)).distinct().count() > 1
    got = skew.skewed_aggregate(rows.withColumnRenamed("__k", "k"), "k", {"n": ("count", "*")}).collect()
    assert [tuple(r) for r in got] == [("hot", 4000, True)]
