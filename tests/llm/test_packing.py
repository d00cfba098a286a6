import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 12))
def test_differencing_partitions_all_items(sizes, k):
    windows = packing.difference(sizes, k)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) <= k


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 1000) for _ in range(400)]
    fill = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 10)]
    assert max(fill) - min(fill) < 30


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_windows_never_exceed_the_capacity(sizes):
    windows = packing.pack(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= 100 for w in windows if w)


def _counts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "container string, capacity_tokens int")


def test_every_token_is_placed_once(spark):
    rng = random.Random(2)
    big = 2**60 + 1  # beyond what a float holds exactly
    rows = [(k, rng.choice([0, 1, 100, rng.randrange(1, 700), 512, 1024])) for k in range(3000)] + [(big, 5), (None, 40), (None, 40), (7, 9), (5000, 3000)]
    packed = packing.fill_containers(_counts(spark, rows), _boxes(spark, [("a", 512), ("b", 2048), (None, 5), ("z", 0), ("a", 900)]), group_windows=20)
    pdf = packed.withColumn("doc_id", packed.doc_id.cast("string")).toPandas()  # as text: pandas makes ids with nulls floats
    assert set(pdf.container) == {"a", "b"}
    for name, cap in (("a", 512), ("b", 2048)):
        p = pdf[pdf.container == name]
        assert p.groupby("window_id").n_tokens.sum().max() <= cap
        assert p.n_tokens.sum() == sum(n for _, n in rows)
        assert sorted(map(int, p[p.piece == 0].doc_id.dropna())) == sorted(k for k, _ in rows if k is not None)
        assert p.doc_id.isna().sum() == 2
        cut = p[p.doc_id == "5000"].sort_values("piece")
        assert list(cut.start_token) == [cap * k for k in range(len(cut))] and cut.n_tokens.sum() == 3000
        whole = {str(k) for k, n in rows if n <= cap and k != 7}
        assert not p[p.doc_id.isin(whole)].piece.any()
    rates = {r["container"]: r["fill"] for r in packing.fill_rates(packed, _boxes(spark, [("a", 512), ("b", 2048)])).collect()}
    assert rates["a"] > 0.95 and rates["b"] > 0.95


def test_copies_do_not_gather(spark):
    packed = packing.fill_containers(_counts(spark, [(None, 300)] * 2000), _boxes(spark, [("a", 600)]), group_windows=50).toPandas()
    assert (packed.window_id // 2**32).value_counts().max() < 200 and packed.n_tokens.sum() == 600000


def test_empty_tables(spark):
    assert packing.fill_containers(_counts(spark, []), _boxes(spark, [("a", 5)])).count() == 0
    assert packing.fill_containers(_counts(spark, [(1, 5)]), _boxes(spark, [])).count() == 0


def test_token_counts_are_of_whole_texts(spark):
    texts = ["", None, "one two three", "ü" * 50_000, "a b " * 100_000, "<|endoftext|>"]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    enc = packing.tokenizer()
    assert got == {k: len(enc.encode_ordinary(t or "")) for k, t in enumerate(texts)} and got[2] == 3
    assert enc.decode(enc.encode_ordinary("Zürich – 東京 \n\t x")) == "Zürich – 東京 \n\t x"


def test_a_vocabulary_must_exist():
    with pytest.raises(OSError):
        packing.tokenizer("/nowhere")
