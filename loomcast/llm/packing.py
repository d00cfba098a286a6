"""Filling fixed-capacity containers with texts of varying length (problem 6).

Texts are measured in tokens of a public tokenizer. A text longer than the capacity is cut into full pieces and a rest;
all other texts stay whole. Items are dealt into groups of bounded size by hash; in a group Karmarkar-Karp multiway
differencing merges partial partitions with opposing imbalances into near-equal windows.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.session import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public pre-tokenization pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Windows a group is expected to fill; about half a window of a group is lost to rounding.
GROUP_WINDOWS = 192


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY, pattern: str = PATTERN):  # noqa: ANN201
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every row, whole texts; a null or empty text has 0 tokens."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return documents.select(F.col(id_col).alias("doc_id"), F.pandas_udf(count, "bigint")(F.col(text_col)).alias("n_tokens"))


# --- differencing ---------------------------------------------------------------


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: the indices of ``sizes`` in ``k`` windows of near-equal sum.

    Every partial partition holds up to k sums, largest first (those absent are 0). The two partitions of greatest
    spread are merged, the largest sums of one with the smallest of the other, until one is left. Members of a sum are a
    chain of indices, so that a merge costs no copying.
    """
    n = len(sizes)
    follow = np.full(n + 1, -1, np.int64)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, ah, at = heapq.heappop(heap)
        _, _, b, bh, bt = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the last `over` sums of both meet, smallest with largest of these
            i, j = slice(len(a) - over, None), slice(len(b) - over, None)
            follow[at[i]] = bh[j][::-1]
            sums = np.concatenate([a[: -over or None], a[i] + b[j][::-1], b[: len(b) - over]])
            heads = np.concatenate([ah, bh[: len(b) - over]])
            tails = np.concatenate([at[: len(a) - over], bt[j][::-1], bt[: len(b) - over]])
        else:
            sums, heads, tails = np.concatenate([a, b]), np.concatenate([ah, bh]), np.concatenate([at, bt])
        order = np.argsort(-sums, kind="stable")
        sums, heads, tails = sums[order], heads[order], tails[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, turn, sums, heads, tails))
        turn += 1
    out = []
    for head, tail in zip(heap[0][3].tolist(), heap[0][4].tolist()) if heap else ():
        chain = [head]
        while chain[-1] != tail:
            chain.append(int(follow[chain[-1]]))
        out.append(chain)
    return out


def pack(sizes: list[int], capacity: int, *, slack: float = 0.002) -> list[list[int]]:
    """Indices of ``sizes`` (each at most ``capacity``) in windows that never exceed the capacity.

    Differencing starts with the fewest windows the total allows. While some window exceeds the capacity, the windows
    that are full to within ``slack`` are closed and the rest is differenced anew; if none is that full the slack
    doubles, and once it spans everything the window count rises.
    """
    left, out, extra = list(range(len(sizes))), [], 0
    while left:
        k = max(1, math.ceil(sum(sizes[i] for i in left) / capacity)) + extra
        windows = [[left[i] for i in w] for w in difference([sizes[i] for i in left], k)]
        fill = [sum(sizes[i] for i in w) for w in windows]
        if max(fill) <= capacity:
            return out + windows
        closed = [w for w, f in zip(windows, fill) if capacity * (1 - slack) <= f <= capacity]
        if closed:
            out += closed
            gone = {i for w in closed for i in w}
            left = [i for i in left if i not in gone]
        elif slack < 1:
            slack = min(1.0, 2 * slack)
        else:
            extra += 1
    return out


def fill_containers(counts: DataFrame, containers: DataFrame, *, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """``container, window_id, doc_id, piece, start_token, n_tokens``: every text assigned to windows of every container.

    ``counts``: ``doc_id, n_tokens``; ``containers``: ``container, capacity_tokens`` (rows with a null name or a capacity
    that isn't positive are left out; of equal names the least capacity holds). The rows of a window sum to at most
    its capacity. A text above the capacity is cut into full pieces, each a window of its own, and a rest (piece numbers
    from 0). Texts of 0 tokens, null texts included, join a window without using space; rows with null or
    repeated ids are items like any other. Empty tables give no rows.

    Groups go by a hash of the row's place in the checkpointed counts, so copies and null ids don't gather in one group.
    """
    counts = materialise(counts.select("doc_id", "n_tokens"))
    counts = counts.withColumn("row", F.monotonically_increasing_id())  # fixed, as the checkpoint's files are
    boxes = [(r["container"], r["c"]) for r in containers.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.min("capacity_tokens").cast("long").alias("c")).collect()]
    if not boxes:
        return counts.sparkSession.createDataFrame([], _PACKED)
    rest = [F.sum(F.col("n_tokens") % c).alias(f"r{k}") for k, (_, c) in enumerate(boxes)]
    totals = counts.agg(F.count(F.lit(1)).alias("n"), *rest).first()
    plan = []
    for k, (name, c) in enumerate(boxes):
        # besides the windows, a group's items are bounded: many tiny or empty texts would fill no window
        groups = max(1, round((totals[f"r{k}"] or 0) / (c * group_windows)), math.ceil(totals["n"] / 20_000))
        plan.append(F.struct(F.lit(name).alias("container"), F.lit(c).cast("long").alias("capacity"), F.pmod(F.xxhash64("row", F.lit(k)), F.lit(groups)).alias("grp")))
    items = counts.withColumn("b", F.explode(F.array(*plan))).select("b.*", "row", F.col("doc_id").cast("string").alias("doc_id"), "n_tokens")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", kind="stable")
        name, capacity, group = part["container"].iat[0], int(part["capacity"].iat[0]), int(part["grp"].iat[0])
        n = part["n_tokens"].to_numpy(np.int64)
        full, rest = n // capacity, n % capacity
        partial = np.flatnonzero(rest > 0)
        windows = pack(rest[partial].tolist(), capacity)
        window = np.zeros(len(n), np.int64)  # empty texts stay in window 0
        for k, w in enumerate(windows):
            window[partial[w]] = k
        whole = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        last = np.flatnonzero((rest > 0) | (n == 0))
        row = np.concatenate([last, whole])
        return pd.DataFrame(
            {
                "container": name,
                "window_id": (group << 32) + np.concatenate([window[last], len(windows) + np.arange(len(whole))]),
                "doc_id": part["doc_id"].to_numpy()[row],
                "piece": np.concatenate([full[last], piece]).astype(np.int64),
                "start_token": np.concatenate([full[last], piece]) * capacity,
                "n_tokens": np.concatenate([rest[last], np.full(len(whole), capacity)]),
            }
        )

    packed = items.groupBy("container", "grp").applyInPandas(fill, _PACKED.replace("doc_id bigint", "doc_id string"))
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))  # as text until here: nulls would make ids floats


_PACKED = "container string, window_id bigint, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint"


def fill_rates(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, windows, tokens, fill``: the share of all windows' capacity in use."""
    windows = packed.groupBy("container", "window_id").agg(F.sum("n_tokens").alias("n"))
    caps = containers.groupBy("container").agg(F.min("capacity_tokens").alias("c"))
    return windows.groupBy("container").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("tokens")).join(caps, "container").select("container", "windows", "tokens", (F.col("tokens") / (F.col("windows") * F.col("c"))).alias("fill"))
