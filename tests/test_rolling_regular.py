import datetime as dt
import math
import random

import numpy as np

from loomcast.operators import regular, rolling


def test_trailing_totals_equal_brute_force(spark):
    rng = random.Random(2)
    day = dt.date(2024, 2, 20)
    rows = [(f"i{rng.randrange(150)}" if rng.random() < 0.8 else None, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None] + [day + dt.timedelta(k * 3) for k in range(20)]), rng.choice([None, 1, 5])) for _ in range(300)]
    seen = {}
    for i, c, t, v in rows:
        if i is not None and i not in seen:
            seen[i] = (c, t, v)
    rows = [(i, *(seen[i] if i else (c, t, v))) for i, c, t, v in rows]
    df = spark.createDataFrame(rows, "event_id string, cell int, t date, value bigint")
    once = rolling.once_per_id(df, "event_id", ["cell", "t", "value"])
    out = rolling.trailing_totals(rolling.daily_totals(once, "cell", "t", "value"), (7, 30), tail=30).collect()
    events = [*seen.values(), *((c, t, v) for i, c, t, v in rows if i is None)]
    want = {}
    for c in {e[0] for e in events} - {None}:
        own = [(t, v or 0) for k, t, v in events if k == c and t]
        for n in range((max(own)[0] - min(own)[0]).days + 31):
            d = min(own)[0] + dt.timedelta(n)
            total = lambda p: sum(v for t, v in own if 0 <= (d - t).days < p)  # noqa: B023, E731
            want[c, d] = (total(1), total(7), total(30), total(7) / 7.0, total(30) / 30.0)
    assert {(r["entity"], r["on_day"]): tuple(r)[2:] for r in out} == want and len(out) == len(want)
    assert rolling.trailing_totals(rolling.daily_totals(df.where("cell > 9"), "cell", "t", "value"), (7,)).count() == 0


def _solve(days, y, first, harmonics=2, ridge=regular.RIDGE):
    a = 2 * math.pi / regular.YEAR_DAYS
    x = lambda d: [1.0, (d - first) / regular.YEAR_DAYS, *(f(a * k * d) for k in range(1, harmonics + 1) for f in (math.sin, math.cos))]
    m = np.array([x(d) for d in days])
    n = m.T @ m
    w = ridge * np.trace(n) / len(n)
    n[range(1, len(n)), range(1, len(n))] += w
    coef = np.linalg.solve(n, m.T @ np.array(y))
    return lambda d: float(np.dot(x(d), coef))


def test_series_equals_brute_force(spark):
    day = dt.date(2022, 1, 1)
    rng = random.Random(5)
    rows = [(k, day + dt.timedelta(rng.randrange(400)), rng.choice([None, 0, 1, 4]) if k else rng.choice([1, 2])) for k in (0, 1) for _ in range(60)]
    rows += [(2, day, 3), (3, day, None), (3, day + dt.timedelta(9), None), (None, day, 1), (4, None, 1)]
    df = spark.createDataFrame(rows, "src int, d date, v bigint")
    out = regular.regular_series(df, ["src"], "d", "v").orderBy("src", "on_day").collect()
    got = {(r["src"], r["on_day"]): r for r in out}
    assert len(got) == len(out) and {r["src"] for r in out} == {0, 1, 2, 3}
    for k in (0, 1, 2):
        read = {}
        for s, d, v in rows:
            if s == k:
                read.setdefault(d, []).append(v)
        mean = {d: float(np.mean([v for v in vs if v is not None])) for d, vs in read.items() if any(v is not None for v in vs)}
        num = {d: (d - dt.date(1970, 1, 1)).days for d in read}
        first = min(num.values())
        f = _solve([num[d] for d in mean], list(mean.values()), first)
        ends = sorted(mean)
        for n in range((max(read) - min(read)).days + 1):
            d = min(read) + dt.timedelta(n)
            r, z = got[k, d], (d - dt.date(1970, 1, 1)).days
            assert r["filled"] == (d not in read) and r["n_readings"] == len(read.get(d, []))
            before, after = [e for e in ends if e < d], [e for e in ends if e > d]
            if d in mean:
                want = mean[d]
            else:
                res = lambda e: mean[e] - f(num[e])  # noqa: B023, E731
                if before and after:
                    p, q = before[-1], after[0]
                    share = (z - num[p]) / (num[q] - num[p])
                    want = f(z) + res(p) + share * (res(q) - res(p))
                else:
                    want = f(z) + res(before[-1] if before else after[0])
            assert math.isclose(r["value"], want, rel_tol=1e-6, abs_tol=1e-6)
    assert all(r["value"] is None for r in out if r["src"] == 3)
    gaps = regular.gaps(regular.regular_series(df, ["src"], "d", "v"), ["src"], 7).where("src = 3").collect()
    assert [(r["gap_first"], r["gap_last"]) for r in gaps] == [(day + dt.timedelta(1), day + dt.timedelta(8))]
    assert regular.regular_series(df.where("src > 50"), ["src"], "d", "v").count() == 0


def test_filled_values_follow_the_season(spark):
    day = dt.date(2021, 1, 1)
    value = lambda n: 10 + 4 * math.sin(2 * math.pi * n / regular.YEAR_DAYS)
    rows = [(1, day + dt.timedelta(n), value(n)) for n in range(730) if not 300 <= n < 400]
    out = regular.regular_series(spark.createDataFrame(rows, "src int, d date, v double"), ["src"], "d", "v").where("filled").collect()
    assert len(out) == 100
    assert max(abs(r["value"] - value((r["on_day"] - day).days)) for r in out) < 0.2
