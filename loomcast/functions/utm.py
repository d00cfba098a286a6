"""Transverse Mercator (UTM) on WGS84 as SQL expression text, order-6 Krueger series (Karney 2011).

Each stage is a list of ``(name, expression)``; a later stage uses names of earlier ones. The text is valid both in Spark
SQL and in ANSI-style engines, so one definition serves ``selectExpr`` chains (whole-stage codegen) and oracle queries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# WGS84 and UTM.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
RECTIFYING_M = SEMI_MAJOR_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Series coefficients of n^1..n^6, one row for each j = 1..6.
_ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
_BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)


def _series(rows: tuple) -> list[float]:
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in rows]


ALPHA, BETA = _series(_ALPHA), _series(_BETA)
Stage = list[tuple[str, str]]


def num(x: float) -> str:
    """A double literal that both engines read as such."""
    return f"{x!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def zone_of(lon: float) -> int:
    """UTM zone without the Norwegian exceptions; longitude 180 belongs to zone 60."""
    return min(60, math.floor((lon + 180) / 6) + 1)


def forward(lon: str, lat: str, zone: int, *, south: bool = False, prefix: str = "u") -> list[Stage]:
    """Stages that give ``{prefix}_x`` (easting) and ``{prefix}_y`` (northing) in metres."""
    p, e, scale = prefix, num(_E), num(SCALE * RECTIFYING_M)
    d = f"radians({lon} - {num(6.0 * zone - 183)})"
    eta = " + ".join(f"{num(a)} * cos({2 * j}e0 * {p}_xi) * sinh({2 * j}e0 * {p}_eta)" for j, a in enumerate(ALPHA, 1))
    xi = " + ".join(f"{num(a)} * sin({2 * j}e0 * {p}_xi) * cosh({2 * j}e0 * {p}_eta)" for j, a in enumerate(ALPHA, 1))
    return [
        [(f"{p}_s", f"sin(radians({lat}))"), (f"{p}_d", d)],
        [(f"{p}_t", f"sinh(atanh({p}_s) - {e} * atanh({e} * {p}_s))")],
        [(f"{p}_xi", f"atan2({p}_t, cos({p}_d))"), (f"{p}_eta", f"asinh(sin({p}_d) / sqrt({p}_t * {p}_t + cos({p}_d) * cos({p}_d)))")],
        [(f"{p}_x", f"{num(FALSE_EASTING)} + {scale} * ({p}_eta + {eta})"), (f"{p}_y", f"{num(FALSE_NORTHING if south else 0.0)} + {scale} * ({p}_xi + {xi})")],
    ]


def inverse(x: str, y: str, zone: int, *, south: bool = False, prefix: str = "g") -> list[Stage]:
    """Stages that give ``{prefix}_lon`` and ``{prefix}_lat`` in degrees; three Newton steps for the latitude."""
    p, scale = prefix, num(SCALE * RECTIFYING_M)
    eta = " - ".join([f"{p}_v", *[f"{num(b)} * cos({2 * j}e0 * {p}_u) * sinh({2 * j}e0 * {p}_v)" for j, b in enumerate(BETA, 1)]])
    xi = " - ".join([f"{p}_u", *[f"{num(b)} * sin({2 * j}e0 * {p}_u) * cosh({2 * j}e0 * {p}_v)" for j, b in enumerate(BETA, 1)]])
    stages = [
        [(f"{p}_u", f"({y} - {num(FALSE_NORTHING if south else 0.0)}) / {scale}"), (f"{p}_v", f"({x} - {num(FALSE_EASTING)}) / {scale}")],
        [(f"{p}_xi", xi), (f"{p}_eta", eta)],
        [(f"{p}_q", f"sin({p}_xi) / sqrt(sinh({p}_eta) * sinh({p}_eta) + cos({p}_xi) * cos({p}_xi))"), (f"{p}_lon", f"degrees(atan2(sinh({p}_eta), cos({p}_xi))) + {num(6.0 * zone - 183)}")],
    ]
    e, e2 = num(_E), num(_E * _E)
    tau = f"{p}_q"
    for k in range(3):
        r = f"sqrt(1e0 + {tau} * {tau})"
        stages.append([(f"{p}_m{k}", f"sinh({e} * atanh({e} * {tau} / {r}))")])
        stages.append([(f"{p}_w{k}", f"{tau} * sqrt(1e0 + {p}_m{k} * {p}_m{k}) - {p}_m{k} * {r}")])
        step = f"({p}_q - {p}_w{k}) / sqrt(1e0 + {p}_w{k} * {p}_w{k}) * (1e0 + (1e0 - {e2}) * {tau} * {tau}) / ((1e0 - {e2}) * {r})"
        stages.append([(f"{p}_tau{k}", f"{tau} + {step}")])
        tau = f"{p}_tau{k}"
    return [*stages, [(f"{p}_lat", f"degrees(atan({tau}))")]]


def apply(df: DataFrame, stages: list[Stage], keep: list[str]) -> DataFrame:
    """Add the columns ``keep`` of the last stages; intermediate ones are dropped.

    They pass through an array of one struct: the optimiser pushes no filter below a generator, where it would put the
    whole series in the place of each name and multiply it by every stage.
    """
    first = df.columns
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage})
    return df.select(*[F.col(f"`{c}`") for c in first], F.inline(F.array(F.struct(*keep))))


def nested_sql(source: str, stages: list[Stage]) -> str:
    """The same as nested subqueries over ``source`` (a table or a bracketed query with alias)."""
    for k, stage in enumerate(stages):
        source = f"(SELECT *, {', '.join(f'{text} AS {name}' for name, text in stage)} FROM {source}) AS s{k}"
    return source
