"""Seeded draws that depend only on ids, so retries and repartitioning cannot change a result."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in (0, 1): the leading 52 bits of the md5 of ids, iteration and seed joined by ``|``, which SQL can repeat."""
    cols = [F.lit(p) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def draw_sql(*parts: str) -> str:
    """SQL twin of ``uniform``."""
    return "((('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double)"


def _poisson_steps() -> list[float]:
    """Distribution function of the Poisson law of mean 1, up to where a double can't tell it from 1."""
    steps, term, total = [], math.exp(-1.0), 0.0
    for i in range(1, 18):
        total += term
        steps.append(total)
        term /= i
    return steps


def poisson_one(u: Column) -> Column:
    """Poisson count of mean 1 at the uniform ``u``: the number of steps of the distribution function at or below it."""
    at = F.array(*[F.lit(s) for s in _poisson_steps()])
    return F.size(F.filter(at, lambda s: s <= u))


def poisson_sql(u: str) -> str:
    """SQL twin of ``poisson_one``."""
    return "(" + " + ".join(f"(({u}) >= {s!r}::double)::int" for s in _poisson_steps()) + ")"


def normal(*parts: Column | str | int) -> Column:
    """Standard normal by the Box-Muller transform of two hashed uniforms."""
    u = uniform(*parts, F.lit(11))
    v = uniform(*parts, F.lit(29))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
