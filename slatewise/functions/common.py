"""Small column-expression helpers shared by the operators.

All of them build Catalyst expressions (no Python UDFs), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den as double, ``default`` when den is 0 or null."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)),
                      F.lit(default).cast("double"))


def r6(c: Column) -> Column:
    """Round a double to 6 places (output convention shared with the oracle SQL)."""
    return F.round(c.cast("double"), 6)


def md5_draw(seed: str | int, *keys: str | Column) -> Column:
    """Deterministic uniform draw in [0, 2^32) from md5(seed|key...).

    Replaces pandas/numpy seeded randomness, which cannot be reproduced
    across engines. Same value as DuckDB ``('0x'||substr(md5(..),1,8))::bigint``.
    """
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit("|"), col_(k).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def draw_fraction(seed: str | int, *keys: str | Column) -> Column:
    """md5 draw scaled to [0, 1)."""
    return md5_draw(seed, *keys).cast("double") / F.lit(4294967296.0)


def ts_string(c: str | Column) -> Column:
    """Timestamp rendered as text with microseconds (engine-neutral output)."""
    return F.date_format(col_(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def last_n(arr: Column, n: int | Column) -> Column:
    """Python ``arr[-n:]`` for n >= 0 (n = 0 gives an empty array).

    Spark ``slice`` with a negative start beyond the length returns an
    empty array, unlike Python, so clamp the start at 1.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    n = F.greatest(n, F.lit(0))
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def first_n(arr: Column, n: int | Column) -> Column:
    """Python ``arr[:n]`` for n >= 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(arr, 1, F.greatest(n, F.lit(0)))
