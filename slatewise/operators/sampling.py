"""Deterministic sampling, splits, shuffles and balancing.

pandas/numpy seeds cannot be reproduced across engines, so every random
choice is an md5 draw of (seed, key): the same in Spark and in SQL, stable
across re-runs and executor loss (no task-order dependence). ``key_col`` is
a column or several; rows that share the key share the draw, so give all
columns that identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions.common import draw_fraction, md5_draw
from slatewise.operators.positions import row_positions

DRAW_RANGE = 2 ** 32   # md5 draws are uniform on [0, 2^32)


def _keys(key_col: str | Sequence[str]) -> list[str]:
    return [key_col] if isinstance(key_col, str) else list(key_col)


def sample_fraction(df: DataFrame, frac: float, seed: int | str, key_col: str | Sequence[str]) -> DataFrame:
    """Keep about ``frac`` of the rows: draw(seed, key) < frac * 2^32."""
    return df.filter(draw_fraction(seed, *_keys(key_col)) < F.lit(float(frac)))


def split_random(df: DataFrame, test_size: float, seed: int | str, key_col: str | Sequence[str],
                 side_col: str = "side") -> DataFrame:
    """Row-wise random split; ``test_size <= 0`` puts everything in train."""
    if test_size <= 0:
        return df.withColumn(side_col, F.lit("train"))
    return df.withColumn(side_col, F.when(draw_fraction(seed, *_keys(key_col)) < F.lit(float(test_size)), "test")
                         .otherwise("train"))


def split_by_rank(df: DataFrame, group_cols: list[str], test_size: float, seed: int | str, key_col: str | Sequence[str],
                  side_col: str = "side") -> DataFrame:
    """Within each group the first ceil(n_group * test_size) rows in draw order
    are test: exact group-wise proportions (stratified split)."""
    g = list(group_cols)
    d = df.withColumn("_draw", md5_draw(seed, *_keys(key_col)))
    p = row_positions(d, ["_draw", *_keys(key_col)], g, "_pos", uniform_range=DRAW_RANGE, total_col="_n")
    return p.withColumn(side_col, F.when(F.col("_pos") <= F.ceil(F.col("_n") * F.lit(float(test_size))), "test")
                        .otherwise("train")).drop("_draw", "_pos", "_n")


def split_stratified(df: DataFrame, label_col: str, test_size: float, seed: int | str, key_col: str | Sequence[str]) -> DataFrame:
    return split_by_rank(df, [label_col], test_size, seed, key_col)


def split_segments(df: DataFrame, segment_col: str, test_size: float, seed: int | str, key_col: str | Sequence[str],
                   independent: bool) -> DataFrame:
    """Train/val per segment (cluster or category): either one split shared by
    all segments, or each segment split on its own. Each segment's val set is
    only its own rows (the reference's shared-mode category val was the whole
    val set)."""
    if independent:
        return split_by_rank(df, [segment_col], test_size, seed, key_col)
    return split_random(df, test_size, seed, key_col)


def shuffle_rows(df: DataFrame, seed: int | str, key_col: str | Sequence[str], out_col: str = "position") -> DataFrame:
    """Random order as an explicit 1-based position (draw, then key)."""
    d = df.withColumn("_draw", md5_draw(seed, *_keys(key_col)))
    return row_positions(d, ["_draw", *_keys(key_col)], [], out_col, uniform_range=DRAW_RANGE).drop("_draw")


def balance_groups(df: DataFrame, group_col: str, seed: int | str, key_col: str | Sequence[str]) -> DataFrame:
    """Down-sample every group to the size of the smallest one (draw order)."""
    n = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
    m = n.agg(F.min("_n")).first()[0] or 0   # one number
    d = df.withColumn("_draw", md5_draw(seed, *_keys(key_col)))
    p = row_positions(d, ["_draw", *_keys(key_col)], [group_col], "_pos", uniform_range=DRAW_RANGE)
    return p.filter(F.col("_pos") <= F.lit(m)).drop("_draw", "_pos")
