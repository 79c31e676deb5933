"""Exact row numbers without a single-task global window (SURVEY 2.6
``assign_row_id``, 2.10 shuffles/splits, donor pools).

``row_number() over (order by k)`` with no partition (or one huge
partition, e.g. one label or one hot day) runs in one task. Here the first
order column is cut into range buckets by approximate quantiles (per
partition group). A first value that fills more than one bucket (a constant
score, a word count of 1) is cut again by quantiles of the second order
column. Bucket sizes are prefix-summed on a tiny table, and the row number
inside each bucket is a window over (group, bucket). Buckets follow the whole
ordering, so the result is exactly its row_number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BUCKETS, MAX_BUCKETS = 64, 1024


def bucket_count(df: DataFrame) -> int:
    """As many range buckets as the session shuffles into, within fixed bounds."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(n, MIN_BUCKETS), MAX_BUCKETS)


def _probs(buckets: int) -> list[float]:
    return [i / buckets for i in range(1, buckets)]


def _rank_value(df: DataFrame, col: str) -> Column | None:
    """A number that never decreases in the column's order; None where the type has none."""
    t = df.schema[col].dataType
    if isinstance(t, T.NumericType):
        return F.col(col)
    if isinstance(t, T.StringType):   # strings order by bytes: the first seven as one number
        return F.conv(F.rpad(F.hex(F.substring(F.col(col).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return None


#: Bounds in a step of the two-level search.
STEP = 16


def _below(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda x: x < value))


def _every_step(bounds: Column) -> Column:
    """Each ``STEP``-th of the (ascending) bounds."""
    return F.filter(bounds, lambda x, i: i % STEP == STEP - 1)


def _below_by_steps(bounds: Column, coarse: Column, value: Column) -> Column:
    """``_below`` of ascending bounds: whole steps first, then the bounds of one step."""
    steps = _below(coarse, value)
    return steps * STEP + _below(F.slice(bounds, steps * STEP + 1, STEP), value)


def row_positions(df: DataFrame, order_cols: list[str], part_cols: list[str] = (),
                  out_col: str = "position", buckets: int | None = None, uniform_range: int | None = None,
                  total_col: str | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based row number within ``part_cols`` ordered by
    ``order_cols`` (ascending; the first one numeric). Ties in all order
    columns get an arbitrary but complete numbering, so pass a unique key last.
    Rows that tie in the first two columns share a bucket.

    ``uniform_range``: the first column is uniform on [0, uniform_range) (an
    md5 draw), so equal-width buckets are already balanced and the quantile
    pass over the input is skipped. ``total_col`` (with ``part_cols``) adds
    the number of rows of the group.
    """
    parts = list(part_cols)
    buckets = buckets or bucket_count(df)
    if not parts:
        return _global_positions(df, order_cols, out_col, buckets, uniform_range)
    if uniform_range:
        b = df.withColumn("_bk", _uniform_bucket(order_cols[0], buckets, uniform_range)).withColumn("_sub", F.lit(0))
    else:
        b = _grouped_buckets(df, order_cols, parts, buckets)
    sizes = b.groupBy(*parts, "_bk", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    wg = Window.partitionBy(*parts)
    wo = wg.orderBy("_bk", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    total = [F.sum("_n").over(wg).alias(total_col)] if total_col else []
    offs = sizes.select(*parts, "_bk", "_sub", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"), *total)
    wi = Window.partitionBy(*parts, "_bk", "_sub").orderBy(*order_cols)
    inner = b.withColumn("_in", F.row_number().over(wi))
    # the rows are already partitioned by the join key
    out = inner.join(offs, [*parts, "_bk", "_sub"])
    return out.withColumn(out_col, (F.col("_off") + F.col("_in")).cast("bigint")).drop("_bk", "_sub", "_in", "_off")


def _grouped_buckets(df: DataFrame, order_cols: list[str], parts: list[str], buckets: int) -> DataFrame:
    first = order_cols[0]
    bounds = df.groupBy(*parts).agg(F.percentile_approx(first, _probs(buckets), 10000).alias("_bounds")).withColumn("_coarse", _every_step(F.col("_bounds")))
    # one row per group, ``buckets`` values each: few groups (models, methods, labels), which a shuffle would make one task each
    b = df.join(F.broadcast(bounds), parts)
    b = b.withColumn("_bk", _below_by_steps(F.col("_bounds"), F.col("_coarse"), F.col(first))).drop("_coarse")
    second = _rank_value(df, order_cols[1]) if len(order_cols) > 1 else None
    if second is None:
        return b.withColumn("_sub", F.lit(0)).drop("_bounds")
    heavy = F.size(F.filter("_bounds", lambda x: x == F.col(first))) > 1
    b = b.withColumn("_second", second).withColumn("_heavy", F.coalesce(heavy, F.lit(False))).drop("_bounds")
    subs = (b.where("_heavy").groupBy(*parts, "_bk").agg(F.percentile_approx("_second", _probs(buckets), 10000).alias("_subs"))
             .groupBy(*parts).agg(F.map_from_entries(F.collect_list(F.struct("_bk", "_subs"))).alias("_subs")))   # < buckets entries
    b = b.join(F.broadcast(subs), parts, "left")
    sub = F.when(F.col("_heavy"), _below(F.try_element_at("_subs", F.col("_bk")), F.col("_second")))
    return b.withColumn("_sub", F.coalesce(sub, F.lit(0))).drop("_second", "_heavy", "_subs")


def assign_row_id(df: DataFrame, key_cols: list[str], out_col: str = "row_id") -> DataFrame:
    """Dense 0-based row id in the order of a stable natural key (never
    ``monotonically_increasing_id``, which depends on the partitioning)."""
    p = row_positions(df, key_cols, [], "_pos")
    return p.withColumn(out_col, F.col("_pos") - 1).drop("_pos")


def _uniform_bucket(col: str, buckets: int, uniform_range: int):
    """Monotone equal-width bucket of a value uniform on [0, uniform_range)."""
    return F.least(F.floor(F.col(col) * F.lit(buckets) / F.lit(float(uniform_range))),
                   F.lit(buckets - 1)).cast("int")


def _global_positions(df: DataFrame, order_cols: list[str], out_col: str, buckets: int,
                      uniform_range: int | None = None) -> DataFrame:
    """Ungrouped case: the quantile bounds and bucket offsets are small
    parameters, inlined as literals, so no join is needed."""
    b = _global_buckets(df, order_cols, buckets, uniform_range)
    # at most 2 x buckets rows
    sizes = {(r["_bk"], r["_sub"]): r["_n"] for r in b.groupBy("_bk", "_sub").agg(F.count(F.lit(1)).alias("_n")).collect()}
    offs, run, width = {}, 0, buckets + 1
    for (bk, sub), n in sorted(sizes.items()):
        offs[bk * width + sub] = run
        run += n
    if not offs:
        return b.withColumn(out_col, F.lit(0).cast("bigint")).drop("_bk", "_sub")
    table = F.create_map(*[F.lit(x).cast(t) for k, v in offs.items() for x, t in ((k, "int"), (v, "bigint"))])
    off = F.try_element_at(table, F.col("_bk") * F.lit(width) + F.col("_sub"))
    wi = Window.partitionBy("_bk", "_sub").orderBy(*order_cols)
    return b.withColumn(out_col, (off + F.row_number().over(wi)).cast("bigint")).drop("_bk", "_sub")


def _global_buckets(df: DataFrame, order_cols: list[str], buckets: int, uniform_range: int | None) -> DataFrame:
    first = F.col(order_cols[0])
    if uniform_range:
        return df.withColumn("_bk", _uniform_bucket(order_cols[0], buckets, uniform_range)).withColumn("_sub", F.lit(0))
    bounds = df.agg(F.percentile_approx(first, _probs(buckets), 10000)).first()[0] or []   # < buckets numbers
    if not bounds:
        return df.withColumn("_bk", F.lit(0)).withColumn("_sub", F.lit(0))
    b = df.withColumn("_bk", _below(F.array(*[F.lit(x) for x in bounds]), first))
    second = _rank_value(df, order_cols[1]) if len(order_cols) > 1 else None
    times = {x: bounds.count(x) for x in set(bounds) if bounds.count(x) > 1}
    sub = F.lit(0)
    if times and second is not None:
        # one row per first value that fills more than one bucket, cut into as many pieces as it fills
        rows = (df.where(first.isin(*times)).groupBy(first.alias("x"))
                  .agg(F.percentile_approx(second, _probs(buckets), 10000).alias("q")).collect())
        cases = None
        for r in rows:
            n = times[r["x"]] + 1
            cuts = [r["q"][i * buckets // n - 1] for i in range(1, n)] if r["q"] else []
            if cuts:
                piece = _below(F.array(*[F.lit(c) for c in cuts]), second)
                cases = (F if cases is None else cases).when(first == F.lit(r["x"]), piece)
        if cases is not None:
            sub = F.coalesce(cases.otherwise(0), F.lit(0))
    return b.withColumn("_sub", sub)
