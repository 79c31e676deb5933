"""Score and result summaries: stats, histograms, balances,
class weights, coverage, log timings, experiment summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions.common import r6


def score_stats(df: DataFrame, group_cols: list[str], score_col: str) -> DataFrame:
    g = list(group_cols)
    return df.groupBy(*g).agg(r6(F.min(score_col)).alias("min"), r6(F.max(score_col)).alias("max"),
                              r6(F.avg(score_col)).alias("mean"), r6(F.stddev_pop(score_col)).alias("std"))


def score_histogram(df: DataFrame, group_cols: list[str], score_col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram between the group's min and max; last bin closed."""
    g = list(group_cols)
    if not g:   # single group: min and max are two numbers
        lo, hi = df.agg(F.min(score_col), F.max(score_col)).first()
        j = df.withColumn("_lo", F.lit(lo)).withColumn("_hi", F.lit(hi))
    else:
        rng = df.groupBy(*g).agg(F.min(score_col).alias("_lo"), F.max(score_col).alias("_hi"))
        j = df.join(rng, g)   # one row per group
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(score_col) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    return j.groupBy(*g, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def label_balance(df: DataFrame, group_cols: list[str], label_col: str = "label") -> DataFrame:
    return df.groupBy(*group_cols, label_col).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights n / (n_classes * count_c)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()   # classes: tiny
    return c.select(label_col, r6(F.lit(float(tot["t"])) / (F.lit(float(tot["k"])) * F.col("n"))).alias("weight"))


def coverage(recommended: DataFrame, catalog: DataFrame, item_col: str = "item_id",
             catalog_col: str = "item_id") -> DataFrame:
    """Distinct recommended items / catalog size."""
    size = catalog.select(catalog_col).distinct().count()   # one number
    rec = recommended.agg(F.countDistinct(item_col).alias("n_recommended"))
    return rec.select("n_recommended", F.lit(size).cast("bigint").alias("catalog_size"),
                      r6(F.col("n_recommended") / F.lit(float(size))).alias("coverage"))


# Fixed value: the log grammar, a quoted name, ':', optional blanks, a quoted number with 'ms'.
TIMING_RE = r"(?U)'(\w+)':\s*'([\d.]+)ms'"


def component_timings(logs: DataFrame, line_col: str = "line") -> DataFrame:
    """Mean milliseconds per component from ``'name': '1.2ms'`` pairs in log lines, slowest first."""
    names = F.regexp_extract_all(F.col(line_col), F.lit(TIMING_RE), 1)
    vals = F.regexp_extract_all(F.col(line_col), F.lit(TIMING_RE), 2)
    z = logs.select(F.explode(F.arrays_zip(names.alias("n"), vals.alias("v"))).alias("p"))
    means = z.groupBy(F.col("p.n").alias("component")).agg(r6(F.avg(F.col("p.v").cast("double"))).alias("mean_ms"))
    return means.orderBy(F.col("mean_ms").desc(), "component")


def experiment_summary(rows: DataFrame, metric_cols: list[str], group_cols: list[str] = (),
                       filter_col: str = "num_future_clicks") -> DataFrame:
    """Over rows with ``filter_col`` != 0: row count and the mean of each metric
    (NaN and null ignored)."""
    g = list(group_cols)
    r = rows.filter(F.col(filter_col) != 0)
    aggs = [F.count(F.lit(1)).alias("users")]
    for c in metric_cols:
        v = F.col(c).cast("double")
        aggs.append(r6(F.avg(F.when(~F.isnan(v), v))).alias(c))
    return r.groupBy(*g).agg(*aggs) if g else r.agg(*aggs)


def standardize(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std per column; std 0 -> 0."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()   # 2 numbers per column
    out = df
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0))
    return out
