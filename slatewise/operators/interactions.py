"""Interaction-log aggregates for all users at once.

The reference rescans the whole log once per user; here each quantity is
one grouped job over the log. Inputs are long interaction rows
``(user_id, ts, item_id, label)``; ``label = 1`` means clicked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interactions_from_log(log: DataFrame) -> DataFrame:
    """(event_id, user_id, ts, item_id, label) of a behaviors log as read (ImpressionID, UserID, Time, HistoryText, Impressions):
    one row per shown item. The slate is the order among events of one time; rows without a time or user stay, with null."""
    from slatewise.operators.slates import explode_slate, parse_time

    rows = log.select(F.col("ImpressionID").alias("event_id"), F.col("UserID").alias("user_id"), parse_time("Time").alias("ts"), F.col("Impressions").alias("impressions"))
    return explode_slate(rows, strict=False).select("event_id", "user_id", "ts", F.col("candidate_id").alias("item_id"), "label")


def midpoint_time(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """One row: min + (max - min) / 2 (microsecond floor)."""
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    a = df.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    return a.select(F.timestamp_micros(F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("long"))
                    .cast("timestamp_ntz").alias("cutoff"))


def midpoint_value(df: DataFrame, ts_col: str = "ts"):
    """The cutoff as a driver-side scalar (a single small parameter)."""
    return midpoint_time(df, ts_col).first()["cutoff"]


def split_by_time(df: DataFrame, cutoff, ts_col: str = "ts") -> tuple[DataFrame, DataFrame]:
    """train = ts <= cutoff, test = ts > cutoff (rows with null time in neither)."""
    c = F.lit(cutoff).cast("timestamp_ntz")
    return df.filter(F.col(ts_col) <= c), df.filter(F.col(ts_col) > c)


def first_interaction(df: DataFrame, item_col: str = "item_id", ts_col: str = "ts") -> DataFrame:
    """Earliest time each item appears (clicked or not); null times skipped."""
    return (df.filter(F.col(ts_col).isNotNull() & F.col(item_col).isNotNull())
              .groupBy(item_col).agg(F.min(ts_col).alias("first_ts")))


def candidate_pool(df: DataFrame, cutoff, item_col: str = "item_id", ts_col: str = "ts") -> DataFrame:
    """Items whose first interaction is at or before the cutoff.

    The cutoff filter is applied before grouping, which is equivalent (an
    item qualifies iff it has any row at or before the cutoff) and lets the
    predicate reach the scan.
    """
    c = F.lit(cutoff).cast("timestamp_ntz")
    return (df.filter(F.col(ts_col) <= c).groupBy(item_col)
              .agg(F.min(ts_col).alias("first_ts")))


def user_future_clicks(df: DataFrame, cutoff, user_col: str = "user_id", item_col: str = "item_id",
                       ts_col: str = "ts", label_col: str = "label") -> DataFrame:
    """Distinct (user, item) clicked strictly after the cutoff."""
    c = F.lit(cutoff).cast("timestamp_ntz")
    return (df.filter((F.col(ts_col) > c) & (F.col(label_col) == 1))
              .select(user_col, item_col).distinct())


def user_shown_articles(df: DataFrame, cutoff, user_col: str = "user_id", item_col: str = "item_id",
                        ts_col: str = "ts") -> DataFrame:
    """Distinct (user, item) shown strictly after the cutoff (any label)."""
    c = F.lit(cutoff).cast("timestamp_ntz")
    return df.filter(F.col(ts_col) > c).select(user_col, item_col).distinct()


def user_history(df: DataFrame, cutoff, user_col: str = "user_id", item_col: str = "item_id",
                 ts_col: str = "ts", order_col: str = "event_id", label_col: str = "label") -> DataFrame:
    """Long history: (user, pos, item) of clicked items at or before the cutoff
    in time order, first occurrence of an item kept. pos is 1-based.

    Kept long (not an array) so a very active user is not one huge value;
    consumers slice by ``pos``.
    """
    c = F.lit(cutoff).cast("timestamp_ntz")
    first = (df.filter((F.col(ts_col) <= c) & (F.col(label_col) == 1))
               .groupBy(user_col, item_col)
               .agg(F.min(F.struct(ts_col, order_col)).alias("_f")))
    w = Window.partitionBy(user_col).orderBy(F.col("_f"), F.col(item_col))
    return first.select(user_col, F.row_number().over(w).alias("pos"), item_col, F.col(f"_f.{ts_col}").alias("first_ts"))


def history_lengths(hist: DataFrame, user_col: str = "user_id") -> DataFrame:
    return hist.groupBy(user_col).agg(F.count(F.lit(1)).alias("history_len"))


def viable_donors(hist: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Users with a non-empty history at the cutoff."""
    return hist.select(user_col).distinct()


def cluster_ground_truth(clicks: DataFrame, clusters: DataFrame, user_col: str = "user_id",
                         item_col: str = "item_id", cluster_col: str = "cluster") -> DataFrame:
    """Distinct clicked items per cluster (clicks already restricted to after the cutoff)."""
    return clicks.join(clusters, user_col).select(cluster_col, item_col).distinct()


def cluster_ground_truth_freq(clicks_rows: DataFrame, clusters: DataFrame, user_col: str = "user_id",
                              item_col: str = "item_id", cluster_col: str = "cluster") -> DataFrame:
    """Click count per (cluster, item) over click rows after the cutoff."""
    return (clicks_rows.join(clusters, user_col).groupBy(cluster_col, item_col)
                       .agg(F.count(F.lit(1)).alias("clicks")))
