"""Row-level feature helpers: category lookup, one-hot, last row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_lookup(df: DataFrame, catalog: DataFrame, item_col: str = "item_id",
                    catalog_id: str = "news_id", category_col: str = "category",
                    unknown: str = "Unknown") -> DataFrame:
    """Left join the item's category; missing -> ``Unknown``."""
    cat = catalog.select(F.col(catalog_id).alias(item_col), F.col(category_col).alias("_cat"))
    return df.join(cat, item_col, "left").withColumn(category_col, F.coalesce("_cat", F.lit(unknown))).drop("_cat")


def one_hot(df: DataFrame, category_col: str, categories: list[str], prefix: str = "cat_") -> DataFrame:
    """One int column per category of a closed list; unknown -> all zeros."""
    return df.select("*", *[(F.col(category_col) == F.lit(c)).cast("int").alias(f"{prefix}{c.lower()}")
                            for c in categories])


def keep_last(df: DataFrame, key_col: str, order_col: str) -> DataFrame:
    """Last row per key by ``order_col`` (the explicit sequence column)."""
    w = Window.partitionBy(key_col).orderBy(F.col(order_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def filter_results(rows: DataFrame, keep_donor: bool, order_col: str, user_col: str = "user_id") -> DataFrame:
    """Result rows of users with future clicks (an unknown number counts as some), the last one per user by ``order_col``.

    ``keep_donor`` keeps the rows with a donor; else those without one stay, and those whose history has no known part
    of the user's own (``num_from_original`` null, where the rows have that column).
    """
    donor = F.col("donor_user_id").isNotNull()
    if not keep_donor:
        donor = ~donor | F.col("num_from_original").isNull() if "num_from_original" in rows.columns else ~donor
    clicks = F.coalesce(F.col("num_future_clicks") != 0, F.lit(True))
    return keep_last(rows.filter(clicks & donor), user_col, order_col)
