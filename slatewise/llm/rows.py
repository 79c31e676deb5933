"""Keeping whole rows by a decision that was taken on narrow ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def mark_of(text: Column) -> Column:
    """Tells rows of one identifier apart by their raw text."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (id, mark, stays) lets stay, all columns kept.

    Rows are found by identifier (nulls included) and text; of rows repeated in both, all stay where ``decided``
    keeps them all, and one where it keeps fewer.
    """
    groups = decided.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__stay")).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if("stays").alias("__stays")).where("__stays > 0")
    rows = docs.withColumn("__mark", mark_of(F.col(text_col)))

    def found(some: DataFrame) -> DataFrame:
        return rows.join(some, rows[id_col].eqNullSafe(some["__id"]) & (rows["__mark"] == some["__stay"]), "left_semi")

    left, fewer = found(groups.where("__stays = __rows")), groups.where("__stays < __rows")
    if not fewer.isEmpty():
        left = left.unionAll(found(fewer).dropDuplicates([id_col, "__mark"]))
    return left.select(*docs.columns)
