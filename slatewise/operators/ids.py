"""Dense numbers for ids of any type, for work that needs numbers (blocked products, positions in the catalog order).

The dictionary is built once from all columns that name the same things, in id order, so a smaller number is a smaller id
and ties resolve as they would on the ids themselves. It is a table like any other, joined by id and joined back by number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.operators.positions import bucket_count
from slatewise.session import materialize


class IdDictionary(NamedTuple):
    """(id, no): distinct ids and their numbers from 1 in id order."""

    table: DataFrame

    def encode(self, df: DataFrame, col: str) -> DataFrame:
        """``col`` as a number; ids that the dictionary lacks, and null, become null. Columns keep their order."""
        return self._swap(df, col, "id", "no")

    def decode(self, df: DataFrame, col: str) -> DataFrame:
        """The ids of the numbers in ``col``."""
        return self._swap(df, col, "no", "id")

    def _swap(self, df: DataFrame, col: str, have: str, want: str) -> DataFrame:
        known = self.table.select(F.col(have).alias("_have"), F.col(want).alias("_want"))
        joined = df.join(known, F.col(col) == F.col("_have"), "left")
        return joined.select(*[F.col("_want").alias(c) if c == col else F.col(c) for c in df.columns])


def numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.IntegralType)


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, no) of distinct ids of any type that has an order: cut into ranges of ids, written, and numbered range by range."""
    cut = materialize(ids.repartitionByRange(bucket_count(ids), "id").withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row a range
    before, offsets = 0, [F.lit(-1), F.lit(0).cast("long")]
    for at in sorted(sizes):
        offsets += [F.lit(at), F.lit(before).cast("long")]
        before += sizes[at]
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("id"))
    return cut.select("id", (F.try_element_at(F.create_map(*offsets), F.col("_range")) + inside).alias("no"))


def id_dictionary(*columns: tuple[DataFrame, str]) -> IdDictionary:
    """The dictionary of all ids in the (frame, column) pairs given; nulls are no ids."""
    frames = [df.select(F.col(c).alias("id")).where(F.col(c).isNotNull()) for df, c in columns]
    all_ids = frames[0]
    for f in frames[1:]:
        all_ids = all_ids.unionAll(f)
    return IdDictionary(materialize(_numbered(all_ids.distinct())))
