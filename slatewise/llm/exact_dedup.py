"""Exact dedup: tree-merge of digest runs in binomial rounds.

Every input task is one run: per digest its retained identifier, count and
verification marks (map-side, so a hot text is one row per run). In each round
``FAN_IN`` neighbouring runs merge, keyed by (run, digest), so a hot digest
never meets more than ``FAN_IN`` rows of itself in one group, and the last
round is spread over all tasks by digest. Only DataFrame functions are used.

Defined cases: a null text counts as empty; equal texts of any length group;
rows repeated with one identifier form one group of which exactly one row
stays; null identifiers lose against any other; an empty table gives an empty
result; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slatewise.llm.rows import keep_rows, mark_of
from slatewise.llm.storage import save

FAN_IN = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: identifier, row number in the run order, run, SHA-256 and verification marks."""
    norm = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm"), mark_of(F.col(text_col)).alias("mark")).select(
        "id",
        F.monotonically_increasing_id().alias("row_no"),
        F.spark_partition_id().alias("run"),
        F.sha2("norm", 256).alias("digest"),
        "mark",
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("bytes"),
    )


def merge_runs(runs: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """Merge digest runs in rounds until one run is left; one row per digest.

    ``runs`` has (id, row_no, run, digest, check, bytes). At every level the retained
    identifier is the smallest (or largest) of the merged ones, and ``verified`` holds while
    the independent 64-bit check and the byte length agree across all merged rows.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    # For the smallest, nulls must lose too: order by (is null, id); for the largest by (is not null, id).
    rank = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    level = runs.groupBy("run", "digest").agg(
        pick(F.struct(rank.alias("null_rank"), F.col("id"), F.col("row_no"))).alias("kept"),
        F.count(F.lit(1)).alias("n"),
        F.min("check").alias("check_lo"), F.max("check").alias("check_hi"),
        F.min("bytes").alias("bytes_lo"), F.max("bytes").alias("bytes_hi"),
    )
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        level = level.withColumn("run", (F.col("run") / fan_in).cast("int")).groupBy("run", "digest").agg(
            pick("kept").alias("kept"), F.sum("n").alias("n"),
            F.min("check_lo").alias("check_lo"), F.max("check_hi").alias("check_hi"),
            F.min("bytes_lo").alias("bytes_lo"), F.max("bytes_hi").alias("bytes_hi"),
        )
        left = -(-left // fan_in)
    return level.select(
        "digest", F.col("kept.id").alias("keep_id"), F.col("kept.row_no").alias("keep_row"), F.col("n").alias("group_size"),
        ((F.col("check_lo") == F.col("check_hi")) & (F.col("bytes_lo") == F.col("bytes_hi"))).alias("verified"),
    )


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """The digest table, written once (a few dozen bytes a row; so the texts are read once and ``row_no`` is fixed
    however often a task is repeated), with what the merged runs say about each row."""
    rows = save(digests(docs, id_col, text_col), "digests")
    return rows.join(merge_runs(rows, keep), "digest").withColumn("kept", F.col("row_no") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, verified, text_sha256)."""
    return _decided(docs, id_col, text_col, keep).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "verified", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the dropped copies, all columns kept."""
    decided = save(_decided(docs, id_col, text_col, keep).select("id", "mark", F.col("kept").alias("stays")), "copies")
    return keep_rows(docs, decided, id_col, text_col)
