"""Bind the driver tables to the recommender shapes (FIXTURES.md section 3).

impr   labelled slates: one row per (impression, item) with three scores
preds  long prediction set (row_id, impression_id, y_true, model, y_pred)
behav  wire format: one row per slate, ``item-label item-label ...``
inter  interactions from ``events`` (view/click/purchase), item from props
news   catalog from ``documents``
vec    item vectors from ``embeddings``

All readers select only the columns they need, so the parquet scans are
pruned; filters are written before joins/explodes so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slate rows of one task: shuffled prediction rows are a few bytes each, so partitions cut by their bytes hold millions of them.
TASK_ROWS = 400_000

# Model names of the three stacked score columns of ``preds``.
MODEL_NAMES = {"s0": "fastformer_0_x", "s1": "fastformer_global_x", "s2": "fastformer_news_x"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # event times are naive (TIMESTAMP_NTZ); watermarks, windows and epoch
    # arithmetic cast them through the session zone, which must be UTC
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled slates.

    Lineitem meets part first, in a plain join (no rows of a scan are held to
    be dealt among many tasks, and AQE splits a part in very many orders).
    The rows are then dealt by order, about ``TASK_ROWS`` to a task, for the
    aggregate on (orderkey, partkey) and the join with orders: what is grouped
    by slate needs no further shuffle. The aggregate is per row of part
    (``_part``), as a join of the aggregated rows with part would give.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_discount").alias("s0"), F.col("l_tax").alias("s1"), (F.col("l_quantity") / F.lit(50.0)).alias("s2"))
    n = max(spark.sparkContext.defaultParallelism, -(-li.count() // TASK_ROWS))   # the count is read from the file footers
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.monotonically_increasing_id().alias("_part"))
    rows = (li.join(part, li.l_partkey == part.p_partkey).repartition(n, "l_orderkey")
              .groupBy("l_orderkey", "l_partkey", "_part")
              .agg(*[F.max(c).alias(c) for c in ("label", "s0", "s1", "s2")], F.first("p_type").alias("p_type")))
    j = rows.join(orders, rows.l_orderkey == orders.o_orderkey)
    return j.select(
        F.col("l_orderkey").alias("impression_id"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_orderkey") * F.lit(1000000) + F.col("l_partkey")).alias("row_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("p_type").alias("category"),
        "label", "s0", "s1", "s2",
    )


def preds(spark: SparkSession, sf_dir: str, impr_df: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Long prediction set: one row per (row_id, model); ``more``: other columns of the slates to keep."""
    base = impr_df if impr_df is not None else impr(spark, sf_dir)
    stack = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(src).cast("double").alias("y_pred"))
        for src, name in MODEL_NAMES.items()]))
    return (base.select("row_id", "impression_id", F.col("label").cast("double").alias("y_true"), *more,
                        stack.alias("p"))
                .select("row_id", "impression_id", "y_true", "p.model", "p.y_pred", *more))


def behav(spark: SparkSession, sf_dir: str, impr_df: DataFrame | None = None) -> DataFrame:
    """Wire format, one row per slate: ``item-label`` items sorted by item id."""
    base = impr_df if impr_df is not None else impr(spark, sf_dir)
    items = F.array_sort(F.collect_list(F.struct("item_id", "label")))
    return (base.groupBy("impression_id", "user_id", "ts")
                .agg(F.array_join(F.transform(items, lambda e: F.concat(
                    e["item_id"].cast("string"), F.lit("-"), e["label"].cast("string"))), " ")
                     .alias("impressions")))


def inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions: shown = every row, clicked = label 1."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")
    return (ev.filter(F.col("event_type").isin("view", "click", "purchase"))
              .select("event_id", "user_id", "ts",
                      F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("item_id"),
                      F.col("event_type").isin("click", "purchase").cast("int").alias("label")))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog: title = first 12 words of the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return d.select(F.col("doc_id").alias("news_id"), F.col("lang").alias("category"),
                    F.col("source").alias("subcategory"),
                    F.array_join(F.slice(F.split(F.trim(F.col("text")), r"\s+", 13), 1, 12), " ").alias("title"),
                    "text")


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors; the 10 labels act as users whose history is their vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"),
                    F.col("label").alias("user_id"))

