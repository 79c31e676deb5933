"""Slate parsing, history strings, time parsing, padding.

Impression logs arrive as one row per slate with a ``id-label id-label``
string. Parsing and exploding are built-in expressions (split / filter /
transform / explode), so they run inside codegen on whatever partitioning
the scan produced; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.common import col_, last_n

ITEM_RE = r"^[^-]*-[0-9]+$"
TIME_FORMAT = "M/d/yyyy h:mm:ss a"


def parse_slate(impressions: str | Column) -> Column:
    """Lenient parse: array<struct<candidate_id, label>>.

    An item is kept only if it splits on '-' into exactly two parts with an
    integer label; any other item is skipped as a whole (the reference
    appended the id before parsing the label, shifting later labels).
    """
    items = F.filter(F.split(F.trim(F.coalesce(col_(impressions), F.lit(""))), r"\s+"),
                     lambda x: x.rlike(ITEM_RE))
    return F.transform(items, lambda x: F.struct(
        F.split(x, "-").getItem(0).alias("candidate_id"),
        F.split(x, "-").getItem(1).cast("int").alias("label")))


def explode_slate(df: DataFrame, impressions_col: str = "impressions", strict: bool = True) -> DataFrame:
    """One row per (slate, candidate) with ``position`` (1-based), candidate_id, label.

    strict: every item must be ``id-label`` with an integer label; a bad
    label fails the job (ANSI cast), as in the reference's strict explode.
    """
    keep = [c for c in df.columns if c != impressions_col]
    if strict:
        # split once: what follows the first '-' must be an integer as a whole
        items = F.transform(F.split(F.trim(F.col(impressions_col)), r"\s+"), lambda x: F.struct(
            F.split(x, "-", 2).getItem(0).alias("candidate_id"),
            F.split(x, "-", 2).getItem(1).cast("int").alias("label")))
    else:
        items = parse_slate(impressions_col)
    return (df.select(*keep, F.posexplode(items).alias("pos", "c"))
              .select(*keep, (F.col("pos") + 1).alias("position"), "c.candidate_id", "c.label"))


def parse_history(history: str | Column) -> Column:
    """Space-separated ids -> array; null / blank -> empty array."""
    return F.filter(F.split(F.trim(F.coalesce(col_(history), F.lit(""))), r"\s+"), lambda x: x != F.lit(""))


def parse_time(text: str | Column, fmt: str = TIME_FORMAT) -> Column:
    """String -> timestamp (no zone); unparsable -> null."""
    return F.try_to_timestamp(col_(text), F.lit(fmt)).cast("timestamp_ntz")


def pad_history(ids: str | Column, n: int, pad: str = "0") -> Column:
    """Last n ids, left-padded with ``pad`` to length n."""
    tail = last_n(col_(ids), n)
    return F.concat(F.array_repeat(F.lit(pad), F.lit(n) - F.size(tail)), tail)


def pad_tokens(tokens: str | Column, n: int) -> Column:
    """First n tokens, zero-padded on the right (post padding / truncation)."""
    return F.slice(F.concat(col_(tokens), F.array_repeat(F.lit(0), F.lit(n))), 1, n)


def slate_histories(slates: DataFrame, clicks: DataFrame, user_col: str = "user_id",
                    ts_col: str = "ts", item_col: str = "item_id") -> DataFrame:
    """For each slate (user, ts), the user's clicked items strictly before ts,
    ordered by (click time, item id), as a space-separated string (null if none).

    One window per user over clicks and slates interleaved in time order;
    ``range`` frame ending 1 microsecond before the row gives strictly
    earlier clicks. No self join of a user's rows with each other.
    """
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    c = clicks.select(F.col(user_col), us.alias("_t"),
                      F.struct(us.alias("t"), F.col(item_col).cast("long").alias("i")).alias("_click"),
                      F.lit(None).cast("long").alias("_slate"))
    s = slates.select(F.col(user_col), us.alias("_t"),
                      F.lit(None).cast("struct<t:bigint,i:bigint>").alias("_click"),
                      F.lit(1).cast("long").alias("_slate"), *[F.col(x) for x in slates.columns if x != user_col])
    for x in slates.columns:
        if x != user_col:
            c = c.withColumn(x, F.lit(None).cast(slates.schema[x].dataType))
    u = c.unionByName(s)
    w = Window.partitionBy(user_col).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    hist = F.array_sort(F.collect_list("_click").over(w))
    out = u.withColumn("_h", hist).filter(F.col("_slate").isNotNull())
    h = F.array_join(F.transform("_h", lambda e: e["i"].cast("string")), " ")
    return out.select(*slates.columns, F.when(F.size("_h") > 0, h).alias("history"))
