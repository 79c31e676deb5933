"""Histories without lists: a per-user click index with position-aware running hashes.

A slate's history is the first ``n`` clicks of its user in (time, item) order, so it is known by (user, n). Two sums of
draws over (position, item) come along: histories of equal length and sums hold the same items in the same order (64 bits),
so contents are compared, pooled and drawn without being built. Items are fetched by position, and only those needed.

Running sums are two-level: time is cut into ranges (one list of bounds for all users), the sums of each (user, range) are
added up on a table of one row per user and range, and a window runs inside (user, range) only. So an active user's
clicks are spread over as many tasks as there are ranges.

A slate without a user or key has an empty history, a click without a user is in none; rows without a time are first. Repeated clicks count as often as they
stand. Item ids are taken as they are, numbers or strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.common import md5_draw
from slatewise.operators.positions import bucket_count

HASHES = ("h1", "h2")


def micros(ts_col: str) -> Column:
    return F.unix_micros(F.col(ts_col).cast("timestamp"))


def time_ranges(rows: DataFrame, ts_col: str = "ts") -> list[int]:
    """Bounds that cut the times of ``rows`` into about equal parts, as many as the session shuffles into; a few numbers.

    Any bounds give right sums; these give even tasks, for all rows whose times are spread like these.
    """
    n = bucket_count(rows)
    return sorted(set(rows.agg(F.percentile_approx(micros(ts_col), [i / n for i in range(1, n)], 10000)).first()[0] or []))


def running_sums(rows: DataFrame, user_col: str, order_cols: list[str], sums: list[str], bounds: list[int]) -> DataFrame:
    """``rows`` with ``before_<s>``, the sum over the user's earlier rows, and ``total_<s>`` over all of them.

    ``order_cols`` begins with a number (the time), cut at ``bounds``; rows equal in all of them may come in any order.
    """
    first = order_cols[0]
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col(first)))
    cut = rows.withColumn("_range", F.when(F.col(first).isNull(), F.lit(-1)).otherwise(at))
    user = Window.partitionBy("_user")
    earlier = user.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(F.col(user_col).alias("_user"), "_range").agg(*[F.sum(s).alias(s) for s in sums]).select(
        "_user", F.col("_range").alias("_at"), *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(user).alias(f"total_{s}") for s in sums])
    inside = Window.partitionBy(user_col, "_range").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    # the rows are already partitioned by the join keys
    out = own.join(offsets, (own[user_col] == offsets["_user"]) & (own["_range"] == offsets["_at"]), "left")
    known = F.col(user_col).isNotNull()
    return out.select(*rows.columns, *[F.when(known, F.col(f"_off_{s}") + F.col(f"_in_{s}")).otherwise(0).alias(f"before_{s}") for s in sums],
                      *[F.when(known, F.col(f"total_{s}")).otherwise(0).alias(f"total_{s}") for s in sums])


def click_index(clicks: DataFrame, user_col: str = "user_id", ts_col: str = "ts", item_col: str = "item_id", bounds: list[int] | None = None) -> DataFrame:
    """(user, t, pos, item, h1, h2): ``pos`` counts the user's clicks from 1 in (time, item) order; ``h1`` and ``h2`` are the
    draws of (pos, item)."""
    c = clicks.select(F.col(user_col), micros(ts_col).alias("t"), F.col(item_col), F.lit(1).cast("long").alias("_one"))
    c = running_sums(c, user_col, ["t", item_col], ["_one"], time_ranges(clicks, ts_col) if bounds is None else bounds).withColumn("pos", F.col("before__one") + 1)
    place = F.concat_ws(":", F.col("pos").cast("string"), F.col(item_col).cast("string"))
    return c.select(user_col, "t", "pos", item_col, *[md5_draw(h, place).alias(h) for h in HASHES])


def history_points(slates: DataFrame, index: DataFrame, user_col: str = "user_id", ts_col: str = "ts", bounds: list[int] | None = None) -> DataFrame:
    """``slates`` with the history of each: ``n`` clicks strictly before its time, their sums ``h1`` and ``h2``, and ``content``,
    which is equal for equal histories and empty for the empty one."""
    zero = F.lit(0).cast("long")
    row = F.struct(*slates.columns)
    s = slates.select(F.col(user_col), micros(ts_col).alias("t"), F.lit(0).alias("_kind"), zero.alias("n"), *[zero.alias(h) for h in HASHES], row.alias("_row"))
    c = index.select(user_col, "t", F.lit(1).alias("_kind"), F.lit(1).cast("long").alias("n"), *HASHES, F.lit(None).cast(s.schema["_row"].dataType).alias("_row"))
    both = running_sums(s.unionByName(c), user_col, ["t", "_kind"], ["n", *HASHES], time_ranges(slates, ts_col) if bounds is None else bounds).where("_kind = 0")
    out = both.select("_row.*", F.col("before_n").alias("n"), *[F.col(f"before_{h}").alias(h) for h in HASHES])
    return out.withColumn("content", F.when(F.col("n") > 0, F.concat_ws(":", "n", *HASHES)).otherwise(F.lit("")))


def slates_after(slates: DataFrame, clicks: DataFrame, user_col: str = "user_id", ts_col: str = "ts", item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(user, item, after) of each click with the number of the user's slates strictly later, and (user, n) of each slate with
    its number of earlier clicks: what sums over all slates' histories need."""
    none = F.lit(None).cast(clicks.schema[item_col].dataType).alias(item_col)
    s = slates.select(F.col(user_col), micros(ts_col).alias("t"), F.lit(0).alias("_kind"), none, F.lit(0).cast("long").alias("click"), F.lit(1).cast("long").alias("slate"))
    c = clicks.select(F.col(user_col), micros(ts_col).alias("t"), F.lit(1).alias("_kind"), F.col(item_col), F.lit(1).cast("long").alias("click"), F.lit(0).cast("long").alias("slate"))
    both = running_sums(s.unionByName(c), user_col, ["t", "_kind"], ["click", "slate"], time_ranges(slates, ts_col))
    return (both.where("_kind = 1").select(user_col, item_col, (F.col("total_slate") - F.col("before_slate")).alias("after")),
            both.where("_kind = 0").select(user_col, F.col("before_click").alias("n")))


def fetch(wanted: DataFrame, index: DataFrame, key_cols: list[str], user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """(keys, pos, item) of ``wanted`` (keys, user, pos): one equi-join on (user, position)."""
    found = index.select(F.col(user_col).alias("_user"), F.col("pos").alias("_pos"), F.col(item_col))
    return wanted.join(found, (wanted[user_col] == found["_user"]) & (wanted["pos"] == found["_pos"])).select(*key_cols, "pos", item_col)


def last_items(points: DataFrame, index: DataFrame, k: int | None, key_col: str, user_col: str = "user_id", item_col: str = "item_id", n_col: str = "n") -> DataFrame:
    """(key, items): the last ``k`` items of each history in order, all of them without ``k``; an empty array where there is none."""
    p = points.select(F.col(key_col), F.col(user_col), F.coalesce(F.col(n_col), F.lit(0)).alias("_n"))
    first = F.lit(1).cast("long") if k is None else F.greatest(F.col("_n") - (k - 1), F.lit(1))
    wanted = p.where("_n > 0").select(key_col, user_col, F.explode(F.sequence(first, F.col("_n"))).alias("pos"))
    items = fetch(wanted, index, [key_col], user_col, item_col).groupBy(F.col(key_col).alias("_key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", item_col))), lambda e: e[item_col]).alias("items"))   # at most k, or the whole history
    empty = F.array().cast(items.schema["items"].dataType)
    return p.join(items, F.col(key_col) == F.col("_key"), "left").select(key_col, F.coalesce("items", empty).alias("items"))


def day_donors(points: DataFrame, seed: int | str, key_col: str = "impression_id", user_col: str = "user_id", day_col: str = "day") -> DataFrame:
    """(key, donor_user, donor_n): a history drawn from the day's pool of distinct non-empty ones, as the first of the users
    that have it; a pool of at most one keeps the slate's own."""
    from slatewise.operators.history import donor_same_day

    drawn = donor_same_day(points.select(key_col, day_col, "content"), seed, key_col, day_col, "content")
    first = points.where("n > 0").groupBy(day_col, F.col("content").alias("donor_history")).agg(F.min(user_col).alias("donor_user"), F.first("n").alias("donor_n"))
    return drawn.join(first, [day_col, "donor_history"], "left").select(key_col, "donor_user", F.coalesce("donor_n", F.lit(0)).alias("donor_n"))


def new_ids(log: DataFrame, user_col: str = "user_id", ts_col: str = "ts", history_col: str = "history", row_col: str = "impression_id",
            bounds: list[int] | None = None) -> DataFrame:
    """(user, t, row, place, item) of the ids in an impression log's history strings, without those that merely repeat.

    A row mostly repeats the one before, with newer ids behind and perhaps the oldest gone in front. Where the list begins
    inside the previous one and agrees with all that follows there, only what comes after is new and only that is exploded;
    any other list is exploded whole, so first occurrences are the same either way. Rows are compared within (user, time range).
    """
    from slatewise.operators.slates import parse_history

    bounds = time_ranges(log, ts_col) if bounds is None else bounds
    rows = log.where(F.col(user_col).isNotNull()).select(user_col, micros(ts_col).alias("t"), F.col(row_col).alias("_row"), parse_history(history_col).alias("_ids"))
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("t")))
    near = Window.partitionBy(user_col, "_range").orderBy("t", "_row")
    rows = rows.where(F.size("_ids") > 0).withColumn("_range", at).withColumn("_last", F.lag("_ids").over(near))
    start = F.array_position("_last", F.get("_ids", F.lit(0)))   # where the list begins in the previous one, from 1; 0: nowhere
    kept = F.size("_last") - start.cast("int") + 1
    repeats = F.col("_last").isNotNull() & (start > 0) & (kept <= F.size("_ids")) & (
        F.slice("_last", F.greatest(start, F.lit(1)).cast("int"), F.size("_last")) == F.slice("_ids", 1, F.greatest(kept, F.lit(0))))
    rows = rows.select(user_col, "t", "_row", "_ids", F.when(repeats, kept).otherwise(0).alias("_skip"))
    fresh = F.slice("_ids", F.col("_skip") + 1, F.greatest(F.size("_ids") - F.col("_skip"), F.lit(0)))
    return rows.select(user_col, "t", "_row", "_skip", F.posexplode(fresh).alias("_p", "item_id")).select(
        user_col, "t", "_row", (F.col("_p") + F.col("_skip")).alias("_place"), "item_id")


def log_history(log: DataFrame, cutoff, user_col: str = "user_id", ts_col: str = "ts", history_col: str = "history", row_col: str = "impression_id",
                bounds: list[int] | None = None) -> DataFrame:
    """Long history (user, pos, item) from the history strings of an impression log: the ids of all the user's rows at or
    before the cutoff, in time, row and list order, the first occurrence of each kept."""
    bounds = time_ranges(log, ts_col) if bounds is None else bounds
    each = new_ids(log.where(F.col(ts_col) <= F.lit(cutoff).cast("timestamp_ntz")), user_col, ts_col, history_col, row_col, bounds)
    first = each.groupBy(user_col, "item_id").agg(F.min(F.struct("t", "_row", "_place")).alias("f")).select(user_col, "item_id", "f.*", F.lit(1).cast("long").alias("_one"))
    numbered = running_sums(first, user_col, ["t", "_row", "_place"], ["_one"], bounds)
    return numbered.select(user_col, (F.col("before__one") + 1).alias("pos"), "item_id")
