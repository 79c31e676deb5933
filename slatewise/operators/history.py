"""History variants and donors for the adaptivity (drift) tests.

Histories reach the models as at most ``max_len`` (50) ids, so arrays here
are always built from the last ``max_len`` rows of the long history: a very
active user never becomes one unbounded value. Python slice semantics are
reproduced with ``slice``/``greatest``; the reference's ``x[-0:]`` (which
returns everything) is treated as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.common import col_, last_n, md5_draw
from slatewise.operators.classification import score_prefix
from slatewise.operators.positions import row_positions


def history_arrays(hist_long: DataFrame, max_len: int = 50, user_col: str = "user_id",
                   pos_col: str = "pos", item_col: str = "item_id") -> DataFrame:
    """(user, pos, item) -> (user, history array of the last max_len items, full length)."""
    n = hist_long.groupBy(user_col).agg(F.max(pos_col).alias("_n"))
    h = hist_long.join(n, user_col).filter(F.col(pos_col) > F.col("_n") - max_len)
    return h.groupBy(user_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pos_col, item_col))), lambda e: e[item_col]).alias("history"),
        F.max("_n").alias("history_len"))


def py_slice(arr: Column, a: Column | int, b: Column | int) -> Column:
    """Python ``arr[a:b]`` for non-negative a, b."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    length = F.greatest(F.least(b, F.size(arr)) - a, F.lit(0))
    return F.slice(arr, a + 1, length)


def swap_history(own: str | Column, donor: str | Column, pivot: int, max_hist: int) -> Column:
    """Daily-donor swap: donor's last ``pivot`` + own last ``max_hist - pivot``."""
    return F.concat(last_n(col_(donor), pivot), last_n(col_(own), max_hist - pivot))


def swap_permuted(own: str | Column, donor: str | Column, pivot: int) -> Column:
    """Permutation swap: donor's last ``pivot`` + own last ``len(own) - pivot``."""
    o = col_(own)
    return F.concat(last_n(col_(donor), pivot), last_n(o, F.size(o) - F.lit(pivot)))


def make_swapped(own: str | Column, donor: str | Column, drift: float, max_len: int = 50,
                 head_swap: bool = True) -> tuple[Column, Column]:
    """(swapped history, pivot). N = min(max_len, len(own)); pivot = max(1, int(N*drift));
    donor truncated to its last N; head swap: donor[:pivot] + own[pivot:N];
    tail swap: own[:N-pivot] + donor[N-pivot:N] (own is sliced from the front)."""
    o, d = col_(own), col_(donor)
    n = F.least(F.lit(max_len), F.size(o))
    pivot = F.greatest(F.lit(1), F.floor(n * F.lit(float(drift))).cast("int"))
    dt = last_n(d, n)
    if head_swap:
        out = F.concat(py_slice(dt, 0, pivot), py_slice(o, pivot, n))
    else:
        cut = F.greatest(n - pivot, F.lit(0))
        out = F.concat(py_slice(o, 0, cut), py_slice(dt, cut, n))
    return out, pivot


def transform_history(hist: str | Column, strategy: str, k: int = 50, donor: str | Column | None = None,
                      pivot: int = 5) -> Column:
    """full / truncate (last k) / remove / swap (donor's last pivot + own rest)."""
    h = col_(hist)
    if strategy == "truncate":
        return last_n(h, k)
    if strategy == "remove":
        return F.filter(h, lambda x: F.lit(False))
    if strategy == "swap":
        if donor is None:
            raise ValueError("donor required for swap")
        return F.concat(last_n(col_(donor), pivot), last_n(h, F.greatest(F.size(h) - F.lit(pivot), F.lit(0))))
    return h


def pad_with_avg(hist: str | Column, avg_profile: Column, max_len: int) -> Column:
    """Empty -> the average profile; shorter than max_len -> append the first
    (max_len - len) entries of the average profile."""
    h = col_(hist)
    return (F.when(F.size(h) == 0, avg_profile)
             .when(F.size(h) < max_len, F.concat(h, F.slice(avg_profile, 1, F.lit(max_len) - F.size(h))))
             .otherwise(h))


def _pool_parts(slates: DataFrame, day_col: str, history_col: str):
    pool = (slates.filter(F.col(history_col).isNotNull() & (F.length(history_col) > 0))
                  .select(day_col, history_col).distinct()
                  .withColumn("_h", md5_draw("pool", history_col)))
    positions = row_positions(pool, ["_h", history_col], [day_col], "pool_idx", uniform_range=2 ** 32).drop("_h")
    sizes = pool.groupBy(day_col).agg(F.count(F.lit(1)).alias("pool_size"))
    return positions, sizes


def daily_pools(slates: DataFrame, day_col: str = "day", history_col: str = "history") -> DataFrame:
    """Distinct non-empty histories per day, numbered 1..size in md5 order."""
    positions, sizes = _pool_parts(slates, day_col, history_col)
    return positions.join(sizes, day_col)


def donor_same_day(slates: DataFrame, seed: int | str, key_col: str = "impression_id",
                   day_col: str = "day", history_col: str = "history") -> DataFrame:
    """Donor history drawn from the day's pool of distinct non-empty histories;
    a pool with <= 1 entry keeps the slate's own history. Equi-join on
    (day, drawn index): no per-day collect."""
    positions, sizes = _pool_parts(slates, day_col, history_col)
    s = slates.join(sizes, day_col, "left").fillna(0, ["pool_size"])
    s = s.withColumn("_idx", F.when(F.col("pool_size") > 1,
                                    (md5_draw(seed, key_col) % F.col("pool_size")) + 1))
    d = positions.select(day_col, F.col("pool_idx").alias("_idx"), F.col(history_col).alias("_donor"))
    j = s.join(d, [day_col, "_idx"], "left")
    return j.withColumn("donor_history", F.when(F.col("pool_size") > 1, F.col("_donor"))
                        .otherwise(F.col(history_col))).drop("_idx", "_donor", "pool_size")


def donor_asof(queries: DataFrame, activity: DataFrame, seed: int | str, key_col: str = "event_id",
               user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """For each query row (key, user, ts) pick a donor uniformly among the other
    users whose first activity is at or before ts.

    Users are numbered by (first time, id); the eligible set at time t is
    exactly the first n(t) users, n(t) from a prefix count over distinct
    times. The draw picks an index among them, skipping the query user, and
    an equi-join on the index fetches the donor: no theta or cross join.
    """
    first = activity.groupBy(user_col).agg(F.min(ts_col).alias("_first"))
    us = F.unix_micros(F.col("_first").cast("timestamp"))
    users = row_positions(first.withColumn("_fus", us), ["_fus", user_col], [], "_upos")
    qt = F.unix_micros(F.col(ts_col).cast("timestamp"))
    times = (first.select(us.alias("_t"), F.lit(1).alias("cnt"))
             .unionByName(queries.select(qt.alias("_t"), F.lit(0).alias("cnt")))
             .groupBy("_t").agg(F.sum("cnt").alias("cnt")))
    cum = score_prefix(times, [], "_t", ["cnt"]).select("_t", (F.col("below_cnt") + F.col("cnt")).alias("_n_le"))
    q = queries.withColumn("_t", qt).join(cum, "_t")
    self_pos = users.select(F.col(user_col), F.col("_upos").alias("_self"), F.col("_fus").alias("_self_t"))
    q = q.join(self_pos, user_col, "left")
    self_in = F.col("_self").isNotNull() & (F.col("_self_t") <= F.col("_t"))
    n_other = F.col("_n_le") - F.when(self_in, 1).otherwise(0)
    r = (md5_draw(seed, key_col) % n_other) + 1
    pick = F.when(self_in & (r >= F.col("_self")), r + 1).otherwise(r)
    q = q.withColumn("_pick", F.when(n_other > 0, pick))
    donors = users.select(F.col("_upos").alias("_pick"), F.col(user_col).alias("donor_user_id"))
    return q.join(donors, "_pick", "left").drop("_t", "_n_le", "_self", "_self_t", "_pick")


def asof_last_n(queries: DataFrame, events: DataFrame, n: int, key_col: str, user_col: str = "user_id",
                ts_col: str = "ts", item_col: str = "item_id", order_col: str = "event_id",
                inclusive: bool = True) -> DataFrame:
    """For each query (key, user, ts): the user's last ``n`` events at (or,
    non-inclusive, strictly before) ts, as an ordered array ``items``.

    Events get a running per-user count c; each query reads the count at its
    time, then fetches exactly the events with c in (cq - n, cq] by an
    equi-join on (user, c). Window state is one counter, and each query
    touches at most n events, however active the user is.
    """
    q_kind, e_kind = (1, 0) if inclusive else (0, 1)
    ev = events.select(user_col, F.col(ts_col).alias("_t"), F.lit(e_kind).alias("_k"),
                       F.col(order_col).cast("long").alias("_o"), F.col(item_col).alias("_item"),
                       F.lit(None).cast(queries.schema[key_col].dataType).alias("_key"))
    qs = queries.select(user_col, F.col(ts_col).alias("_t"), F.lit(q_kind).alias("_k"),
                        F.lit(None).cast("long").alias("_o"),
                        F.lit(None).cast(events.schema[item_col].dataType).alias("_item"),
                        F.col(key_col).alias("_key"))
    u = ev.unionByName(qs)
    w = Window.partitionBy(user_col).orderBy("_t", "_k", "_o", "_key").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_c", F.sum(F.when(F.col("_key").isNull(), 1).otherwise(0)).over(w))
    clicks = u.filter(F.col("_key").isNull()).select(user_col, "_c", "_item")
    qq = u.filter(F.col("_key").isNotNull()).select(
        user_col, "_key", F.explode(F.sequence(F.greatest(F.col("_c") - F.lit(n - 1), F.lit(1)), F.col("_c"))).alias("_c"))
    qq = qq.filter(F.col("_c") > 0)
    j = qq.join(clicks, [user_col, "_c"])
    res = j.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_item"))),
                                            lambda e: e["_item"]).alias("items"))
    return queries.join(res.withColumnRenamed("_key", key_col), key_col, "left").withColumn(
        "items", F.coalesce(F.col("items"), F.filter(F.array(F.lit(None).cast(events.schema[item_col].dataType)),
                                                     lambda x: x.isNotNull())))
