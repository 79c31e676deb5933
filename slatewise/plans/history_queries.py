"""Registered queries: history variants, donors and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import last_n, r6
from slatewise.operators import click_index as CI
from slatewise.operators import history as H
from slatewise.operators import interactions as I
from slatewise.operators import ranking as R
from slatewise.operators.positions import row_positions
from slatewise.functions.common import md5_draw
from slatewise.plans import bindings as B
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register
from slatewise.session import materialize
from slatewise.plans.sampling_queries import draw_sql
from slatewise.plans.slate_queries import HIST_CTE, HISTORY_LEN, UHIST_CTE, indexed, inter_cut, tails


def lastn_sql(l: str, n: str) -> str:
    return f"list_slice({l}, GREATEST(len({l}) - ({n}) + 1, 1), len({l}))"


def arr_sql(h: str) -> str:
    return f"list_filter(string_split(coalesce({h}, ''), ' '), lambda x: x <> '')"


def joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# ---- day-keyed donor pools on the slate histories ---------------------------------
def hist_days(spark: SparkSession, sf_dir: str, im: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The click index and each slate's point in it with its day, both written once: pools, donors and variants read them."""
    index, points = indexed(spark, sf_dir, im)
    return index, materialize(points.withColumn("day", F.date_format("ts", "yyyy-MM-dd")))


# ``content`` names a history by its length and two sums of draws over (position, item)
CONTENT_SQL = HIST_CTE + f""",
cd AS (SELECT user_id, ts, {draw_sql('h1', "(pos || ':' || item_id)")} AS d1, {draw_sql('h2', "(pos || ':' || item_id)")} AS d2 FROM (
        SELECT user_id, ts, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos FROM impr WHERE label = 1) x),
ck AS (SELECT hs.impression_id, count(*) || ':' || CAST(SUM(d1) AS BIGINT) || ':' || CAST(SUM(d2) AS BIGINT) AS content
       FROM hs JOIN cd ON cd.user_id = hs.user_id AND cd.ts < hs.ts GROUP BY hs.impression_id)"""
POOL_SQL = CONTENT_SQL + f""",
hd AS (SELECT hist.impression_id, hist.user_id, strftime(hist.ts, '%Y-%m-%d') AS day, hist.history, ck.content FROM hist LEFT JOIN ck USING (impression_id)),
pool AS (SELECT day, history, min(content) AS content, min(user_id) AS donor_user FROM hd WHERE history IS NOT NULL AND length(history) > 0 GROUP BY day, history),
pp AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY {draw_sql('pool', 'content')}, content) AS pool_idx,
              COUNT(*) OVER (PARTITION BY day) AS pool_size FROM pool),
sz AS (SELECT DISTINCT day, pool_size FROM pp),
sd AS (SELECT h.impression_id, h.day, h.history, COALESCE(sz.pool_size, 0) AS pool_size FROM hd h LEFT JOIN sz USING (day)),
dn AS (SELECT sd.impression_id, sd.history,
              CASE WHEN sd.pool_size > 1 THEN pp.history ELSE sd.history END AS donor_history,
              CASE WHEN sd.pool_size > 1 THEN pp.donor_user ELSE own.donor_user END AS donor_user
       FROM sd LEFT JOIN pp ON pp.day = sd.day AND sd.pool_size > 1
                           AND pp.pool_idx = {draw_sql(7, 'sd.impression_id')} % GREATEST(sd.pool_size, 1) + 1
       LEFT JOIN pool own ON own.day = sd.day AND own.history = sd.history)"""


@register("daily_history_pool", with_("impr", extra=POOL_SQL) + "SELECT day, pool_size FROM sz")
def q_daily_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = hist_days(spark, sf_dir)[1]
    return points.where("n > 0").select("day", "content").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("pool_size"))


@register("donor_same_day", with_("impr", extra=POOL_SQL) + f"""SELECT impression_id, CAST(donor_user AS BIGINT) AS donor_user,
  CAST(len({arr_sql('donor_history')}) AS BIGINT) AS donor_len, donor_history FROM dn""")
def q_donor_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who lends a history, how long it is, and the whole of it (null: none)."""
    index, points = hist_days(spark, sf_dir)
    d = materialize(CI.day_donors(points, 7))
    whole = CI.last_items(d, index.withColumnRenamed("user_id", "donor_user"), None, "impression_id", "donor_user", n_col="donor_n")
    return d.join(whole, "impression_id").select("impression_id", F.col("donor_user").cast("long").alias("donor_user"), F.col("donor_n").alias("donor_len"),
                                                 F.when(F.size("items") > 0, joined(F.col("items"))).alias("donor_history"))


def swap_parts(spark: SparkSession, sf_dir: str, own: int | None, donor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the slates' points, and (impression_id, own, donor): the last ids of the own (None: all) and of the donor's history."""
    index, points = hist_days(spark, sf_dir)
    d = CI.day_donors(points, 7)
    mine = CI.last_items(points, index, own, "impression_id").withColumnRenamed("items", "own")
    theirs = CI.last_items(d, index.withColumnRenamed("user_id", "donor_user"), donor, "impression_id", "donor_user", n_col="donor_n").withColumnRenamed("items", "donor")
    return index, points, mine.join(theirs, "impression_id")


@register("history_swap", with_("impr", extra=POOL_SQL) + f"""SELECT impression_id, array_to_string(list_concat(
  {lastn_sql(arr_sql('donor_history'), '2')}, {lastn_sql(arr_sql('history'), '3')}), ' ') AS swapped FROM dn""")
def q_history_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-donor swap with pivot 2 and max history 5."""
    parts = swap_parts(spark, sf_dir, 3, 2)[2]
    return parts.select("impression_id", joined(H.swap_history("own", "donor", 2, 5)).alias("swapped"))


@register("history_swap_permuted", with_("impr", extra=HIST_CTE + f""",
hp AS (SELECT impression_id, {lastn_sql(arr_sql('history'), str(HISTORY_LEN))} AS h,
        row_number() OVER (ORDER BY {draw_sql(1, 'impression_id')}, impression_id) AS p1,
        row_number() OVER (ORDER BY {draw_sql(2, 'impression_id')}, impression_id) AS p2 FROM hist)""")
    + f"""SELECT a.impression_id, array_to_string(list_concat({lastn_sql('b.h', '2')}, {lastn_sql('a.h', 'len(a.h) - 2')}), ' ') AS swapped
FROM hp a JOIN hp b ON b.p2 = a.p1""")
def q_swap_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor = the history at the same position of a second random permutation."""
    h = materialize(tails(spark, sf_dir).select("impression_id", F.col("items").cast("array<string>").alias("h")))
    p1 = row_positions(h.withColumn("_d", md5_draw(1, "impression_id")), ["_d", "impression_id"], [], "pos", uniform_range=2 ** 32).drop("_d")
    p2 = row_positions(h.withColumn("_d", md5_draw(2, "impression_id")), ["_d", "impression_id"], [], "pos", uniform_range=2 ** 32) \
        .select("pos", F.col("h").alias("donor"))
    j = p1.join(p2, "pos")
    return j.select("impression_id", F.array_join(H.swap_permuted("h", "donor", 2), " ").alias("swapped"))


# ---- per-user swaps on the interaction histories ----------------------------------
UARR_SQL = UHIST_CTE + """,
ua AS (SELECT user_id, list(item_id ORDER BY pos) AS h FROM (
         SELECT uh.*, MAX(pos) OVER (PARTITION BY user_id) AS n FROM uh) x WHERE pos > n - 50 GROUP BY user_id),
vd AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS vpos, COUNT(*) OVER () AS nv FROM ua),
dsel AS (SELECT a.user_id, a.h, d.user_id AS donor_user_id, d2.h AS dh FROM ua a
         JOIN vd v ON v.user_id = a.user_id
         JOIN vd d ON d.vpos = """ + draw_sql("donor", "a.user_id") + """ % v.nv + 1
         JOIN ua d2 ON d2.user_id = d.user_id),
sw AS (SELECT *, LEAST(50, len(h)) AS n, GREATEST(1, CAST(floor(LEAST(50, len(h)) * 0.5) AS INT)) AS pv FROM dsel),
sw2 AS (SELECT *, """ + lastn_sql("dh", "n") + """ AS dt FROM sw)"""


def user_arrays(spark: SparkSession, sf_dir: str):
    it, cut = inter_cut(spark, sf_dir)
    return H.history_arrays(I.user_history(it, cut), 50)


def user_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user with a history gets a donor drawn from all users with one."""
    ua = user_arrays(spark, sf_dir)
    vd = row_positions(ua.select("user_id"), ["user_id"], [], "vpos")
    nv = ua.count()   # number of viable donors: one number
    pick = ua.select("user_id", "history", ((md5_draw("donor", "user_id") % F.lit(nv)) + 1).alias("vpos"))
    d = pick.join(vd.withColumnRenamed("user_id", "donor_user_id"), "vpos")
    return d.join(ua.select(F.col("user_id").alias("donor_user_id"), F.col("history").alias("donor_history")),
                  "donor_user_id").drop("vpos")


@register("make_swapped_history", with_("inter", "cut", extra=UARR_SQL) + """SELECT user_id, donor_user_id, pv AS "pivot",
  array_to_string(list_concat(list_slice(dt, 1, LEAST(pv, len(dt))), list_slice(h, pv + 1, LEAST(n, len(h)))), ' ') AS head_swap,
  array_to_string(list_concat(list_slice(h, 1, LEAST(GREATEST(n - pv, 0), len(h))),
                              list_slice(dt, GREATEST(n - pv, 0) + 1, LEAST(n, len(dt)))), ' ') AS tail_swap
FROM sw2""")
def q_make_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_donors(spark, sf_dir)
    head, pivot = H.make_swapped("history", "donor_history", 0.5, 50, True)
    tail, _ = H.make_swapped("history", "donor_history", 0.5, 50, False)
    return d.select("user_id", "donor_user_id", pivot.alias("pivot"), joined(head).alias("head_swap"),
                    joined(tail).alias("tail_swap"))


@register("transform_history", with_("inter", "cut", extra=UARR_SQL) + f"""SELECT user_id, strategy, history FROM (
  SELECT user_id, 'full' AS strategy, array_to_string(h, ' ') AS history FROM sw2
  UNION ALL SELECT user_id, 'truncate', array_to_string({lastn_sql('h', '3')}, ' ') FROM sw2
  UNION ALL SELECT user_id, 'remove', '' FROM sw2
  UNION ALL SELECT user_id, 'swap', array_to_string(list_concat({lastn_sql('dh', '2')},
        {lastn_sql('h', 'GREATEST(len(h) - 2, 0)')}), ' ') FROM sw2) x""")
def q_transform_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = user_donors(spark, sf_dir)
    parts = []
    for strat, kw in (("full", {}), ("truncate", {"k": 3}), ("remove", {}), ("swap", {"pivot": 2, "donor": "donor_history"})):
        col = H.transform_history("history", strat, **kw)
        parts.append(d.select("user_id", F.lit(strat).alias("strategy"), joined(col).alias("history")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("history_last_k", with_("inter", "cut", extra=UHIST_CTE) + """SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY pos) AS history
FROM (SELECT uh.*, MAX(pos) OVER (PARTITION BY user_id) AS n FROM uh) x WHERE pos > n - 5 GROUP BY user_id""")
def q_history_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = user_arrays(spark, sf_dir)
    return ua.select("user_id", joined(last_n(F.col("history"), 5)).alias("history"))


AVG_SQL = UHIST_CTE + f""",
l5 AS (SELECT user_id, list(item_id ORDER BY pos) AS h FROM (
        SELECT uh.*, MAX(pos) OVER (PARTITION BY user_id) AS n FROM uh) x WHERE pos > n - {HISTORY_LEN} GROUP BY user_id),
pd AS (SELECT user_id, list_concat(list_transform(range({HISTORY_LEN} - len(h)), lambda i: 0), h) AS p FROM l5),
av AS (SELECT i AS pos, CAST(trunc(AVG(p[i])) AS INT) AS value FROM pd, range(1, {HISTORY_LEN + 1}) t(i) GROUP BY i)"""


def avg_profile(ua: DataFrame, n: int = HISTORY_LEN) -> DataFrame:
    """Element-wise mean of the left-padded last-n histories, truncated to int."""
    padded = F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(n) - F.size(last_n(F.col("history"), n))),
                      last_n(F.col("history"), n).cast("array<bigint>"))
    p = ua.filter(F.size("history") > 0).select(F.posexplode(padded).alias("p0", "v"))
    return p.groupBy((F.col("p0") + 1).alias("pos")).agg(F.avg("v").cast("int").alias("value"))


@register("global_avg_profile", with_("inter", "cut", extra=AVG_SQL) + "SELECT CAST(pos AS INT) AS pos, value FROM av")
def q_global_avg_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avg_profile(user_arrays(spark, sf_dir)).select(F.col("pos").cast("int").alias("pos"), "value")


@register("pad_with_avg", with_("inter", "cut", extra=AVG_SQL + """,
ap AS (SELECT list(value ORDER BY pos) AS a FROM av),
au AS (SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM l5),
al AS (SELECT au.user_id, coalesce(l5.h, []) AS h FROM au LEFT JOIN l5 USING (user_id))""") + f"""SELECT CAST(user_id AS BIGINT) AS user_id,
  array_to_string(CASE WHEN len(h) = 0 THEN a WHEN len(h) < {HISTORY_LEN} THEN list_concat(h, list_slice(a, 1, {HISTORY_LEN} - len(h)))
  ELSE h END, ' ') AS history FROM al, ap""")
def q_pad_with_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and users of the log; those without a history get the whole average profile."""
    ua = user_arrays(spark, sf_dir)
    prof = [r["value"] for r in avg_profile(ua).orderBy("pos").collect()]   # HISTORY_LEN numbers
    a = F.array(*[F.lit(int(v)).cast("bigint") for v in prof])
    own = ua.select(F.col("user_id").cast("long").alias("user_id"), last_n(F.col("history"), HISTORY_LEN).cast("array<bigint>").alias("h"))
    customers = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    users = customers.unionByName(own.select("user_id")).distinct().join(own, "user_id", "left")
    h = F.coalesce(F.col("h"), F.array().cast("array<bigint>"))
    return users.select("user_id", joined(H.pad_with_avg(h, a, HISTORY_LEN)).alias("history"))


@register("donor_asof", with_("inter", "cut") + f"""
, fu AS (SELECT user_id, MIN(ts) AS first_ts FROM inter GROUP BY user_id),
up AS (SELECT user_id, first_ts, row_number() OVER (ORDER BY epoch_us(first_ts), user_id) AS upos FROM fu),
q AS (SELECT event_id, user_id, ts FROM inter, cut WHERE ts > cutoff),
qn AS (SELECT q.*, (SELECT COUNT(*) FROM fu WHERE fu.first_ts <= q.ts) AS n_le, up.upos AS self_pos, up.first_ts AS self_t
       FROM q LEFT JOIN up USING (user_id)),
qp AS (SELECT *, n_le - CASE WHEN self_pos IS NOT NULL AND self_t <= ts THEN 1 ELSE 0 END AS n_other FROM qn),
qr AS (SELECT *, CASE WHEN n_other > 0 THEN {draw_sql(11, 'event_id')} % n_other + 1 END AS r FROM qp),
qk AS (SELECT *, CASE WHEN self_pos IS NOT NULL AND self_t <= ts AND r >= self_pos THEN r + 1 ELSE r END AS pick FROM qr),
dn AS (SELECT qk.event_id, qk.ts, up.user_id AS donor_user_id FROM qk LEFT JOIN up ON up.upos = qk.pick)
SELECT dn.event_id, dn.donor_user_id, (SELECT string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY ts, event_id) FROM (
    SELECT c.item_id, c.ts, c.event_id FROM inter c WHERE c.user_id = dn.donor_user_id AND c.label = 1 AND c.ts <= dn.ts
    ORDER BY c.ts DESC, c.event_id DESC LIMIT {HISTORY_LEN}) z) AS donor_history FROM dn""")
def q_donor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor among users active at or before each later event; donor's last clicks up to then."""
    it, cut = inter_cut(spark, sf_dir)
    q = it.filter(F.col("ts") > F.lit(cut)).select("event_id", "user_id", "ts")
    d = H.donor_asof(q, it, 11, "event_id")
    clicks = it.filter(F.col("label") == 1).select("user_id", "ts", "item_id", "event_id")
    dq = d.select("event_id", F.col("donor_user_id").alias("user_id"), "ts", "donor_user_id")
    h = H.asof_last_n(dq.filter(F.col("user_id").isNotNull()), clicks, HISTORY_LEN, "event_id", inclusive=True)
    out = d.select("event_id", "donor_user_id").join(h.select("event_id", "items"), "event_id", "left")
    return out.select("event_id", "donor_user_id",
                      F.when(F.size("items") > 0, joined(F.col("items"))).alias("donor_history"))


# ---- drift: ranking quality under history variants --------------------------------
VARIANTS = ["full", "last3", "swap2", "remove"]


def variant_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(impression_id, variant, history array) for every slate; the full history is the whole one."""
    parts = swap_parts(spark, sf_dir, None, 2)[2]
    v = F.array(
        F.struct(F.lit("full").alias("variant"), F.col("own").alias("h")),
        F.struct(F.lit("last3").alias("variant"), last_n(F.col("own"), 3).alias("h")),
        F.struct(F.lit("swap2").alias("variant"), H.swap_history("own", "donor", 2, 5).alias("h")),
        F.struct(F.lit("remove").alias("variant"), F.slice("own", 1, 0).alias("h")))
    return parts.select("impression_id", F.explode(v).alias("x")).select("impression_id", "x.variant", "x.h")


def drift_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slate rows scored under each history variant: bagged score + 0.1 when the
    candidate's category occurs among the history items' categories.

    In the full history it does if the user's first click in that category is
    among the slate's first ``n``; the short variants are at most five items.
    Rows are dealt by slate last, and the few columns that the variants need of
    a slate meet them there: what ranks a slate under each variant needs no
    further shuffle. A task gets about ``TASK_ROWS`` rows of all variants.
    """
    im = materialize(B.impr(spark, sf_dir).select("impression_id", "user_id", "ts", "item_id", "category", "label",
                                                  ((F.col("s0") + F.col("s1") + F.col("s2")) / F.lit(3.0)).alias("base")))
    index, points = hist_days(spark, sf_dir, im)
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_type")
    donors = CI.day_donors(points, 7)
    back = lambda n, k: F.sequence(F.greatest(F.col(n) - (k - 1), F.lit(1)), F.col(n))
    own = points.where("n > 0").select("impression_id", "user_id", F.lit(True).alias("own"), F.explode(back("n", 3)).alias("pos"))
    theirs = donors.where("donor_n > 0").select("impression_id", F.col("donor_user").alias("user_id"), F.lit(False).alias("own"), F.explode(back("donor_n", 2)).alias("pos"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(VARIANTS) * im.count() // B.TASK_ROWS))   # the count is read from the file footers
    few = CI.fetch(own.unionByName(theirs), index, ["impression_id", "own"]).join(part, "item_id").repartition(tasks, "impression_id")
    few = few.groupBy("impression_id").agg(F.collect_set(F.when(F.col("own"), F.col("p_type"))).alias("last3"), F.collect_set("p_type").alias("swap2"))   # at most 5
    first = index.join(part, "item_id").groupBy("user_id", F.col("p_type").alias("category")).agg(F.min("pos").alias("first_pos"))
    rows = im.select("impression_id", "user_id", "item_id", "category", "label", "base")
    at = points.select("impression_id", "n").repartition(tasks, "impression_id").join(few, "impression_id", "left")
    clicked = rows.join(first, ["user_id", "category"], "left").select("impression_id", "item_id", "category", "label", "base", "first_pos")
    j = clicked.repartition(tasks, "impression_id").join(at, "impression_id")
    has = {"full": F.col("first_pos") <= F.col("n"), "last3": F.array_contains("last3", F.col("category")),
           "swap2": F.array_contains("swap2", F.col("category")), "remove": F.lit(False)}
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.coalesce(c, F.lit(False)).cast("int").alias("m")) for v, c in has.items()])
    return j.select("impression_id", "item_id", F.col("label").cast("double").alias("y_true"), "base", F.explode(variants).alias("x")).select(
        "impression_id", "item_id", "x.variant", "y_true", (F.col("base") + F.lit(0.1) * F.col("x.m")).alias("y_pred"))


DRIFT_SQL = HIST_CTE + ",\n" + POOL_SQL.split(HIST_CTE + ",\n", 1)[1] + f""",
vh AS (SELECT impression_id, 'full' AS variant, {arr_sql('history')} AS h FROM dn
  UNION ALL SELECT impression_id, 'last3', {lastn_sql(arr_sql('history'), '3')} FROM dn
  UNION ALL SELECT impression_id, 'swap2', list_concat({lastn_sql(arr_sql('donor_history'), '2')}, {lastn_sql(arr_sql('history'), '3')}) FROM dn
  UNION ALL SELECT impression_id, 'remove', CAST([] AS VARCHAR[]) FROM dn),
vc AS (SELECT DISTINCT v.impression_id, v.variant, p.p_type AS category FROM
        (SELECT impression_id, variant, CAST(unnest(h) AS BIGINT) AS hid FROM vh) v JOIN part p ON p.p_partkey = v.hid),
sc AS (SELECT i.impression_id, i.item_id AS row_id, v.variant AS model, CAST(i.label AS DOUBLE) AS y_true,
        (i.s0 + i.s1 + i.s2) / 3.0 + 0.1 * CASE WHEN vc.category IS NOT NULL THEN 1 ELSE 0 END AS y_pred
       FROM impr i JOIN vh v ON v.impression_id = i.impression_id
       LEFT JOIN vc ON vc.impression_id = i.impression_id AND vc.variant = v.variant AND vc.category = i.category)"""


def _tracker_on(source: str) -> str:
    from slatewise.plans.metric_queries import TRACKER_BODY
    return TRACKER_BODY.replace("FROM preds),", f"FROM {source}),", 1)


@register("drift_report", with_("impr", extra=DRIFT_SQL + ",\n" + _tracker_on("sc")) + """,
mm AS (SELECT model, k, CAST(h AS DOUBLE) / (slates * k) AS precision, CAST(h AS DOUBLE) / rel AS recall,
              ap / slates AS ap, nd / slates AS ndcg FROM m)
SELECT v.model AS variant, v.k, round(v.precision - f.precision, 6) AS d_precision, round(v.recall - f.recall, 6) AS d_recall,
  round(v.ap - f.ap, 6) AS d_ap, round(v.ndcg - f.ndcg, 6) AS d_ndcg
FROM mm v JOIN mm f ON f.model = 'full' AND f.k = v.k""")
def q_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics under each history variant minus the full-history baseline."""
    sc = drift_scores(spark, sf_dir)
    t = R.ranking_tracker(sc, [1, 3, 5], "impression_id", ["variant"], "item_id", "y_pred", "y_true", rounded=False)
    t = materialize(t)   # a row per variant and k, read twice
    f = t.filter(F.col("variant") == "full").select("k", *[F.col(c).alias(f"f_{c}") for c in ("precision", "recall", "ap", "ndcg")])
    j = t.join(f, "k")
    return j.select("variant", "k", *[r6(F.col(c) - F.col(f"f_{c}")).alias(f"d_{c}") for c in ("precision", "recall", "ap", "ndcg")])
