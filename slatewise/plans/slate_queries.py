"""Registered queries: parsing, projections, joins, set ops and interaction
aggregates (SURVEY 2.2 - 2.5) on the ``impr`` / ``behav`` / ``inter`` bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import draw_fraction, last_n, md5_draw, ts_string
from slatewise.functions.text import STOP_WORDS, clean_text
from slatewise.operators import candidates as CA
from slatewise.operators import click_index as CI
from slatewise.operators import interactions as I
from slatewise.operators import slates as S
from slatewise.plans import bindings as B
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register
from slatewise.session import materialize

TS_FMT_SQL = "'%Y-%m-%d %H:%M:%S.%f'"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
POOL_K = 10
HISTORY_LEN = 50   # items of a history that reach a model


def inter_cut(spark: SparkSession, sf_dir: str):
    it = B.inter(spark, sf_dir)
    return it, I.midpoint_value(it)


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per slate of ``impr``: the user's clicked items in earlier orders."""
    im = B.impr(spark, sf_dir)
    slates = im.select("impression_id", "user_id", "ts").distinct()
    clicks = im.filter(F.col("label") == 1).select("user_id", "ts", "item_id")
    return S.slate_histories(slates, clicks)


def click_log(spark: SparkSession, sf_dir: str, im: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Slates and click rows of ``impr``."""
    im = B.impr(spark, sf_dir) if im is None else im
    return im.select("impression_id", "user_id", "ts").distinct(), im.filter(F.col("label") == 1).select("user_id", "ts", "item_id")


def indexed(spark: SparkSession, sf_dir: str, im: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The click index, written once, and each slate's point in it."""
    im = materialize(B.impr(spark, sf_dir).select("impression_id", "user_id", "ts", "item_id", "label")) if im is None else im
    slates, clicks = click_log(spark, sf_dir, im)
    bounds = CI.time_ranges(im)
    index = materialize(CI.click_index(clicks, bounds=bounds))
    return index, CI.history_points(slates, index, bounds=bounds)


def tails(spark: SparkSession, sf_dir: str, k: int = HISTORY_LEN) -> DataFrame:
    """(impression_id, items): the last ``k`` items of each slate's history."""
    index, points = indexed(spark, sf_dir)
    return CI.last_items(points, index, k, "impression_id")


HIST_CTE = """hs AS (SELECT DISTINCT impression_id, user_id, ts FROM impr),
hist AS (SELECT s.impression_id, s.user_id, s.ts,
   (SELECT string_agg(CAST(c.item_id AS VARCHAR), ' ' ORDER BY c.ts, c.item_id) FROM impr c
     WHERE c.user_id = s.user_id AND c.ts < s.ts AND c.label = 1) AS history FROM hs s)"""

DIRTY = "'x ' || impressions || '  5- 5-a 5-1-1 '"


# ---- 2.2 parsing / projection -----------------------------------------------------
@register("parse_slate", with_("impr", "behav", extra=f"""p AS (SELECT impression_id,
   list_filter(regexp_split_to_array(trim({DIRTY}), '\\s+'), lambda x: regexp_full_match(x, '[^-]*-[0-9]+')) AS items
   FROM behav),
u AS (SELECT impression_id, unnest(items) AS it, unnest(range(1, len(items) + 1)) AS position FROM p)""")
    + """SELECT impression_id, CAST(position AS INT) AS position, split_part(it, '-', 1) AS candidate_id,
  CAST(split_part(it, '-', 2) AS INT) AS label FROM u""")
def q_parse_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.behav(spark, sf_dir).select(
        "impression_id", F.concat(F.lit("x "), F.col("impressions"), F.lit("  5- 5-a 5-1-1 ")).alias("impressions"))
    return S.explode_slate(b, strict=False).select(
        "impression_id", F.col("position").cast("int").alias("position"), "candidate_id", "label")


@register("explode_slate", with_("impr", "behav", extra="""u AS (SELECT impression_id, user_id,
   unnest(string_split(impressions, ' ')) AS it FROM behav)""")
    + """SELECT impression_id, user_id, CAST(split_part(it, '-', 1) AS BIGINT) AS candidate_id,
  CAST(split_part(it, '-', 2) AS INT) AS label FROM u""")
def q_explode_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.behav(spark, sf_dir).select("impression_id", "user_id", "impressions")
    e = S.explode_slate(b, strict=True)
    return e.select("impression_id", "user_id", F.col("candidate_id").cast("bigint").alias("candidate_id"), "label")


@register("behav_wire", with_("impr", "behav")
    + "SELECT impression_id, user_id, strftime(ts, " + TS_FMT_SQL + ") AS ts, impressions FROM behav")
def q_behav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire-format slates (what a behaviors file holds), built from the tables."""
    b = B.behav(spark, sf_dir)
    return b.select("impression_id", "user_id", ts_string("ts").alias("ts"), "impressions")


@register("parse_history", with_("impr", extra=HIST_CTE)
    + """SELECT impression_id, CAST(len(list_filter(string_split(trim(coalesce(history, '')), ' '), lambda x: x <> '')) AS INT) AS n_history,
  coalesce(history, '') AS history FROM hist""")
def q_parse_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist(spark, sf_dir)
    arr = S.parse_history("history")
    return h.select("impression_id", F.size(arr).alias("n_history"), F.array_join(arr, " ").alias("history"))


@register("parse_time", """SELECT event_id, strftime(try_strptime(s, '%m/%d/%Y %I:%M:%S %p'), '%Y-%m-%d %H:%M:%S') AS parsed
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad ' || CAST(event_id AS VARCHAR)
             ELSE strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p') END AS s FROM events) x""")
def q_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = B.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    s = F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), F.col("event_id").cast("string"))) \
         .otherwise(F.date_format("ts", S.TIME_FORMAT))
    return ev.select("event_id", F.date_format(S.parse_time(s), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


CLEAN_SQL = ("array_to_string(list_filter(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({c}, ''), "
             r"'[^a-zA-Z \t\n\r\f\v]', '', 'g')), '[ \t\n\r\f\v]+'), lambda x: x <> ''), "
             "lambda x: NOT list_contains(" + STOP_SQL + ", x)), ' ')")


@register("clean_text", with_("news") + "SELECT news_id, " + CLEAN_SQL.format(c="text") + " AS clean FROM news")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.news(spark, sf_dir)
    return n.select("news_id", clean_text("text").alias("clean"))


@register("combined_text", with_("news") + "SELECT news_id, " + CLEAN_SQL.format(c="title")
    + " || ' ' || " + CLEAN_SQL.format(c="text") + " AS combined FROM news")
def q_combined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.news(spark, sf_dir)
    return n.select("news_id", F.concat(clean_text("title"), F.lit(" "), clean_text("text")).alias("combined"))


@register("category_lookup", with_("impr") + """SELECT i.impression_id, i.item_id, coalesce(d.lang, 'Unknown') AS category
FROM impr i LEFT JOIN documents d ON d.doc_id = i.item_id""")
def q_category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = B.impr(spark, sf_dir).select("impression_id", "item_id")
    cat = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang"))
    return im.join(cat, "item_id", "left").select(
        "impression_id", "item_id", F.coalesce("lang", F.lit("Unknown")).alias("category"))


# Closed category list for the one-hot features (STANDARD is left
# out on purpose so that an unknown category maps to all zeros).
ONE_HOT_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]


@register("one_hot_category", with_("impr") + "SELECT row_id, "
    + ", ".join(f"CAST(category = '{c}' AS INT) AS cat_{c.lower()}" for c in ONE_HOT_CATEGORIES) + " FROM impr")
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slatewise.operators.features import one_hot
    im = B.impr(spark, sf_dir).select("row_id", "category")
    return one_hot(im, "category", ONE_HOT_CATEGORIES).drop("category")


@register("midpoint_time", with_("inter", "cut") + f"SELECT strftime(cutoff, {TS_FMT_SQL}) AS cutoff FROM cut")
def q_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.midpoint_time(B.inter(spark, sf_dir)).select(ts_string("cutoff").alias("cutoff"))


@register("split_by_time", with_("inter", "cut") + """SELECT event_id, CASE WHEN ts <= cutoff THEN 'train' ELSE 'test' END AS side
FROM inter, cut""")
def q_split_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    tr, te = I.split_by_time(it, cut)
    return tr.select("event_id", F.lit("train").alias("side")).unionByName(
        te.select("event_id", F.lit("test").alias("side")))


@register("union_rows", with_("inter", "cut") + """SELECT side, COUNT(*) AS n_rows, COUNT(DISTINCT user_id) AS n_users FROM
(SELECT user_id, CASE WHEN ts <= cutoff THEN 'train' ELSE 'test' END AS side FROM inter, cut) x GROUP BY side""")
def q_union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    tr, te = I.split_by_time(it, cut)
    u = tr.withColumn("side", F.lit("train")).unionByName(te.withColumn("side", F.lit("test")))
    return u.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"))


@register("pad_history", with_("impr", extra=HIST_CTE) + f""", a AS (SELECT impression_id,
   list_filter(string_split(trim(coalesce(history, '')), ' '), lambda x: x <> '') AS h FROM hist)
SELECT impression_id, array_to_string(list_concat(list_transform(range(GREATEST({HISTORY_LEN} - len(h), 0)), lambda i: '0'),
   list_slice(h, GREATEST(len(h) - {HISTORY_LEN - 1}, 1), len(h))), ' ') AS padded FROM a""")
def q_pad_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tails(spark, sf_dir).select("impression_id", F.col("items").cast("array<string>").alias("h"))
    return h.select("impression_id", F.array_join(S.pad_history("h", HISTORY_LEN), " ").alias("padded"))


@register("dedupe_keep_last", with_("inter") + """SELECT user_id, event_id, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM inter) x WHERE rn = 1""")
def q_dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slatewise.operators.features import keep_last
    return keep_last(B.inter(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "item_id")


# ---- 2.5 interaction aggregates ---------------------------------------------------
@register("first_interaction", with_("inter")
    + f"SELECT item_id, strftime(MIN(ts), {TS_FMT_SQL}) AS first_ts FROM inter WHERE ts IS NOT NULL GROUP BY item_id")
def q_first_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = I.first_interaction(B.inter(spark, sf_dir))
    return f.select("item_id", ts_string("first_ts").alias("first_ts"))


POOL_CTE = """pool AS (SELECT item_id, MIN(ts) AS first_ts FROM inter, cut WHERE ts <= cutoff GROUP BY item_id)"""


@register("candidate_pool", with_("inter", "cut", extra=POOL_CTE)
    + f"SELECT item_id, strftime(first_ts, {TS_FMT_SQL}) AS first_ts FROM pool")
def q_candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    return I.candidate_pool(it, cut).select("item_id", ts_string("first_ts").alias("first_ts"))


@register("user_future_clicks", with_("inter", "cut")
    + "SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff AND label = 1")
def q_future_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    return I.user_future_clicks(it, cut)


@register("user_shown_articles", with_("inter", "cut")
    + "SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff")
def q_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    return I.user_shown_articles(it, cut)


UHIST_CTE = """fh AS (SELECT user_id, item_id, MIN((ts, event_id)) AS f FROM inter, cut
         WHERE ts <= cutoff AND label = 1 GROUP BY user_id, item_id),
uh AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY f, item_id) AS pos FROM fh)"""


# Ids that users bring along from before the log (in no click), and the last HISTORY_LEN ids of each row
BEFORE_SQL = "['P' || CAST(user_id % 97 AS VARCHAR), 'P' || CAST(user_id % 89 + 200 AS VARCHAR), 'P' || CAST(user_id % 97 AS VARCHAR)]"
LOG_SQL = HIST_CTE + f""",
lh AS (SELECT impression_id, user_id, ts, list_concat({BEFORE_SQL}, list_filter(string_split(coalesce(history, ''), ' '), lambda x: x <> '')) AS h FROM hist),
lcut AS (SELECT make_timestamp(CAST((epoch_us(MIN(ts)) + (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) // 2) AS BIGINT)) AS cutoff FROM impr),
lx AS (SELECT impression_id, user_id, ts, unnest(h) AS item_id, unnest(range(len(h))) AS p FROM (
        SELECT impression_id, user_id, ts, list_slice(h, GREATEST(len(h) - {HISTORY_LEN - 1}, 1), len(h)) AS h FROM lh, lcut WHERE ts <= cutoff) x),
lf AS (SELECT user_id, item_id, MIN((epoch_us(ts), impression_id, p)) AS f FROM lx GROUP BY user_id, item_id)"""


def impression_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(impression_id, user_id, ts, history): a log whose history strings begin with ids from before the log."""
    im = materialize(B.impr(spark, sf_dir).select("impression_id", "user_id", "ts", "item_id", "label"))
    index, points = indexed(spark, sf_dir, im)
    user = F.col("user_id")
    before = F.array(*[F.concat(F.lit("P"), c.cast("string")) for c in (user % 97, user % 89 + 200, user % 97)])
    ids = last_n(F.concat(before, F.col("items").cast("array<string>")), HISTORY_LEN)
    return points.select("impression_id", "user_id", "ts").join(CI.last_items(points, index, HISTORY_LEN, "impression_id"), "impression_id").select(
        "impression_id", "user_id", "ts", F.array_join(ids, " ").alias("history"))


@register("user_history_ids", with_("impr", extra=LOG_SQL) + "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY f) AS pos, item_id FROM lf")
def q_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the log's history strings up to the midpoint, first occurrence kept."""
    log = materialize(impression_log(spark, sf_dir))
    return CI.log_history(log, I.midpoint_value(log)).select("user_id", "pos", "item_id")


@register("viable_donors", with_("inter", "cut", extra=UHIST_CTE) + "SELECT DISTINCT user_id FROM uh")
def q_viable_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    return I.viable_donors(I.user_history(it, cut))


CLUSTER_SQL = "CAST(('0x' || substr(md5('cluster|' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 3 AS INT)"
FINE_CLUSTERS = 30
FINE_CLUSTER_SQL = CLUSTER_SQL.replace("% 3", f"% {FINE_CLUSTERS}")


def inter_clusters(it: DataFrame, n: int = 3) -> DataFrame:
    """Deterministic n-way user clustering for the interaction fixture."""
    return it.select("user_id").distinct().select("user_id", (md5_draw("cluster", "user_id") % n).cast("int").alias("cluster"))


@register("cluster_ground_truth", with_("inter", "cut") + f"""SELECT DISTINCT {CLUSTER_SQL} AS cluster, item_id
FROM inter, cut WHERE ts > cutoff AND label = 1""")
def q_cluster_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    return I.cluster_ground_truth(I.user_future_clicks(it, cut), inter_clusters(it))


@register("cluster_ground_truth_freq", with_("inter", "cut") + f"""SELECT {CLUSTER_SQL} AS cluster, item_id, COUNT(*) AS clicks
FROM inter, cut WHERE ts > cutoff AND label = 1 GROUP BY 1, 2""")
def q_cluster_gt_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    rows = it.filter((F.col("ts") > F.lit(cut)) & (F.col("label") == 1))
    return I.cluster_ground_truth_freq(rows, inter_clusters(it))


# ---- 2.3 joins / 2.4 set operations ---------------------------------------------------
@register("label_candidates", with_("inter", "cut") + """SELECT s.user_id, s.item_id,
  CAST(c.user_id IS NOT NULL AS INT) AS label
FROM (SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff) s
LEFT JOIN (SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff AND label = 1) c
  ON c.user_id = s.user_id AND c.item_id = s.item_id""")
def q_label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    shown = I.user_shown_articles(it, cut)
    clicks = I.user_future_clicks(it, cut).withColumn("label", F.lit(1))
    return shown.join(clicks, ["user_id", "item_id"], "left").fillna(0, ["label"]) \
                .select("user_id", "item_id", F.col("label").cast("int").alias("label"))


@register("gt_in_pool", with_("inter", "cut", extra=POOL_CTE) + """SELECT user_id, COUNT(*) AS num_truth_in_pool FROM (
  SELECT user_id, item_id FROM inter, cut WHERE ts > cutoff AND label = 1
  INTERSECT
  SELECT user_id, item_id FROM inter, cut WHERE ts > cutoff AND item_id IN (SELECT item_id FROM pool)) x GROUP BY user_id""")
def q_gt_in_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    pool = I.candidate_pool(it, cut)
    clicks = I.user_future_clicks(it, cut)
    shown_in_pool = I.user_shown_articles(it, cut).join(pool.select("item_id"), "item_id", "left_semi")
    both = clicks.select("user_id", "item_id").intersect(shown_in_pool.select("user_id", "item_id"))
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_truth_in_pool"))


@register("pool_minus_history", with_("inter", "cut", extra=UHIST_CTE + ",\n" + POOL_CTE) + f"""SELECT CAST(g.cluster AS INT) AS cluster, p.item_id
FROM pool p, range({FINE_CLUSTERS}) g(cluster) EXCEPT SELECT {FINE_CLUSTER_SQL} AS cluster, item_id FROM uh""")
def q_pool_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster: the cutoff pool without the items its users have in their history (set difference)."""
    it, cut = inter_cut(spark, sf_dir)
    seen = I.user_history(it, cut).join(inter_clusters(it, FINE_CLUSTERS), "user_id").select("cluster", "item_id").distinct()
    clusters = F.explode(F.sequence(F.lit(0), F.lit(FINE_CLUSTERS - 1)))
    return I.candidate_pool(it, cut).select(clusters.alias("cluster"), "item_id").exceptAll(seen)


@register("missing_users", with_("inter", "cut", extra=UHIST_CTE)
    + "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM uh)")
def q_missing_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any history at the cutoff."""
    it, cut = inter_cut(spark, sf_dir)
    users = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id")).distinct()
    return users.join(I.user_history(it, cut), "user_id", "left_anti")


@register("reindex_users", with_("inter", "cut", extra=UHIST_CTE) + """SELECT u.user_id, COALESCE(h.n, 0) AS history_len
FROM (SELECT DISTINCT user_id FROM inter) u LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM uh GROUP BY user_id) h USING (user_id)""")
def q_reindex_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut = inter_cut(spark, sf_dir)
    h = I.history_lengths(I.user_history(it, cut))
    return it.select("user_id").distinct().join(h, "user_id", "left").fillna(0, ["history_len"])


def pool_scored(it: DataFrame, cut) -> DataFrame:
    """Pool at the cutoff with its popularity score (clicks at or before the cutoff)."""
    c = F.lit(cut).cast("timestamp_ntz")
    return (it.filter(F.col("ts") <= c).groupBy("item_id")
              .agg(F.sum("label").cast("double").alias("score")))


POOLS_CTE = POOL_CTE + """,
ps AS (SELECT item_id, CAST(SUM(label) AS DOUBLE) AS score FROM inter, cut WHERE ts <= cutoff GROUP BY item_id),
users AS (SELECT DISTINCT user_id FROM inter),
cand AS (SELECT u.user_id, p.item_id, p.score FROM users u CROSS JOIN ps p
         WHERE NOT EXISTS (SELECT 1 FROM uh WHERE uh.user_id = u.user_id AND uh.item_id = p.item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cand)"""


def pool_recs(spark: SparkSession, sf_dir: str, k: int = POOL_K):
    it, cut = inter_cut(spark, sf_dir)
    users = it.select("user_id").distinct()
    h = I.user_history(it, cut).select("user_id", "item_id")
    pool = pool_scored(it, cut)
    return it, cut, users, h, pool, CA.topk_excluding(users, h, pool, k)


@register("user_pool_cross", with_("inter", "cut", extra=UHIST_CTE + ",\n" + POOLS_CTE)
    + f"SELECT user_id, CAST(rank AS INT) AS rank, item_id, score FROM rk WHERE rank <= {POOL_K}")
def q_user_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-pool top 10 per user (pool minus own history, popularity order)."""
    *_, recs = pool_recs(spark, sf_dir)
    return recs.select("user_id", F.col("rank").cast("int").alias("rank"), "item_id", "score")


@register("exclude_history", with_("inter", "cut", extra=UHIST_CTE + ",\n" + POOLS_CTE)
    + "SELECT user_id, COUNT(*) AS num_candidates FROM cand GROUP BY user_id")
def q_exclude_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut, users, h, pool, _ = pool_recs(spark, sf_dir)
    return CA.pool_sizes(users, h, pool)


@register("behavior_pool_flag", with_("inter", "cut", extra=UHIST_CTE + ",\n" + POOLS_CTE)
    + f"""SELECT r.user_id, CAST(r.rank AS INT) AS rank, r.item_id,
  CAST(EXISTS (SELECT 1 FROM inter, cut WHERE ts > cutoff AND inter.user_id = r.user_id AND inter.item_id = r.item_id) AS INT) AS shown
FROM rk r WHERE rank <= {POOL_K}""")
def q_behavior_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut, users, h, pool, recs = pool_recs(spark, sf_dir)
    shown = I.user_shown_articles(it, cut).withColumn("shown", F.lit(1))
    return (recs.join(shown, ["user_id", "item_id"], "left").fillna(0, ["shown"])
                .select("user_id", F.col("rank").cast("int").alias("rank"), "item_id",
                        F.col("shown").cast("int").alias("shown")))


@register("limit_candidates", with_("inter", "cut", extra=UHIST_CTE + ",\n" + POOL_CTE + """,
users AS (SELECT DISTINCT user_id FROM inter),
cand AS (SELECT u.user_id, p.item_id FROM users u CROSS JOIN pool p
         WHERE NOT EXISTS (SELECT 1 FROM uh WHERE uh.user_id = u.user_id AND uh.item_id = p.item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS rank FROM cand)""")
    + "SELECT user_id, CAST(rank AS INT) AS rank, item_id FROM rk WHERE rank <= 5")
def q_limit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 5 candidates per user in catalog (id) order after history exclusion."""
    it, cut = inter_cut(spark, sf_dir)
    users = it.select("user_id").distinct()
    h = I.user_history(it, cut).select("user_id", "item_id")
    pool = I.candidate_pool(it, cut).select("item_id", F.lit(0.0).alias("score"))
    r = CA.topk_excluding(users, h, pool, 5)
    return r.select("user_id", F.col("rank").cast("int").alias("rank"), "item_id")


# Clustering rule of the customer fixture (balance >= 0 has a cluster).
@register("join_user_cluster", with_("impr") + """SELECT i.impression_id, i.item_id, CAST(c.c_nationkey // 9 AS INT) AS cluster
FROM impr i JOIN customer c ON c.c_custkey = i.user_id WHERE c.c_acctbal >= 0""")
def q_join_user_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = B.impr(spark, sf_dir).select("impression_id", "item_id", "user_id")
    cl = (B.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
          .select(F.col("c_custkey").alias("user_id"), (F.floor(F.col("c_nationkey") / 9)).cast("int").alias("cluster")))
    return im.join(cl, "user_id").select("impression_id", "item_id", "cluster")


@register("sample_semi", with_("impr") + """SELECT impression_id, item_id FROM impr WHERE impression_id IN (
  SELECT DISTINCT impression_id FROM impr
  WHERE ('0x' || substr(md5('7|' || CAST(impression_id AS VARCHAR)), 1, 8))::BIGINT < 0.3 * 4294967296)""")
def q_sample_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = B.impr(spark, sf_dir)
    ids = im.select("impression_id").distinct().filter(draw_fraction(7, "impression_id") < F.lit(0.3))
    return im.join(ids, "impression_id", "left_semi").select("impression_id", "item_id")
