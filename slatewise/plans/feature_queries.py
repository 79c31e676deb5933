"""Registered queries: vocabulary, encodings, token joins, TF-IDF, dense vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import last_n, r6
from slatewise.functions.text import clean_text, keep_token, raw_tokens
from slatewise.operators import history as H
from slatewise.operators import interactions as I
from slatewise.operators import slates as S
from slatewise.operators import text as TX
from slatewise.operators import vectors as V
from slatewise.plans import bindings as B
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register
from slatewise.session import materialize
from slatewise.plans.slate_queries import CLEAN_SQL, HIST_CTE, HISTORY_LEN, STOP_SQL, UHIST_CTE, inter_cut, tails

TITLE_LEN = 30


def clean_list_sql(c: str) -> str:
    return ("list_filter(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(" + c + ", ''), "
            r"'[^a-zA-Z \t\n\r\f\v]', '', 'g')), '[ \t\n\r\f\v]+'), lambda x: x <> ''), "
            "lambda x: NOT list_contains(" + STOP_SQL + ", x))")


def ints_sql(l: str) -> str:
    return f"array_to_string(list_transform({l}, lambda x: CAST(x AS VARCHAR)), ' ')"


def pad30_sql(l: str) -> str:
    return f"list_slice(list_concat({l}, list_transform(range({TITLE_LEN}), lambda i: 0)), 1, {TITLE_LEN})"


def ints(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def combined_tokens() -> F.Column:
    """Tokens of CombinedText = clean(title) + ' ' + clean(text), before ``keep_token``."""
    return F.concat(raw_tokens("title"), raw_tokens("text"))


VOCAB_SQL = f"""nt AS (SELECT news_id, {clean_list_sql('title')} AS tt, {clean_list_sql('text')} AS xt FROM news),
tk AS (SELECT news_id, unnest(tt) AS token, unnest(range(0, len(tt))) AS pos FROM nt),
ak AS (SELECT news_id, unnest(list_concat(tt, xt)) AS token, unnest(range(0, len(tt) + len(xt))) AS pos FROM nt),
vc AS (SELECT token, COUNT(*) AS count, MIN((news_id, pos)) AS f FROM ak GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count DESC, f) AS INT) AS id, count FROM vc),
xk AS (SELECT news_id, unnest(xt) AS token, unnest(range(0, len(xt))) AS pos FROM nt),
enc0 AS (SELECT x.news_id, list(v.id ORDER BY x.pos) AS ids FROM xk x JOIN vocab v USING (token) GROUP BY x.news_id),
enc AS (SELECT nt.news_id, COALESCE(enc0.ids, CAST([] AS INT[])) AS ids FROM nt LEFT JOIN enc0 USING (news_id)),
tenc0 AS (SELECT t.news_id, list(v.id ORDER BY t.pos) AS ids FROM tk t JOIN vocab v USING (token) GROUP BY t.news_id),
ttab AS (SELECT nt.news_id, {pad30_sql('COALESCE(tenc0.ids, CAST([] AS INT[]))')} AS tokens FROM nt LEFT JOIN tenc0 USING (news_id))"""


def catalog_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary fitted on the catalog's CombinedText (clean title and clean text)."""
    return TX.fit_vocabulary(B.news(spark, sf_dir), "news_id", combined_tokens(), keep_token)


def title_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id -> title ids padded/truncated to 30 (post)."""
    n = B.news(spark, sf_dir)
    enc = TX.encode_text(n, "news_id", raw_tokens("title"), catalog_vocab(spark, sf_dir), keep_token)
    return enc.select("news_id", S.pad_tokens("ids", TITLE_LEN).alias("tokens"))


@register("fit_vocabulary", with_("news", extra=VOCAB_SQL) + "SELECT token, id, count FROM vocab")
def q_fit_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_vocab(spark, sf_dir)


@register("encode_text", with_("news", extra=VOCAB_SQL)
    + f"SELECT news_id, CAST(len(ids) AS INT) AS n_ids, {ints_sql('ids')} AS ids FROM enc")
def q_encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.news(spark, sf_dir)
    e = TX.encode_text(n, "news_id", raw_tokens("text"), catalog_vocab(spark, sf_dir), keep_token)
    return e.select("news_id", F.size("ids").alias("n_ids"), ints(F.col("ids")).alias("ids"))


@register("title_table", with_("news", extra=VOCAB_SQL) + f"SELECT news_id, {ints_sql('tokens')} AS tokens FROM ttab")
def q_title_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_table(spark, sf_dir).select("news_id", ints(F.col("tokens")).alias("tokens"))


@register("pad_title", with_("news", extra=VOCAB_SQL) + f"SELECT news_id, {ints_sql(pad30_sql('ids'))} AS tokens FROM enc")
def q_pad_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 30 ids of each whole-text encoding, zero-padded on the right."""
    n = B.news(spark, sf_dir)
    e = TX.encode_text(n, "news_id", raw_tokens("text"), catalog_vocab(spark, sf_dir), keep_token)
    return e.select("news_id", ints(S.pad_tokens("ids", TITLE_LEN)).alias("tokens"))


ZEROS30 = " ".join(["0"] * TITLE_LEN)


@register("join_candidate_tokens", with_("news", "impr", extra=VOCAB_SQL)
    + f"""SELECT i.impression_id, i.item_id, COALESCE({ints_sql('t.tokens')}, '{ZEROS30}') AS tokens
FROM impr i LEFT JOIN ttab t ON t.news_id = i.item_id""")
def q_join_candidate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = B.impr(spark, sf_dir).select("impression_id", "item_id")
    tt = title_table(spark, sf_dir).select(F.col("news_id").alias("item_id"), "tokens")
    j = im.join(tt, "item_id", "left")
    return j.select("impression_id", "item_id", F.coalesce(ints(F.col("tokens")), F.lit(ZEROS30)).alias("tokens"))


@register("join_history_tokens", with_("news", "impr", extra=VOCAB_SQL + ",\n" + HIST_CTE + f""",
ha AS (SELECT impression_id, list_filter(string_split(coalesce(history, ''), ' '), lambda x: x <> '') AS h FROM hist),
hp AS (SELECT impression_id, list_concat(list_transform(range(GREATEST({HISTORY_LEN} - len(h), 0)), lambda i: NULL::VARCHAR),
          list_slice(h, GREATEST(len(h) - {HISTORY_LEN - 1}, 1), len(h))) AS p FROM ha),
hx AS (SELECT impression_id, unnest(p) AS hid, unnest(range(1, {HISTORY_LEN + 1})) AS pos FROM hp)""")
    + f"""SELECT hx.impression_id, CAST(hx.pos AS INT) AS pos, COALESCE({ints_sql('t.tokens')}, '{ZEROS30}') AS tokens
FROM hx LEFT JOIN ttab t ON t.news_id = CAST(hx.hid AS BIGINT)""")
def q_join_history_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last history ids of each slate (left-padded with empty rows) -> title tokens;
    padding and unknown ids give zero rows.

    Only real ids are joined; padding rows are made where the slate is (as null join keys they would all meet in one task).
    """
    h = materialize(tails(spark, sf_dir))
    tt = title_table(spark, sf_dir).select(F.col("news_id").alias("_nid"), ints(F.col("tokens")).alias("tokens"))
    pad = F.lit(HISTORY_LEN) - F.size("items")
    x = h.select("impression_id", pad.alias("_pad"), F.posexplode("items").alias("p0", "hid"))
    own = x.join(tt, x.hid.cast("long") == tt._nid, "left").select(
        "impression_id", (F.col("_pad") + F.col("p0") + 1).cast("int").alias("pos"), F.coalesce("tokens", F.lit(ZEROS30)).alias("tokens"))
    padding = h.where(pad > 0).select("impression_id", F.explode(F.sequence(F.lit(1), pad)).alias("pos"), F.lit(ZEROS30).alias("tokens"))
    return own.unionByName(padding)


@register("user_profile", with_("news", "inter", "cut", extra=VOCAB_SQL + ",\n" + UHIST_CTE + f""",
ck AS (SELECT news_id, unnest(ct) AS token, unnest(range(0, len(ct))) AS pos FROM (SELECT news_id, list_concat(tt, xt) AS ct FROM nt)),
cenc0 AS (SELECT c.news_id, list(v.id ORDER BY c.pos) AS ids FROM ck c JOIN vocab v USING (token) GROUP BY c.news_id),
cenc AS (SELECT nt.news_id, COALESCE(cenc0.ids, CAST([] AS INT[])) AS ids FROM nt LEFT JOIN cenc0 USING (news_id)),
ul AS (SELECT uh.*, MAX(pos) OVER (PARTITION BY user_id) AS n FROM uh)""")
    + f"""SELECT ul.user_id, CAST(ul.pos - GREATEST(ul.n - 50, 0) AS INT) AS pos, ul.item_id, CAST(ul.n AS BIGINT) AS original_len,
  {ints_sql(pad30_sql("CASE WHEN len(COALESCE(c.ids, CAST([] AS INT[]))) = 0 THEN [1] ELSE c.ids END"))} AS tokens
FROM ul LEFT JOIN cenc c ON c.news_id = ul.item_id WHERE ul.pos > ul.n - 50""")
def q_user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 50 history items per user with their CombinedText encodings (no
    known word -> [1]), padded to 30, and the full history length."""
    it, cut = inter_cut(spark, sf_dir)
    hl = I.user_history(it, cut)
    n = hl.groupBy("user_id").agg(F.max("pos").alias("n"))
    last = hl.join(n, "user_id").filter(F.col("pos") > F.col("n") - 50)
    last = materialize(last)
    # only the texts that histories name are encoded; the vocabulary is the whole catalog's
    news = B.news(spark, sf_dir).join(last.select(F.col("item_id").cast("long").alias("news_id")).distinct(), "news_id", "left_semi")
    enc = TX.encode_text(news, "news_id", combined_tokens(), catalog_vocab(spark, sf_dir), keep_token)
    j = last.join(enc.select(F.col("news_id").alias("item_id"), "ids"), "item_id", "left")
    ids = F.coalesce(F.col("ids"), F.filter(F.array(F.lit(0)), lambda x: F.lit(False)))
    ids = F.when(F.size(ids) == 0, F.array(F.lit(1))).otherwise(ids)
    return j.select("user_id", (F.col("pos") - F.greatest(F.col("n") - 50, F.lit(0))).cast("int").alias("pos"),
                    "item_id", F.col("n").cast("bigint").alias("original_len"),
                    ints(S.pad_tokens(ids, TITLE_LEN)).alias("tokens"))


# ---- TF-IDF -----------------------------------------------------------------------------
TFIDF_SQL = f"""ct AS (SELECT news_id, list_filter(string_split({CLEAN_SQL.format(c='title')} || ' ' || {CLEAN_SQL.format(c='text')}, ' '),
        lambda x: length(x) >= 2) AS toks FROM news),
dtf AS (SELECT news_id, term, COUNT(*) AS tf FROM (SELECT news_id, unnest(toks) AS term FROM ct) z GROUP BY news_id, term),
idf AS (SELECT term, ln((1.0 + (SELECT COUNT(*) FROM news)) / (1.0 + COUNT(*))) + 1.0 AS idf FROM dtf GROUP BY term),
dw AS (SELECT news_id, term, tf * idf AS w FROM dtf JOIN idf USING (term)),
dv AS (SELECT news_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY news_id)) AS weight FROM dw)"""


def tfidf_tokens() -> F.Column:
    """Default TF-IDF tokens (2+ word characters) of CombinedText; CombinedText
    holds only lower-case ASCII letters and single spaces."""
    comb = F.concat(clean_text("title"), F.lit(" "), clean_text("text"))
    return F.filter(F.split(comb, " "), lambda x: F.length(x) >= 2)


def news_tfidf(spark: SparkSession, sf_dir: str):
    """(idf, doc term counts, doc vectors) of the news catalog."""
    news = B.news(spark, sf_dir)
    # the catalog's term counts feed the idf, the document vectors and every
    # user vector: written once instead of re-cleaning the texts per branch
    tf = materialize(TX.clean_term_counts(news, "news_id", ["title", "text"], min_len=2))
    n_docs = news.count()   # one number
    idf = TX.fit_idf(tf, "news_id", n_docs)
    return idf, tf, TX.tfidf_vectors(tf, idf, "news_id")


@register("fit_tfidf", with_("news", extra=TFIDF_SQL) + "SELECT news_id, term, round(weight, 6) AS weight FROM dv")
def q_fit_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, dv = news_tfidf(spark, sf_dir)
    return dv.select("news_id", "term", r6(F.col("weight")).alias("weight"))


# ---- dense vectors ------------------------------------------------------------------------
# Fixed rule for the attention weight vector of ``pooled_user_vector``:
# w_d = 0.01 * ((d mod 7) - 3) for d = 0..63, bias 0.
POOL_W = [0.01 * ((d % 7) - 3) for d in range(64)]
POOL_W_SQL = "[" + ", ".join(repr(w) for w in POOL_W) + "]"


@register("pooled_user_vector", with_("vec", extra=f"""a AS (SELECT user_id, item_id, v,
   list_sum(list_transform(list_zip(v, {POOL_W_SQL}), lambda x: CAST(x[1] AS DOUBLE) * x[2])) AS s FROM vec
   WHERE list_bool_or(list_transform(v, lambda x: x <> 0))),
e AS (SELECT user_id, item_id, v, exp(s - MAX(s) OVER (PARTITION BY user_id)) AS e FROM a),
p AS (SELECT user_id, v, e / SUM(e) OVER (PARTITION BY user_id) AS p FROM e)""")
    + """SELECT user_id, CAST(d - 1 AS INT) AS dim, round(SUM(p * CAST(v[d] AS DOUBLE)), 6) AS value
FROM p, range(1, 65) t(d) GROUP BY user_id, d""")
def q_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = V.pooled_user_vector(B.vec(spark, sf_dir), POOL_W)
    return pv.select("user_id", F.col("dim").cast("int").alias("dim"), r6(F.col("value")).alias("value"))


MEANVEC_SQL = """mv AS (SELECT user_id, d, AVG(CAST(v[d] AS DOUBLE)) AS m FROM vec, range(1, 65) t(d) GROUP BY user_id, d),
uv AS (SELECT user_id, list(m ORDER BY d) AS u FROM mv GROUP BY user_id)"""


def mean_user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.assemble(V.pooled_user_vector(B.vec(spark, sf_dir), None), "user_id", out_col="u")


@register("two_tower_score", with_("vec", extra=MEANVEC_SQL) + """SELECT v.item_id, v.user_id,
  round(1.0 / (1.0 + exp(-list_sum(list_transform(list_zip(u.u, v.v), lambda x: x[1] * CAST(x[2] AS DOUBLE))))), 6) AS score
FROM vec v JOIN uv u USING (user_id)""")
def q_two_tower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item scored against its own user's mean history vector."""
    uv = mean_user_vectors(spark, sf_dir)
    j = B.vec(spark, sf_dir).join(uv, "user_id")
    return V.two_tower_score(j).select("item_id", "user_id", r6(F.col("score")).alias("score"))


@register("cosine_topk", with_("vec", extra=MEANVEC_SQL + """,
cs AS (SELECT u.user_id, v.item_id,
   list_sum(list_transform(list_zip(u.u, v.v), lambda x: x[1] * CAST(x[2] AS DOUBLE)))
   / (sqrt(list_sum(list_transform(u.u, lambda x: x * x))) * sqrt(list_sum(list_transform(v.v, lambda x: CAST(x AS DOUBLE) * x)))) AS sim
   FROM uv u CROSS JOIN vec v),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, item_id) AS rank FROM cs)""")
    + "SELECT user_id, CAST(rank AS INT) AS rank, item_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5")
def q_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 items per user by cosine with the user's mean vector."""
    uv = mean_user_vectors(spark, sf_dir).select(F.col("user_id").cast("long").alias("user_id"), "u")
    items = B.vec(spark, sf_dir).select("item_id", "v")
    t = V.cosine_topk(uv, items, 5)
    return t.select(F.col("user_id").cast("int").alias("user_id"), "rank", "item_id", r6(F.col("similarity")).alias("similarity"))
