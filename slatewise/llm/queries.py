"""The operators bound to the driver tables: one query each, over whole tables, with DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slatewise.llm import (
    alignment, decontaminate, divergence, exact_dedup, language, licenses, mixing, near_dedup, quality, substring_dedup, suffix_dedup, url_lists, warc,
)
from slatewise.llm.storage import save, ship, table

#: The dated lists of op10 and its fetch times lie in this year (2024, UTC).
YEAR_START, YEAR_SECONDS = 1_704_067_200, 31_622_400
EVENTS_PER_PATTERN = 6


def crc_mod(id_: Column, n: int) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % n


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    learning = crc_mod(F.col("doc_id"), 5) != 0
    model = quality.learn(docs.where(learning), labels.where(learning))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = save(mixing.sized(docs), "sizes")
    return mixing.mix_rows(docs, rows=rows).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.learn(docs.where(~held_out).select("lang", "text"))
    return language.label(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def _draw(text: Column, at: int) -> Column:
    """32 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")


def dated_lists(pages: DataFrame) -> DataFrame:
    """List events derived from the hosts, parent domains and first path parts of the pages themselves."""
    patterns = pages.select(F.explode(url_lists.patterns_of(F.col("url"))).alias("pattern")).where(
        F.length(F.regexp_replace("pattern", "[^/]", "")) <= 1).distinct()
    events = patterns.withColumn("event_no", F.explode(F.sequence(F.lit(0), F.lit(EVENTS_PER_PATTERN - 1))))
    key = F.concat("pattern", F.lit("#"), F.col("event_no").cast("string"))
    return events.where(_draw(key, 1) % 3 != 0).select(
        F.when(_draw(key, 9) % 3 == 0, "trusted").otherwise("blocked").alias("list"),
        F.when(_draw(key, 9) % 3 == 0, "allow").otherwise("block").alias("kind"), "pattern",
        (F.lit(YEAR_START) + _draw(key, 17) % YEAR_SECONDS).alias("at"), "event_no",
        F.when(_draw(key, 25) % 2 == 0, "add").otherwise("remove").alias("action"))


def op10_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.lit(YEAR_START) + _draw(F.col("page_id").cast("string"), 1) % YEAR_SECONDS)
    return url_lists.temporal_filter(captures, dated_lists(pages)).select("page_id", "fetched_at", *url_lists.RESULT)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    at = F.col("places.at")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return divergence.divergence_audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


#: Files of the two public tokenizers of op13, in the installed folder that holds them.
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op13_token_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return alignment.cross_alignment(table(spark, sf_dir, "documents"), a_path or str(public_tokenizers.path(A_FILE)), b_path or str(public_tokenizers.path(B_FILE)))


UPPER = exact_dedup.UPPER
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
firsts AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN firsts USING (g) WHERE first_id < win.doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '{P}') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '{P}') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i))),
m AS (SELECT doc_id, s, k, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""".replace("{U}", UPPER).replace("{L}", UPPER.lower()).replace("{P}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OP8_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
OP10_SQL = r"""
WITH u AS (
  SELECT page_id, url, {START} + CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % {SECONDS} AS fetched_at,
         lower(regexp_extract(url, '{HOST}', 1)) AS host,
         [x for x in string_split(regexp_extract(url, '{PATH}', 1), '/') if x <> ''] AS seg
  FROM pages),
c AS (
  SELECT page_id, fetched_at, host, list_distinct(list_concat(
           [array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') for i in range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)],
           [host || '/' || array_to_string(list_slice(seg, 1, i), '/') for i in range(1, len(seg) + 1)])) AS pats
  FROM u),
asked AS (SELECT page_id, fetched_at, unnest(pats) AS pattern FROM c WHERE host <> ''),
ev AS (
  SELECT pattern, event_no, md5(pattern || '#' || CAST(event_no AS VARCHAR)) AS h
  FROM (SELECT DISTINCT pattern FROM asked WHERE length(regexp_replace(pattern, '[^/]', '', 'g')) <= 1), (SELECT unnest(range(0, {EVENTS})) AS event_no)),
events AS (
  SELECT pattern, event_no, CASE WHEN CAST('0x' || substr(h, 9, 8) AS BIGINT) % 3 = 0 THEN 'allow' ELSE 'block' END AS kind,
         {START} + CAST('0x' || substr(h, 17, 8) AS BIGINT) % {SECONDS} AS ts,
         CASE WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 2 = 0 THEN 'add' ELSE 'remove' END AS action
  FROM ev WHERE CAST('0x' || substr(h, 1, 8) AS BIGINT) % 3 <> 0),
iv AS (SELECT *, lead(ts) OVER (PARTITION BY kind, pattern ORDER BY ts, event_no) AS valid_to FROM events),
hits AS (
  SELECT page_id, kind, asked.pattern AS rule FROM asked JOIN iv ON asked.pattern = iv.pattern
  WHERE action = 'add' AND ts <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, kind, rule DESC) AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM hits)
SELECT c.page_id, c.fetched_at, c.host, coalesce(n, 0) AS n_active, rule, CASE kind WHEN 'allow' THEN 'trusted' WHEN 'block' THEN 'blocked' END AS rule_list,
       kind AS rule_kind, coalesce(kind = 'block', FALSE) AS blocked
FROM c LEFT JOIN best ON c.page_id = best.page_id AND rn = 1
""".replace("{START}", str(YEAR_START)).replace("{SECONDS}", str(YEAR_SECONDS)).replace("{EVENTS}", str(EVENTS_PER_PATTERN)).replace("{HOST}", url_lists.HOST).replace("{PATH}", url_lists.PATH)

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '{P}') AS w FROM documents),
phrase(label, p) AS (VALUES {PHRASES}),
starts AS (SELECT r, w, unnest(range(0, len(w))) AS s FROM d),
base AS (SELECT r, s, label FROM starts, phrase WHERE w[s + 1] = p[1] AND w[s + 1:s + len(p)] = p),
place AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r),
template(label, t, alpha) AS (VALUES {TEMPLATES}),
block AS (SELECT r, list_distinct(w[b * {STRIDE} + 1:(b + 2) * {STRIDE}]) AS x FROM (SELECT r, w, unnest(range(0, greatest(CAST(ceil((len(w) - {STRIDE}) / {STRIDE}.0) AS BIGINT), 1))) AS b FROM d)),
hit AS (SELECT r, label, len(list_intersect(x, t)) / CAST(len(t) AS DOUBLE) AS c FROM block, template WHERE list_has_any(x, t) AND len(list_intersect(x, t)) >= alpha),
added AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(place.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(place.labels, []), coalesce(added.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS score
FROM d LEFT JOIN place ON d.r = place.r LEFT JOIN added ON d.r = added.r
"""
for _name, _value in (
        ("U", UPPER), ("L", UPPER.lower()), ("P", licenses.WORDS), ("STRIDE", str(licenses.STRIDE)),
        ("PHRASES", ", ".join(f"('{k}', {licenses.split_words(p)})" for k, p in licenses.PHRASES)),
        ("TEMPLATES", ", ".join(f"('{k}', {t}, {a})" for k, t, a in licenses.template_sets(licenses.TEMPLATES)))):
    OP11_SQL = OP11_SQL.replace("{" + _name + "}", _value)
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '{P}') AS w FROM documents),
term AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM term GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN}),
size AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT lang, source, term, count(*) AS n FROM term JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, source, sum(n) AS group_n FROM cell GROUP BY lang, source),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000 * CAST(coalesce(n, 0) + 5 AS HUGEINT)) // CAST(coalesce(group_n, 0) + 5 * v AS HUGEINT) AS p,
         1 + (1000000000 * CAST(all_n + 5 AS HUGEINT)) // CAST(lang_n + 5 * v AS HUGEINT) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN size ON size.lang = g.lang
  LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
  LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN far ON far.lang = g.lang AND far.source = g.source AND far.item = h.source),
ahead AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM ahead))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
""".replace("{U}", UPPER).replace("{L}", UPPER.lower()).replace("{P}", divergence.TERMS).replace("{MIN}", str(divergence.MIN_DOCS)).replace("{TOP}", str(divergence.TOP_TERMS))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc_chunks, op2_nb_support_vectors, op3_substring_dedup, op4_decontaminate, op5_mix_sources,
        op6_language_spans, op7_suffix_dedup, op8_exact_dedup, op9_minhash_components, op10_dated_url_lists,
        op11_license_scan, op12_source_divergence, op13_token_alignment)
}
ORACLE: dict[str, str] = {
    "op3_substring_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op10_dated_url_lists": OP10_SQL,
    "op11_license_scan": OP11_SQL, "op12_source_divergence": OP12_SQL,
}
