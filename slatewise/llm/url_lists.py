"""URL filters: a temporal join of captures with dated list entries.

List events (list, kind, pattern, at, event_no, action) become validity intervals: an event holds from its time
until the next event of the same list and pattern; 'add' intervals are active. A capture is evaluated against
the entries active when it was fetched. Its candidate patterns are the host, every parent domain of two labels
at least, and host + every leading part of the path; they are found by equality, never by a range over all
entries.

Intervals are cut at fixed time buckets and the join is on (pattern, bucket), so even a host with a third of
all captures is spread over the buckets, and within a bucket only the intervals touching it are compared. The
number of pieces per interval is bounded by the buckets between the first and the last capture.

The most specific active entry decides (longest pattern, 'allow' before 'block', then list name). Only
DataFrame functions are used.

Defined cases: a null or unparsable url has no host, matches nothing and stays; a null fetch time matches
nothing; events with a null pattern, time or action are ignored; of several events of one pattern at the same
time the one with the largest event_no holds; repeated captures get equal results; empty tables give an empty
result (no captures) or no matches (no events); extra columns of captures stay, but those named like a result
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
BUCKET_SECONDS = 7 * 86_400
RESULT = ["host", "n_active", "rule", "rule_list", "rule_kind", "blocked"]


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url; empty if there is none, null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns_of(url: Column) -> Column:
    """All list patterns that a url can match, as an array."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths)))


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, pattern, valid_from, valid_to) of the 'add' events; an open end is null."""
    w = Window.partitionBy("list", "pattern").orderBy("at", "event_no", "action")
    known = events.where("pattern is not null and at is not null and action is not null")
    return (
        known.withColumn("valid_to", F.lead("at").over(w))
        .where("action = 'add' and (valid_to is null or valid_to > at)")
        .select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def temporal_filter(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched_at",
                    bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``captures`` with host, n_active (entries active at fetch time that match), the deciding rule and ``blocked``."""
    keys = captures.select(F.col(url_col).alias("__url"), F.col(time_col).cast("long").alias("__at"))
    looked_up = keys.where("__url is not null and __at is not null").distinct()
    lo, hi = looked_up.agg(F.min("__at"), F.max("__at")).first()
    lo, hi = lo or 0, hi or 0
    asked = looked_up.withColumn("pattern", F.explode(patterns_of(F.col("__url")))).withColumn("bucket", F.floor(F.col("__at") / bucket_seconds))
    pieces = (
        intervals(events).where(f"valid_from <= {hi} and (valid_to is null or valid_to > {lo})")
        .withColumn("bucket", F.explode(F.sequence(
            F.floor(F.greatest("valid_from", F.lit(lo)) / bucket_seconds),
            F.floor(F.least(F.coalesce(F.col("valid_to") - 1, F.lit(hi)), F.lit(hi)) / bucket_seconds))))
    )
    allow = (F.col("kind") == "allow").cast("int")
    hits = (
        asked.join(pieces, ["pattern", "bucket"])
        .where("valid_from <= __at and (valid_to is null or __at < valid_to)")
        .groupBy("__url", "__at")
        .agg(F.count(F.lit(1)).alias("n_active"),
             F.max_by(F.struct(F.col("pattern").alias("rule"), F.col("list").alias("rule_list"), F.col("kind").alias("rule_kind")),
                      F.struct(F.length("pattern"), allow, "list", "pattern")).alias("best"))
        .select(F.col("__url").alias("__u"), F.col("__at").alias("__t"), "n_active", "best.*")
    )
    base = captures.drop(*RESULT)
    out = base.join(hits, (base[url_col] == hits["__u"]) & (base[time_col].cast("long") == hits["__t"]), "left")
    return out.select(
        *[base[c] for c in base.columns], host_of(base[url_col]).alias("host"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        "rule", "rule_list", "rule_kind", F.coalesce(F.col("rule_kind") == "block", F.lit(False)).alias("blocked"),
    )
