"""Candidate generation and recommendation for all users (or clusters) in one job.

Inputs are the long interaction log ``(user_id, ts, event_id, item_id, label)`` and a :class:`TextModel` of the
catalog. Nothing enumerates user x item pairs: similarities are blocked products cut to the best items, and
the unfiltered form generates only the positions of the catalog order that each user needs.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.operators import candidates as CA
from slatewise.operators import ids as ID
from slatewise.operators import interactions as I
from slatewise.operators import text as TX
from slatewise.session import materialize


class TextModel(NamedTuple):
    """TF-IDF of a catalog: (term, idf), (news_id, term, tf) and (news_id, term, weight)."""

    idf: DataFrame
    counts: DataFrame
    vectors: DataFrame

    def of_items(self, items: DataFrame) -> DataFrame:
        """(item_id, term, weight) of the items given."""
        v = self.vectors.withColumnRenamed("news_id", "item_id")
        return v.join(items.select(F.col("item_id").cast("long").alias("item_id")), "item_id", "left_semi")

    def numbered(self, items: ID.IdDictionary) -> TextModel:
        """The same model with its items' numbers for ids."""
        return TextModel(self.idf, items.encode(self.counts, "news_id"), items.encode(self.vectors, "news_id"))


def fit_text_model(catalog: DataFrame, id_col: str, text_cols: list[str], min_len: int = 2) -> TextModel:
    """TF-IDF of a catalog's cleaned texts; the term counts are written once, since everything else derives from them."""
    docs = catalog.select(F.col(id_col).alias("news_id"), *[F.col(c) for c in text_cols])
    counts = materialize(TX.clean_term_counts(docs, "news_id", text_cols, min_len=min_len))
    idf = TX.fit_idf(counts, "news_id", docs.count())   # one number
    return TextModel(idf, counts, TX.tfidf_vectors(counts, idf, "news_id"))


def _dictionaries(inter: DataFrame, model: TextModel | None, users: DataFrame | None, scores: DataFrame | None) -> tuple[ID.IdDictionary, ID.IdDictionary]:
    """Of users and of items, over all inputs that name them."""
    items = [(inter, "item_id"), *([(model.counts, "news_id")] if model else []), *([(scores, "item_id")] if scores is not None else [])]
    who = [(inter, "user_id"), *([(users, "user_id")] if users is not None else []), *([(scores, "user_id")] if scores is not None else [])]
    return ID.id_dictionary(*who), ID.id_dictionary(*items)


def _log(inter: DataFrame, who: ID.IdDictionary, items: ID.IdDictionary) -> DataFrame:
    return items.encode(who.encode(inter, "user_id"), "item_id")


def generate_candidates(inter: DataFrame, cutoff, model: TextModel, max_candidates: int | None = None,
                        min_similarity: float = 0.02, exclude_history: bool = True, whole_catalog: bool = False,
                        clusters: DataFrame | None = None) -> DataFrame:
    """(key, item_id, similarity, rank) for every user, or with ``clusters`` (user_id, cluster) for every cluster.

    Candidates are the items first seen at or before ``cutoff``, or the whole catalog. With ``min_similarity``
    above 0 only items that similar to the history count, best first. At 0 or less there is no text filter:
    the first ``max_candidates`` in catalog (id) order count, for every key, and ``similarity`` is null; that form
    needs a limit, since without one it is every pair. Without a limit the filtered form has no rank.
    User and item ids may be of any type.
    """
    if not (ID.numeric(inter, "user_id") and ID.numeric(inter, "item_id")):
        who, items = _dictionaries(inter, model, clusters, None)
        found = generate_candidates(_log(inter, who, items), cutoff, model.numbered(items), max_candidates, min_similarity, exclude_history,
                                    whole_catalog, None if clusters is None else who.encode(clusters, "user_id"))
        found = items.decode(found, "item_id")
        return who.decode(found, "user_id") if clusters is None else found
    key = "user_id" if clusters is None else "cluster"
    hist = I.user_history(inter, cutoff).select("user_id", "item_id")
    keys = inter.select("user_id").distinct()
    if clusters is not None:
        hist = hist.join(clusters, "user_id").select(key, "item_id")   # an item counts once per member
        keys = clusters.select(key).distinct()
    if min_similarity <= 0:
        if max_candidates is None:
            raise ValueError("without a similarity threshold max_candidates is needed")
        ids = model.vectors.select(F.col("news_id").alias("item_id")) if whole_catalog else I.candidate_pool(inter, cutoff)
        pool = ids.select(F.col("item_id").cast("long").alias("item_id"), F.lit(0.0).alias("score")).distinct()
        own = hist.select(key, F.col("item_id").cast("long").alias("item_id")).where(F.lit(exclude_history)).distinct()
        top = CA.topk_excluding(keys.withColumnRenamed(key, "user_id"), own.withColumnRenamed(key, "user_id"), pool, max_candidates)
        w = Window.partitionBy(key).orderBy("item_id")
        return top.select(F.col("user_id").alias(key), "item_id", F.lit(None).cast("double").alias("similarity")).withColumn("rank", F.row_number().over(w))
    items = model.vectors.withColumnRenamed("news_id", "item_id") if whole_catalog else model.of_items(I.candidate_pool(inter, cutoff))
    return TX.history_topk(hist, model.counts, model.idf, items, key, max_candidates, min_similarity, exclude_history)


def recommend(inter: DataFrame, model: TextModel | None = None, users: DataFrame | None = None,
              ref_date: dt.datetime | None = None, timeframe_hours: int = 24, max_candidates: int | None = None,
              show: int = 5, scores: DataFrame | None = None) -> DataFrame:
    """(user_id, rank, item_id, score): the ``show`` best recent items of every user.

    Candidates are first seen in the ``timeframe_hours`` before ``ref_date`` (default: the last event), the first
    ``max_candidates`` of them in id order. Without ``scores`` an item's score is its TF-IDF cosine with the user's
    history up to ``ref_date``, 0 where nothing matches; ``scores`` (user_id, item_id, score), such as bagged, boosted or
    stacked predictions, replace it, and pairs that they lack are left out. Ties go to the smaller id.
    ``users`` (user_id) defaults to all users of the log. User and item ids may be of any type.
    """
    if not (ID.numeric(inter, "user_id") and ID.numeric(inter, "item_id")):
        who, items = _dictionaries(inter, model, users, scores)
        top = recommend(_log(inter, who, items), model and model.numbered(items), None if users is None else who.encode(users, "user_id"), ref_date,
                        timeframe_hours, max_candidates, show, None if scores is None else items.encode(who.encode(scores, "user_id"), "item_id"))
        return items.decode(who.decode(top, "user_id"), "item_id")
    ref = ref_date or inter.agg(F.max("ts")).first()[0]   # one timestamp
    if ref is None:
        return inter.where("false").select("user_id", F.lit(0).alias("rank"), F.col("item_id").cast("long").alias("item_id"), F.lit(0.0).alias("score"))
    lo = ref - dt.timedelta(hours=timeframe_hours)
    first = I.first_interaction(inter)
    fresh = first.filter((F.col("first_ts") > F.lit(lo)) & (F.col("first_ts") <= F.lit(ref))) \
                 .select(F.col("item_id").cast("long").alias("item_id"))
    if max_candidates is not None:
        fresh = fresh.orderBy("item_id").limit(max_candidates)
    who = (inter if users is None else users).select("user_id").distinct()
    if scores is None:
        if model is None:
            raise ValueError("recommend needs a text model or scores")
        hist = I.user_history(inter, ref).select("user_id", "item_id").join(who, "user_id", "left_semi")
        top = TX.history_topk(hist, model.counts, model.idf, model.of_items(fresh), "user_id", show,
                              left_ids=who, right_ids=fresh).withColumnRenamed("similarity", "score")
    else:
        s = scores.select("user_id", F.col("item_id").cast("long").alias("item_id"), "score").join(fresh, "item_id", "left_semi") \
                  .join(who, "user_id", "left_semi")
        w = Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), F.col("item_id").asc())
        top = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= show)
    return top.select("user_id", F.col("rank").cast("int").alias("rank"), "item_id", "score")
