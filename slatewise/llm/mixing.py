"""Mixing sources to target weights: Sainte-Laguë apportionment, taken in blocks of nearly equal tokens.

1. Targets: every source gets its weight's share of the mix, at most ``max_epochs`` times its size; what a
   capped source cannot take is shared again by weight until none is above its cap (in closed form: sources in
   the order of cap / weight, and the first level at which the rest can take the rest).
2. Quotas: the mix's words go one by one to the source with the highest quotient ``target / (2 * seats + 1)``; a
   source's words go to its shards in the same way, by shard size. A source of any size, however far below a
   block, so gets its target to the rounding of whole words.
3. Selection: a shard's documents, in a seeded order, form one line of tokens cut into nearly equal blocks of at
   most ``block_tokens``. Every block is taken ``quota div shard size`` times; the ``quota mod shard size`` words
   left are a seeded choice of blocks once more, of the last one its first words. A document's share is what the
   taken words cover of it.

A shard holds about ``shard_tokens`` tokens, so a source with a third of all rows is as many tasks as it needs.
Only DataFrame functions are used; the windows without a partition run over one row per source or over the
few seats in question per source. Reruns agree: every order is by seeded digest, identifier, size and text
digest, so only fully repeated rows can change places.

Defined cases: a null source is a source of its own, ordered last; a null or empty text has size 0 and is never
taken; a source without words has target 0; an empty table gives an empty result; a clashing column of the
input is replaced in the result of ``mix_rows`` only where it is one of the result's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def cycled_weights(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Weights repeating over the sources in code point order, null last. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("double"))


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): weighted shares of ``share`` x all sizes, capped."""
    ratio = F.try_divide(F.col("cap"), F.col("weight"))
    order = Window.orderBy(ratio.asc_nulls_first(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        sources.withColumn("cap", F.when(F.col("weight") > 0, F.col("source_size") * F.lit(float(max_epochs))).otherwise(F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(rest)))
        .withColumn("level", F.max(F.when(ratio >= F.col("level"), F.col("level"))).over(whole))
    )
    return levels.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("cap", "total", "level")


def sainte_lague(parties: DataFrame, votes: str, seats: str, keys: list[str], within: list[str], out: str = "quota") -> DataFrame:
    """Apportion ``seats`` (a column, one value per ``within`` group) over the group's rows by ``votes``.

    The divisor that would give the average seat count rounds to within half a seat per party, so dividing by
    ``votes / (seats -+ parties / 2)`` brackets every party's seats; only the seats between the brackets are
    made rows and ranked by their quotients, ties by ``keys``.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    v = F.col(votes).cast("double")
    p = (
        parties.withColumn("__sum", F.sum(v).over(group))
        .withColumn("__half", F.count(F.when(v > 0, 1)).over(group) / 2 + 1)
        .withColumn("__lo", F.when(v > 0, F.greatest(F.lit(0), F.floor(v * (F.col(seats) - F.col("__half")) / F.col("__sum") + 0.5))).otherwise(F.lit(0)).cast("long"))
        .withColumn("__hi", F.when(v > 0, F.greatest(F.lit(0), F.floor(v * (F.col(seats) + F.col("__half")) / F.col("__sum") + 0.5))).otherwise(F.lit(0)).cast("long"))
        .withColumn("__open", F.col(seats) - F.sum("__lo").over(group))
    )
    best = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    best = best.orderBy(F.col("__q").desc(), *[F.col(k).asc_nulls_last() for k in keys])
    won = (
        p.where("__hi > __lo").withColumn("__seat", F.explode(F.sequence("__lo", F.col("__hi") - 1)))
        .withColumn("__q", v / (2 * F.col("__seat") + 1))
        .withColumn("__rank", F.row_number().over(best)).where("__rank <= __open")
        .groupBy(*[F.col(k).alias(f"__{k}") for k in {*within, *keys}]).agg(F.count(F.lit(1)).alias("__won"))
    )
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in {*within, *keys}]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return p.join(won, cond, "left").withColumn(out, F.col("__lo") + F.coalesce("__won", F.lit(0))).select(*parties.columns, out)


def mix_rows(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights=WEIGHTS, block_tokens: int = 64,
             shard_tokens: int = 1_000_000, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weight_table: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(id, source, text_digest, size, source_size, target, taken), one row per input row.

    ``weight_table`` (source, weight) replaces the cycled weights. ``rows`` may pass the narrow table made by
    ``sized`` if it has been written already; the texts are then not read again.
    """
    rows = sized(docs, seed, id_col, text_col, source_col) if rows is None else rows
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weight_table is None:
        per_source = cycled_weights(per_source, weights)
    else:
        w = weight_table.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        per_source = per_source.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna(0.0, ["weight"])
    plan = targets(per_source, share, max_epochs)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = plan.withColumn("seats", F.round(F.sum("target").over(whole)).cast("long"))
    plan = sainte_lague(plan, "target", "seats", ["source"], [], "source_quota").drop("seats")
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"))

    # A shard is a seeded slice of a source; the per-source plan is one small row per source.
    p = plan.select(F.col("source").alias("__s"), "source_size", "target", "source_quota", "shards")
    placed = rows.join(p, rows["source"].eqNullSafe(p["__s"])).drop("__s").withColumn("shard", F.pmod("draw", "shards"))
    sized_shards = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(sized_shards, "shard_size", "source_quota", ["shard"], ["source"]).where("shard_size > 0")
    shards = shards.withColumn("quota", F.least("quota", F.floor(F.col("shard_size") * F.lit(max_epochs))))
    s = shards.select(
        F.col("source").alias("__s"), F.col("shard").alias("__shard"), "shard_size", F.ceil(F.col("shard_size") / block_tokens).alias("blocks"),
        F.expr("quota div shard_size").alias("rounds"), (F.col("quota") % F.col("shard_size")).alias("rest"))

    line = Window.partitionBy("source", "shard").orderBy("draw", F.col("id").asc_nulls_last(), "size", "text_digest")
    docs_on = placed.withColumn("seq", F.row_number().over(line)).withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    docs_on = docs_on.withColumn("begin", F.col("end") - F.col("size"))
    on_shard = docs_on.where("size > 0").join(s, docs_on["source"].eqNullSafe(s["__s"]) & (docs_on["shard"] == s["__shard"]))
    # Seeded choice of blocks: those with the smallest digests are taken once more, until the rest is used up.
    pick = Window.partitionBy("__s", "__shard").orderBy(F.xxhash64(F.lit(seed), "__s", "__shard", "block"), "block")
    taken_blocks = (
        s.where("rest > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("block_begin", F.expr("block * shard_size div blocks"))
        .withColumn("block_words", F.expr("(block + 1) * shard_size div blocks") - F.col("block_begin"))
        .withColumn("before", F.sum("block_words").over(pick.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_words"))
        .where("before < rest")
        .select("__s", "__shard", "block", "block_begin", (F.col("block_begin") + F.least("block_words", F.col("rest") - F.col("before"))).alias("block_end"))
    )
    # The block of a word x is the last one that begins at or before it.
    parts = (
        on_shard.where("rest > 0")
        .withColumn("block_no", F.explode(F.expr("sequence(((begin + 1) * blocks - 1) div shard_size, (end * blocks - 1) div shard_size)")))
        .select("source", "shard", "seq", "begin", F.col("end"), "block_no")
    )
    b = taken_blocks
    words = F.greatest(F.lit(0), F.least("end", "block_end") - F.greatest("begin", "block_begin"))
    once_more = (
        parts.join(b, parts["source"].eqNullSafe(b["__s"]) & (parts["shard"] == b["__shard"]) & (parts["block_no"] == b["block"]))
        .select("source", "shard", "seq", words.alias("words"))
    )
    per_doc = (
        on_shard.where("rounds > 0").select("source", "shard", "seq", (F.col("size") * F.col("rounds")).alias("words")).unionByName(once_more)
        .groupBy("source", "shard", "seq").agg(F.sum("words").alias("taken"))
        .select(F.col("source").alias("__s"), F.col("shard").alias("__shard"), F.col("seq").alias("__seq"), "taken")
    )
    out = docs_on.join(per_doc, docs_on["source"].eqNullSafe(per_doc["__s"]) & (docs_on["shard"] == per_doc["__shard"]) & (docs_on["seq"] == per_doc["__seq"]), "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "text_digest", "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def sized(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow table the mix works on: identifier, source, size, text digest and seeded draw."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_digest"),
    ).withColumn("draw", F.xxhash64(F.lit(seed), "id", "text_digest"))
