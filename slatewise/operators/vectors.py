"""Dense vector features: pooled user vectors, two-tower scores, cosine top-k
(SURVEY 2.8).

Vectors are ``array<float|double>`` columns; dot products are
``aggregate(zip_with(...))`` so they stay in codegen. Exact top-k by cosine
over a whole item catalog scores blocks of users against blocks of items
with numpy, so user x item scores are computed inside tasks but never
materialised as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.operators.ids import id_dictionary, numeric

BLOCK_ROWS = 20_000
USER_CHUNK = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pooled_user_vector(hist: DataFrame, weights: list[float] | None, bias: float = 0.0,
                       user_col: str = "user_id", vec_col: str = "v") -> DataFrame:
    """Attention pooling: softmax over history items of (w . v + b), then the
    weighted sum of the item vectors. All-zero (padding) vectors are masked
    out. ``weights=None`` (or all zero) gives mean pooling.

    Softmax and sums are grouped aggregates per user and per dimension, so a
    long history is reduced in parallel, never collected.
    """
    v = F.col(vec_col)
    nz = F.exists(v, lambda x: x != 0)
    h = hist.filter(nz)
    if weights:
        a = dot(v, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))
    else:
        a = F.lit(0.0)
    h = h.withColumn("_a", a)
    mx = h.groupBy(user_col).agg(F.max("_a").alias("_m"))
    h = h.join(mx, user_col).withColumn("_e", F.exp(F.col("_a") - F.col("_m")))
    z = h.groupBy(user_col).agg(F.sum("_e").alias("_z"))
    h = h.join(z, user_col).withColumn("_p", F.col("_e") / F.col("_z"))
    e = h.select(user_col, "_p", F.posexplode(v).alias("dim", "x"))
    return e.groupBy(user_col, "dim").agg(F.sum(F.col("_p") * F.col("x").cast("double")).alias("value"))


def assemble(long_vec: DataFrame, key_col: str, dim_col: str = "dim", value_col: str = "value",
             out_col: str = "v") -> DataFrame:
    """(key, dim, value) -> (key, array ordered by dim). Arrays are model-sized (fixed dims)."""
    return long_vec.groupBy(key_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(dim_col, value_col))), lambda e: e[value_col]).alias(out_col))


def two_tower_score(pairs: DataFrame, user_vec: str = "u", item_vec: str = "v", out_col: str = "score") -> DataFrame:
    """sigmoid(dot(user vector, item vector))."""
    return pairs.withColumn(out_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(F.col(user_vec), F.col(item_vec)))))


def cosine_topk(users: DataFrame, items: DataFrame, k: int, user_col: str = "user_id", item_col: str = "item_id",
                user_vec: str = "u", item_vec: str = "v") -> DataFrame:
    """Exact top k items per user by cosine (ties at 1e-9: smaller item id first).

    Users and items are cut by hash into blocks of about ``BLOCK_ROWS``; every
    pair of blocks is one group, scored with numpy, that gives its k best items
    per user. A per-user window merges at most (item blocks x k) candidates.
    Nothing goes through the driver but the two row counts.
    """
    if not (numeric(users, user_col) and numeric(items, item_col)):
        us, its = id_dictionary((users, user_col)), id_dictionary((items, item_col))
        top = cosine_topk(us.encode(users, user_col), its.encode(items, item_col), k, user_col, item_col, user_vec, item_vec)
        return its.decode(us.decode(top, user_col), item_col)
    n_u, n_i = (max(1, -(-x.count() // BLOCK_ROWS)) for x in (users, items))

    def blocks(df: DataFrame, key: str, vec: str, mine: str, own: int, other: str, others: int) -> DataFrame:
        own_block = F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(mine)
        return df.select(F.col(key).cast("long").alias(key), F.col(vec).cast("array<double>").alias(vec), own_block,
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    u = blocks(users, user_col, user_vec, "_ub", n_u, "_ib", n_i)
    v = blocks(items, item_col, item_vec, "_ib", n_i, "_ub", n_u)
    schema = T.StructType([T.StructField(user_col, T.LongType()), T.StructField(item_col, T.LongType()),
                           T.StructField("similarity", T.DoubleType())])

    def best(up, ip):
        import numpy as np
        import pandas as pd
        if up.empty or ip.empty:
            return pd.DataFrame({user_col: [], item_col: [], "similarity": []})

        def unit(vectors):
            m = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        ip = ip.sort_values(item_col, kind="stable")   # ties then resolve to the smaller id
        ids, item_ids = up[user_col].to_numpy(), ip[item_col].to_numpy()
        um, iv, kk, out = unit(up[user_vec]), unit(ip[item_vec]), min(k, len(ip)), []
        for lo in range(0, len(ids), USER_CHUNK):   # bounded users x items block in memory
            sims = um[lo:lo + USER_CHUNK] @ iv.T
            top = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :kk]
            out.append(pd.DataFrame({user_col: np.repeat(ids[lo:lo + USER_CHUNK], kk), item_col: item_ids[top].ravel(),
                                     "similarity": np.take_along_axis(sims, top, axis=1).ravel()}))
        return pd.concat(out)

    cand = u.groupBy("_ub", "_ib").cogroup(v.groupBy("_ub", "_ib")).applyInPandas(best, schema)
    w = Window.partitionBy(user_col).orderBy(F.round("similarity", 9).desc(), F.col(item_col).asc())
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select(user_col, F.col("rank").cast("int").alias("rank"), item_col, "similarity"))
