"""DuckDB SQL for the fixture bindings (FIXTURES.md section 3).

Each ``*_CTE`` is a ``name AS (...)`` fragment to put in a WITH clause;
:func:`with_` joins the fragments a query needs. The driver registers the
raw tables as views, so these run unchanged in DuckDB.
"""

from __future__ import annotations

IMPR_CTE = """impr AS (
  SELECT l.l_orderkey AS impression_id, l.l_partkey AS item_id,
         l.l_orderkey * 1000000 + l.l_partkey AS row_id,
         o.o_custkey AS user_id, o.o_orderdate AS ts, p.p_type AS category,
         MAX(CAST(l.l_returnflag = 'R' AS INT)) AS label,
         MAX(l.l_discount) AS s0, MAX(l.l_tax) AS s1, MAX(l.l_quantity / 50.0) AS s2
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
                  JOIN part p   ON p.p_partkey  = l.l_partkey
  GROUP BY l.l_orderkey, l.l_partkey, o.o_custkey, o.o_orderdate, p.p_type)"""

PREDS_CTE = """preds AS (
  SELECT row_id, impression_id, CAST(label AS DOUBLE) AS y_true, 'fastformer_0_x' AS model, CAST(s0 AS DOUBLE) AS y_pred FROM impr
  UNION ALL
  SELECT row_id, impression_id, CAST(label AS DOUBLE), 'fastformer_global_x', CAST(s1 AS DOUBLE) FROM impr
  UNION ALL
  SELECT row_id, impression_id, CAST(label AS DOUBLE), 'fastformer_news_x', CAST(s2 AS DOUBLE) FROM impr)"""

BEHAV_CTE = """behav AS (
  SELECT impression_id, user_id, ts, string_agg(item_id || '-' || label, ' ' ORDER BY item_id) AS impressions
  FROM impr GROUP BY impression_id, user_id, ts)"""

INTER_CTE = """inter AS (
  SELECT event_id, user_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS item_id,
         CAST(event_type IN ('click', 'purchase') AS INT) AS label
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""

CUTOFF_CTE = """cut AS (
  SELECT make_timestamp(CAST((epoch_us(MIN(ts)) + (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) // 2) AS BIGINT)) AS cutoff
  FROM inter)"""

NEWS_CTE = """news AS (
  SELECT doc_id AS news_id, lang AS category, source AS subcategory,
         array_to_string(list_slice(regexp_split_to_array(trim(text), '\\s+'), 1, 12), ' ') AS title, text
  FROM documents)"""

VEC_CTE = """vec AS (SELECT vec_id AS item_id, embedding AS v, label AS user_id FROM embeddings)"""

CTES = {"impr": IMPR_CTE, "preds": PREDS_CTE, "behav": BEHAV_CTE, "inter": INTER_CTE,
        "cut": CUTOFF_CTE, "news": NEWS_CTE, "vec": VEC_CTE}
DEPS = {"preds": ["impr"], "behav": ["impr"], "cut": ["inter"]}


def with_(*names: str, extra: str = "") -> str:
    """WITH clause with the named bindings (and their dependencies) first."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTES[n] for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def ks_values(ks: list[int]) -> str:
    return "(VALUES " + ", ".join(f"({k})" for k in ks) + ") AS ks(k)"
