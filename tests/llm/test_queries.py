"""The registered queries with their production parameters: SQL, plain versions and plan shape, on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from slatewise.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
ALL = sorted(k for k in entry.queries() if k in queries.QUERIES or k == "pipeline")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("key", ALL)
def test_no_cross_or_nested_loop_join(spark, key):
    assert len(ALL) == 14
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", sorted(k for k in entry.oracle_sql() if k in queries.QUERIES))
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[key])
    got = entry.queries()[key](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got.select(*want.columns).collect()) == bag(want.fetchall())


def test_op1(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    first = {}
    for i, raw in pages:
        first[raw] = min(i, first.get(raw, i))
    want = [(i, len(raw), brute.base32_sha1(raw), *(("response", None) if first[raw] == i else ("revisit", first[raw]))) for i, raw in pages]
    assert bag(queries.op1_warc_chunks(spark, SF).collect()) == bag(want)


def test_op5(spark, documents):
    sizes = {}
    for _, t, s in documents:
        sizes[s] = sizes.get(s, 0) + len(brute.SPACE_WORDS.findall(t or ""))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = brute.capped_targets(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 1.5, 2)
    source, taken = {i: s for i, _, s in documents}, dict.fromkeys(sizes, 0)
    for r in queries.op5_mix_sources(spark, SF).collect():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_op7(spark, documents):
    got = queries.op7_suffix_dedup(spark, SF).collect()
    assert bag(got) == bag(brute.suffix_dedup([(i, t) for i, t, _ in documents], 200))


def test_op9(spark, documents):
    tops, sizes = brute.near_components([(i, t) for i, t, _ in documents], 3, 85)
    want = [(i, n, c if n else i, not n or i == c) for (i, _, _), c, n in zip(documents, tops, sizes)]
    assert bag(queries.op9_minhash_components(spark, SF).collect()) == bag(want)
