"""Plan shape: no query plans a cartesian product or a nested-loop join, and
scans are pruned/pushed down."""
import pytest

SF = "/root/testdata/sf0.001"
# queries whose builders run streams, file writes or ML fits are checked elsewhere
SKIP_PREFIX = ("stream_", "read_", "append_", "write_", "collect_", "combine_")
SKIP = {"stacking_fit", "calibrate_isotonic", "feature_weights", "segment_models", "user_kmeans", "cosine_topk"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _keys():
    from slatewise.plans import registry as r
    r.load_all()
    return sorted(k for k in r.QUERIES if not k.startswith(SKIP_PREFIX) and k not in SKIP)


@pytest.mark.parametrize("key", _keys())
def test_no_cross_or_nested_loop_join(spark, registry, key):
    plan = _plan(registry.QUERIES[key](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pool_filter_reaches_scan(spark, registry):
    df = registry.QUERIES["candidate_pool"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in plan or "LessThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in plan
