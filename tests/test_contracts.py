"""Contracts of small operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from slatewise.operators import classification as C, slates as S, summaries as SU
from slatewise.sources import files


def test_strict_slate_rejects_a_second_dash(spark):
    df = spark.createDataFrame([(1, "5-1 6-0")], "impression_id int, impressions string")
    assert [(r.candidate_id, r.label) for r in S.explode_slate(df).collect()] == [("5", 1), ("6", 0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        S.explode_slate(spark.createDataFrame([(1, "5-1-1")], df.schema)).collect()


def test_timings_grammar_and_order(spark):
    logs = spark.createDataFrame([("{'x':'1ms', '2nd':  '3ms'}",), ("{'x': '3ms'}",), (None,)], "line string")
    assert [tuple(r) for r in SU.component_timings(logs).collect()] == [("2nd", 3.0), ("x", 2.0)]


def test_auc_denominator_does_not_overflow(spark):
    big = spark.range(1).select((F.lit(4_000_000_000).cast("long")).alias("P"), (F.lit(4_000_000_000).cast("long")).alias("N"))
    assert big.select((F.col("P").cast("double") * F.col("N").cast("double")).alias("x")).first().x == 1.6e19
    preds = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.1), ("m", 0, 0.9)], "model string, y_true int, y_pred double")
    assert C.roc_auc(preds).first().auc == 0.75


def test_metric_documents_indented_and_large_thresholds(spark, tmp_path):
    (tmp_path / "a_m1_metrics.json").write_text('{\n  "auc": 0.5,\n  "5": {\n    "ndcg": 0.25\n  }\n}\n')
    row = files.collect_metrics(spark, str(tmp_path / "*.json"), r"a_(\w+)_metrics").first()
    assert (row["key"], row["auc"], row["5"]["ndcg"]) == ("m1", 0.5, 0.25)
    out = str(tmp_path / "out")
    files.write_metrics(spark.createDataFrame([("m", 1234.5, 1.0)], "model string, threshold double, auc double"), out)
    assert any(p.name.endswith("1234.5000_m_metrics.json") for p in (tmp_path / "out").iterdir())


def test_filter_results_both_branches(spark):
    from slatewise.operators.features import filter_results
    rows = spark.createDataFrame([  # user, donor, own part, clicks, place in the file
        ("u1", None, 5, 2, 1), ("u1", "d", 3, 2, 2), ("u1", None, 4, 2, 3), ("u2", "d", None, 1, 4), ("u3", None, 1, 0, 5),
        ("u3", "d", 1, 0, 6), ("u4", "d", 2, None, 7), (None, None, 1, 1, 8)],
        "user_id string, donor_user_id string, num_from_original int, num_future_clicks int, seq int")
    assert {r["seq"] for r in filter_results(rows, True, "seq").collect()} == {2, 4, 7}
    assert {r["seq"] for r in filter_results(rows, False, "seq").collect()} == {3, 4, 8}
    assert {r["seq"] for r in filter_results(rows.drop("num_from_original"), False, "seq").collect()} == {3, 8}
    assert filter_results(rows.limit(0), False, "seq").columns == rows.columns
