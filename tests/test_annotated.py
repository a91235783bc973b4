"""Reviews with their quadruples and conflict flag."""

from __future__ import annotations

from opinara.sources import fixtures as V
from tests.parity import DATA


def test_annotated_moves_the_quadruples_once(spark):
    """Distinct sentiments are counted where a review's quadruples are."""
    plan = V.annotated(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_annotated_conflict_needs_three_sentiments(spark, tmp_path):
    row = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    flags = {1: "ANR", 2: "AAN", 3: "R"}
    lines = [(o, i, 1, i, 1.0, 0.01, f, "F") for o, fs in flags.items() for i, f in enumerate(fs)]
    spark.createDataFrame(lines, row).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.review_id: (len(r.quadruples), r.conflict) for r in V.annotated(spark, str(tmp_path)).collect()}
    assert got == {"1": (3, True), "2": (3, False), "3": (1, False)}
