"""Plans: columns and filters reach the scan, ranks are limited early, small tables are broadcast."""

from lectern.operators import candidates, matching, metrics
from lectern.plans.registry import QUERIES
from lectern.plans.table_queries import bags


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_one_column(spark, sf_dir):
    assert "ReadSchema: struct<event_type:string>" in plan(QUERIES["ag14_histogram"](spark, sf_dir))


def test_filter_and_rank_are_pushed(spark, sf_dir):
    assert "GreaterThan(l_quantity,45.0)" in plan(QUERIES["st3_set_difference"](spark, sf_dir))
    assert "WindowGroupLimit" in plan(QUERIES["tk1_top_confident"](spark, sf_dir))


def test_items_are_aggregated_before_predictions_meet_them(spark, sf_dir):
    _, gt, pred = bags(spark, sf_dir)
    for made in (matching.best_match(gt, pred), metrics.item_recall(*bags(spark, sf_dir), ["dimension"])):
        p = plan(made)
        assert p.count("HashAggregate") >= 2 and "NestedLoop" not in p and "Cartesian" not in p


def test_no_join_in_bag_matching(spark, sf_dir):
    p = plan(QUERIES["ag12_hits_at_k"](spark, sf_dir))
    assert p.count("Join") == 1 and "NestedLoop" not in p and "Cartesian" not in p


def test_taxonomy_is_broadcast(spark):
    items = spark.createDataFrame([("C3.1", "E-T-01")], "dimension string, error_type string")
    assert "BroadcastHashJoin" in plan(candidates.valid(items))


def test_corpus_dedup_keeps_python_out(spark, sf_dir):
    p = plan(QUERIES["wn2_keep_first"](spark, sf_dir))
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
