"""What moves once, and what leaves a task in small batches."""

import pytest

from lectern.operators import metrics
from lectern.plans import file_queries, review_queries
from lectern.plans.table_queries import _cited, bags
from lectern.sources import clients, files


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange ") - text.count("BroadcastExchange "), text


def test_records_move_once(spark, sf_dir):
    n, text = exchanges(review_queries.records(spark, sf_dir))
    assert n == 1 and "Join" not in text


def test_groups_move_items_once(spark, sf_dir):
    n, text = exchanges(metrics._group_hits(bags(spark, sf_dir)[1], bags(spark, sf_dir)[2], "dimension"))
    assert n == 2 and "Join" not in text  # items and predictions by section, sums by document


def test_references_are_listed_where_they_arrive(spark, sf_dir):
    n, text = exchanges(_cited(spark, sf_dir))
    assert n == 1 and text.index("ObjectHashAggregate") < text.rindex("ObjectHashAggregate") < text.index("Exchange ")  # no list is built before the exchange


@pytest.mark.parametrize("make", ["embedded", "docx"])
def test_rows_leave_in_small_batches(spark, monkeypatch, make):
    """A task's batch of 10,000 rows is not answered as a whole."""
    pa = pytest.importorskip("pyarrow")
    n, seen = 200, []
    if make == "embedded":
        catch = type("Frame", (), {"schema": spark.createDataFrame([], "text string").schema, "mapInArrow": lambda self, run, schema: seen.append(run)})()
        clients.embedded(catch, "http://m", "x", post=file_queries._vectors, size=16)
        out = list(seen[0](iter([pa.record_batch([pa.array(["a"] * (n - 1) + [None])], ["text"])])))
        assert out[-1].column("embedding").to_pylist()[-2:] == [[1.0, 1.0], [0.0, 1.0]]
    else:
        batch = pa.record_batch([pa.array([str(i) for i in range(n)]), pa.array(["1.1 a\nb"] * n)], ["path", "text"])
        out = list(file_queries._word_files(iter([batch])))
    assert sum(len(b) for b in out) == n and max(len(b) for b in out) <= files.FILES
