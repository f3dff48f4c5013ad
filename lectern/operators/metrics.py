"""Recall and noise metrics: by document, over the corpus, and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.numbers import rounded
from lectern.operators.matching import DIAGNOSIS, DIMENSION, LOCATION, contains_all, described_matches
from lectern.taxonomy import MISS_DECAY, NOISE_SCALE, NOISE_WEIGHT

HITS = ["location_hits", "dimension_hits", "diagnosis_hits"]


def item_recall(docs: DataFrame, gt: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By document of docs (and by columns of the ground truth): items, predictions, and hits of 1, 2 and 3 key fields.

    One pass of two aggregations serves all three key sets: the finest key's counts are summed up. With by,
    the ground truth of each group meets all of its document's predictions, which are counted by key first.
    """
    outer = ["doc_id", *(f"by_{c}" for c in by or ())]
    p = pred.groupBy("doc_id", *DIAGNOSIS).agg(F.count(F.lit(1)).alias("p")).withColumn("g", F.lit(0).cast("bigint"))
    g = gt.select("*", *[F.col(c).alias(f"by_{c}") for c in by or ()]).groupBy(*outer, *DIAGNOSIS).agg(F.count(F.lit(1)).alias("g")).withColumn("p", F.lit(0).cast("bigint"))
    if by:
        p = p.join(gt.select("doc_id", *[F.col(c).alias(f"by_{c}") for c in by]).distinct(), "doc_id")
    counts = g.unionByName(p).groupBy(*outer, *DIAGNOSIS).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    least = F.sum(F.least("g", "p"))
    by_dim = counts.groupBy(*outer, *DIMENSION).agg(F.sum("g").alias("g"), F.sum("p").alias("p"), least.alias("h3"))
    by_loc = by_dim.groupBy(*outer, *LOCATION).agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("h3").alias("h3"), least.alias("h2"))
    totals = by_loc.groupBy(*outer).agg(F.sum("g").alias("gt_count"), F.sum("p").alias("pred_count"), least.alias("location_hits"), F.sum("h2").alias("dimension_hits"), F.sum("h3").alias("diagnosis_hits"))
    if by:
        return totals.select("doc_id", *[F.col(f"by_{c}").alias(c) for c in by], "gt_count", "pred_count", *HITS)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return docs.select("doc_id").join(totals, "doc_id", "left").select("doc_id", *map(zero, ("gt_count", "pred_count", *HITS)))


def _group_hits(gt: DataFrame, pred: DataFrame, by: str) -> DataFrame:
    """By document and group (by) of the ground truth: items, and hits of 1, 2 and 3 key fields, as item_recall counts them.

    Items and predictions travel once, to the task of their document and section; there the predictions of each
    key are summed beside the items of every group, and the counts rolled up. Only sums of sections travel on.
    """
    both = gt.select("doc_id", *DIAGNOSIS, F.col(by).alias("by"), F.lit(1).alias("g"), F.lit(0).alias("p")).unionAll(pred.select("doc_id", *DIAGNOSIS, F.lit(None).cast(gt.schema[by].dataType), F.lit(0), F.lit(1)))
    counts = both.repartition("doc_id", *LOCATION).groupBy("doc_id", *DIAGNOSIS, "by").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    all_p = lambda keys: F.sum("p").over(Window.partitionBy("doc_id", *keys))
    items = counts.withColumn("p3", all_p(DIAGNOSIS)).withColumn("p2", all_p(DIMENSION)).withColumn("p1", all_p(LOCATION)).where("g > 0")
    by_dim = items.groupBy("doc_id", *DIMENSION, "by").agg(F.sum("g").alias("g"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum(F.least("g", "p3")).alias("h3"))
    by_loc = by_dim.groupBy("doc_id", *LOCATION, "by").agg(F.sum("g").alias("g"), F.max("p1").alias("p1"), F.sum(F.least("g", "p2")).alias("h2"), F.sum("h3").alias("h3"))
    return by_loc.groupBy("doc_id", "by").agg(F.sum("g").alias("gt_count"), F.sum(F.least("g", "p1")).alias("location_hits"), F.sum("h2").alias("dimension_hits"), F.sum("h3").alias("diagnosis_hits"))


def rate(hits: Column, of: Column) -> Column:
    return F.when(of > 0, hits / of).otherwise(F.lit(0.0))


def misses(gt: Column, hits: Column) -> Column:
    return F.greatest(F.lit(0), gt - hits)


def false_positives(pred: Column, hits: Column) -> Column:
    return F.greatest(F.lit(0), pred - hits)


def mcs(gt: Column, hits: Column) -> Column:
    """Recall, discounted by the exponential of the miss rate."""
    return F.when(gt > 0, hits / gt * F.exp(-MISS_DECAY * misses(gt, hits) / gt)).otherwise(F.lit(0.0))


def noise_penalty(fp: Column) -> Column:
    return F.when(fp > 0, 1 - NOISE_WEIGHT * fp / (fp + NOISE_SCALE)).otherwise(F.lit(1.0))


def derived(recall: DataFrame, digits: bool = True) -> DataFrame:
    """Counts with misses, false positives, rates, mcs, penalty and their product; rates with 4 and metrics with 6 decimals if digits."""
    gt, pred, hits = F.col("gt_count"), F.col("pred_count"), F.col("diagnosis_hits")
    made = recall.withColumns({"miss_count": misses(gt, hits), "fp_count": false_positives(pred, hits), "mcs": mcs(gt, hits)} | {c.replace("hits", "recall"): rate(F.col(c), gt) for c in HITS})
    made = made.withColumn("penalty", noise_penalty(F.col("fp_count")))
    made = made.withColumn("np_mcs", F.col("mcs") * F.col("penalty"))
    return with_digits(made, {c.replace("hits", "recall"): 4 for c in HITS} | dict.fromkeys(("mcs", "penalty", "np_mcs"), 6)) if digits else made


def with_digits(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: rounded(c, n) for c, n in digits.items()})


def corpus_totals(recall: DataFrame) -> DataFrame:
    """Sums over documents, and sums of metrics weighted by ground truth; partial sums add up."""
    d = derived(recall, digits=False)
    w = F.col("gt_count")
    return d.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gt_count", "pred_count", *HITS)], F.coalesce(F.sum(F.col("mcs") * w), F.lit(0.0)).alias("mcs_weight"),
        F.coalesce(F.sum(F.col("penalty") * w), F.lit(0.0)).alias("penalty_weight"), F.coalesce(F.sum(F.col("np_mcs") * w), F.lit(0.0)).alias("np_mcs_weight"), F.count(F.lit(1)).alias("documents"),
    )


def corpus_metrics(recall: DataFrame, digits: bool = True) -> DataFrame:
    """Micro metrics of the totals, and document means weighted by ground truth, with 6 decimals if digits."""
    means = {"doc_weighted_mcs": "mcs_weight", "avg_penalty": "penalty_weight", "doc_weighted_np_mcs": "np_mcs_weight"}
    made = derived(corpus_totals(recall), digits).withColumns({n: rate(F.col(c), F.col("gt_count")) for n, c in means.items()}).drop(*means.values())
    return with_digits(made, dict.fromkeys(means, 6)) if digits else made


def grouped_recall(docs: DataFrame, gt: DataFrame, pred: DataFrame, by: str, digits: bool = True) -> DataFrame:
    """Recall by a column of the ground truth, in order of its value; null is <NULL>. Rates have 4 decimals if digits."""
    sums = _group_hits(gt, pred, by).groupBy(F.coalesce("by", F.lit("<NULL>")).alias("group")).agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("gt_count", *HITS)])
    made = sums.withColumns({c.replace("hits", "recall"): rate(F.col(c), F.col("gt_count")) for c in HITS})
    return (with_digits(made, {c.replace("hits", "recall"): 4 for c in HITS}) if digits else made).orderBy("group")


def group_dimensions(gt: DataFrame) -> DataFrame:
    """Error types with their dimensions in order, joined by commas."""
    return gt.groupBy("error_type").agg(F.array_join(F.array_sort(F.collect_set("dimension")), ",").alias("dimensions"))


def document_hits(docs: DataFrame, gt: DataFrame, pred: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """By document: location and diagnosis contained, and precision: all items described too; all true without items."""
    loc, diag = (contains_all(gt, pred, k).withColumnRenamed("contained", n) for k, n in ((LOCATION, "location_hit"), (DIAGNOSIS, "diagnosis_hit")))
    described = described_matches(gt, pred, judged).groupBy("doc_id").agg(F.bool_and(F.col("matched") >= F.col("items")).alias("described"))
    true = lambda c: F.coalesce(F.col(c), F.lit(True))
    all_ = docs.select("doc_id").join(loc, "doc_id", "left").join(diag, "doc_id", "left").join(described, "doc_id", "left")
    return all_.select("doc_id", (true("diagnosis_hit") & true("described")).alias("precision_hit"), true("location_hit").alias("location_hit"), true("diagnosis_hit").alias("diagnosis_hit"))


def hits_at(recall: DataFrame, most: int = 10) -> DataFrame:
    """By document, whether at least k items are diagnosed, for each k up to most."""
    return recall.select("doc_id", *[(F.col("diagnosis_hits") >= k).alias(f"h{k}") for k in range(1, most + 1)])


def corpus_rates(hits: DataFrame, digits: bool = True) -> DataFrame:
    """Shares of documents, with 4 decimals if digits; 0 without documents."""
    rates = {c: c.replace("hit", "rate") for c in ("precision_hit", "location_hit", "diagnosis_hit")}
    made = hits.agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)).alias(n) for c, n in rates.items()])
    return with_digits(made, dict.fromkeys(rates.values(), 4)) if digits else made


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value in order; null and empty are UNKNOWN."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("UNKNOWN"))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """By reviewer, the number of issues, and by issue type in a map."""
    counts = issues.groupBy("reviewer_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("reviewer_id").agg(F.sum("n").alias("total_issues"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_type", "n")))).alias("by_type"))


def pipeline_totals(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.coalesce(F.sum("total_issues"), F.lit(0)).alias("total_issues"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reviewer_id", "total_issues")))).alias("by_reviewer"))


def usage_delta(before: DataFrame, after: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of after less those of before, never below zero."""
    old = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in counters])
    return after.join(old, keys, "left").select(*keys, *[F.greatest(F.lit(0), F.col(c) - F.coalesce(f"old_{c}", F.lit(0))).alias(c) for c in counters])
