"""Matching of predictions with ground truth, as bags of keys.

Ground truth and predictions are rows of doc_id and key columns. Keys are null-safe: null equals null.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import WS, section_key
from lectern.operators.components import components
from lectern.operators.storage import stored

LOCATION, DIMENSION, DIAGNOSIS = ["section"], ["section", "dimension"], ["section", "dimension", "error_type"]


def keyed(items: DataFrame) -> DataFrame:
    """Items with the comparable form of their section number."""
    return items.withColumn("section", section_key(F.col("section_number")))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & left[c].eqNullSafe(right[c])
    return found


def bag_counts(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key of the ground truth, with how often it is there (g) and predicted (p)."""
    names = ["doc_id", *keys]
    both = gt.select(*names, F.lit(1).alias("g"), F.lit(0).alias("p")).unionAll(pred.select(*names, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return both.groupBy(*names).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def bag_hits(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """By document, the size of the bag intersection."""
    return bag_counts(gt, pred, keys).groupBy("doc_id").agg(F.sum(F.least("g", "p")).alias("hits"))


def bag_intersection(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    return gt.select("doc_id", *keys).intersectAll(pred.select("doc_id", *keys))


def bag_difference(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    return gt.select("doc_id", *keys).exceptAll(pred.select("doc_id", *keys))


def set_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b lacks; null equals null."""
    return a.select(*keys).subtract(b.select(*keys))


def set_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def contains_all(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """By document with predictions or ground truth, whether each key is predicted as often as it is there."""
    return bag_counts(gt, pred, keys).groupBy("doc_id").agg(F.bool_and(F.col("p") >= F.col("g")).alias("contained"))


def best_match(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """For each prediction the item that it marks: the first with its diagnosis, else the first at its section.

    Several predictions may mark one item. Columns: doc_id, pred_index, gt_index (null: none), is_diagnosis.
    Only the first item of a key matters, so items are aggregated by key before they meet predictions.
    """
    by = lambda keys, name: gt.groupBy("doc_id", *keys).agg(F.min("gt_index").alias(name)).toDF(*(f"{name}_{c}" for c in ("doc_id", *keys)), name)
    same = lambda keys, name: reduce(lambda a, c: a & pred[c].eqNullSafe(F.col(f"{name}_{c}")), keys, pred["doc_id"] == F.col(f"{name}_doc_id"))
    found = pred.join(by(DIAGNOSIS, "exact"), same(DIAGNOSIS, "exact"), "left").join(by(LOCATION, "near"), same(LOCATION, "near"), "left")
    return found.select(pred["doc_id"], "pred_index", F.coalesce("exact", "near").alias("gt_index"), F.col("exact").isNotNull().alias("is_diagnosis"))


def section_lookup(sections: DataFrame, last: bool = False) -> DataFrame:
    """One section for each key of a document: the first in order, or the last."""
    row = F.struct("ord", "section_number", "title", "content")
    pick = (F.max if last else F.min)(row).alias("s")
    return sections.withColumn("section", section_key(F.col("section_number"))).groupBy("doc_id", "section").agg(pick).select("doc_id", "section", "s.*")


def hit_sections(gt: DataFrame, pred: DataFrame, sections: DataFrame) -> DataFrame:
    """Items that a prediction diagnoses, with the predictions that do and the section's place and title.

    Ordered within a document by place (10 ** 9 without section) and number in column position.
    """
    names = ["doc_id", *DIAGNOSIS]
    marking = pred.groupBy(*names).agg(F.array_sort(F.collect_list("pred_index")).alias("pred_indexes")).toDF(*(f"p_{c}" for c in names), "pred_indexes")  # once for each key, not for each pair
    same = reduce(lambda a, c: a & gt[c].eqNullSafe(marking[f"p_{c}"]), DIAGNOSIS, gt["doc_id"] == marking["p_doc_id"])
    marks = gt.join(marking, same).select(*[gt[c] for c in names], "gt_index", "pred_indexes")
    known = section_lookup(sections).select(F.col("doc_id").alias("s_doc"), F.col("section").alias("s_key"), "ord", "title")
    placed = marks.join(known, (marks["doc_id"] == known["s_doc"]) & marks["section"].eqNullSafe(known["s_key"]), "left")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("ord", F.lit(10**9)), F.coalesce("section", F.lit("")), "gt_index")
    return placed.select("doc_id", F.row_number().over(order).alias("position"), *DIAGNOSIS, "gt_index", "pred_indexes", "title")


def marked_text(hits: DataFrame) -> DataFrame:
    """By document, a line for each hit section in order."""
    line = F.format_string("[%s] %s | %s/%s | #%s", F.coalesce("section", F.lit("-")), F.coalesce("title", F.lit("")), "dimension", "error_type", F.array_join(F.transform("pred_indexes", lambda i: i.cast("string")), ","))
    rows = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return hits.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("marked"))


def _largest_matching(edges: list[tuple[int, int]], have: list[int], give: list[int]) -> int:
    """Size of the largest one-to-one choice of edges between kinds of which there are have and give.

    Blocking flows: each phase finds the distances from the kinds that are left, and then sends as much as fits
    along shortest ways, trying no edge twice. Copies of a kind go together; phases grow with the root of the kinds.
    """
    near: list[list[int]] = [[] for _ in have]
    for a, b in sorted(set(edges)):
        near[a].append(b)
    left, right, taken, total = list(have), list(give), [{} for _ in give], 0  # taken: by right kind, what each left kind has of it
    while True:
        depth, queue, reached = {a: 0 for a in range(len(have)) if left[a]}, [a for a in range(len(have)) if left[a]], False
        seen: set[int] = set()
        for a in queue:
            for b in near[a]:
                if b not in seen:
                    seen.add(b)
                    reached = reached or right[b] > 0
                    for o, n in taken[b].items():
                        if n and o not in depth:
                            depth[o] = depth[a] + 1
                            queue.append(o)
        if not reached:
            return total
        todo = [[*x] for x in near]
        back: list[dict[int, list[int]]] = [{} for _ in give]
        for start in [a for a in queue if not depth[a]]:
            while left[start]:
                way, a = [], start  # pairs of a left kind and the right kind it goes on by
                while True:
                    if not todo[a]:
                        if not way:
                            break
                        a = way.pop()[0]  # nothing behind: the owner is given up there
                        back[todo[a][-1]][a].pop()
                        if not back[todo[a][-1]][a]:
                            todo[a].pop()
                        continue
                    b = todo[a][-1]
                    if right[b]:
                        way.append((a, b))
                        break
                    owners = back[b].setdefault(a, [o for o, n in taken[b].items() if n and depth.get(o) == depth[a] + 1])
                    while owners and not taken[b].get(owners[-1]):
                        owners.pop()
                    if not owners:
                        todo[a].pop()
                        continue
                    way.append((a, b))
                    a = owners[-1]
                if not way or not right[way[-1][1]]:
                    break
                owners_of = [way[i + 1][0] for i in range(len(way) - 1)]
                flow = min(left[start], right[way[-1][1]], *(taken[b][o] for (_, b), o in zip(way, owners_of, strict=False)))
                for (x, b), o in zip(way, [*owners_of, None], strict=True):
                    taken[b][x] = taken[b].get(x, 0) + flow
                    if o is not None:
                        taken[b][o] -= flow
                left[start] -= flow
                right[way[-1][1]] -= flow
                total += flow


def described_matches(gt: DataFrame, pred: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """By document and diagnosis key, items, predictions and the largest one-to-one match of equal descriptions.

    Descriptions are equal without white space, or where judged (gt_text, pred_text) lists them. Without
    judged the relation is an equivalence, and the match is a bag intersection; else blocking flows find it, in
    each connected component of the edges by itself. Components are told apart by 64-bit hashes.
    """
    names = ["doc_id", *DIAGNOSIS]
    if judged is None:
        plain = F.regexp_replace(F.coalesce(F.col("description"), F.lit("")), f"{WS}+", "").alias("description")
        counts = bag_counts(gt.select(*names, plain), pred.select(*names, plain), [*DIAGNOSIS, "description"])
        shared = F.when(F.col("description") != "", F.least("g", "p")).otherwise(0)
        return counts.groupBy(*names).agg(F.sum("g").alias("items"), F.sum(shared).alias("matched")).where("items > 0")
    bag = lambda df, n: df.groupBy(F.struct(*names).alias("key"), "description").agg(F.count(F.lit(1)).alias(n))
    g, p = stored(bag(gt, "g"), "items"), stored(bag(pred, "p").withColumnRenamed("description", "p_description"), "marks")
    total = g.groupBy("key").agg(F.sum("g").alias("items"))
    plain = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), f"{WS}+", "")
    # Edges by equal keys only: the pairs of a key never meet.
    equal = g.withColumn("text", plain("description")).where("text <> ''").join(p.withColumn("text", plain("p_description")), ["key", "text"]).select("key", "description", "p_description")
    listed = judged.select(F.col("gt_text").alias("description"), F.col("pred_text").alias("p_description")).distinct()
    told = g.join(listed, "description").join(p, ["key", "p_description"]).select("key", "description", "p_description")
    edges = stored(equal.unionByName(told).distinct().withColumns({"u": F.xxhash64("key", F.lit("g"), "description"), "v": F.xxhash64("key", F.lit("p"), "p_description")}), "edges")
    parts = edges.join(components(edges), edges["u"] == F.col("node")).select("key", "component", "description", "p_description")
    sized = parts.join(g, ["key", "description"]).join(p, ["key", "p_description"]).select("component", "key", "description", "p_description", "g", "p")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        left = {d: i for i, d in enumerate(sorted(rows["description"].unique()))}
        right_ = {d: i for i, d in enumerate(sorted(rows["p_description"].unique()))}
        have = rows.drop_duplicates("description").set_index("description")["g"].to_dict()
        give = rows.drop_duplicates("p_description").set_index("p_description")["p"].to_dict()
        links = [(left[a], right_[b]) for a, b in zip(rows["description"], rows["p_description"], strict=True)]
        matched = _largest_matching(links, [have[d] for d in left], [give[d] for d in right_])
        return pd.DataFrame({"component": rows["component"].iloc[:1], "matched": [matched]})

    owner = sized.select("component", "key").distinct()
    solved = sized.groupBy("component").applyInPandas(solve, "component bigint, matched bigint").join(owner, "component").groupBy("key").agg(F.sum("matched").alias("matched"))
    return total.join(solved, "key", "left").select("key.*", "items", F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"))
