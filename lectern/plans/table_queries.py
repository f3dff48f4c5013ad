"""Queries over the supplied tables, each with its SQL.

Orders stand for documents and line items for their findings: section = line number (7 as null), dimension =
return flag, error type = flag and status. Predictions are the items with some dropped, some moved to the
next section and some repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import replies, text
from lectern.functions.numbers import rounded_sql
from lectern.operators import allocation, candidates, matching, metrics, patterns, retrieval, rules, scans, sections, vector_index
from lectern.operators.storage import stored
from lectern.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


ITEM_COLUMNS = ["doc_id", "gt_index", "section_number", "dimension", "error_type", "error_description"]


def bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, ground truth and predictions; gt_index and pred_index follow all of an item's columns."""
    lines = read(spark, sf_dir, "lineitem")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(key)) - 1
    base = lines.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", index.alias("i"), F.col("l_returnflag").alias("dimension"), F.concat("l_returnflag", "l_linestatus").alias("error_type"))
    number = lambda c: F.nullif(c, F.lit(7)).cast("string").alias("section_number")
    gt = base.select("doc_id", F.col("i").alias("gt_index"), number(F.col("l_linenumber")), "dimension", "error_type", F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("description"))
    copies = F.when(F.col("l_partkey") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    moved = F.col("l_linenumber") + (F.col("l_partkey") % 7 == 0).cast("int")
    pred = base.where("l_partkey % 10 <> 0").select("*", F.explode(copies).alias("copy")).select("doc_id", (F.col("i") * 2 + F.col("copy")).alias("pred_index"), number(moved), "dimension", "error_type", F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("description"))
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return docs, matching.keyed(gt), matching.keyed(pred)


_BAGS = """
    base AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS i,
                    l_returnflag AS dimension, l_returnflag || l_linestatus AS error_type FROM lineitem),
    gt AS (SELECT doc_id, i AS gt_index, nullif(l_linenumber, 7)::VARCHAR AS section, dimension, error_type, 'd' || (l_partkey % 3) AS description FROM base),
    pred AS (SELECT doc_id, i * 2 + c AS pred_index, nullif(l_linenumber + (CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END), 7)::VARCHAR AS section, dimension, error_type, 'd' || (l_suppkey % 3) AS description
             FROM base, (VALUES (0), (1)) v(c) WHERE l_partkey % 10 <> 0 AND (c = 0 OR l_partkey % 11 = 0)),
    docs AS (SELECT o_orderkey AS doc_id FROM orders)"""


def _hits(keys: str, name: str, extra: str = "") -> str:
    """SQL of one key set's hits by document."""
    return f"""{name} AS (SELECT g.doc_id, sum(least(g.n, coalesce(p.n, 0))) AS h, bool_and(coalesce(p.n, 0) >= g.n) AS c
        FROM (SELECT doc_id, {keys}, count(*) AS n FROM gt GROUP BY ALL) g LEFT JOIN (SELECT doc_id, {keys}, count(*) AS n FROM pred GROUP BY ALL) p
          ON g.doc_id = p.doc_id AND {' AND '.join(f'g.{k.strip()} IS NOT DISTINCT FROM p.{k.strip()}' for k in keys.split(','))} GROUP BY g.doc_id)"""


_RECALL = f"""{_BAGS}, {_hits('section', 'h1')}, {_hits('section, dimension', 'h2')}, {_hits('section, dimension, error_type', 'h3')},
    recall AS (SELECT doc_id, coalesce(gn, 0)::BIGINT AS gt_count, coalesce(pn, 0)::BIGINT AS pred_count, coalesce(h1.h, 0)::BIGINT AS location_hits, coalesce(h2.h, 0)::BIGINT AS dimension_hits, coalesce(h3.h, 0)::BIGINT AS diagnosis_hits
        FROM docs LEFT JOIN (SELECT doc_id, count(*) AS gn FROM gt GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS pn FROM pred GROUP BY 1) USING (doc_id)
        LEFT JOIN h1 USING (doc_id) LEFT JOIN h2 USING (doc_id) LEFT JOIN h3 USING (doc_id)),
    metric AS (SELECT *, greatest(0, gt_count - diagnosis_hits) AS miss_count, greatest(0, pred_count - diagnosis_hits) AS fp_count,
        CASE WHEN gt_count > 0 THEN diagnosis_hits / gt_count::DOUBLE * exp(-1.0 * greatest(0, gt_count - diagnosis_hits) / gt_count) ELSE 0 END AS mcs,
        CASE WHEN pred_count > diagnosis_hits THEN 1 - 0.15::DOUBLE * (pred_count - diagnosis_hits) / (pred_count - diagnosis_hits + 100) ELSE 1.0 END AS penalty FROM recall)"""


def _round(x: str, digits: int) -> str:
    return rounded_sql(x, digits, "HUGEINT", "//")


@query(f"WITH {_BAGS}, {_hits('section, dimension, error_type', 'h3')} SELECT doc_id, h::BIGINT AS hits FROM h3")
def jn1_bag_equi_join(spark, sf_dir):
    """JN1: size of the bag intersection by document, counted with null-safe keys."""
    _, gt, pred = bags(spark, sf_dir)
    held = gt.select("doc_id").distinct()
    return matching.bag_hits(gt, pred, matching.DIAGNOSIS).join(held, "doc_id", "left_semi")


@query(f"WITH {_BAGS} SELECT doc_id, section, dimension, error_type, count(*) AS n FROM (SELECT doc_id, section, dimension, error_type FROM gt INTERSECT ALL SELECT doc_id, section, dimension, error_type FROM pred) GROUP BY ALL")
def st5_bag_intersection(spark, sf_dir):
    """ST5: the bag intersection itself."""
    _, gt, pred = bags(spark, sf_dir)
    return matching.bag_intersection(gt, pred, matching.DIAGNOSIS).groupBy("doc_id", *matching.DIAGNOSIS).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BAGS} SELECT doc_id, section, dimension, error_type, count(*) AS n FROM (SELECT doc_id, section, dimension, error_type FROM gt EXCEPT ALL SELECT doc_id, section, dimension, error_type FROM pred) GROUP BY ALL")
def st6_bag_difference(spark, sf_dir):
    """ST6: items that no prediction accounts for."""
    _, gt, pred = bags(spark, sf_dir)
    return matching.bag_difference(gt, pred, matching.DIAGNOSIS).groupBy("doc_id", *matching.DIAGNOSIS).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BAGS}, {_hits('section', 'h1')} SELECT doc_id, c AS contained FROM h1")
def jn2_bag_containment(spark, sf_dir):
    """JN2: whether all sections of a document's items are predicted often enough."""
    _, gt, pred = bags(spark, sf_dir)
    return matching.contains_all(gt, pred, matching.LOCATION).join(gt.select("doc_id").distinct(), "doc_id", "left_semi")


@query(f"""WITH {_BAGS}, g AS (SELECT doc_id, section, dimension, error_type, description, count(*) AS n FROM gt GROUP BY ALL), p AS (SELECT doc_id, section, dimension, error_type, description, count(*) AS n FROM pred GROUP BY ALL)
    SELECT g.doc_id, g.section, g.dimension, g.error_type, sum(g.n)::BIGINT AS items, sum(least(g.n, coalesce(p.n, 0)))::BIGINT AS matched FROM g LEFT JOIN p
      ON g.doc_id = p.doc_id AND g.section IS NOT DISTINCT FROM p.section AND g.dimension = p.dimension AND g.error_type = p.error_type AND g.description = p.description GROUP BY ALL""")
def jn3_described_matches(spark, sf_dir):
    """JN3: largest one-to-one match of equal descriptions within a diagnosis key."""
    _, gt, pred = bags(spark, sf_dir)
    return matching.described_matches(gt, pred)


@query(f"""WITH {_BAGS}, m AS (SELECT p.doc_id, p.pred_index, g.gt_index, (p.dimension IS NOT DISTINCT FROM g.dimension AND p.error_type IS NOT DISTINCT FROM g.error_type) AS d
      FROM pred p LEFT JOIN gt g ON p.doc_id = g.doc_id AND p.section IS NOT DISTINCT FROM g.section),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pred_index ORDER BY NOT d, gt_index) AS k FROM m)
    SELECT doc_id, pred_index, gt_index, (gt_index IS NOT NULL AND d) AS is_diagnosis FROM r WHERE k = 1""")
def jn4_best_match(spark, sf_dir):
    """JN4: the item that each prediction marks, diagnosis before location."""
    _, gt, pred = bags(spark, sf_dir)
    return matching.best_match(gt, pred).withColumns({c: F.col(c).cast("bigint") for c in ("pred_index", "gt_index")})


@query(f"WITH {_RECALL} SELECT * FROM recall")
def ag1_item_recall(spark, sf_dir):
    """AG1: counts and hits of 1, 2 and 3 key fields by document."""
    return metrics.item_recall(*bags(spark, sf_dir))


@query(f"""WITH {_RECALL}, m AS (SELECT *, CASE WHEN gt_count > 0 THEN location_hits / gt_count::DOUBLE ELSE 0.0::DOUBLE END AS l, CASE WHEN gt_count > 0 THEN diagnosis_hits / gt_count::DOUBLE ELSE 0.0::DOUBLE END AS d, mcs::DOUBLE AS a, penalty::DOUBLE AS b, mcs::DOUBLE * penalty::DOUBLE AS c FROM metric)
    SELECT doc_id, miss_count::BIGINT AS miss_count, fp_count::BIGINT AS fp_count, {_round('l', 4)} AS location_recall, {_round('d', 4)} AS diagnosis_recall, {_round('a', 6)} AS mcs, {_round('b', 6)} AS penalty, {_round('c', 6)} AS np_mcs FROM m""")
def ag6_derived_metrics(spark, sf_dir):
    """AG2 to AG6: rates (4 decimals), misses, false positives, MCS, noise penalty and their product (6 decimals) by document."""
    made = metrics.derived(metrics.item_recall(*bags(spark, sf_dir)))
    return made.select("doc_id", F.col("miss_count").cast("bigint"), F.col("fp_count").cast("bigint"), "location_recall", "diagnosis_recall", "mcs", "penalty", "np_mcs")


@query(f"""WITH {_RECALL}, m AS (SELECT doc_id, {', '.join(f"CASE WHEN gt_count > 0 THEN {c}_hits / gt_count::DOUBLE ELSE 0.0::DOUBLE END AS {c[0]}" for c in ('location', 'dimension'))}, CASE WHEN gt_count > 0 THEN diagnosis_hits / gt_count::DOUBLE ELSE 0.0::DOUBLE END AS g FROM metric)
    SELECT doc_id, {_round('l', 4)} AS location_recall, {_round('d', 4)} AS dimension_recall, {_round('g', 4)} AS diagnosis_recall FROM m""")
def ag2_recall_rates(spark, sf_dir):
    """AG2: rates of each document with 4 decimals."""
    return metrics.derived(metrics.item_recall(*bags(spark, sf_dir))).select("doc_id", "location_recall", "dimension_recall", "diagnosis_recall")


@query(f"""WITH {_RECALL} SELECT sum(gt_count)::BIGINT AS gt_count, sum(diagnosis_hits)::BIGINT AS diagnosis_hits, count(*) AS documents,
    round(sum(mcs * gt_count), 3) AS mcs_weight, round(sum(penalty * gt_count), 3) AS penalty_weight, round(sum(mcs * penalty * gt_count), 3) AS np_mcs_weight FROM metric""")
def ag7_weighted_sums(spark, sf_dir):
    """AG7: sums that add up over partitions, weighted by ground truth."""
    t = metrics.corpus_totals(metrics.item_recall(*bags(spark, sf_dir)))
    return t.select("gt_count", "diagnosis_hits", "documents", *[F.round(c, 3).alias(c) for c in ("mcs_weight", "penalty_weight", "np_mcs_weight")])


@query(f"""WITH {_RECALL}, t AS (SELECT sum(gt_count)::BIGINT AS g, sum(pred_count)::BIGINT AS p, sum(location_hits)::BIGINT AS l, sum(dimension_hits)::BIGINT AS m, sum(diagnosis_hits)::BIGINT AS d, count(*) AS documents,
      sum(mcs * gt_count) AS a, sum(penalty * gt_count) AS b, sum(mcs * penalty * gt_count) AS c FROM metric),
    u AS (SELECT *, d / g::DOUBLE * exp(-1.0 * (g - d) / g) AS mcs, CASE WHEN p > d THEN 1 - 0.15::DOUBLE * (p - d) / (p - d + 100) ELSE 1.0 END AS penalty FROM t)
    SELECT g AS gt_count, p AS pred_count, l AS location_hits, m AS dimension_hits, d AS diagnosis_hits, documents, (g - d)::BIGINT AS miss_count, greatest(0, p - d)::BIGINT AS fp_count,
      {_round('mcs', 6)} AS mcs, {_round('penalty::DOUBLE', 6)} AS penalty, {_round('(mcs * penalty::DOUBLE)', 6)} AS np_mcs, {_round('(l / g::DOUBLE)', 4)} AS location_recall, {_round('(m / g::DOUBLE)', 4)} AS dimension_recall, {_round('(d / g::DOUBLE)', 4)} AS diagnosis_recall,
      {_round('(a / g::DOUBLE)', 6)} AS doc_weighted_mcs, {_round('(b / g::DOUBLE)', 6)} AS avg_penalty, {_round('(c / g::DOUBLE)', 6)} AS doc_weighted_np_mcs FROM u""")
def ag8_corpus_metrics(spark, sf_dir):
    """AG8: the headline numbers: micro metrics and means of documents weighted by ground truth."""
    m = metrics.corpus_metrics(metrics.item_recall(*bags(spark, sf_dir)))
    return m.withColumns({c: F.col(c).cast("bigint") for c in ("miss_count", "fp_count")})


def _grouped_sql(by: str) -> str:
    """Each group's items against all predictions of their documents."""

    def hits(keys: list[str], name: str) -> str:
        of = ", ".join(dict.fromkeys(["doc_id", *keys, by]))
        same = " AND ".join(f"g.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
        return f"""{name} AS (SELECT g.{by} AS grp, sum(least(g.n, coalesce(p.n, 0))) AS h FROM (SELECT {of}, count(*) AS n FROM gt GROUP BY ALL) g
            LEFT JOIN (SELECT doc_id, {', '.join(keys)}, count(*) AS n FROM pred GROUP BY ALL) p ON g.doc_id = p.doc_id AND {same} GROUP BY 1)"""

    sets = [hits(k, f"x{i}") for i, k in enumerate((matching.LOCATION, matching.DIMENSION, matching.DIAGNOSIS))]
    return f"""WITH {_BAGS}, {', '.join(sets)}
    SELECT "group", documents, gt_count, x0.h::BIGINT AS location_hits, x1.h::BIGINT AS dimension_hits, x2.h::BIGINT AS diagnosis_hits, {_round('(x0.h / gt_count::DOUBLE)', 4)} AS location_recall, {_round('(x1.h / gt_count::DOUBLE)', 4)} AS dimension_recall, {_round('(x2.h / gt_count::DOUBLE)', 4)} AS diagnosis_recall
    FROM (SELECT {by} AS "group", count(DISTINCT doc_id) AS documents, count(*) AS gt_count FROM gt GROUP BY 1) t JOIN x0 ON "group" = x0.grp JOIN x1 ON "group" = x1.grp JOIN x2 ON "group" = x2.grp"""


def _grouped_query(spark, sf_dir, by):
    return metrics.grouped_recall(*bags(spark, sf_dir), by)


@query(_grouped_sql("dimension"))
def ag9_recall_by_dimension(spark, sf_dir):
    """AG9: recall by dimension; location hits of groups are not exclusive."""
    return _grouped_query(spark, sf_dir, "dimension")


@query(_grouped_sql("error_type"))
def ag9_recall_by_error_type(spark, sf_dir):
    """AG9: recall by error type."""
    return _grouped_query(spark, sf_dir, "error_type")


@query(f"WITH {_BAGS} SELECT error_type, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions FROM gt GROUP BY 1")
def ag10_group_dimensions(spark, sf_dir):
    """AG10: dimensions of each error type."""
    return metrics.group_dimensions(bags(spark, sf_dir)[1])


_DOC_HITS = f"""{_BAGS}, {_hits('section', 'h1')}, {_hits('section, dimension, error_type', 'h3')},
    g AS (SELECT doc_id, section, dimension, error_type, description, count(*) AS n FROM gt GROUP BY ALL), p AS (SELECT doc_id, section, dimension, error_type, description, count(*) AS n FROM pred GROUP BY ALL),
    x AS (SELECT g.doc_id, bool_and(coalesce(p.n, 0) >= g.n) AS c FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.section IS NOT DISTINCT FROM p.section AND g.dimension = p.dimension AND g.error_type = p.error_type AND g.description = p.description GROUP BY 1),
    hit AS (SELECT docs.doc_id, coalesce(h3.c, true) AND coalesce(x.c, true) AS precision_hit, coalesce(h1.c, true) AS location_hit, coalesce(h3.c, true) AS diagnosis_hit FROM docs LEFT JOIN h1 USING (doc_id) LEFT JOIN h3 USING (doc_id) LEFT JOIN x USING (doc_id))"""


@query(f"WITH {_DOC_HITS} SELECT * FROM hit")
def ag11_document_hits(spark, sf_dir):
    """AG11: whether a document's items are all located, diagnosed and described; true without items."""
    return metrics.document_hits(*bags(spark, sf_dir))


@query(f"WITH {_RECALL} SELECT doc_id, {', '.join(f'diagnosis_hits >= {k} AS h{k}' for k in range(1, 11))} FROM recall")
def ag12_hits_at_k(spark, sf_dir):
    """AG12: at least k diagnosed items, k from 1 to 10."""
    return metrics.hits_at(metrics.item_recall(*bags(spark, sf_dir)))


@query(f"WITH {_DOC_HITS}, r AS (SELECT count(*) AS documents, avg(precision_hit::INT) AS p, avg(location_hit::INT) AS l, avg(diagnosis_hit::INT) AS d FROM hit) SELECT documents, {_round('p', 4)} AS precision_rate, {_round('l', 4)} AS location_rate, {_round('d', 4)} AS diagnosis_rate FROM r")
def ag13_corpus_rates(spark, sf_dir):
    """AG13: shares of documents with 4 decimals."""
    return metrics.corpus_rates(metrics.document_hits(*bags(spark, sf_dir)))


@query("SELECT coalesce(nullif(event_type, ''), 'UNKNOWN') AS value, count(*) AS n FROM events GROUP BY 1")
def ag14_histogram(spark, sf_dir):
    """AG14: rows by type."""
    return metrics.histogram(read(spark, sf_dir, "events"), "event_type")


@query("SELECT user_id % 7 AS reviewer_id, sum(n)::BIGINT AS total_issues, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type FROM (SELECT user_id % 7 AS user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def ag15_issue_summary(spark, sf_dir):
    """AG15: issues of each reviewer in all and by type."""
    issues = read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("reviewer_id"), F.col("event_type").alias("issue_type"))
    shown = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return metrics.issue_summary(issues).select("reviewer_id", "total_issues", shown.alias("by_type"))


@query("SELECT sum(n)::BIGINT AS total_issues, string_agg(r || ':' || n, ',' ORDER BY r) AS by_reviewer FROM (SELECT user_id % 7 AS r, count(*) AS n FROM events GROUP BY 1)")
def ag16_pipeline_totals(spark, sf_dir):
    """AG16: issues of all reviewers."""
    issues = read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("reviewer_id"), F.col("event_type").alias("issue_type"))
    t = metrics.pipeline_totals(metrics.issue_summary(issues))
    return t.select("total_issues", F.array_join(F.transform(F.map_entries("by_reviewer"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("by_reviewer"))


@query("SELECT a.user_id, greatest(0, a.n - coalesce(b.n, 0))::BIGINT AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1) b USING (user_id)")
def ag17_usage_delta(spark, sf_dir):
    """AG17: counters less an earlier snapshot's."""
    e = read(spark, sf_dir, "events")
    count = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.usage_delta(count(e.where("event_id % 3 = 0")), count(e), ["user_id"], ["n"]).withColumn("n", F.col("n").cast("bigint"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn, role, text) AS joined FROM conversations GROUP BY 1")
def ag19_ordered_concat(spark, sf_dir):
    """AG19: parts of a document joined in order."""
    part = F.concat_ws(":", "role", F.length("text").cast("string"))
    return sections.ordered_concat(read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], part, " ", "joined")


@query("WITH c AS (SELECT conv_id AS doc_id, turn AS ord, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations) SELECT doc_id, ord, running::BIGINT AS running FROM c WHERE running <= 2000")
def ag20_budgeted_prefix(spark, sf_dir):
    """AG20: leading turns within a budget of code points."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("text").alias("content"))
    return sections.budgeted(c, 2000).select("doc_id", "ord", F.col("running").cast("bigint").alias("running"))


@query(f"WITH {_BAGS} SELECT doc_id, section, dimension, error_type, min(pred_index)::BIGINT AS pred_index FROM pred GROUP BY ALL")
def wn2_keep_first(spark, sf_dir):
    """WN2: the first finding of each document, dimension, type and section."""
    _, _, pred = bags(spark, sf_dir)
    return candidates.first_of_key(pred, ["pred_index"]).select("doc_id", "section", "dimension", "error_type", F.col("pred_index").cast("bigint").alias("pred_index"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
    h AS (SELECT *, sum(CASE WHEN length(trim(line)) BETWEEN 1 AND 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM l)
    SELECT doc_id, sid::BIGINT AS sid, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM h WHERE sid > 0 GROUP BY 1, 2""")
def wn1_islands(spark, sf_dir):
    """WN1: lines attached to the short line before them."""
    rows = scans.in_parts(read(spark, sf_dir, "documents"), "text", "\n")
    marked = sections.islands(rows, F.length(F.trim("line")).between(1, 40))
    return marked.groupBy("doc_id", "sid").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("""WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber, l_suppkey, l_quantity) AS ord FROM lineitem),
    w AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM o) SELECT doc_id, ord, before || ' t' AS prev, n || ' t' AS curr FROM w WHERE n <= before""")
def wn5_monotone_numbers(spark, sf_dir):
    """WN5: top-level numbers that do not grow from heading to heading."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("bigint").alias("ord"), F.col("l_linenumber").cast("string").alias("section_number"), F.lit("t").alias("title"))
    return rules.order_issues(h).where("kind = 'sequence'").select("doc_id", "ord", "prev", "curr")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, min(l_linenumber) AS a, max(l_linenumber) AS b, list(DISTINCT l_linenumber) AS have FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1),
    g AS (SELECT doc_id, unnest(range(a, b + 1)) AS n, have FROM s) SELECT doc_id, string_agg('3.' || n, ', ' ORDER BY n) AS missing FROM g WHERE NOT list_contains(have, n::INT) GROUP BY 1""")
def wn6_number_gaps(spark, sf_dir):
    """WN6: term numbers missing between the least and the greatest."""
    terms = read(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("3."), F.col("l_linenumber").cast("string")).alias("section_number"))
    return rules.number_gaps(terms).select("doc_id", "missing")


_LINES = "l AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))"


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, pos, last_value(CASE WHEN length(trim(line)) BETWEEN 1 AND 40 THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS head FROM l)
    SELECT doc_id, head, count(*) AS n_lines, min(pos)::BIGINT AS first_line, max(pos)::BIGINT AS last_line FROM c GROUP BY 1, 2""")
def wn7_running_heads(spark, sf_dir):
    """WN7: the last short line above each line, over documents in parts."""
    rows = scans.in_parts(read(spark, sf_dir, "documents"), "text", "\n")
    head = F.when(F.length(F.trim("line")).between(1, 40), F.trim("line"))
    run = scans.scanned(rows, "pos", head=(scans.LATEST, head))
    return run.groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("n_lines"), F.min("pos").cast("bigint").alias("first_line"), F.max("pos").cast("bigint").alias("last_line"))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, pos, CASE WHEN length(line) < 40 THEN true WHEN length(line) >= 60 THEN false END AS on_, line FROM l),
    c AS (SELECT *, coalesce(last_value(on_ IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS skipping FROM s)
    SELECT doc_id, count(*) AS kept, sum(pos)::BIGINT AS places FROM c WHERE NOT skipping GROUP BY 1""")
def wn12_contents_skip(spark, sf_dir):
    """WN12: lines outside contents tables, where short lines stand for a contents heading and long ones for the next heading."""
    rows = scans.in_parts(read(spark, sf_dir, "documents"), "text", "\n")
    marked = rows.withColumn("line", F.when(F.length("line") < 40, "目次").when(F.length("line") >= 60, "1 范围").otherwise("行"))
    return sections.without_contents_table(marked).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("places"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events")
def wn7_carry_forward(spark, sf_dir):
    """WN7: the last value so far."""
    e = read(spark, sf_dir, "events").withColumn("c", F.when(F.col("event_type") == "click", F.col("event_id")))
    return e.select("event_id", sections.carried("c", ["user_id"], ["ts", "event_id"]).alias("last_click"))


@query("""WITH w AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block, value FROM events)
    SELECT user_id, block::BIGINT AS block, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, bool_or(value > 100) AS any_large FROM w WHERE block > 0 GROUP BY 1, 2""")
def wn10_blocks(spark, sf_dir):
    """WN10: blocks that a marked row opens, with their extent."""
    e = read(spark, sf_dir, "events").withColumns({"doc_id": F.col("user_id"), "pos": F.struct("ts", "event_id")})
    b = sections.islands(e, F.col("event_type") == "click")
    return b.groupBy("user_id", F.col("sid").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.bool_or(F.col("value") > 100).alias("any_large"))


@query("SELECT conv_id, turn, rank, floor((rank - 1) / 2)::INT AS batch FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank FROM conversations)")
def wn14_batches(spark, sf_dir):
    """WN14: batches of two turns in order."""
    d = sections.batches(read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], 2)
    return d.select("conv_id", "turn", F.col("rank").cast("bigint").alias("rank"), "batch")


@query("""WITH c AS (SELECT s_suppkey, s_nationkey || '.' || (s_suppkey % 7) || '.' || s_suppkey AS key FROM supplier),
    u AS (SELECT s_suppkey, k, array_to_string(string_split(key, '.')[1:3 - k], '.') AS parent FROM c, (VALUES (1), (2)) v(k)) SELECT s_suppkey, k, parent FROM u""")
def jn12_ancestors(spark, sf_dir):
    """JN12: ancestors of dotted keys, nearest first."""
    key = F.concat_ws(".", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 7).cast("string"), F.col("s_suppkey").cast("string"))
    up = read(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(candidates.ancestors(key)).alias("k", "parent"))
    return up.where("parent is not null").select("s_suppkey", (F.col("k") + 1).alias("k"), "parent")


@query("""WITH c AS (SELECT (s_nationkey || '.' || s_suppkey % 3) AS parent, s_suppkey, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey) AS child_rank FROM supplier)
    SELECT parent, parent || '.' || s_suppkey AS child, child_rank FROM c WHERE child_rank <= 5""")
def jn13_children(spark, sf_dir):
    """JN13: the first five direct children of each dotted key."""
    number = F.concat_ws(".", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 3).cast("string"), F.col("s_suppkey").cast("string"))
    rows = read(spark, sf_dir, "supplier").select(F.lit("d").alias("doc_id"), F.col("s_suppkey").alias("ord"), number.alias("section_number"))
    return candidates.parent_keys(rows).where("child_rank <= 5").select("parent", "child", F.col("child_rank").cast("bigint").alias("child_rank"))


def _cited(spark, sf_dir):
    """Orders as documents: lines up to number 2 are the list of references, the others cite; parts are the standards."""
    cited = F.concat(F.lit("GB/T "), (F.col("l_partkey") % 5 + 1).cast("string"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") <= 2).alias("listed"), "l_linenumber", cited.alias("ref"))
    part = rows.repartition("doc_id").groupBy("doc_id", "listed").agg(F.array_join(F.array_sort(F.collect_list("ref")), "\n").alias("content"))
    return part.select("doc_id", F.when(F.col("listed"), 0).otherwise(1).alias("ord"), F.when(F.col("listed"), "2").otherwise("5").alias("section_number"), F.when(F.col("listed"), "规范性引用文件").otherwise("要求").alias("title"), "content")


_CITED = """WITH r AS (SELECT l_orderkey AS doc_id, 'GB/T' || (l_partkey % 5 + 1) AS name, bool_or(l_linenumber <= 2) AS in_list, bool_or(l_linenumber > 2) AS in_body FROM lineitem GROUP BY 1, 2),
    h AS (SELECT l_orderkey AS doc_id, bool_or(l_linenumber <= 2) AS has_list FROM lineitem GROUP BY 1)"""


@query(f"{_CITED} SELECT doc_id, name, '5' AS section_number FROM r WHERE in_body AND NOT in_list")
def jn8_missing_references(spark, sf_dir):
    """JN8: cited, not listed."""
    return rules.reference_findings(_cited(spark, sf_dir)).where("error_type = 'E-R-01'").select("doc_id", "name", "section_number")


@query(f"{_CITED} SELECT doc_id, name, '2' AS section_number FROM r WHERE in_list AND NOT in_body")
def jn9_redundant_references(spark, sf_dir):
    """JN9: listed, not cited."""
    return rules.reference_findings(_cited(spark, sf_dir)).where("error_type = 'E-R-02'").select("doc_id", "name", "section_number")


@query("""WITH p AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS pattern FROM benchmark), w AS (SELECT * FROM p WHERE length(pattern) >= 12)
    SELECT d.doc_id, w.pattern AS phrase, instr(d.text, w.pattern) AS first FROM documents d JOIN w ON contains(d.text, w.pattern)""")
def jn11_benchmark_phrases(spark, sf_dir):
    """JN11: every line of the benchmark texts in every document, by one automaton."""
    lines = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("pattern")).where(F.length("pattern") >= 12).distinct()
    hits = patterns.pattern_hits(read(spark, sf_dir, "documents"), lines.withColumn("pattern_id", F.col("pattern")))
    return hits.select("doc_id", F.col("pattern_id").alias("phrase"), "first")


@query(r"""WITH c AS (SELECT conv_id, turn, text FROM conversations), w AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[a-z]{3,5}'))) AS term FROM c WHERE turn = 0),
    t AS (SELECT * FROM (SELECT conv_id, term, row_number() OVER (PARTITION BY conv_id ORDER BY term) AS rank FROM w) WHERE rank <= 4)
    SELECT t.conv_id AS doc_id, t.term, count(c.turn) AS used_count FROM t LEFT JOIN c ON c.conv_id = t.conv_id AND contains('t' || chr(10) || coalesce(c.text, ''), t.term) GROUP BY ALL""")
def jn11_term_usage(spark, sf_dir):
    """JN11: turns of a conversation that hold each of four strings of its first turn, anywhere in a word."""
    c = read(spark, sf_dir, "conversations")
    words = c.where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,5}"), F.lit(0)))).alias("term")).distinct()
    terms = words.withColumns({"rank": F.row_number().over(Window.partitionBy("doc_id").orderBy("term")), "section_number": F.lit("3.1")}).where("rank <= 4")
    turns = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.lit("5").alias("section_number"), F.lit("t").alias("title"), F.col("text").alias("content"))
    return rules.term_usage(terms, turns).select("doc_id", "term", "used_count")


@query("SELECT count(*) AS queries, 5 * count(*) AS answers, true AS recall_met FROM embeddings WHERE vec_id % 20 = 0")
def tk2_indexed_top_k(spark, sf_dir):
    """TK2: the five nearest vectors of each query through the index of every row; at least nine tenths of tk2_vector_top_k's are among them."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    quantiser = vector_index.fit(e)
    found = stored(vector_index.search(vector_index.build(e, quantiser), e, quantiser, queries, 5, probes=quantiser.probes(0.95), rerank=20), "found")
    met = vector_index.recall(found, retrieval.top_k(queries, e, 5)) >= 0.9
    return found.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("answers")).withColumn("recall_met", F.lit(met))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
    d AS (SELECT query_id, vec_id AS id, label, 1 - list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS distance FROM embeddings, q)
    SELECT query_id, id, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5""")
def tk2_vector_top_k(spark, sf_dir):
    """TK2: the five nearest vectors of each query (ids divisible by 20), exactly."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    found = retrieval.top_k(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), e, 5)
    return found.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
    d AS (SELECT query_id, vec_id AS id, label, 1 - list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS distance FROM embeddings, q)
    SELECT query_id, label::VARCHAR AS label, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, id) AS rank FROM d) WHERE rank <= 2""")
def tk3_top_k_by_group(spark, sf_dir):
    """TK3: the two nearest vectors of each group."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return retrieval.top_k(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), e, 2, group="label").select("query_id", "label", "id", "rank")


@query("""WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderstatus AS dimension, o_totalprice / 1000000::DOUBLE AS confidence FROM orders WHERE o_orderkey % 9 <> 0)
    SELECT doc_id, dimension, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, dimension ORDER BY confidence DESC, ord) AS rank FROM i WHERE confidence >= 0.01) WHERE rank <= 3""")
def tk1_top_confident(spark, sf_dir):
    """TK1: the three most confident findings of each document and dimension above a bound, without those found directly."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("dimension"), F.lit("E").alias("error_type"), F.col("o_orderkey").cast("string").alias("section_number"), (F.col("o_totalprice") / 1000000.0).cast("string").alias("confidence"))
    found = candidates.supplements(o, o.where("ord % 9 = 0"), 3, 0.01)
    return found.select("doc_id", "dimension", "ord", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT event_type AS error_type, (json_extract(props, '$.k')::BIGINT % 3)::VARCHAR AS section_number, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL")
def fj1_json_members(spark, sf_dir):
    """FJ1: items of replies in a fence, after a thought, or skipped as null."""
    k = F.regexp_extract("props", r"\d+", 0).cast("bigint") % 3
    item = F.to_json(F.struct(F.col("event_type").alias("error_type"), k.cast("string").alias("section_number")))
    reply = F.when(F.col("event_id") % 5 == 0, "null").when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n[3, "), item, F.lit("]\n```"))).otherwise(F.concat(F.lit("<think>[1]</think>the list: ["), item, F.lit("] done")))
    return read(spark, sf_dir, "events").select(F.explode(replies.items(reply)).alias("i")).groupBy("i.error_type", "i.section_number").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n, row_number() OVER (ORDER BY n)::BIGINT AS rank FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def tk7_least_used(spark, sf_dir):
    """TK7: types by use, least first; ties are drawn, so only counts are compared."""
    n = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
    return allocation.least_used(n.select("error_type"), n, 3).select("n", F.col("rank").cast("bigint").alias("rank"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[。；;！？!?' || chr(10) || ']+')) AS raw FROM documents), t AS (SELECT doc_id, trim(regexp_replace(raw, '[\s\x{3000}\x{00A0}]+', ' ', 'g')) AS sentence FROM s)
    SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars FROM t WHERE length(sentence) >= 6 AND regexp_matches(lower(sentence), 'the|les|der|los') GROUP BY 1""")
def wn3_word_sentences(spark, sf_dir):
    """WN3, FS6: sentences that hold one of a list of strings."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence")).where(text.has_any(F.lower("sentence"), ["the", "les", "der", "los"]))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query("""SELECT doc_id, n FROM (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_quantity <= CASE l_linenumber % 5 WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 5 ELSE 4 END AND l_quantity >= 1 GROUP BY 1)""")
def pf5_semi_join(spark, sf_dir):
    """PF5: findings whose type belongs to their dimension."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    kind = F.concat(pick("E-S-0", "E-SC-0", "E-T-0", "E-TM-0", "E-R-0"), F.col("l_quantity").cast("int").cast("string"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), pick("C2.1", "C2.2", "C3.1", "C3.2", "C3.3").alias("dimension"), kind.alias("error_type"))
    return candidates.valid(items).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[\s#]+', ' ', 'g')) AS text FROM conversations)
    SELECT conv_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS ord, (turn + 1)::VARCHAR AS section_number, role AS title, text AS content FROM t""")
def io14_page_headings(spark, sf_dir):
    """IO14: conversations as Markdown, a numbered heading for each turn, parsed to sections again."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s#]+", " "))
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", "role", plain.alias("text"))
    part = F.concat(F.lit("## "), (F.col("turn") + 1).cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"))
    made = files.sections_of_markdown(sections.ordered_concat(c, "doc_id", ["turn", "role", "text"], part, "\n", "markdown"))
    return made.select("doc_id", F.col("ord").cast("int").alias("ord"), "section_number", "title", "content")


@query("""SELECT source_agent, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT 'clean' AS source_agent, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT 'poor', doc_id FROM labels WHERE quality = 0) GROUP BY 1""")
def st1_tagged_union(spark, sf_dir):
    """ST1, PF18: streams in one bag with their names."""
    l = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    u = candidates.union_streams({"clean": l.where("quality = 1"), "toxic": l.where("toxic = 1"), "poor": l.where("quality = 0")})
    return u.groupBy("source_agent").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def _keys(spark, sf_dir):
    return read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k"), read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")


@query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier")
def st4_set_intersection(spark, sf_dir):
    """ST4: keys on both sides."""
    return matching.set_intersection(*_keys(spark, sf_dir), ["k"])


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def st3_set_difference(spark, sf_dir):
    """ST3: keys of one side only."""
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "k")
    return matching.set_difference(lines, lines.where("l_quantity > 45"), ["k"])


@query("SELECT DISTINCT n_nationkey AS k FROM (SELECT c_nationkey AS n_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def st2_set_union(spark, sf_dir):
    """ST2: keys of either side."""
    return matching.set_union(*_keys(spark, sf_dir), ["k"])


@query("""WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first, o_orderstatus = 'F' AS is_body FROM orders)
    SELECT a.doc_id, a.first, max(b.first) AS contents_first FROM o a LEFT JOIN o b ON a.doc_id = b.doc_id AND NOT b.is_body AND b.first < a.first WHERE a.is_body GROUP BY 1, 2""")
def jn19_latest_before(spark, sf_dir):
    """JN19: the latest earlier block of the same number without a body (as-of)."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint")
    blocks = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("1").alias("number"), place.alias("first"), (F.col("o_orderstatus") == "F").alias("is_body"))
    return sections.contents_block(blocks).select("doc_id", "first", "contents_first")