"""Running values over the lines of long documents: scans within parts, and summaries of parts composed in a tree.

A window over a whole document puts all its lines into one task. Here a document is cut into parts of PART lines
that different tasks take. A part's summary says what it does to a running value (how much it adds, or to what it
last sets it); summaries of FAN parts are composed to one of the next level, LEVELS times, and the way back down
gives each part the value that it starts from. Only summaries of documents of several parts are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Lines of a part, as a power of two; parts of a node, as one; levels above the parts.
PART, FAN, LEVELS = 12, 8, 2


@dataclass(frozen=True)
class Fold:
    """A running value: over a window, as the summary of ordered rows, and after an earlier value."""

    over: Callable[[str, WindowSpec], Column]
    total: Callable[[str, str], Column]
    after: Callable[[Column, Column], Column]


#: The sum so far, and the last value so far that is not null (the state of a machine that each value resets).
ADDED = Fold(lambda c, w: F.sum(c).over(w), lambda c, order: F.sum(c), lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)))
LATEST = Fold(lambda c, w: F.last(c, ignorenulls=True).over(w), lambda c, order: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))), lambda before, own: F.coalesce(own, before))


def in_parts(docs: DataFrame, text: str, pattern: str, part: int | None = None) -> DataFrame:
    """doc_id, pos and line of each line of a text, with the part of its document that it is in, and how many parts that has."""
    size = PART if part is None else part
    cut = docs.select("doc_id", F.split(F.coalesce(F.col(text), F.lit("")), pattern).alias("_lines"))
    cut = cut.withColumn("_parts", F.shiftright(F.size("_lines") - 1, size) + 1)
    return cut.select("doc_id", "_parts", F.posexplode("_lines").alias("pos", "line")).withColumn("_part", F.shiftright("pos", size))


def _before(sums: DataFrame, folds: dict[str, Fold], level: int) -> DataFrame:
    """Of each part of sums (_doc, _part, and a summary for each fold) the values that it starts from, named as the folds."""
    block = F.shiftright("_part", FAN)
    within = Window.partitionBy("_doc", *([block] if level else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.select("_doc", "_part", *[f.over(c, within).alias(c) for c, f in folds.items()])
    if not level:
        return inside
    upper = _before(sums.groupBy("_doc", block.alias("_up")).agg(*[f.total(c, "_part").alias(c) for c, f in folds.items()]).withColumnRenamed("_up", "_part"), folds, level - 1)
    upper = upper.select("_doc", F.col("_part").alias("_up"), *[F.col(c).alias(f"_{c}") for c in folds])
    met = inside.withColumn("_up", block).join(upper, ["_doc", "_up"])
    return met.select("_doc", "_part", *[f.after(F.col(f"_{c}"), F.col(c)).alias(c) for c, f in folds.items()])


def scanned(rows: DataFrame, order: str, **values: tuple[Fold, Column]) -> DataFrame:
    """rows of in_parts() with a running value, up to and with each row, for each name: a fold of a column.

    Rows with a null doc_id are one document. A sum is null where no value came yet, as is a latest value.
    """
    folds = {name: f for name, (f, _) in values.items()}
    marked = rows.withColumns({"_doc": F.struct("doc_id"), **{name: c for name, (_, c) in values.items()}})
    within = Window.partitionBy("_doc", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumns({name: f.over(name, within) for name, f in folds.items()})
    sums = marked.where("_parts > 1").groupBy("_doc", "_part").agg(*[f.total(name, order).alias(name) for name, f in folds.items()])
    start = _before(sums, folds, LEVELS).select("_doc", "_part", *[F.col(name).alias(f"_from_{name}") for name in folds])
    met = own.join(start, ["_doc", "_part"], "left")
    return met.withColumns({name: F.when(F.col("_parts") > 1, f.after(F.col(f"_from_{name}"), F.col(name))).otherwise(F.col(name)) for name, f in folds.items()}).select(*rows.columns, *folds)
