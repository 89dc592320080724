"""Interval operators over spans of texts: grouping, selection, containment, ensembles.

A document's spans meet in one window or array; spans of different documents
never meet, so a shuffle on the document is all it takes.  Spans are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def groups(df: DataFrame, doc: str = "doc_id", touching: bool = True) -> DataFrame:
    """Number the groups of overlapping spans of each document (``touching`` joins spans that only touch)."""
    w = Window.partitionBy(doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(w)
    apart = F.col("start") > reach if touching else F.col("start") >= reach
    marked = df.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0))
    run = Window.partitionBy(doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("span_group", F.sum("_new").over(run)).drop("_new")


def union(df: DataFrame, doc: str = "doc_id", touching: bool = True) -> DataFrame:
    """Merged spans: (doc, start, end, n)."""
    g = groups(df, doc, touching).groupBy(doc, "span_group")
    return g.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("span_group")


def first_wins(spans: Column, touching: bool = False) -> Column:
    """Of an ordered array of spans those that meet no span kept before.

    Works on structs with ``start`` and ``end``; the order of the array decides.
    """
    kind = F.slice(spans, 1, 0)

    def clash(a: Column, b: Column) -> Column:
        return (a["start"] <= b["end"]) & (b["start"] <= a["end"]) if touching else (a["start"] < b["end"]) & (b["start"] < a["end"])

    return F.aggregate(spans, kind, lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def select_greedy(df: DataFrame, order: list[str], doc: str = "doc_id", touching: bool = False) -> DataFrame:
    """Spans of each document kept greedily in the given order of columns (ascending)."""
    rest = [c for c in df.columns if c != doc and c not in order]
    packed = df.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_s"))
    return packed.select(doc, F.explode(first_wins(F.col("_s"), touching)).alias("_k")).select(doc, "_k.*")


def within(inner: DataFrame, outer: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The smallest span of ``outer`` that holds each inner span and is larger: columns ``outer_start``, ``outer_end``.

    Ties go to the earlier start.  A join on the document with a range
    condition; both sides are spans of the same text.
    """
    o = outer.select(F.col(doc).alias("_d"), F.col("start").alias("outer_start"), F.col("end").alias("outer_end")).distinct()
    on = (F.col(doc) == F.col("_d")) & (F.col("start") >= F.col("outer_start")) & (F.col("end") <= F.col("outer_end"))
    on = on & (F.col("end") - F.col("start") < F.col("outer_end") - F.col("outer_start"))
    w = Window.partitionBy(doc, "start", "end").orderBy(F.col("outer_end") - F.col("outer_start"), "outer_start")
    return inner.join(o, on).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_d")


def vote(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per group of overlapping spans the type most models give (ties by type) and its best score."""
    g = groups(df, doc)
    n = g.groupBy(doc, "span_group", "type").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    w = Window.partitionBy(doc, "span_group").orderBy(F.desc("n"), "type")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(doc, "span_group", "type", "n", "score")


def weighted_vote(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per group the type with the highest sum of score times model weight (ties by type)."""
    n = groups(df, doc).groupBy(doc, "span_group", "type").agg(F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("total"))
    w = Window.partitionBy(doc, "span_group").orderBy(F.desc("total"), "type")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(doc, "span_group", "type", "total")


def near_pairs(df: DataFrame, first: str, second: str, gap: int, doc: str = "doc_id") -> DataFrame:
    """Neighbouring spans of two types at most ``gap`` characters apart, in this order."""
    w = Window.partitionBy(doc).orderBy("start", "end", "type")
    nxt = df.withColumns({"_t": F.lead("type").over(w), "_s": F.lead("start").over(w)})
    hit = (F.col("type") == first) & (F.col("_t") == second) & (F.col("_s") - F.col("end") <= gap)
    return nxt.where(hit).select(doc, F.col("start").alias("first_start"), F.col("_s").alias("second_start"))


def band(first: Column, second: Column, distance: int, directed: bool = False) -> Column:
    """Whether two position arrays hold positions at most ``distance`` apart (directed: the second behind the first)."""
    if directed:
        return F.exists(first, lambda a: F.exists(second, lambda b: (b - a > 0) & (b - a <= distance)))
    return F.exists(first, lambda a: F.exists(second, lambda b: F.abs(a - b) <= distance))


def link(df: DataFrame, names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Link texts of spans to a dictionary (surface, id): exact match 0.95, else none.  Case does not count."""
    keyed = names.select(F.lower("surface").alias("_k"), "id").groupBy("_k").agg(F.min("id").alias("entity_id"))
    out = df.withColumn("_k", F.lower("text")).join(keyed, "_k", "left").drop("_k")
    return out.withColumn("confidence", F.when(F.col("entity_id").isNotNull(), 0.95))
