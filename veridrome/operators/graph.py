"""Links between records: neighbours of a concept graph, similarity by string, clusters by text."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def related(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes reached from ``starts`` (node) over ``edges`` (source, target) in at most ``depth`` steps: (start, node, distance).

    The least distance counts.  Each step joins the frontier with the edges and
    combines before it goes on; ``depth`` is a small constant of the caller.
    """
    e = edges.select("source", "target").distinct()
    front = starts.select(F.col("node").alias("start"), "node").distinct()
    out = None
    for k in range(1, depth + 1):
        front = front.join(e, front["node"] == e["source"]).select("start", F.col("target").alias("node")).distinct()
        step = front.withColumn("distance", F.lit(k))
        out = step if out is None else out.unionByName(step)
    return out.where("start <> node").groupBy("start", "node").agg(F.min("distance").alias("distance"))


def string_similarity(df: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    """1 for equal texts, 0.9 times the length ratio if one holds the other, else the ratio of matching blocks; 0 for a null."""
    kind = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, `{name}` double"

    def one(a, b) -> float:
        if not isinstance(a, str) or not isinstance(b, str):
            return 0.0
        if a == b:
            return 1.0
        if a and b and (a in b or b in a):
            return 0.9 * min(len(a), len(b)) / max(len(a), len(b))
        return SequenceMatcher(None, a, b).ratio()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{name: [one(a, b) for a, b in zip(pdf[left], pdf[right])]})

    return df.mapInPandas(run, kind)


def antecedents(mentions: DataFrame, doc: str = "doc_id", reach: int = 5) -> DataFrame:
    """For each pronoun the nearest earlier entity of its kind at most ``reach`` sentences before.

    ``mentions`` has (doc, sentence, start, kind, pronoun, text).  A window with
    the last entity seen replaces a join of all pairs.
    """
    w = Window.partitionBy(doc, "kind").orderBy("sentence", "start").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(~F.col("pronoun"), F.struct("sentence", "text")), ignorenulls=True).over(w)
    linked = mentions.withColumn("_e", seen).where("pronoun")
    near = F.col("sentence") - F.col("_e.sentence") <= reach
    return linked.select(doc, "sentence", "start", "text", F.when(near, F.col("_e.text")).alias("refers_to"))


def precedence(df: DataFrame, key: str, item: str, order: DataFrame) -> DataFrame:
    """The item of each key with the highest precedence: (key, winner, n_items); ties by name.  ``order`` has (item, rank)."""
    ranked = df.select(key, item).distinct().join(order.select(F.col("item").alias(item), "rank"), item, "left")
    best = F.min_by(item, F.struct(F.coalesce("rank", F.lit(1 << 30)), F.col(item)))
    return ranked.groupBy(key).agg(best.alias("winner"), F.count(F.lit(1)).alias("n_items"))
