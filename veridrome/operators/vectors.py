"""Operators over vectors: nearest neighbours for a query set, centroids, drift of codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridrome.functions import vectors as V


def centroids(df: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """Mean vector of each label (sums combine before the shuffle)."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_{i}") for i in range(size)]
    return df.groupBy(label).agg(*means).select(label, F.array(*[f"_{i}" for i in range(size)]).alias("centroid"))


#: Queries of one block, rows of one pack, and queries up to which all blocks are broadcast.
BLOCK, PACK, BROADCAST_QUERIES = 512, 4096, 20_000


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = np.asarray(flat, float).reshape(n, -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _packer(key: str, vector: str):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), PACK):
                part = pdf.iloc[i : i + PACK]
                yield pd.DataFrame({"keys": [part[key].tolist()], "x": [np.concatenate(part[vector].to_list())]})

    return pack


def _products(key: str, k: int):
    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for keys, x, qs, qv in zip(pdf["keys"], pdf["x"], pdf["qs"], pdf["qv"]):
                keys, qs = np.asarray(keys), np.asarray(qs)
                s = (_unit(x, len(keys)) @ _unit(qv, len(qs)).T).round(6)
                s[keys[:, None] == qs] = -np.inf
                # all that reach the k-th score of this pack: ties are settled over all packs
                bound = np.partition(s, -k, axis=0)[-k] if len(keys) > k else np.full(len(qs), -2.0)
                i, j = np.nonzero((s >= bound) & (s > -2))
                yield pd.DataFrame({"query": qs[j], key: keys[i], "score": s[i, j]})

    return best


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine: (query, key, score, rank); ties to the smaller key.

    A stated query set against all rows, in blocks: queries come in blocks of
    about ``BLOCK`` and rows in packs, a pair of which is one matrix product;
    only what can still be among a query's best is shuffled.  Blocks are
    broadcast when a count proves the set small, else packs are repeated a block
    and joined on it.  A query is not its own neighbour; zero vectors score 0;
    null vectors have no place.
    """
    slim = lambda df: df.select(key, F.transform(vector, lambda x: x.cast("double")).alias(vector)).where(F.col(vector).isNotNull())
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    kind = rows.schema[key].dataType.simpleString()
    packed = slim(queries).groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(key).alias("qs"), F.flatten(F.collect_list(vector)).alias("qv"))
    packs = slim(rows).mapInPandas(_packer(key, vector), f"keys array<{kind}>, x array<double>").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = packs.join(F.broadcast(packed) if n <= BROADCAST_QUERIES else packed, "_b").select("keys", "x", "qs", "qv")
    flat = pairs.mapInPandas(_products(key, k), f"query {kind}, `{key}` {kind}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_scores(df: DataFrame, centers: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Cosine of each row with each label's centroid.

    Every row meets every label, for that is the result.  Labels are packed in
    blocks of about ``BLOCK``, broadcast when a count proves them few.
    """
    n = centers.count()
    blocks = max(1, -(-n // BLOCK))
    packed = centers.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid").alias("c"))).alias("_cs"))
    every = df.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    one = every.join(F.broadcast(packed) if n <= BROADCAST_QUERIES else packed, "_b")
    return one.select(key, F.explode(F.transform("_cs", lambda x: F.struct(x["label"].alias("concept"), V.cosine(F.col(vector), x["c"]).alias("cosine")))).alias("s")).select(key, "s.*")
