"""Choice of rows: token budgets with diversity, mixtures with restart, queues, overlap of phrases, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pick_within_budget(rows: pd.DataFrame, budget: int, most: int, least: float = 0.0, cut: int = 200, penalty: float = 0.1) -> pd.DataFrame:
    """Rows (key, group, score, cost) of one request that fit a budget of cost.

    Best first; equal scores by key.  First the best row of every group that
    still fits, then the others: their score loses ``penalty`` for each row that
    their group has already, those under ``least`` are passed over, costs are cut
    to ``cut``, and the first that does not fit ends the choice.
    """
    order = rows.sort_values(["score", "key"], ascending=[False, True]).reset_index(drop=True)
    used, taken, counts = 0, {}, {}
    for i, g, c in zip(order.index, order["group"], order["cost"]):
        if g not in counts and used + c <= budget and len(taken) < most:
            taken[i], counts[g] = c, 1
            used += c
    for i, g, s, c in zip(order.index, order["group"], order["score"], order["cost"]):
        if i in taken or s - penalty * counts.get(g, 0) < least:
            continue
        c = min(c, cut)
        if used + c > budget or len(taken) >= most:
            break
        taken[i] = c
        counts[g] = counts.get(g, 0) + 1
        used += c
    out = order.loc[sorted(taken)].copy()
    out["spent"] = [taken[i] for i in sorted(taken)]
    return out


def within_budget(df: DataFrame, request: str, key: str, group: str, score: str, cost: str, budget: int, most: int, **kw) -> DataFrame:
    """:func:`pick_within_budget` for every request: (request, key, group, score, spent).

    A request holds the candidates that a search returned for it, which the
    search bounds; requests are spread over the cluster.  Null scores and costs
    are left out; null groups are one group.
    """
    slim = df.select(F.col(request).alias("request"), F.col(key).cast("string").alias("key"), F.coalesce(F.col(group), F.lit("unknown")).alias("group"), F.col(score).cast("double").alias("score"), F.col(cost).cast("long").alias("cost"))
    slim = slim.where("request is not null and score is not null and cost is not null")
    kind = slim.schema["request"].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pick_within_budget(pdf, budget, most, **kw)[["request", "key", "group", "score", "spent"]]

    return slim.groupBy("request").applyInPandas(pick, f"request {kind}, key string, `group` string, score double, spent long")


def mixture(df: DataFrame, dataset: str, order, size: int, batches: int) -> DataFrame:
    """Batches of rows drawn from several data sets by their share of the rows, starting again where one runs out.

    Every data set gives ``size`` times its share of each batch, one row at
    least; what is missing goes to the larger ones.  Rows are taken in ``order``;
    null data sets give none.  Result: the columns of ``df`` with batch and place.
    """
    rows = df.where(F.col(dataset).isNotNull())
    counts = sorted(((r["count"], r[dataset]) for r in rows.groupBy(dataset).count().collect()), key=lambda x: (-x[0], x[1]))  # one row a data set
    total = sum(n for n, _ in counts)
    quota = {d: max(1, int(size * n / total)) for n, d in counts}
    for _, d in counts[: max(0, size - sum(quota.values()))]:
        quota[d] += 1
    spark, need = df.sparkSession, []
    for n, d in counts:
        need += [(d, b, j, (b * quota[d] + j) % n + 1) for b in range(batches) for j in range(quota[d])]
    places = spark.createDataFrame(need, f"_d {df.schema[dataset].dataType.simpleString()}, batch int, place int, _at long") if need else spark.createDataFrame([], f"_d {df.schema[dataset].dataType.simpleString()}, batch int, place int, _at long")
    most = max([batches * q for q in quota.values()], default=0)
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(dataset).orderBy(*order))).where(F.col("_at") <= most)
    at = (F.col(dataset) == F.col("_d")) & (ranked["_at"] == places["_at"])
    return ranked.join(F.broadcast(places), at).drop("_d", "_at")  # batches times size rows


def claim(df: DataFrame, score: str, keys: list[str], n: int) -> DataFrame:
    """The ``n`` waiting rows of the lowest score, ties by the keys (a queue's next batch)."""
    return df.orderBy(score, *keys).limit(n)


def containing(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of phrases of which one contains the other, without case: distinct (left, right).

    No pair is looked at that does not share the first three characters of the
    shorter one: those are joined with the three-character pieces of the longer
    one.  Shorter phrases are joined whole.  Null and empty phrases match nothing.
    """
    x = a.select(F.lower(left).alias("x")).where("x <> ''").distinct()
    y = b.select(F.lower(right).alias("y")).where("y <> ''").distinct()
    head = lambda c: F.substring(c, 1, 3)

    def pieces(c: str):
        return F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*[F.substring(F.col(c), i, F.lit(k)) for k in (1, 2, 3)])))))

    one = x.select("x", head("x").alias("g")).join(y.select("y", pieces("y").alias("g")), "g").where("contains(y, x)")
    two = x.select("x", pieces("x").alias("g")).join(y.select("y", head("y").alias("g")), "g").where("contains(x, y)")
    return one.select(F.col("x").alias(left), F.col("y").alias(right)).union(two.select("x", "y")).distinct()


def principal_axes(df: DataFrame, vector: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the ``n`` principal axes (rows) and their variances of an array column.

    One pass adds up products in every task; what reaches the driver is one
    matrix of the vectors' width.  Null vectors are left out.  Axes point to
    their largest entry.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, s, ss = 0, None, None
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                count += len(x)
                s = x.sum(0) + (0 if s is None else s)
                ss = x.T @ x + (0 if ss is None else ss)
        if count:
            yield pd.DataFrame({"n": [count], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = df.select(F.col(vector).alias("v")).where("v is not null").mapInPandas(add, "n long, s array<double>, ss array<double>")
    merged = parts.select("n", F.posexplode(F.concat("s", "ss"))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("x")).orderBy("pos").toPandas()
    if merged.empty:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    count, flat = int(merged["n"].iloc[0]), merged["x"].to_numpy()
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:d] / count
    values, axes = np.linalg.eigh(flat[d:].reshape(d, d) / count - np.outer(mean, mean))
    top = np.argsort(values)[::-1][:n]
    axes = axes[:, top].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean, axes, values[top]


def project(df: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, out: str) -> DataFrame:
    """The vectors on the axes."""
    m, a = mean.tolist(), axes.tolist()
    centred = F.zip_with(vector, F.array(*map(F.lit, m)), lambda x, y: x - y)
    return df.withColumn(out, F.array(*[F.aggregate(F.zip_with(centred, F.array(*map(F.lit, r)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for r in a]))
