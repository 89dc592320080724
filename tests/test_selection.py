"""Entities, relations and choice of rows against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veridrome.functions import entities as E
from veridrome.operators import selection
from veridrome.plans import entity_queries


def pick(rows, budget, most, least, cut=200, penalty=0.1):
    """The choice for one request, row by row: list of (key, spent)."""
    rows = sorted(rows, key=lambda r: (-r["score"], r["key"]))
    got, used, groups = [], 0, {}
    for r in rows:
        if r["group"] not in groups and used + r["cost"] <= budget and len(got) < most:
            got.append((r["key"], r["cost"]))
            used += r["cost"]
            groups[r["group"]] = 1
    have = {k for k, _ in got}
    for r in rows:
        if r["key"] in have or r["score"] - penalty * groups.get(r["group"], 0) < least:
            continue
        c = min(r["cost"], cut)
        if used + c > budget or len(got) == most:
            break
        got.append((r["key"], c))
        used += c
        groups[r["group"]] = groups.get(r["group"], 0) + 1
    return set(got)


def test_budget_against_loop(spark):
    rnd = random.Random(4)
    rows = [(f"r{i % 7}", f"k{i}", rnd.choice(["a", "b", None]), rnd.choice([0.1, 0.5, 0.5, 0.9, None]), rnd.choice([10, 150, 300, None]), "x") for i in range(200)]
    df = spark.createDataFrame(rows, "req string, k string, g string, s double, c long, spent string")
    got = selection.within_budget(df, "req", "k", "g", "s", "c", 700, 4, least=0.3).collect()
    for r in {x[0] for x in rows}:
        mine = [{"key": k, "group": g or "unknown", "score": s, "cost": c} for q, k, g, s, c, _ in rows if q == r and s is not None and c is not None]
        assert {(x.key, x.spent) for x in got if x.request == r} == pick(mine, 700, 4, 0.3)
    assert selection.within_budget(df.limit(0), "req", "k", "g", "s", "c", 700, 4).count() == 0


def test_mixture_starts_again(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(3)] + [(None, 1)], "d string, n int")
    got = selection.mixture(df, "d", ["n"], 11, 4).collect()
    assert sorted({r.d for r in got}) == ["a", "b"] and len(got) == 44
    b = [r.n for r in sorted((r for r in got if r.d == "b"), key=lambda r: (r.batch, r.place))]
    assert b == [0, 1, 2, 0]
    assert selection.mixture(df.limit(0), "d", ["n"], 11, 4).count() == 0


def test_containing_against_loop(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aAbc ") for _ in range(rnd.randrange(7))) for _ in range(60)] + [None, ""]
    a, b = (spark.createDataFrame([(w,) for w in ws], f"{c} string") for c, ws in (("p", words[:35] + words[60:]), ("q", words[30:])))
    low = lambda ws: {w.lower() for w in ws if w}
    want = {(x, y) for x in low(words[:35]) for y in low(words[30:]) if x in y or y in x}
    assert {tuple(r) for r in selection.containing(a, b, "p", "q").collect()} == want


def test_axes_against_decomposition(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 6)) @ rnd.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "i int, v array<double>")
    mean, axes, values = selection.principal_axes(df, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(values, (s**2 / len(x))[:3]) and np.allclose(np.abs(axes), np.abs(vt[:3]))
    p = selection.project(df.where("i < 5"), "v", mean, axes, "p").orderBy("i").toPandas()["p"]
    assert np.allclose(np.stack(p), (x - x.mean(0))[:5] @ axes.T)
    assert len(selection.principal_axes(df.limit(0), "v", 3)[0]) == 0


def test_classes_and_edges(spark):
    rules = {"a": (["key"], [r"^\d+$"]), "b": ([], ["^x"])}
    rows = [("12", "a key", None), ("12", "", None), ("xy", "key", None), ("q", "", "PER"), ("q", "", None), ("", "", None)]
    df = spark.createDataFrame(rows, "t string, c string, g string")
    got = [tuple(r.k) for r in df.select(E.rule_class(F.col("t"), F.col("c"), rules, F.col("g"), {"b": ["PER"]}).alias("k")).collect()]
    assert [(k, pytest.approx(c)) for k, c in got] == [("a", 1.0), ("a", 0.7), ("b", 0.7), ("b", 0.8), ("UNKNOWN", 0.5), ("UNKNOWN", 0.5)]


def test_queries_of_budget(spark):
    small = "/root/testdata/sf0.001"
    got = entity_queries.select_within_budget(spark, small).toPandas()
    a = pd.read_parquet(f"{small}/audit_entries.parquet").drop_duplicates("entry_id")
    a = a[a.session_id.notna() & a.compliance_score.notna()]
    want = set()
    for _, g in a.groupby("session_id"):
        rows = [{"key": r.entry_id, "group": r.framework_id or "unknown", "score": r.compliance_score, "cost": 40 + 60 * (0 if r.violations is None else len(r.violations))} for r in g.itertuples()]
        want |= pick(rows, 400, 5, 0.1)
    assert set(zip(got.key, got.spent)) == want
