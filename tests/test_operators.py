import random

import pytest
from pyspark.sql import functions as F

from veridrome.functions import patterns as P
from veridrome.functions import text as T
from veridrome.functions import vectors as V
from veridrome.operators import rules, sequences, skew, spans, store
from veridrome.operators import vectors as VO


def test_salted_join_equals_plain(spark):
    rnd = random.Random(2)
    many = spark.createDataFrame([(rnd.choice(["hot"] * 8 + ["b", None]), i) for i in range(300)], "k string, v int")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("c", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, skew.salted_join(many, few, ["k"], how, 5).collect()))
        plain = many.join(few.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"), how).drop("k2")
        assert a == sorted(map(str, plain.collect()))


def test_broadcast_is_checked(spark):
    df = spark.range(100)
    assert skew.broadcast_if_small(df, 8, rows=200)[1]
    assert not skew.broadcast_if_small(df, 8, rows=50)[1]


def test_greedy_spans_against_loop(spark):
    rnd = random.Random(3)
    rows = [(d, rnd.randrange(4), s, s + rnd.randrange(1, 9)) for d in range(5) for s in [rnd.randrange(40) for _ in range(25)]]
    got = spans.select_greedy(spark.createDataFrame(rows, "doc_id int, rank int, start int, end int"), ["rank", "start", "end"])
    want = []
    for d in range(5):
        kept = []
        for r in sorted(x for x in rows if x[0] == d):
            if all(r[3] <= k[2] or k[3] <= r[2] for k in kept):
                kept.append(r)
        want += kept
    assert sorted(tuple(r[c] for c in ("doc_id", "rank", "start", "end")) for r in got.collect()) == sorted(want)


def test_offsets_against_finditer(spark):
    import re

    texts = ["", "a@b.co and c.d@e.org.", "é a@b.co\n🙂 x@y.zz", None, "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for (t,), row in zip([(t,) for t in texts], df.select(P.matches(df.t, P.EMAIL).alias("m")).collect()):
        want = None if t is None else [(m[0], m.start(), m.end()) for m in re.finditer(P.EMAIL, t)]
        assert (row.m and [tuple(x) for x in row.m]) == (want or (None if t is None else []))
    for bad in ("a*", "("):
        with pytest.raises(ValueError):
            P.check(bad)


def test_text_functions(spark):
    df = spark.createDataFrame([("aaaa (b)", "One. Two! Three",), ("", "",), (None, None)], "a string, b string")
    r = df.select(T.overlapping_count(F.col("a"), "aa").alias("n"), T.balanced(F.col("a")).alias("p"), F.size(T.sentences(F.col("b"))).alias("s"), T.word_count(F.col("a")).alias("w"), T.within_budget(T.words(F.col("b")), 8, lambda x: F.length(x).cast("long")).alias("k")).collect()
    assert (r[0].n, r[0].p, r[0].s, r[0].w, r[0].k) == (3, True, 3, 2, ["One.", "Two!"])
    assert (r[1].n, r[1].p, r[1].s, r[1].w, r[2].n) == (0, False, 0, 0, 0)


def test_forward_chaining(spark):
    chain = [rules.Inference(("a",), "b"), rules.Inference(("c",), "d"), rules.Inference(("b",), "c"), rules.Inference(("a",), "z", ("d",))]
    df = spark.createDataFrame([(["a"],), (["x"],), ([],)], "f array<string>")
    got = [sorted(r[0]) for r in df.select(rules.forward_chain(F.col("f"), chain)).collect()]
    assert got == [["a", "b", "c", "d", "z"], ["x"], []]  # z fires before its blocker is known


def test_as_of_and_ties(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 5, 20.0), ("a", 5, 30.0), ("c", 1, 1.0)], "k string, t int, v double")
    got = {r.id: r.as_of_value for r in sequences.as_of(left, right, "k", "t", "v").collect()}
    assert got == {1: 30.0, 2: None, 3: None}


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], "id string, v int, w string")
    new = spark.createDataFrame([("a", 1, "y"), ("b", 4, "y"), ("c", None, "y")], "id string, v int, w string")
    assert {r.id: r.w for r in store.upsert(old, new, "id", "v").collect()} == {"a": "y", "b": "x", "c": "y"}
    assert [r.id for r in store.insert_new(old, new, "id").collect()] == ["c"]


def test_log_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-02 03:04:05", [1]), ("b", None, None)], "id string, timestamp string, xs array<int>").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    store.write_log(df, str(tmp_path / "log"))
    store.write_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("event_date = '2024-01-02'").count() == 2
    store.export(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        store.export(df, str(tmp_path / "x"), "xml")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0])], "id long, v array<double>")
    r = {x.id: x for x in df.select("id", V.norm(F.col("v")).alias("n"), V.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(4.0))).alias("c"), V.quantise(F.col("v")).alias("q"), V.normalise(F.col("v")).alias("u")).collect()}
    assert r[1].n == 5 and abs(r[1].c - 1) < 1e-12 and r[2].c == 0 and r[2].q == [0, 0] and r[1].q == [95, 127] and r[2].u == [0, 0]
    n = VO.nearest(df.where("id = 1"), df, "id", "v", 1).collect()
    assert [(x["query"], x.id, x["rank"]) for x in n] == [(1, 3, 1)]
