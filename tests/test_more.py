from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veridrome.functions import contexts as C
from veridrome.functions import rewrite as W
from veridrome.functions import scores as S
from veridrome.functions import text as T
from veridrome.operators import graph, hooks, reports, retrieval, sequences


def test_string_similarity(spark):
    rows = [("abcd", "bcde"), ("abc", "abc"), ("ab", "xaby"), (None, "a"), ("", ""), ("", "a")]
    got = [r.similarity for r in graph.string_similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()]
    assert got == [SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, 0.45, 0.0, 1.0, 0.0]


def test_related_and_antecedents(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")], "source string, target string")
    start = spark.createDataFrame([("a",), ("q",)], "node string")
    assert {(r.start, r.node, r.distance) for r in graph.related(edges, start, 3).collect()} == {("a", "b", 1), ("a", "c", 2)}
    rows = [(1, 1, 0, "p", False, "Ann"), (1, 2, 5, "p", True, "she"), (1, 9, 0, "p", True, "she"), (2, 1, 0, "p", True, "he")]
    m = spark.createDataFrame(rows, "doc_id int, sentence int, start int, kind string, pronoun boolean, text string")
    assert {(r.doc_id, r.sentence): r.refers_to for r in graph.antecedents(m).collect()} == {(1, 2): "Ann", (1, 9): None, (2, 1): None}


def test_contexts(spark):
    df = spark.createDataFrame([({"a": "1", "b": None},), (None,), ({},)], "m map<string,string>")
    r = df.select(C.has(F.col("m"), "a").alias("k"), C.has_pair(F.col("m"), "a:1").alias("p"), C.has_all(F.col("m"), ["a:2"]).alias("n"), C.digest(F.col("m")).alias("d")).collect()
    assert [(x.k, x.p, x.n) for x in r] == [(True, True, False), (False, False, False), (False, False, False)]
    assert r[0].d != r[2].d and r[1].d is None
    one = spark.sql("SELECT map('x', '1', 'y', '2') AS m, map('y', '2', 'x', '1') AS n").select(C.digest(F.col("m")) == C.digest(F.col("n")))
    assert one.first()[0]


def test_rewriting(spark):
    df = spark.createDataFrame([("a  b , c .", [(0, 1), (3, 4)])], "t string, s array<struct<start:int,end:int>>")
    r = df.select(W.spaced(F.col("t")).alias("a"), W.without_spans(F.col("t"), F.col("s")).alias("b"), W.numbered_marks(F.col("t"), "[abc]", "X").alias("c"), W.with_notice(W.with_notice(F.col("t"), "N"), "N").alias("d"), W.replace_terms(F.lit("Bad BAD bad badly"), {"bad": "good"}).alias("e")).first()
    assert (r.a, r.b, r.c, r.e) == ("a b, c.", "   , c .", "[X_1]  [X_2] , [X_3] .", "Good GOOD good badly")
    assert r.d.count("N") == 1


def test_rendering(spark):
    df = spark.createDataFrame([("<T>", [("r&1", "n")])], "t string, s array<struct<rule:string,note:string>>")
    out = df.select(*[W.render(F.col("t"), F.col("s"), f).alias(f) for f in ("text", "html", "markdown")]).first()
    assert out.text == "<T>\n1. r&1: n" and out.html == "<h1>&lt;T&gt;</h1><ol><li><b>r&amp;1</b> n</li></ol>" and out.markdown == "# <T>\n- **r&1** n"
    with pytest.raises(ValueError):
        W.render(F.col("t"), F.col("s"), "pdf")


def test_hooks(spark):
    df = spark.createDataFrame([("stop it",), ("mail a@b.co",), (None,)], "t string")
    steps = [hooks.Intervention("b", blocks=lambda t: t.contains("stop")), hooks.Intervention("r", rewrites=lambda t: F.upper(t)), hooks.Intervention("late", blocks=lambda t: t.contains("MAIL"))]
    assert [(r.output, r.blocked_by) for r in hooks.intervene(df, "t", steps).collect()] == [(None, "b"), (None, "late"), (None, None)]
    reg = hooks.Registry()
    reg.column("n")(lambda c: F.length(c))
    reg.tables["m"] = lambda d: d.select("t")
    assert reg.apply(df, "t", ["n"]).first().n == 7 and reg.run_all(df).columns == ["t", "model"]
    with pytest.raises(ValueError):
        reg.column("n")(lambda c: c)


def test_scores_and_ties(spark):
    df = spark.createDataFrame([("low",), ("critical",), (None,), ("odd",)], "s string")
    assert [r[0] for r in df.select(S.rank(F.col("s"))).collect()] == [1, 4, 0, 0]
    assert df.select(T.argmax({"x": F.lit(1), "y": F.lit(1)}), T.argmax({"x": F.lit(0)}, "none")).first()[:] == ("x", "none")
    g = reports.most_common(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), "v", 1)
    assert g.first().v == "a"
    empty = spark.createDataFrame([], "g string, tp long, fp long, fn long, tn long")
    assert reports.with_rates(empty).count() == 0


def test_empty_and_null_windows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2)], "k string, t timestamp, id int")
    assert sequences.sessions(df, "k", "t", "id", 60).select("session").distinct().count() == 1
    assert sequences.islands(df.limit(0).select("k", "id"), "id", []).count() == 0
    hits = spark.createDataFrame([("d", 0.5)], "id string, score double")
    assert retrieval.merge_hits(hits, hits.limit(0), "id").first().score == 0.35
