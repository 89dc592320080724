from pyspark.sql import functions as F

from veridrome.sources import stores
from veridrome.streaming import monitor


def drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return stream.sparkSession.table(name)


def folder(spark, tmp_path, rows, schema, name="in"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return path


def test_alerts_carry_the_surplus(spark, tmp_path):
    schema = "id string, severity string"
    rows = [(str(i), "high") for i in range(7)] + [("x", "critical"), ("y", "low"), ("z", None)]
    s = monitor.read_folder(spark, folder(spark, tmp_path, rows, schema), schema)
    got = sorted((r.severity, r.alert_no) for r in drain(monitor.alerts(s), "alerts_out").collect())
    assert got == [("critical", 1), ("high", 1), ("high", 2)]


def test_windows_and_repeats(spark, tmp_path):
    schema = "id string, t timestamp, kind string"
    rows = [("a", "2024-01-01 00:10:00", "x"), ("a", "2024-01-01 00:10:00", "x"), ("b", "2024-01-01 00:50:00", "x"), ("c", "2024-01-01 01:10:00", "y")]
    df = spark.createDataFrame(rows, "id string, t string, kind string").withColumn("t", F.col("t").cast("timestamp"))
    path = str(tmp_path / "w")
    df.coalesce(1).write.parquet(path)
    once = monitor.without_repeats(monitor.read_folder(spark, path, schema), "id", "t")
    assert sorted(r.id for r in drain(once, "once_out").collect()) == ["a", "b", "c"]
    n = monitor.windowed_counts(monitor.read_folder(spark, path, schema), "t", ["kind"])
    assert sorted((r.kind, r.n) for r in drain(n, "windows_out", "complete").collect()) == [("x", 3), ("y", 1)]


def test_running_words(spark, tmp_path):
    from datetime import datetime

    schema = "request_id string, at timestamp, delta_text string, finish_reason string"
    t = datetime(2024, 1, 1)
    rows = [("r", t, "one two", None), ("r", t, " three", "stop"), ("q", t, None, None)]
    s = monitor.read_folder(spark, folder(spark, tmp_path, rows, schema, "words"), schema)
    got = {r.request_id: (r.n_words, r.ended) for r in drain(monitor.running_words(s, "at"), "words_out").collect()}
    assert got == {"r": (3, True), "q": (0, False)}


def test_fan_out(spark, tmp_path):
    schema = "id string, ok boolean"
    s = monitor.read_folder(spark, folder(spark, tmp_path, [("a", True), ("b", False)], schema, "fan"), schema)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    q = monitor.fan_out(s, {"good": (F.col("ok"), monitor.append_to(good)), "bad": (~F.col("ok"), monitor.append_to(bad))}, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.read.parquet(good).collect()] == ["a"] and spark.read.parquet(bad).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\xffc")
    assert spark.createDataFrame([], "x int").count() == 0
    (tmp_path / "log.json").write_text('{"entry_id": "e1", "compliance_score": 0.5}\n{"entry_id": "e2"}\n')
    log = stores.audit_log(spark, str(tmp_path / "log.json"))
    assert stores.entry(log, "e1").first().compliance_score == 0.5
    (tmp_path / "reg.json").write_text('[{"id": "s1"}, {"id": "s2", "active": false}]')
    assert {r.id: r.active for r in stores.register(spark, str(tmp_path / "reg.json")).collect()} == {"s1": True, "s2": False}
    assert stores.decode_lists(spark.createDataFrame([('["a"]',), ("x",)], "l string"), "l").collect()[0].l == ["a"]
