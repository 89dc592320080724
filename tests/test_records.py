import json
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from tests import brute
from veridrome.operators import nested, references, timestamps

SMALL = "/root/testdata/sf0.001"


def at(day):
    return datetime(2024, 1, 1) + timedelta(days=day)


def child(spark, rows):
    return spark.createDataFrame(rows, "id string, key string, at timestamp, since string, _salt int")


def test_orphans_against_loop(spark):
    rnd = random.Random(1)
    kids = [(f"u{i}", rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, at(rnd.randrange(9))]), "x", i) for i in range(200)]
    kids += kids[:20]  # repeated rows
    parents = [("a", at(2), at(4)), ("a", at(5), None), ("b", at(3), at(3)), ("c", None, None), (None, at(0), None), ("a", at(2), at(4))]
    got = references.orphans(child(spark, kids), spark.createDataFrame(parents, "key string, since timestamp, until timestamp"), salt=3)
    ok = lambda k, t: any(p == k and s and t and s <= t and (e is None or e > t) for p, s, e in parents)
    want = sorted(i for i, k, t, *_ in kids if k is not None and not ok(k, t))
    assert sorted(r.id for r in got.collect()) == want
    assert set(got.columns) == {"id", "key", "at", "since", "_salt"}


def test_orphans_empty_tables(spark):
    none = spark.createDataFrame([], "key string, since timestamp, until timestamp")
    kids = child(spark, [("u", "a", at(1), "", 0)])
    assert [r.id for r in references.orphans(kids, none).collect()] == ["u"]
    assert references.orphans(kids.limit(0), none).count() == 0


def test_key_forms(spark):
    df = spark.createDataFrame([("  SRC-1\t ",), ("",), ("  ",), (None,)], "id string")
    from veridrome.functions.keys import id_key

    assert [r[0] for r in df.select(id_key(df.id)).collect()] == ["src-1", None, None, None]


DOCS = [
    ("plain", '[{"evidence": [{"spans": [{}, null, 3]}]}, "x", null]'),
    ("wrapped", json.dumps(json.dumps(json.dumps([{"evidence": json.dumps({"spans": {"start": 1}})}])))),
    ("single", '{"related": {"related": [{"related": [{"a": 1}]}]}}'),
    ("unreadable", '[{"a": 1'),
    ("empty", ""),
    ("null", None),
    ("literal", "null"),
    ("plain", '[{"evidence": [{"spans": [{}, null, 3]}]}, "x", null]'),
    ("deep", json.dumps({"related": [{"related": [{"related": [{"related": [{"related": [{"related": [{"related": [{"x": 1}]}]}]}]}]}]}]})),
    ("bottomless", '{"related":' * 1200 + "1" + "}" * 1200),
    ("clash", '[{"@": 1, "Evidence": 2, "evidence": [{"@": {"spans": [{"q": 1}]}}], "a.b": {"evidence": [{}]}}]'),
]


def test_nested_against_walk(spark):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in DOCS], "id string, violations string, root string, doc string")
    docs = nested.roots(df, "t", "id", {"violations": df.violations})
    got = {(r.record_id, r.node_path) for r in nested.explode_levels(docs).collect()}
    want = {(i, p) for i, v in DOCS if i not in ("bottomless", "clash") for p in brute.nodes("violations", v)}
    assert {g for g in got if g[0] not in ("bottomless", "clash")} == want
    assert sorted(len(p) for i, p in got if i == "bottomless") == [len("violations[1]") + k * len(".related[1]") for k in range(1200)]
    assert ("deep", "violations[1]" + ".related[1]" * 7) in got


@pytest.mark.parametrize("wrapper", ["details", "a.b"])
def test_nested_wrapper_below_the_first_round(spark, wrapper):
    for place in (1, 5, 6, 7):  # levels that the first round unrolls, hands on, and that the next one does
        v, path, want = {"x": 1}, "violations[1]", {"violations[1]": None}
        for k in reversed(range(8)):
            v = {"related": [v, {}]}
            v = {wrapper: v} if k == place else v
        for k in range(8):
            below = path + (f".{wrapper}" if k == place else "") + ".related"
            want |= {f"{below}[1]": path, f"{below}[2]": path}
            path = f"{below}[1]"
        df = spark.createDataFrame([("r", json.dumps([v]))], "id string, violations string")
        n = {r.node_path: r for r in nested.explode_levels(nested.roots(df, "t", "id", {"violations": df.violations})).collect()}
        assert {k: r.parent_path for k, r in n.items()} == want
        assert {r.level for r in n.values() if r.parent_path} == {"related"}


def test_json_of_any_depth():
    from veridrome.functions import deepjson

    deep = "[" * 200_000 + "1" + "]" * 200_000
    assert deepjson.dumps(deepjson.loads(deep)) == deep
    rnd = random.Random(2)

    def value(d):
        k = rnd.randrange(7 if d else 5)
        return [None, True, rnd.randrange(99), 1.5e3, 'a"\\\n\u00e9', [value(d - 1) for _ in range(rnd.randrange(3))] if d else 0, {f"k{i}": value(d - 1) for i in range(rnd.randrange(3))} if d else 0][k]

    for _ in range(300):
        v = value(5)
        for text in (json.dumps(v), json.dumps(v, indent=2)):
            assert deepjson._loads(text) == v and deepjson._dumps(v) == json.dumps(v, ensure_ascii=False)
            for bad in (text + "]", text[:-1] + ",", "{" + text, "[1 2]", '{"a" 1}', '{"a":}', "[1,]", "", "tru"):
                try:
                    want = json.loads(bad)
                except ValueError:
                    with pytest.raises(ValueError):
                        deepjson._loads(bad)
                else:
                    assert deepjson._loads(bad) == want


def test_nested_links_and_types(spark):
    df = spark.createDataFrame(DOCS[:1], "id string, violations string")
    n = nested.explode_levels(nested.roots(df, "t", "id", {"violations": df.violations}))
    rows = {r.node_path: r.parent_path for r in n.collect()}
    assert all(p is None or p in rows for p in rows.values())
    assert nested.level_table(n, "spans", {"start": "bigint"}).first().start is None


def test_every_level_has_a_table(spark):
    from veridrome.plans import records

    tables = {k: records.QUERIES[f"p3_{k}"](spark, SMALL).collect() for k in nested.ARRAYS}
    rows = [r for k in tables for r in tables[k]]
    paths = {(r.table_name, r.record_id, r.node_path) for r in rows}
    assert len(rows) == len(paths) and all(tables.values())
    assert paths == {tuple(r) for r in records.p3_found(spark, SMALL).collect()}
    assert all(r.parent_path is None or (r.table_name, r.record_id, r.parent_path) in paths for r in rows)
    assert all(r.node_path.endswith(f"{k}[{r.ordinal}]") for k in tables for r in tables[k])
    assert all(json.loads(r.attributes).get("note") == r.note for k in ("comments", "replies") for r in tables[k])


def test_nested_empty(spark):
    df = spark.createDataFrame([], "id string, violations string")
    assert nested.explode_levels(nested.roots(df, "t", "id", {"violations": df.violations})).count() == 0


STAMPS = [
    "1704067200", "1704067200.1234567", "1704067200123", "2024-02-30T10:00:00Z", "2024-02-29", "20240229", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03T01:30:00-05:00",
    "03/04/2024 05:06", "13/04/2024 12:00 AM", "04/13/2024 12:00 PM", "1.2.2024 3:04", "2 January 2024, 23:59", "02-Feb-2024 01:00", "Feb 02, 2024 12:10 AM EST", "January 02, 2024 at 03:04 PM", "Tue, 02 Jan 2024 19:26:10 +0100",
    "2024-01-07T12:56:14+05:45", "2024-01-07T12:56:14[Asia/Kathmandu]", "2024-01-07T12:56:14[Nowhere/City]", "2024-01-07 12:56 CEST", "2024-01-07 12:56 QQQ", "25:61", "TBD", "", None, "  2024-01-01 00:00:00 ", "2024-01-01T00:00:60Z", "2024-01-01 24:00", "0000-01-01", "12345678901", "9999-12-31 23:59:59", "1850-06-01 12:00",
]


@pytest.mark.parametrize("tz,order", [("America/New_York", "mdy"), ("America/New_York", "dmy"), ("Asia/Kathmandu", None), (None, "dmy")])
def test_timestamps_against_zoneinfo(spark, tz, order):
    rows = [(str(i), v, tz, order, 1) for i, v in enumerate(STAMPS)]
    df = spark.createDataFrame(rows, "record_id string, text string, tz string, date_order string, utc int").withColumnRenamed("utc", "extra")
    got = {int(r.record_id): r.utc_us for r in timestamps.to_utc(timestamps.parse(df, "text", "date_order", "tz"), salt=2).collect()}

    def want(v):
        if v and ("Nowhere" in v or "QQQ" in v or v.startswith("0000")):
            return None
        try:
            return brute.utc_us(v, tz, order)
        except OverflowError:
            return None

    assert got == {i: want(v) for i, v in enumerate(STAMPS) if want(v) is not None}


def test_zone_pieces_cover_without_gap():
    for zone in ("Europe/Berlin", "America/Sao_Paulo", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca"):
        for year in (1, 1916, 1999, 2011, 2024, 9999):
            p = timestamps.zone_intervals(zone, year)
            assert all(a[1] == b[0] for a, b in zip(p, p[1:])) and p[0][0] == -(1 << 62) and p[-1][1] == 1 << 62
    assert timestamps.zone_intervals("No/Zone", 2024) == []


def test_found_queries_against_brute(spark):
    from veridrome.plans import records

    db = duckdb.connect()
    want = set()
    for i, v, m in db.execute(f"SELECT entry_id, violations, metadata FROM '{SMALL}/audit_entries.parquet'").fetchall():
        want |= {("audit_entries", i, p) for p in brute.audit_nodes({"violations": v, "metadata": m})}
    for i, v in db.execute(f"SELECT id, violations FROM '{SMALL}/compliance_events.parquet'").fetchall():
        want |= {("compliance_events", i, p) for p in brute.nodes("violations", v)}
    assert {tuple(r) for r in records.p3_found(spark, SMALL).collect()} == want
    clocks = {i.strip().lower(): json.loads(c or "{}") for i, c in db.execute(f"SELECT id, parser_config FROM '{SMALL}/sources.parquet'").fetchall()}
    want = set()
    for t, sql in (("updates", "SELECT id, source_id, published_date FROM '{}/updates.parquet'"), ("sources", "SELECT id, id, last_checked FROM '{}/sources.parquet'")):
        for i, s, v in db.execute(sql.format(SMALL)).fetchall():
            c = clocks.get((s or "").strip().lower(), {})
            us = brute.utc_us(v, c.get("tz"), c.get("date_order"))
            if us is not None:
                want.add((t, i, us))
    assert {tuple(r) for r in records.p4_found(spark, SMALL).collect()} == want
