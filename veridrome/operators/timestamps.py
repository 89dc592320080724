"""Timestamps in mixed forms and zones as one UTC instant (problem 4).

Parsing is a handful of regular expressions in the JVM.  Local times are then
joined with zone-offset intervals: an interval of zone Z holds the local times
that its offset gives.  Two intervals over a local time mean that it occurs
twice, none that it is skipped, one gives the offset directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrome.functions.keys import id_key, strip
from veridrome.operators.skew import broadcast_if_small, salted_join
from veridrome.session import materialise

#: Offsets of zone letters in minutes.
LETTERS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "PST": -480, "JST": 540}
#: English months.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
FULL = "january february march april may june july august september october november december".split()

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*([A-Za-z]{1,5}))?(?:\s*([+-]\d{2}:?\d{2}|[+-]\d{2}))?(?:\s*\[([^\]]+)\])?"
_REST = rf"(?:[Tt\s,]+(?:at\s+)?{_TIME}{_ZONE})?"
_DAY = r"(?:[A-Za-z]{3,9},?\s+)?"
#: Per form: pattern and where year, month and day are; then hour, minute, second, fraction, am/pm, letters, offset, zone name.
FORMS = [
    ("ymd", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_REST}$", "$1|$2|$3"),
    ("ymd", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_REST}$", "$1|$2|$3"),
    ("ordered", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_REST}$", "$3|$2|$1"),
    ("ymd", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_REST}$", "$3|$2|$1"),
    ("ymd", rf"^{_DAY}(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}}){_REST}$", "$3|$2|$1"),
    ("ymd", rf"^{_DAY}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_REST}$", "$3|$1|$2"),
    ("ymd", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?(?![0-9])()\s*{_ZONE})?$", "$1|$2|$3"),
]
EPOCH = r"^(?:\d{10}(?:\.\d+)?|\d{13})$"


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, in integer arithmetic."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)


def parse(df: DataFrame, text: str, order: str, default_zone: str) -> DataFrame:
    """Add ``_zone``, ``_year`` and ``_local`` (microseconds) for usable values of ``text``.

    ``order`` names a column with ``dmy`` or ``mdy`` (or null) and
    ``default_zone`` one with a zone name (or null).  Values with a fixed offset
    come out as local time of the zone UTC.  Rows without a usable value are
    dropped: null, blank, no date, an impossible one, slashes without an order,
    local time without a zone.
    """
    s = F.col("_s")
    canon = F.lit(None).cast("string")
    for kind, pattern, ymd in reversed(FORMS):
        canon = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, f"{kind}|{ymd}|$4|$5|$6|$7|$8|$9|$10|$11")).otherwise(canon)
    canon = F.when(s.rlike(EPOCH), F.regexp_replace(s, r"^(\d{10})(\d{3})?(?:\.(\d+))?$", "epoch|$1|$2$3")).otherwise(canon)
    # exploding arrays of one keeps the optimiser from copying the long expressions into every use
    out = df.withColumn("_s", F.explode(F.array(strip(F.col(text))))).where("_s <> ''")
    out = out.withColumn("_p", F.explode(F.array(F.split(canon, r"\|", -1)))).where("_p is not null")
    at = lambda i: F.get("_p", F.lit(i))
    num = lambda c: c.try_cast("long")
    kind = at(0)
    order_known = F.lower(F.trim(F.col(order)))
    swap = (kind == "ordered") & (order_known == "mdy")
    second, third = F.when(swap, at(3)).otherwise(at(2)), F.when(swap, at(2)).otherwise(at(3))
    named = F.lower(second)
    month = F.when(named.rlike("^[0-9]+$"), num(named))
    for i, (a, b) in enumerate(zip(MONTHS, FULL), 1):
        month = month.when(named.isin(a, b, *(["sept"] if i == 9 else [])), i)
    fraction = F.substring(F.rpad(F.coalesce(F.when(kind == "epoch", at(2)).otherwise(at(7)), F.lit("")), 6, "0"), 1, 6)
    half = F.lower(at(8))
    hour = F.when(at(4) == "", 0).otherwise(num(at(4)))
    hour24 = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    fields = {
        "_kind": kind,
        "_y": num(at(1)),
        "_m": month.cast("long"),
        "_d": num(third),
        "_h": hour24,
        "_mi": F.when(at(5) == "", 0).otherwise(num(at(5))),
        "_se": F.when(at(6) == "", 0).otherwise(num(at(6))),
        "_us": num(fraction),
        "_letters": F.upper(at(9)),
        "_offset": F.regexp_replace(at(10), ":", ""),
        "_name": F.trim(at(11)),
    }
    out = out.withColumn("_f", F.explode(F.array(F.struct(*[v.alias(k) for k, v in fields.items()])))).select("*", "_f.*")
    letter = F.create_map(*[x for k, v in LETTERS.items() for x in (F.lit(k), F.lit(v))])
    offset = F.col("_offset")
    minutes = num(F.substring(offset, 2, 2)) * 60 + F.coalesce(num(F.substring(offset, 4, 2)), F.lit(0))
    shift = F.when(offset != "", minutes * F.when(offset.startswith("-"), -1).otherwise(1)).when(F.col("_letters") != "", F.try_element_at(letter, F.col("_letters")).cast("long"))
    zone = F.when((offset != "") | (F.col("_letters") != ""), F.when(shift.isNotNull(), F.lit("UTC"))).when(F.col("_name") != "", F.col("_name")).otherwise(F.trim(F.col(default_zone)))
    valid = (
        F.col("_m").between(1, 12)
        & (F.col("_y") >= 1)
        & (F.col("_d") >= 1)
        & (F.col("_d") <= _month_days(F.col("_y"), F.col("_m")))
        & F.col("_h").between(0, 23)
        & F.col("_mi").between(0, 59)
        & F.col("_se").between(0, 59)
        & ((F.col("_kind") != "ordered") | order_known.isin("dmy", "mdy"))
    )
    civil = ((_days(F.col("_y"), F.col("_m"), F.col("_d")) * 24 + F.col("_h")) * 60 + F.col("_mi") - F.coalesce(shift, F.lit(0))) * 60 + F.col("_se")
    epoch = F.col("_kind") == "epoch"
    out = out.withColumns({
        "_zone": F.when(epoch, F.lit("UTC")).otherwise(zone),
        "_local": F.when(epoch, F.col("_y") * 1_000_000 + F.col("_us")).when(valid, civil * 1_000_000 + F.col("_us")),
        "_year": F.when(epoch | (offset != "") | (F.col("_letters") != ""), F.lit(1970)).otherwise(F.col("_y").cast("int")),
    })
    keep = [*df.columns, "_zone", "_year", "_local"]
    return out.where(F.col("_local").isNotNull() & (F.col("_zone") != "")).select(*keep)


def zone_intervals(zone: str, year: int) -> list[tuple[int, int, int, int]]:
    """Pieces of local time around ``year``: (from, to, intervals over it, offset), microseconds.

    The offset of a piece under two intervals is that of the earlier instant;
    of a piece under none it is the one before the gap.  A zone that the zone
    database lacks has no piece.
    """
    from zoneinfo import ZoneInfo

    big = 1 << 62
    if zone == "UTC":
        return [(-big, big, 1, 0)]
    try:
        z = ZoneInfo(zone)
    except Exception:  # an unknown or malformed name
        return []
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    lo = datetime(max(year, 2), 1, 1, tzinfo=timezone.utc) - timedelta(days=3)
    hi = datetime(min(year, 9997) + 1, 1, 1, tzinfo=timezone.utc) + timedelta(days=3)
    off = lambda t: round(t.astimezone(z).utcoffset().total_seconds())
    spans, start, here, t = [], -big, off(lo), lo
    while t < hi:
        nxt = t + timedelta(hours=12)
        if off(nxt) != here:
            a, b = t, nxt
            while b - a > timedelta(seconds=1):
                mid = a + timedelta(seconds=int((b - a).total_seconds()) // 2)
                a, b = (mid, b) if off(mid) == here else (a, mid)
            at = int((b - zero).total_seconds())
            spans.append((start, at, here))
            start, here = at, off(nxt)
        t = nxt
    spans.append((start, big, here))
    out, done = [], -big
    for i, (a, b, o) in enumerate(spans):
        first = -big if a == -big else a + o
        last = big if b == big else b + o
        if i and first > done:
            out.append((done, first, 0, spans[i - 1][2]))
        elif i and first < done:  # the last piece ends where the overlap begins
            p = out.pop()
            out += [(p[0], first, p[2], p[3]), (first, done, 2, p[3])]
            first = done
        out.append((first, last, 1, o))
        done = last
    us = 1_000_000
    return [(a if a == -big else a * us, b if b == big else b * us, n, o * us) for a, b, n, o in out]


def _intervals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [(z, y, *p) for z, y in zip(pdf["_zone"], pdf["_year"]) for p in zone_intervals(z, int(y))]
        yield pd.DataFrame(rows, columns=["_zone", "_year", "_from", "_to", "_over", "_off"])


def to_utc(parsed: DataFrame, salt: int = 16) -> DataFrame:
    """Add ``utc_us`` and ``over`` (0 skipped, 1 plain, 2 twice) to :func:`parse`'s rows.

    The interval table has a few rows for each zone and year that occurs, at
    most a few million for all zones of the database and all years; it is sent
    to the executors if a count shows it is small, else the join is salted.
    Rows of a zone that does not exist are dropped.
    """
    pairs = parsed.select("_zone", "_year").distinct()
    table = materialise(pairs.mapInPandas(_intervals, "_zone string, _year int, _from long, _to long, _over int, _off long"))  # counted and then read, not made twice
    within = (F.col("_local") >= F.col("_from")) & (F.col("_local") < F.col("_to"))
    few, small = broadcast_if_small(table, 96)
    joined = salted_join(parsed, few, ["_zone", "_year"], "inner", 1 if small else salt, F.xxhash64("_local"), within)
    return joined.withColumns({"utc_us": F.col("_local") - F.col("_off"), "over": F.col("_over")}).drop("_zone", "_year", "_local", "_from", "_to", "_over", "_off")


def source_clocks(sources: DataFrame) -> DataFrame:
    """One row a source key: (key, tz, date_order) from parser_config.

    Of rows with one key the last added counts, ties by id; unreadable
    configuration gives null for both.
    """
    best = F.max_by(F.struct("tz", "date_order"), F.struct(F.coalesce("added_at", F.lit(0).cast("timestamp")), "id"))
    slim = sources.select(
        id_key(F.col("id")).alias("key"),
        "id",
        "added_at",
        F.get_json_object("parser_config", "$.tz").alias("tz"),
        F.get_json_object("parser_config", "$.date_order").alias("date_order"),
    )
    return slim.where("key is not null").groupBy("key").agg(best.alias("b")).select("key", "b.tz", "b.date_order")


def normalised(df: DataFrame, table_name: str, key: str, clocks: DataFrame, salt: int = 8) -> DataFrame:
    """Rows (table_name, record_id, tz, date_order, text) of a table with ``key``, ``record_id``, ``text``.

    Values under every source key are spread over ``salt`` tasks.
    """
    rows = df.select("record_id", "key", "text").where(F.col("text").isNotNull())
    known = salted_join(rows.where("key is not null"), clocks, ["key"], "left", salt)
    loose = rows.where("key is null").withColumns({"tz": F.lit(None).cast("string"), "date_order": F.lit(None).cast("string")})
    return known.unionByName(loose).select(F.lit(table_name).alias("table_name"), "record_id", "tz", "date_order", "text")


def instants(updates: DataFrame, sources: DataFrame) -> DataFrame:
    """One UTC instant for each usable published_date and last_checked.

    Columns: table_name, record_id, utc_us, over, distinct.
    """
    clocks = source_clocks(sources)
    u = updates.select(F.col("id").alias("record_id"), id_key(F.col("source_id")).alias("key"), F.col("published_date").alias("text"))
    s = sources.select(
        F.lit("sources").alias("table_name"),
        F.col("id").alias("record_id"),
        F.get_json_object("parser_config", "$.tz").alias("tz"),
        F.get_json_object("parser_config", "$.date_order").alias("date_order"),
        F.col("last_checked").alias("text"),
    )
    rows = normalised(u, "updates", "id", clocks).unionByName(s)
    # values are parsed once: the pairs of zone and year and the join both read what was written
    parsed = materialise(parse(rows, "text", "date_order", "tz").select("table_name", "record_id", "_zone", "_year", "_local"))
    return to_utc(parsed).select("table_name", "record_id", "utc_us", "over").distinct()
