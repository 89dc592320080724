"""Queries over audit entries, compliance events and the event stream's batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridrome.functions import scores as S
from veridrome.operators import reports as R
from veridrome.operators import sequences as Q
from veridrome.plans.registry import registry
from veridrome.sources.tables import table

query, QUERIES, SQL = registry()


def _audit(spark, d, *columns):
    """Audit entries, one row an id (repeated rows are equal)."""
    return _once(table(spark, d, "audit_entries", "entry_id", *columns))


def _once(df):
    """Rows without repeats; by id where a map column cannot be compared."""
    return df.dropDuplicates(["entry_id"]) if any(t.startswith("map") for _, t in df.dtypes) else df.distinct()


def _violations(spark, d):
    a = _audit(spark, d, "framework_id", "timestamp", "violations", "user_id")
    return a.select("entry_id", "framework_id", "timestamp", "user_id", F.posexplode("violations").alias("pos", "v")).where("v is not null").select(
        "entry_id", "framework_id", "timestamp", "user_id", "pos", "v.type", "v.rule_id", "v.severity", "v.matched_content"
    )


_A = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY entry_id) AS rn FROM audit_entries) WHERE rn = 1)"
_V = f"(SELECT entry_id, framework_id, \"timestamp\", user_id, v.type AS type, v.rule_id AS rule_id, v.severity AS severity, v.matched_content AS matched_content, pos FROM (SELECT entry_id, framework_id, \"timestamp\", user_id, unnest(violations) AS v, generate_subscripts(violations, 1) - 1 AS pos FROM {_A}) WHERE v IS NOT NULL)"


@query(f"""SELECT entry_id, event_type, compliance_score FROM {_A} WHERE "timestamp" >= TIMESTAMPTZ '2024-02-01 00:00:00+00' AND "timestamp" <= TIMESTAMPTZ '2024-11-30 00:00:00+00'
AND compliance_result = false AND framework_id IN ('GDPR', 'HIPAA', 'CCPA') ORDER BY "timestamp" DESC NULLS LAST, entry_id LIMIT 100""")
def audit_query(spark, d):
    """The newest hundred failed entries of three frameworks in a time range."""
    # repeated rows are equal, so the conditions can go before the unification and reach the scan
    rows = table(spark, d, "audit_entries", "entry_id", "timestamp", "event_type", "framework_id", "compliance_result", "compliance_score")
    a = R.matching(rows, "2024-02-01", "2024-11-30", {"compliance_result": False}, {"framework_id": ["GDPR", "HIPAA", "CCPA"]})
    return R.latest(_once(a), 100).select("entry_id", "event_type", "compliance_score")


@query(f"""SELECT entry_id, user_id, session_id FROM {_A} WHERE entry_id = (SELECT min(entry_id) FROM audit_entries)""")
def audit_point_lookup(spark, d):
    """One entry by its id (here the least one)."""
    a = _audit(spark, d, "user_id", "session_id")
    least = table(spark, d, "audit_entries", "entry_id").agg(F.min("entry_id").alias("entry_id"))
    return a.join(least, "entry_id", "left_semi").select("entry_id", "user_id", "session_id")


@query(f"""SELECT framework_id, count(*) AS n, count(*) FILTER (WHERE compliance_result) AS n_compliant, round(coalesce(avg(compliance_score), 0), 9) AS mean_score,
round(count(*) FILTER (WHERE compliance_result) / count(*), 6) AS rate FROM {_A} GROUP BY framework_id""")
def audit_report(spark, d):
    """Entries, compliant ones, rate and mean score per framework."""
    return R.compliance_rates(_audit(spark, d, "framework_id", "compliance_result", "compliance_score"), ["framework_id"], "compliance_result", "compliance_score")


@query(f"SELECT type, count(*) AS n FROM {_V} WHERE type IS NOT NULL GROUP BY type ORDER BY n DESC, type LIMIT 5")
def audit_top_violation_types(spark, d):
    """The five most frequent violation types."""
    return R.most_common(_violations(spark, d), "type", 5)


@query(f"SELECT rule_id, count(*) AS n FROM {_V} WHERE rule_id IS NOT NULL GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10")
def audit_top_rules(spark, d):
    """The ten most violated rules."""
    return R.most_common(_violations(spark, d), "rule_id", 10)


_CNT = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s}" for s in S.SEVERITIES)


@query(f"""SELECT *, (n_critical * 100 + n_high * 50 + n_medium * 10 + n_low)::BIGINT AS weighted, CASE WHEN n_critical > 0 THEN 'critical' WHEN n_high > 0 THEN 'high' WHEN n_medium > 0 THEN 'medium' ELSE 'low' END AS highest,
CASE WHEN n_critical >= 1 THEN 'critical' WHEN n_high >= 2 THEN 'high' WHEN n_medium >= 5 THEN 'medium' WHEN n_low >= 10 THEN 'low' ELSE 'none' END AS reached FROM (SELECT framework_id, {_CNT} FROM {_V} GROUP BY framework_id)""")
def audit_severity_profile(spark, d):
    """Severity counts, weighted score and ladder per framework."""
    return R.severity_profile(_violations(spark, d), ["framework_id"])


@query(f"""SELECT entry_id, round(1 - least(1.0, sum(CASE severity WHEN 'low' THEN 0.1 WHEN 'medium' THEN 0.3 WHEN 'high' THEN 0.6 WHEN 'critical' THEN 1.0 ELSE 0 END::DOUBLE)), 6) AS score FROM {_V} GROUP BY entry_id""")
def audit_penalty_scores(spark, d):
    """Score of each entry from the penalties of its violations."""
    return R.penalty_score(_violations(spark, d), ["entry_id"])


@query(f"""SELECT entry_id, rule_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, rule_id ORDER BY pos) AS r FROM {_V} WHERE rule_id IS NOT NULL) WHERE r = 1""")
def audit_first_violation_per_rule(spark, d):
    """Violations without repeats of a rule in an entry; the first wins."""
    v = _violations(spark, d).where("rule_id is not null").withColumn("k", F.concat_ws("\u0001", "entry_id", "rule_id"))
    return Q.last_rows(v, "k", 1, [F.asc("pos")]).select("entry_id", "rule_id", "severity")


@query(f"""SELECT rule_id, count(*) AS n FROM {_V} WHERE rule_id IS NOT NULL GROUP BY rule_id HAVING count(*) >= 3""")
def audit_repeated_rules(spark, d):
    """Rules violated three times or more."""
    return _violations(spark, d).where("rule_id is not null").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(f"""SELECT category, count(*) AS n, count(DISTINCT rule_id) AS n_rules FROM (SELECT rule_id, CASE WHEN starts_with(rule_id, 'gdpr') OR starts_with(rule_id, 'ccpa') OR starts_with(rule_id, 'lgpd') THEN 'privacy' WHEN starts_with(rule_id, 'hipaa') THEN 'health' WHEN starts_with(rule_id, 'glba') OR starts_with(rule_id, 'pci') THEN 'finance' ELSE 'general' END AS category FROM {_V} WHERE rule_id IS NOT NULL) GROUP BY category""")
def audit_rule_categories(spark, d):
    """Violations by the first prefix of their rule that names a category."""
    prefixes = {"gdpr": "privacy", "ccpa": "privacy", "lgpd": "privacy", "hipaa": "health", "glba": "finance", "pci": "finance"}
    category = F.lit("general")
    for p, c in reversed(prefixes.items()):
        category = F.when(F.col("rule_id").startswith(p), c).otherwise(category)
    v = _violations(spark, d).where("rule_id is not null")
    return v.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rule_id").alias("n_rules"))


@query(f"""SELECT domain, rule_id, n FROM (SELECT coalesce(a.metadata['domain'], 'unknown') AS domain, v.rule_id, count(*) AS n FROM {_V} v JOIN {_A} a USING (entry_id) WHERE v.rule_id IS NOT NULL GROUP BY ALL) WHERE n >= 3""")
def audit_domain_patterns(spark, d):
    """Rules violated three times or more within a domain."""
    v = _violations(spark, d).where("rule_id is not null").select("entry_id", "rule_id")
    a = _audit(spark, d, "metadata").select("entry_id", F.coalesce(F.try_element_at("metadata", F.lit("domain")), F.lit("unknown")).alias("domain"))
    return v.join(a, "entry_id").groupBy("domain", "rule_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(f"""SELECT platform, round(count(*) FILTER (WHERE severity IN ('high', 'critical')) / count(*), 6) AS severe_share FROM (SELECT coalesce(a.metadata['platform'], 'unknown') AS platform, v.severity FROM {_V} v JOIN {_A} a USING (entry_id)) GROUP BY platform""")
def audit_platform_severity(spark, d):
    """Share of severe violations per platform."""
    v = _violations(spark, d).select("entry_id", "severity")
    a = _audit(spark, d, "metadata").select("entry_id", F.coalesce(F.try_element_at("metadata", F.lit("platform")), F.lit("unknown")).alias("platform"))
    share = F.count_if(F.col("severity").isin("high", "critical")) / F.count(F.lit(1))
    return v.join(a, "entry_id").groupBy("platform").agg(F.round(share, 6).alias("severe_share"))


@query(f"""SELECT rule_id, count(DISTINCT framework_id) AS n_frameworks FROM {_V} WHERE rule_id IS NOT NULL GROUP BY rule_id HAVING count(DISTINCT framework_id) >= 3""")
def audit_cross_context_rules(spark, d):
    """Rules that appear in three frameworks' entries or more."""
    return _violations(spark, d).where("rule_id is not null").groupBy("rule_id").agg(F.count_distinct("framework_id").alias("n_frameworks")).where("n_frameworks >= 3")


@query(f"""SELECT entry_id, framework_id, list_sort(list_distinct(list_filter(list_transform(violations, lambda v: v.severity), lambda s: s IS NOT NULL))) AS severities, regexp_replace(coalesce(user_id, ''), '[0-9]', '#', 'g') AS masked_user FROM {_A}""")
def audit_sanitised(spark, d):
    """Entries with masked users and only the severities of their violations."""
    a = _audit(spark, d, "framework_id", "violations", "user_id")
    severities = F.array_sort(F.array_distinct(F.array_compact(F.transform("violations", lambda v: v["severity"]))))
    return a.select("entry_id", "framework_id", severities.alias("severities"), F.regexp_replace(F.coalesce("user_id", F.lit("")), "[0-9]", "#").alias("masked_user"))


@query(f"""SELECT entry_id FROM {_A} WHERE "timestamp" >= TIMESTAMPTZ '2024-12-31 00:00:00+00' - INTERVAL 90 DAY""")
def audit_retained(spark, d):
    """Entries that a purge of more than ninety days before a day keeps."""
    return R.matching(table(spark, d, "audit_entries", "entry_id", "timestamp"), "2024-10-02").select("entry_id").distinct()


@query(f"""SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cumulative FROM (SELECT event_type, count(*) AS n FROM {_A} WHERE event_type IS NOT NULL GROUP BY event_type)""")
def audit_type_shares(spark, d):
    """Share and cumulative share of entry types."""
    return R.share_of_total(_audit(spark, d, "event_type"), "event_type")


@query(f"""SELECT framework_id, round(avg(compliance_score), 9) AS mean, round(quantile_cont(compliance_score, 0.5), 9) AS p50, round(quantile_cont(compliance_score, 0.95), 9) AS p95, round(quantile_cont(compliance_score, 0.99), 9) AS p99 FROM {_A} WHERE compliance_score IS NOT NULL GROUP BY framework_id""")
def audit_score_percentiles(spark, d):
    """Mean and percentiles of scores per framework."""
    return R.percentiles(_audit(spark, d, "framework_id", "compliance_score").where("compliance_score is not null"), ["framework_id"], "compliance_score")


@query(f"""SELECT framework_id, bool_and(compliance_result) AS all_compliant, min(compliance_score) AS min_score FROM {_A} WHERE compliance_result IS NOT NULL AND request_id IS NOT NULL GROUP BY framework_id""")
def audit_rollup(spark, d):
    """And of results, least of scores per framework."""
    a = _audit(spark, d, "framework_id", "compliance_result", "compliance_score", "request_id").where("compliance_result is not null and request_id is not null")
    return a.groupBy("framework_id").agg(F.bool_and("compliance_result").alias("all_compliant"), F.min("compliance_score").alias("min_score"))


_CE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at NULLS LAST) AS rn FROM compliance_events) WHERE rn = 1)"


def _events(spark, d, *columns):
    """Compliance events, of each id the first received."""
    e = table(spark, d, "compliance_events", "id", "received_at", *[c for c in columns if c not in ("id", "received_at")])
    return Q.last_rows(e, "id", 1, [F.asc_nulls_last("received_at")])


@query(f"""SELECT framework, count(*) AS n, count(*) FILTER (WHERE is_compliant) AS n_compliant, round(count(*) FILTER (WHERE is_compliant) / count(*), 6) AS rate FROM (SELECT unnest(framework_ids) AS framework, is_compliant FROM {_CE}) GROUP BY framework""")
def monitor_framework_rates(spark, d):
    """Compliance rate per framework named by an event."""
    e = _events(spark, d, "framework_ids", "is_compliant").select(F.explode("framework_ids").alias("framework"), "is_compliant")
    return R.compliance_rates(e, ["framework"], "is_compliant")


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE is_compliant) AS n_compliant FROM {_CE} WHERE "timestamp" >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND "timestamp" <= TIMESTAMPTZ '2024-09-01 00:00:00+00' AND list_has_any(framework_ids, ['GDPR', 'HIPAA'])""")
def monitor_report(spark, d):
    """Events of two frameworks in a time range."""
    e = R.matching(_events(spark, d, "timestamp", "framework_ids", "is_compliant"), "2024-03-01", "2024-09-01", overlaps={"framework_ids": ["GDPR", "HIPAA"]})
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_compliant").alias("n_compliant"))


@query(f"""SELECT user_id, count(DISTINCT f) AS n_items FROM (SELECT user_id, unnest(framework_ids) AS f FROM {_CE} WHERE user_id IS NOT NULL) WHERE f IS NOT NULL GROUP BY user_id HAVING count(DISTINCT f) > 1""")
def monitor_framework_conflicts(spark, d):
    """Users whose events name more than one framework."""
    return R.conflicts(_events(spark, d, "user_id", "framework_ids").where("user_id is not null"), "user_id", "framework_ids")


@query(f"""SELECT strftime("timestamp" AT TIME ZONE 'UTC', '%H')::INT AS hour, count(*) AS n FROM {_CE} WHERE "timestamp" IS NOT NULL GROUP BY 1""")
def monitor_hourly(spark, d):
    """Events per hour of the day."""
    return Q.histogram(_events(spark, d, "timestamp").where("timestamp is not null"), F.hour("timestamp"), "hour")


@query("""WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT hour::INT AS hour, n FROM h WHERE n >= 1.1 * (SELECT avg(n) FROM h) AND n >= 3""")
def event_peak_hours(spark, d):
    """Hours with clearly more errors than the mean hour."""
    return Q.peaks(table(spark, d, "events", "ts", "event_type").where("event_type = 'error'"), F.hour("ts"), "hour", 1.1)


@query("""WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), p AS (SELECT hour FROM h WHERE n >= (SELECT avg(n) FROM h)),
i AS (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS g FROM p) SELECT min(hour)::INT AS first, max(hour)::INT AS last, count(*) AS n FROM i GROUP BY g""")
def event_hour_ranges(spark, d):
    """Ranges of consecutive hours at or above the mean."""
    return Q.islands(Q.peaks(table(spark, d, "events", "ts", "event_type").where("event_type = 'error'"), F.hour("ts"), "hour", 1.0, 0), "hour", [])


@query("""SELECT event_type, round(count(*) FILTER (WHERE isodow(ts) < 6) / 5.0, 6) AS weekday_mean, round(count(*) FILTER (WHERE isodow(ts) >= 6) / 2.0, 6) AS weekend_mean FROM events GROUP BY event_type""")
def event_weekday_weekend(spark, d):
    """Mean events of a weekday and of a weekend day."""
    e = table(spark, d, "events", "ts", "event_type")
    return e.groupBy("event_type").agg(F.round(F.count_if(F.weekday("ts") < 5) / 5.0, 6).alias("weekday_mean"), F.round(F.count_if(F.weekday("ts") >= 5) / 2.0, 6).alias("weekend_mean"))


@query("""SELECT CASE WHEN day(ts) <= 10 THEN 'begin' WHEN day(ts) <= 20 THEN 'middle' ELSE 'end' END AS part, quarter(ts)::INT AS quarter, count(*) AS n FROM events GROUP BY ALL""")
def event_month_parts(spark, d):
    """Events by part of the month and quarter."""
    part = F.when(F.dayofmonth("ts") <= 10, "begin").when(F.dayofmonth("ts") <= 20, "middle").otherwise("end")
    return table(spark, d, "events", "ts").groupBy(part.alias("part"), F.quarter("ts").alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, " + ", ".join(f"round(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL {n} DAY AND ts <= TIMESTAMP '2024-01-30 00:00:00') / {n}.0, 6) AS per_day_{n}" for n in (1, 7, 30)) + " FROM events GROUP BY user_id")
def event_frequency_change(spark, d):
    """Events a day over three spans before a fixed moment, per user."""
    return Q.frequency_change(table(spark, d, "events", "ts", "user_id"), "user_id", "ts", "2024-01-30", (1, 7, 30))


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN epoch_us(ts) - prev > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
FROM (SELECT user_id, ts, event_id, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, session::BIGINT AS session, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM g GROUP BY user_id, session HAVING count(*) >= 2""")
def event_sessions(spark, d):
    """Clusters of a user's events with gaps of at most an hour."""
    return Q.session_summary(table(spark, d, "events", "user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3600)


@query("""SELECT sequence, count(*) AS n FROM (SELECT event_type || '>' || lead(event_type, 1) OVER w || '>' || lead(event_type, 2) OVER w AS sequence FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE sequence IS NOT NULL GROUP BY sequence HAVING count(*) >= 3""")
def event_sequences(spark, d):
    """Sequences of three event types that occur three times or more."""
    return Q.ngrams(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "event_type", "ts", "event_id", 3)


@query("""WITH c AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events),
r AS (SELECT user_id, event_type, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM r GROUP BY user_id, run) GROUP BY user_id""")
def event_longest_runs(spark, d):
    """Longest run of one event type per user."""
    r = Q.runs(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "event_type", "ts", "event_id")
    return r.groupBy("user_id").agg(F.max("n").alias("longest"))


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""")
def event_recent_history(spark, d):
    """The last five events of each user."""
    return Q.last_rows(table(spark, d, "events", "event_id", "user_id", "ts"), "user_id", 5, [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@query("""SELECT event_id, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 6) AS hit_rate FROM events""")
def event_moving_rate(spark, d):
    """Share of views among a user's last hundred events."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    return Q.moving(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "view", 1.0).otherwise(0.0), "hit_rate", 100).select("event_id", "hit_rate")


@query("""SELECT user_id, event_id, running, (running // 3)::BIGINT AS alert_no FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events WHERE event_type = 'error') WHERE running % 3 = 0""")
def event_alerts(spark, d):
    """Every third error of a user raises an alert."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type = 'error'")
    return Q.running_alerts(e, "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "running", "alert_no")


@query("""SELECT user_id, d AS day, n, round(avg(n) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS before FROM (SELECT user_id, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL)""")
def event_daily_spikes(spark, d):
    """Events a day against the mean of the seven active days before."""
    from pyspark.sql.window import Window

    g = table(spark, d, "events", "user_id", "ts").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-7, -1)
    return g.withColumn("before", F.round(F.avg("n").over(w), 6))


@query("""SELECT event_id, as_of_value FROM (SELECT e.event_id, p.v AS as_of_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts)""")
def event_as_of_purchase(spark, d):
    """Each error with the user's newest purchase value until then."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    left, right = e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return Q.as_of(left, right, "user_id", "ts", "value").select("event_id", "as_of_value")


@query("""SELECT event_type, count(*) AS n, round(avg(json_extract(props, '$.k')::DOUBLE), 6) AS mean_k, max(json_extract(props, '$.k')::BIGINT) AS max_k FROM events GROUP BY event_type""")
def event_property_stats(spark, d):
    """Statistics of a property inside JSON."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(k.cast("double")), 6).alias("mean_k"), F.max(k.cast("long")).alias("max_k"))


@query("""SELECT rule_id, count(*) AS n, count(*) FILTER (WHERE completed) AS n_done, count(*) FILTER (WHERE error IS NOT NULL) AS n_failed, min(priority) AS first_priority FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM rule_tasks) WHERE rn = 1) GROUP BY rule_id""")
def task_queue_state(spark, d):
    """Tasks of each rule: all, done, failed, least priority."""
    t = table(spark, d, "rule_tasks", "id", "rule_id", "completed", "error", "priority").dropDuplicates(["id"])
    return t.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("completed").alias("n_done"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.min("priority").alias("first_priority"))


@query("""SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, rule_id
FROM (SELECT r.rule_id, count(*) FILTER (WHERE contains(lower(text), r.rule_id) AND toxic = 1) AS tp, count(*) FILTER (WHERE contains(lower(text), r.rule_id) AND toxic = 0) AS fp, count(*) FILTER (WHERE NOT contains(lower(text), r.rule_id) AND toxic = 1) AS fn, count(*) FILTER (WHERE NOT contains(lower(text), r.rule_id) AND toxic = 0) AS tn
FROM doc_labels l JOIN documents d USING (doc_id), (VALUES ('you'), ('stupid'), ('audit')) r(rule_id) WHERE text IS NOT NULL AND toxic IS NOT NULL GROUP BY r.rule_id)""")
def rule_performance(spark, d):
    """Outcomes of three keyword rules against the ratings, with precision and recall."""
    rated = table(spark, d, "doc_labels", "doc_id", "toxic").where("toxic is not null").join(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id")
    rows = rated.select("toxic", F.lower("text").alias("t"), F.explode(F.array(*[F.lit(k) for k in ("you", "stupid", "audit")])).alias("rule_id"))
    return R.confusion(rows, ["rule_id"], F.contains("t", F.col("rule_id")), F.col("toxic") == 1)
