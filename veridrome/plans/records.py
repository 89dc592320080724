"""Queries over records: missing references, nested records, timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridrome.operators import nested, references, timestamps
from veridrome.operators.skew import spread
from veridrome.sources.tables import table


def _orphans(spark, d):
    u = references.update_references(table(spark, d, "updates"))
    return references.orphans(u, references.source_periods(table(spark, d, "sources")))


def p2_found(spark, d):
    """Updates whose source did not exist when they were found."""
    return _orphans(spark, d).select(F.col("id").alias("update_id")).distinct()


def p2_orphans_by_month(spark, d):
    """Orphan updates per table and month of finding."""
    return references.orphan_report(_orphans(spark, d), "id", F.lit("updates"), F.date_format("at", "yyyy-MM"))


def _nodes(spark, d):
    audit = spread(table(spark, d, "audit_entries", "entry_id", "violations", "metadata"))
    return nested.explode_levels(nested.compliance_roots(audit, spread(table(spark, d, "compliance_events", "id", "violations"))))


def p3_found(spark, d):
    """Every object of the nested array fields, with its place."""
    return _nodes(spark, d).select("table_name", "record_id", "node_path")


def p3_spans(spark, d):
    """The flat table of spans, typed, with the link to its parent."""
    return nested.level_table(_nodes(spark, d), "spans", {"start": "bigint", "end": "bigint"})


def p3_evidence(spark, d):
    """The flat table of evidence, typed, with the link to its violation."""
    return nested.level_table(_nodes(spark, d), "evidence", {"detector": "string", "confidence": "double"})


def p3_violations(spark, d):
    """The flat table of violations, the roots, with all attributes."""
    columns = ("rule_id", "severity", "type", "matched_content", "context", "framework")
    return nested.level_table(_nodes(spark, d), "violations", dict.fromkeys(columns, "string"), True)


def p3_related(spark, d):
    """The flat table of related records, typed, with the link to the parent and all attributes."""
    return nested.level_table(_nodes(spark, d), "related", {"detector": "string", "confidence": "double"}, True)


def p3_reviews(spark, d):
    """The flat table of reviews, the roots, with all attributes."""
    return nested.level_table(_nodes(spark, d), "reviews", {"stage": "string", "outcome": "string"}, True)


def p3_comments(spark, d):
    """The flat table of comments, with the link to the review and all attributes."""
    return nested.level_table(_nodes(spark, d), "comments", {"by": "string", "note": "string"}, True)


def p3_replies(spark, d):
    """The flat table of replies, with the link to the parent and all attributes."""
    return nested.level_table(_nodes(spark, d), "replies", {"by": "string", "note": "string"}, True)


def p3_links(spark, d):
    """Records of each level and of those how many have a parent."""
    n = _nodes(spark, d)
    return n.groupBy("table_name", "level").agg(F.count(F.lit(1)).alias("n_records"), F.count("parent_path").alias("n_with_parent"))


def _instants(spark, d):
    return timestamps.instants(table(spark, d, "updates"), table(spark, d, "sources"))


def p4_found(spark, d):
    """One UTC instant per usable timestamp."""
    return _instants(spark, d).select("table_name", "record_id", "utc_us")


def p4_clock_changes(spark, d):
    """Values that fell into repeated (2) or skipped (0) local time, per table."""
    return _instants(spark, d).groupBy("table_name", "over").agg(F.count(F.lit(1)).alias("n_values"))


QUERIES = {f.__name__: f for f in (p2_found, p2_orphans_by_month, p3_found, p3_spans, p3_evidence, p3_violations, p3_related, p3_reviews, p3_comments, p3_replies, p3_links, p4_found, p4_clock_changes)}

_KEY = r"lower(regexp_replace({}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g'))"
_ORPHANS = f"""
SELECT DISTINCT u.id, u.found_date FROM updates u
WHERE {_KEY.format("u.source_id")} <> ''
  AND NOT EXISTS (SELECT 1 FROM sources s WHERE {_KEY.format("s.id")} = {_KEY.format("u.source_id")}
                  AND s.added_at <= u.found_date AND (s.removed_at IS NULL OR s.removed_at > u.found_date))"""
SQL = {
    "p2_found": f"SELECT DISTINCT id AS update_id FROM ({_ORPHANS})",
    "p2_orphans_by_month": f"""SELECT 'updates' AS table_name, strftime(found_date AT TIME ZONE 'UTC', '%Y-%m') AS period, count(DISTINCT id) AS n_orphans
FROM ({_ORPHANS}) GROUP BY 1, 2""",
}
