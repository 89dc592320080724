"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridrome.llm import abuse, encoding, leakage, pages, personal, repeated_lines, residue
from veridrome.operators.skew import spread
from veridrome.sources.tables import table


PERSONAL = (("content_events", "id", "content"), ("rule_tasks", "id", "content"), ("text_chunks", "chunk_id", "text"))


def p1_found(spark, d):
    """Every piece of personal data with its place."""
    parts = [personal.find(spread(table(spark, d, t, k, c)), t, k, c) for t, k, c in PERSONAL]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_redacted(spark, d):
    """Texts with typed placeholders in place of personal data."""
    parts = [
        spread(table(spark, d, t, k, c).distinct()).select(F.lit(t).alias("table_name"), F.col(k).alias("record_id"), personal.redacted(F.col(c)).alias("text"))
        for t, k, c in PERSONAL
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_counts(spark, d):
    """Pieces of personal data per table and kind."""
    return p1_found(spark, d).groupBy("table_name", "kind").agg(F.count(F.lit(1)).alias("n_pieces"), F.countDistinct("record_id").alias("n_records"))


#: Batches of time in which the queries of repeated lines feed the updates in.
BATCHES = 4


def _source_docs(spark, d):
    return repeated_lines.source_documents(table(spark, d, "updates", "id", "source_id", "content", "found_date"), table(spark, d, "sources", "id"), "found_date")


def _repeated(spark, d):
    docs = _source_docs(spark, d)
    hashed, state = repeated_lines.run_batches(spark, docs, "found_date", BATCHES)
    return docs, repeated_lines.holding(hashed, state.standing)


def p5_found(spark, d):
    """Lines that are excessive in their source, after the updates came in by batches of time."""
    return _repeated(spark, d)[1].select(F.col("id").alias("update_id"), F.col("line_no").cast("int").alias("line_no"))


def p5_cleaned(spark, d):
    """The rebuilt contents of updates that hold an excessive line."""
    docs, spots = _repeated(spark, d)
    return repeated_lines.without_lines(docs, spots).select(F.col("id").alias("update_id"), "content")


def _pages(spark, d):
    return spread(table(spark, d, "updates", "id", "title", "summary", "content"))


def p6_found(spark, d):
    """Lines that do not belong to the article."""
    u, model = _pages(spark, d), pages.page_model()
    index = residue.Index(*residue.word_weights(u))
    return pages.lines_around(u, model, residue.skipper(index)).select(F.col("id").alias("update_id"), "field", "line_no")


def p6_bodies(spark, d):
    """Contents and summaries reduced to the article."""
    return pages.main_body(_pages(spark, d)).distinct().withColumnRenamed("id", "update_id")


def p7_found(spark, d):
    """Fields that were never filled in or hold a failed page."""
    return residue.find(_pages(spark, d)).select(F.col("id").alias("update_id"), "field")


def p7_kept(spark, d):
    """Updates without residue: those that stay in the corpus, per impact level."""
    u = table(spark, d, "updates")
    kept = u.join(residue.find(u).select("id").distinct(), "id", "left_anti")
    return kept.groupBy("impact_level").agg(F.countDistinct("id").alias("n_updates"))


def p8_ids(spark, d):
    """Token ids of each document."""
    return encoding.encode(spread(table(spark, d, "documents", "doc_id", "text")))


def p8_round_trip(spark, d):
    """The text that each document's ids give back, null as empty text."""
    return encoding.decode(encoding.encode(spread(table(spark, d, "documents", "doc_id", "text"))))


def p9_found(spark, d):
    """Documents and the test items they contain."""
    return leakage.leaks(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items", "item_id", "text"))


def p9_leaked_items(spark, d):
    """Documents per leaked item: with an exact run, and with a run or an overlap of twice its length that tolerates substitutions."""
    o = leakage.overlaps(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items", "item_id", "text"))
    exact = F.sum((F.col("run") >= leakage.RUN).cast("int")).alias("n_exact")
    return o.groupBy("item_id").agg(exact, F.sum((F.col("near") >= 2 * leakage.RUN).cast("int")).alias("n_tolerant"))


def p9_items(spark, d):
    """Documents with an exact run, per leaked item."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def _judge(spark, d):
    docs = spread(table(spark, d, "documents", "doc_id", "text", "source"))
    return docs, abuse.fit(abuse.rated_sample(docs, table(spark, d, "doc_labels", "doc_id", "toxic")), docs)


def p10_found(spark, d):
    """Documents with an abusive, hateful or sexual passage."""
    docs, judge = _judge(spark, d)
    return abuse.score(docs, judge).where("abusive").select("doc_id")


def p10_scores(spark, d):
    """The score of every document."""
    docs, judge = _judge(spark, d)
    return abuse.score(docs, judge).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark, d):
    """Documents and abusive ones per source."""
    docs, judge = _judge(spark, d)
    one = abuse.score(docs, judge).join(docs.select("doc_id", "source"), "doc_id")
    counts = one.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("abusive").cast("long")).alias("n_abusive"))
    return counts.withColumn("rate", F.col("n_abusive") / F.col("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_counts, p5_found, p5_cleaned, p6_found, p6_bodies, p7_found, p7_kept, p8_ids, p8_round_trip, p9_found, p9_items, p9_leaked_items, p10_found, p10_scores, p10_rates)}


def queries():
    return dict(QUERIES)


_W = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = f"lower(regexp_replace({{}}, '^{_W.replace('{', '{{').replace('}', '}}')}+|{_W.replace('{', '{{').replace('}', '}}')}+$', '', 'g'))"
_LINES = f"""
docs AS (SELECT DISTINCT {_TRIM.format("u.source_id")} AS source, u.id, u.content FROM updates u
         WHERE {_TRIM.format("u.source_id")} IN (SELECT {_TRIM.format("id")} FROM sources)),
lines AS (SELECT source, id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM docs),
keyed AS (SELECT source, id, line_no, trim(regexp_replace(regexp_replace(lower(line), '{_W}+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS k FROM lines),
counts AS (SELECT source, k, count(DISTINCT id) AS n FROM keyed WHERE k <> '' GROUP BY ALL),
totals AS (SELECT source, count(DISTINCT id) AS total FROM docs GROUP BY ALL),
spots AS (SELECT DISTINCT id, line_no FROM keyed JOIN counts USING (source, k) JOIN totals USING (source) WHERE n >= 3 AND n * 1000 >= total * 80)"""
_LEAKS = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM eval_items),
a AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 14], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 13)) AS i FROM w WHERE len(ws) >= 15)),
b AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 14], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 13)) AS i FROM v WHERE len(ws) >= 15))"""
SQL = {
    "p5_found": f"WITH {_LINES} SELECT id AS update_id, line_no::INT AS line_no FROM spots",
    "p5_cleaned": f"""WITH {_LINES}
SELECT id AS update_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE (id, line_no) NOT IN (SELECT id, line_no FROM spots)), '') AS content
FROM lines WHERE id IN (SELECT id FROM spots) GROUP BY id""",
    "p9_found": f"{_LEAKS} SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)",
    "p9_items": f"{_LEAKS} SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM a JOIN b USING (g) GROUP BY item_id",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def oracle_sql():
    return dict(SQL)
