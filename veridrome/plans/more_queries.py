"""Queries over contexts, rewriting, graphs, hooks, score ladders and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridrome.functions import contexts as C
from veridrome.functions import patterns as P
from veridrome.functions import rewrite as W
from veridrome.functions import scores as S
from veridrome.functions import text as T
from veridrome.functions import vectors as V
from veridrome.operators import graph, hooks, reports
from veridrome.plans.registry import registry
from veridrome.sources.tables import table

query, QUERIES, SQL = registry()
_A = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY entry_id) AS rn FROM audit_entries) WHERE rn = 1)"
_CH = "(SELECT DISTINCT chunk_id, text FROM text_chunks WHERE text IS NOT NULL) c"
_D = "documents WHERE text IS NOT NULL"
MAIL = P.LOOSE["email"]


def _audit(spark, d, *columns):
    return table(spark, d, "audit_entries", "entry_id", *columns).dropDuplicates(["entry_id"])


def _chunks(spark, d):
    return table(spark, d, "text_chunks", "chunk_id", "text").where("text is not null").distinct()


def _docs(spark, d, *more):
    return table(spark, d, "documents", "doc_id", "text", *more).where("text is not null")


@query(f"""SELECT entry_id, coalesce(metadata['domain'] = 'finance', false) AND metadata['platform'] IS NOT NULL AS applies, round(((CASE WHEN coalesce(metadata['domain'] = 'finance', false) THEN 0.7 ELSE 0 END) + (CASE WHEN metadata['platform'] IS NOT NULL THEN 0.3 ELSE 0 END))::DOUBLE, 6) AS share FROM {_A}""")
def context_conditions(spark, d):
    """Conditions over the context map of an entry, all and weighed."""
    m = F.col("metadata")
    return _audit(spark, d, "metadata").select("entry_id", C.has_all(m, ["domain:finance", "platform"]).alias("applies"), F.round(C.match_share(m, {"domain:finance": 0.7, "platform": 0.3}), 6).alias("share"))


@query(f"SELECT doc_id, contains(lower(text), 'audit') AND contains(lower(text), 'consent') AND length(text) >= 500 AS ready FROM {_D}")
def context_content_ready(spark, d):
    """Texts that hold all required pieces and are long enough."""
    return _docs(spark, d).select("doc_id", C.content_ready(F.col("text"), ["audit", "consent"], 500).alias("ready"))


_SUP = "['GDPR', 'HIPAA', 'GLBA']"


@query(f"""SELECT id, array_to_string(list_sort(CASE WHEN len(list_intersect(coalesce(f, []), {_SUP})) > 0 THEN list_intersect(f, {_SUP}) WHEN dom = 'healthcare' THEN ['HIPAA'] WHEN dom = 'finance' THEN ['GLBA'] ELSE {_SUP} END), ',') AS frameworks
FROM (SELECT DISTINCT id, framework_ids AS f, metadata['domain'] AS dom FROM compliance_events)""")
def context_applicable_frameworks(spark, d):
    """Frameworks that apply to an event: asked for, called for by its domain, or all."""
    e = table(spark, d, "compliance_events", "id", "framework_ids", "metadata").select("id", "framework_ids", F.try_element_at("metadata", F.lit("domain")).alias("dom"))
    made = C.applicable(F.col("framework_ids"), ["GDPR", "HIPAA", "GLBA"], {"healthcare": ["HIPAA"], "finance": ["GLBA", "PCI_DSS"]}, F.col("dom"))
    return e.select("id", F.array_join(F.array_sort(made), ",").alias("frameworks")).distinct()


@query("""SELECT id, array_to_string(list_filter([CASE WHEN url IS NULL OR NOT starts_with(url, 'https://') THEN 'url' END, CASE WHEN country IS NULL THEN 'country' END, CASE WHEN coalesce(len(keywords), 0) NOT BETWEEN 1 AND 5 THEN 'keywords' END, CASE WHEN parser_config->>'$.tz' IS NULL THEN 'tz' END], lambda x: x IS NOT NULL), ',') AS problems FROM sources""")
def context_source_problems(spark, d):
    """Checks that a source's settings fail."""
    checks = {"url": F.col("url").startswith("https://"), "country": F.col("country").isNotNull(), "keywords": F.size("keywords").between(1, 5), "tz": C.at_path(F.col("parser_config"), "tz").isNotNull()}
    return table(spark, d, "sources").select("id", F.array_join(C.problems(checks), ",").alias("problems"))


@query(f"SELECT id, coalesce(parser_config->>'$.date_order', '') AS date_order, coalesce(parser_config->>'$.a.b[0]', 'none') AS missing FROM sources")
def context_dotted_paths(spark, d):
    """Dotted paths into JSON settings, with defaults."""
    return table(spark, d, "sources", "id", "parser_config").select("id", C.at_path(F.col("parser_config"), "date_order", "").alias("date_order"), C.at_path(F.col("parser_config"), "a.b[0]", "none").alias("missing"))


@query(f"""SELECT entry_id, coalesce(array_to_string(list_sort(list_transform(map_entries(metadata), lambda e: e.key || '=' || CASE WHEN e.key IN ('platform', 'reviews') THEN '***' ELSE coalesce(e.value, '') END)), ';'), '') AS masked FROM {_A}""")
def context_masked(spark, d):
    """Context maps with secret values hidden."""
    shown = F.array_sort(F.transform(F.map_entries(C.masked(F.col("metadata"), ["platform", "reviews"])), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return _audit(spark, d, "metadata").select("entry_id", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("masked"))


@query(f"""WITH p AS (SELECT chunk_id, string_split_regex(text, '{MAIL}') AS parts FROM {_CH}) SELECT chunk_id, array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE '[EMAIL_' || (i - 1) || ']' || x END), '') AS marked FROM p WHERE len(parts) > 1""")
def rewrite_numbered(spark, d):
    """E-mail addresses as numbered references."""
    c = _chunks(spark, d).where(F.col("text").rlike(MAIL))
    return c.select("chunk_id", W.numbered_marks(F.col("text"), MAIL, "EMAIL").alias("marked"))


@query(f"SELECT chunk_id, regexp_replace(text, '{MAIL}', '', 'g') AS kept FROM {_CH}")
def rewrite_span_removal(spark, d):
    """Texts without the spans of their e-mail addresses."""
    return _chunks(spark, d).select("chunk_id", W.without_spans(F.col("text"), P.matches(F.col("text"), MAIL)).alias("kept"))


_MAP = {"shall": "must", "suspended": "paused", "whatever": "whichever"}


@query()
def rewrite_terms_keep_case(spark, d):
    """Terms of documents of every language replaced with their case kept; checked against a loop in the tests."""
    return _docs(spark, d).select("doc_id", W.replace_terms(F.col("text"), _MAP, edges=P.EDGES).alias("rewritten"))


@query(f"SELECT chunk_id, CASE WHEN contains(text, 'Not legal advice.') THEN text ELSE text || chr(10) || chr(10) || 'Not legal advice.' END AS noticed, regexp_replace(text, '\\b(\\d{{3}})[-. ]\\d{{3}}[-. ]\\d{{4}}\\b', '\\1-***-****', 'g') AS area_only FROM {_CH}")
def rewrite_notice(spark, d):
    """A notice added once; phone numbers reduced to their area code."""
    return _chunks(spark, d).select("chunk_id", W.with_notice(F.col("text"), "Not legal advice.").alias("noticed"), W.keep_area_code(F.col("text")).alias("area_only"))


@query(f"""SELECT entry_id, 'Entry ' || entry_id || chr(10) || coalesce(string_agg((i) || '. ' || coalesce(v.rule_id, '?') || ': ' || coalesce(v.severity, '?'), chr(10) ORDER BY i), '') AS report
FROM (SELECT entry_id, v, row_number() OVER (PARTITION BY entry_id ORDER BY pos) AS i FROM (SELECT entry_id, unnest(violations) AS v, generate_subscripts(violations, 1) AS pos FROM {_A}) WHERE v IS NOT NULL) GROUP BY entry_id""")
def report_text(spark, d):
    """Each entry's violations rendered as text."""
    steps = F.transform(F.array_compact("violations"), lambda v: F.struct(F.coalesce(v["rule_id"], F.lit("?")).alias("rule"), F.coalesce(v["severity"], F.lit("?")).alias("note")))
    a = _audit(spark, d, "violations").withColumn("steps", steps).where(F.size("steps") > 0)
    return a.select("entry_id", W.render(F.concat(F.lit("Entry "), "entry_id"), F.col("steps"), "text").alias("report"))


@query(f"SELECT entry_id, length('<h1>' || replace(entry_id, '&', '&amp;') || '</h1><ol></ol>')::INT AS n_chars FROM {_A} WHERE violations IS NOT NULL AND len(list_filter(violations, lambda v: v IS NOT NULL)) = 0")
def report_html_empty(spark, d):
    """The HTML of entries without violations."""
    steps = F.transform(F.array_compact("violations"), lambda v: F.struct(v["rule_id"].alias("rule"), v["severity"].alias("note")))
    a = _audit(spark, d, "violations").where("violations is not null").withColumn("steps", steps).where(F.size("steps") == 0)
    return a.select("entry_id", F.length(W.render(F.col("entry_id"), F.col("steps"), "html")).alias("n_chars"))


_EDGES = "SELECT DISTINCT user_id AS source, content_id AS target FROM content_events WHERE user_id IS NOT NULL AND content_id IS NOT NULL UNION SELECT DISTINCT content_id, unnest(framework_ids) FROM compliance_events WHERE content_id IS NOT NULL"


@query(f"""WITH e AS (SELECT * FROM ({_EDGES}) WHERE target IS NOT NULL), one AS (SELECT DISTINCT source AS start, target AS node, 1 AS distance FROM e WHERE source IN (SELECT user_id FROM content_events)),
two AS (SELECT o.start, e.target AS node, 2 AS distance FROM one o JOIN e ON o.node = e.source)
SELECT start, node, min(distance)::INT AS distance FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL""")
def graph_related(spark, d):
    """Contents and frameworks within two steps of every user."""
    c = table(spark, d, "content_events", "user_id", "content_id").where("user_id is not null and content_id is not null")
    f = table(spark, d, "compliance_events", "content_id", "framework_ids").where("content_id is not null").select("content_id", F.explode("framework_ids").alias("f")).where("f is not null")
    return graph.related(c.union(f).toDF("source", "target").distinct(), c.select(F.col("user_id").alias("node")).distinct(), 2)


@query()
def graph_title_similarity(spark, d):
    """Likeness of title and summary by matching blocks; checked against a loop in the tests."""
    u = table(spark, d, "updates", "id", "title", "summary").distinct()
    return graph.string_similarity(u, "title", "summary").select("id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT id, f AS winner, n::BIGINT AS n_items FROM (SELECT id, f, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY coalesce(r.rank, 1073741824), f) AS k FROM (SELECT DISTINCT id, unnest(framework_ids) AS f FROM compliance_events) e LEFT JOIN (VALUES ('HIPAA', 1), ('GDPR', 2), ('GLBA', 3)) r(item, rank) ON e.f = r.item) WHERE k = 1""")
def conflict_precedence(spark, d):
    """The framework that prevails for each event."""
    e = table(spark, d, "compliance_events", "id", "framework_ids").select("id", F.explode("framework_ids").alias("f"))
    order = spark.createDataFrame([("HIPAA", 1), ("GDPR", 2), ("GLBA", 3)], "item string, rank int")
    return graph.precedence(e, "id", "f", order)


@query("""WITH s AS (SELECT user_id, event_id, event_type, value, ts FROM events WHERE event_type IN ('view', 'click')) SELECT user_id, event_id, refers_to FROM (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refers_to FROM s) WHERE event_type = 'click'""")
def graph_antecedents(spark, d):
    """Each click with the user's nearest earlier view."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "ts").where("event_type in ('view', 'click')")
    m = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("sentence"), F.col("event_id").alias("start"), F.lit("e").alias("kind"), (F.col("event_type") == "click").alias("pronoun"), F.col("event_id").alias("text"))
    return graph.antecedents(m, "user_id", 1 << 60).select("user_id", F.col("start").alias("event_id"), "refers_to")


@query(f"SELECT chunk_id, CASE WHEN contains(lower(text), 'passport') THEN NULL ELSE regexp_replace(text, '{MAIL}', '[EMAIL]', 'g') END AS output, CASE WHEN contains(lower(text), 'passport') THEN 'block' END AS blocked_by FROM {_CH}")
def hook_interventions(spark, d):
    """A block list and a redaction run in order."""
    steps = [hooks.Intervention("block", blocks=lambda t: T.contains_any(t, ["passport"])), hooks.Intervention("redact", rewrites=lambda t: F.regexp_replace(t, MAIL, "[EMAIL]"))]
    return hooks.intervene(_chunks(spark, d), "text", steps).select("chunk_id", "output", "blocked_by")


@query("SELECT doc_id, CASE WHEN source = 'forum_dump' THEN 'p9' WHEN starts_with(source, 'vendor') THEN 'p2' WHEN starts_with(source, 'c') THEN 'p3' ELSE 'p1' END AS provider FROM documents WHERE source IS NOT NULL")
def hook_routing(spark, d):
    """Provider of each document's source."""
    r = hooks.route(table(spark, d, "documents", "doc_id", "source").where("source is not null"), "source", {"forum_dump": "p9"}, [("vendor", "p2"), ("complaint", "failed"), ("c", "p3")], "p1", ["failed"])
    return r.select("doc_id", "provider")


@query(f"""SELECT entry_id, CASE WHEN compliance_score < 0.2 THEN 'minimal' WHEN compliance_score < 0.4 THEN 'low' WHEN compliance_score < 0.7 THEN 'medium' ELSE 'high' END AS level FROM {_A} WHERE compliance_score IS NOT NULL""")
def score_levels(spark, d):
    """Scores in four levels."""
    level = S.ladder(F.col("compliance_score"), [(0.2, "minimal"), (0.4, "low"), (0.7, "medium")], "high")
    return _audit(spark, d, "compliance_score").where("compliance_score is not null").select("entry_id", level.alias("level"))


@query(f"""SELECT entry_id, round(sum(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.25 END * (pos % 2)) / sum(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.25 END), 6) AS score FROM (SELECT entry_id, v.severity AS severity, pos FROM (SELECT entry_id, unnest(violations) AS v, generate_subscripts(violations, 1) AS pos FROM {_A}) WHERE v IS NOT NULL) GROUP BY entry_id""")
def score_weighted_mean(spark, d):
    """Severity-weighted mean over an entry's rows (every second counts as met)."""
    v = _audit(spark, d, "violations").select("entry_id", F.posexplode("violations").alias("pos", "v")).where("v is not null")
    w = S.scale(F.col("v.severity"), S.REASONER, 0.25)
    return v.groupBy("entry_id").agg(F.round(F.sum(w * ((F.col("pos") + 1) % 2)) / F.sum(w), 6).alias("score"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, i, value AS ema FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, 0.9 * r.ema + 0.1 * o.value FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, round(arg_max(ema, i), 6) AS ema FROM r GROUP BY user_id""")
def score_moving_average(spark, d):
    """Exponential average of a user's purchases, seeded with the first."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events", "user_id", "ts", "event_id", "event_type", "value").where("event_type = 'purchase'")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    # the average is a sum whose weights follow from the place counted from the end
    placed = e.withColumns({"k": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("user_id"))})
    weight = F.pow(F.lit(0.9), F.col("k")) * F.when(F.col("k") == F.col("n") - 1, 1.0).otherwise(0.1)
    return placed.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 6).alias("ema"))


@query("""SELECT rule_id, tp, fp, f1 FROM (SELECT *, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (SELECT k.rule_id, count(*) FILTER (WHERE contains(lower(text), k.rule_id) AND toxic = 1) AS tp, count(*) FILTER (WHERE contains(lower(text), k.rule_id) AND toxic = 0) AS fp, count(*) FILTER (WHERE NOT contains(lower(text), k.rule_id) AND toxic = 1) AS fn
FROM doc_labels JOIN documents USING (doc_id), (VALUES ('you'), ('filthy'), ('audit'), ('the')) k(rule_id) WHERE text IS NOT NULL AND toxic IS NOT NULL GROUP BY k.rule_id))) WHERE (f1 < 0.5 AND tp > 0) OR fp > tp ORDER BY fp / greatest(tp, 1) DESC, f1, rule_id LIMIT 5""")
def rule_problematic(spark, d):
    """The rules that do worst (a top-k report)."""
    rated = table(spark, d, "doc_labels", "doc_id", "toxic").where("toxic is not null").join(_docs(spark, d), "doc_id")
    rows = rated.select("toxic", F.lower("text").alias("t"), F.explode(F.array(*[F.lit(k) for k in ("you", "filthy", "audit", "the")])).alias("rule_id"))
    c = reports.confusion(rows, ["rule_id"], F.contains("t", F.col("rule_id")), F.col("toxic") == 1)
    bad = c.where(((F.col("f1") < 0.5) & (F.col("tp") > 0)) | (F.col("fp") > F.col("tp")))
    return bad.orderBy(F.desc(F.col("fp") / F.greatest("tp", F.lit(1))), "f1", "rule_id").limit(5).select("rule_id", "tp", "fp", "f1")


@query()
def rule_sentence_kinds(spark, d):
    """Sentences of every language by whether they forbid, demand or allow; checked against a loop in the tests."""
    s = _docs(spark, d).select(F.explode(F.transform(T.sentences(F.col("text"), P.SPACE), lambda x: F.lower(x))).alias("s"))
    kind = F.when(F.col("s").rlike(r"(?:must not|may not|prohibited|no [^\n]* may be)"), "prohibition").when(F.col("s").rlike("(?:must|shall|have to|required)"), "obligation").when(F.col("s").rlike("(?:may|can|allowed)"), "permission").otherwise("other")
    return s.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, list_transform(regexp_extract_all(text, '\\b[Mm]ust [a-z]+'), lambda x: split_part(x, ' ', 2)) AS actions FROM documents WHERE regexp_matches(text, '\\b[Mm]ust [a-z]+')""")
def rule_required_actions(spark, d):
    """Words that follow a demand."""
    found = F.regexp_extract_all("text", F.lit(r"\b[Mm]ust ([a-z]+)"), F.lit(1))
    return _docs(spark, d).select("doc_id", found.alias("actions")).where(F.size("actions") > 0)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - round_even(x::DOUBLE / s, 0) * s, 2)))), 6) AS error FROM (SELECT vec_id, embedding, pow(2, ceil(log2(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))))) / 128 AS s FROM embeddings)""")
def vector_power_of_two_error(spark, d):
    """Distance to codes whose scale is a power of two."""
    v = F.col("embedding")
    scale = F.pow(F.lit(2.0), F.ceil(F.log2(V.peak(v)))) / 128
    diff = T.let(scale, lambda s: F.transform(v, lambda x: x.cast("double") - F.bround(x.cast("double") / s) * s))
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(V.norm(diff), 6).alias("error"))


@query("""SELECT vec_id, list_position(m, list_max(m))::INT - 1 AS best FROM (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 2 = 0 THEN -1e9 ELSE x::DOUBLE END) AS m FROM embeddings)""")
def vector_masked_argmax(spark, d):
    """Best entry when every second one is forbidden."""
    forbidden = F.array(*[F.lit(i) for i in range(0, 64, 2)])
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", T.let(V.mask(F.col("embedding"), forbidden), lambda m: (F.array_position(m, F.array_max(m)) - 1).cast("int")).alias("best"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def load_rollup(spark, d):
    """A roll-up over the largest table, as load."""
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", "l_shipdate").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def load_join(spark, d):
    """A join and roll-up of orders and customers, as load."""
    o, c = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice"), table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
