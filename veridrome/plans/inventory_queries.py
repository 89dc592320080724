"""Queries of single operators: groupings, histories, predicates, lookups, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridrome.functions import patterns as P
from veridrome.functions import scores as S
from veridrome.functions import text as T
from veridrome.functions import vectors as V
from veridrome.plans.entity_queries import _A, _CH, _V, _W, _audit, _chunks, _docs, _violations
from veridrome.plans.registry import registry
from veridrome.sources.tables import table

query, QUERIES, SQL = registry()
MAIL, PHONE = P.LOOSE["email"], P.LOOSE["phone"]


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


@query(f"SELECT severity, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules FROM {_V} WHERE severity IS NOT NULL AND rule_id IS NOT NULL GROUP BY severity")
def group_rules_by_severity(spark, d):
    """Rules of each severity as a list."""
    v = _violations(spark, d).where("severity is not null and rule_id is not null")
    return v.groupBy("severity").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


@query(f"SELECT event_type, rule_id, n, round(least(1.0, n / 10.0), 6) AS confidence FROM (SELECT event_type, rule_id, count(*) AS n FROM {_V} WHERE rule_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL) WHERE n >= 3")
def group_frequent_rules(spark, d):
    """Rules with three hits or more for a type of event, with a confidence that grows to one."""
    v = _violations(spark, d, "event_type").where("rule_id is not null and event_type is not null")
    n = v.groupBy("event_type", "rule_id").agg(_n()).where("n >= 3")
    return n.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 10.0), 6))


@query("""WITH c AS (SELECT kind, count(*) AS n FROM (SELECT id, coalesce(content_type, CASE WHEN content LIKE '%<%' THEN 'html' ELSE 'unknown' END) AS kind FROM content_events GROUP BY ALL) GROUP BY kind)
SELECT kind, n, round(sum(n) OVER (ORDER BY n DESC, kind) / sum(n) OVER (), 6) AS share FROM c""")
def group_type_coverage(spark, d):
    """Types of content, given or inferred, with the cumulative share of the more frequent ones."""
    c = table(spark, d, "content_events", "id", "content_type", "content")
    kind = F.coalesce("content_type", F.when(F.col("content").contains("<"), "html").otherwise("unknown"))
    n = c.select("id", kind.alias("kind")).distinct().groupBy("kind").agg(_n())  # a row a type from here on
    w = Window.orderBy(F.desc("n"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("share", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query(f"SELECT rule_id, array_to_string(list(matched_content ORDER BY k), '|') AS examples FROM (SELECT rule_id, matched_content, row_number() OVER (PARTITION BY rule_id ORDER BY entry_id DESC, pos) AS k FROM {_V} WHERE rule_id IS NOT NULL AND matched_content IS NOT NULL) WHERE k <= 3 GROUP BY rule_id")
def group_last_examples(spark, d):
    """The last three examples of each rule."""
    v = _violations(spark, d).where("rule_id is not null and matched_content is not null")
    k = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("entry_id"), "pos"))
    few = v.withColumn("k", k).where("k <= 3")
    return few.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "matched_content"))), lambda x: x["matched_content"]), "|").alias("examples"))


@query(f"SELECT framework_id, rule_id, count(*) AS n_uses, count(DISTINCT entry_id) AS n_entries FROM {_V} WHERE rule_id IS NOT NULL GROUP BY ALL")
def group_rule_usage(spark, d):
    """Uses of each rule per framework."""
    return _violations(spark, d, "framework_id").where("rule_id is not null").groupBy("framework_id", "rule_id").agg(_n("n_uses"), F.count_distinct("entry_id").alias("n_entries"))


@query(f"SELECT coalesce(type, 'none') AS type, coalesce(severity, 'none') AS severity, count(*) AS n FROM {_V} GROUP BY ALL")
def group_violation_histogram(spark, d):
    """Violations by type and severity."""
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return _violations(spark, d).groupBy(none("type"), none("severity")).agg(_n())


@query("""WITH t AS (SELECT DISTINCT id, rule_id, (result->>'$.is_compliant')::BOOLEAN AS ok, (result->>'$.score')::DOUBLE AS score, completed FROM rule_tasks)
SELECT rule_id, coalesce(bool_and(ok) FILTER (WHERE completed), true) AS compliant, round(avg(score) FILTER (WHERE completed), 6) AS mean_score, count(*) FILTER (WHERE completed) AS n_done, count(*) AS n FROM t GROUP BY rule_id""")
def group_task_results(spark, d):
    """All compliant, and mean score, over the finished tasks of each rule."""
    t = table(spark, d, "rule_tasks", "id", "rule_id", "result", "completed")
    t = t.select("id", "rule_id", F.get_json_object("result", "$.is_compliant").cast("boolean").alias("ok"), F.get_json_object("result", "$.score").cast("double").alias("score"), "completed").distinct()
    done = F.col("completed")
    return t.groupBy("rule_id").agg(F.coalesce(F.every(F.when(done, F.col("ok"))), F.lit(True)).alias("compliant"), F.round(F.avg(F.when(done, F.col("score"))), 6).alias("mean_score"), F.count_if(done).alias("n_done"), _n())


@query("SELECT framework, count(DISTINCT region) AS n_regions, count(DISTINCT region) > 1 AS many FROM (SELECT region, unnest(frameworks) AS framework FROM sources) WHERE framework IS NOT NULL GROUP BY framework")
def group_framework_regions(spark, d):
    """Frameworks whose sources lie in several regions."""
    s = table(spark, d, "sources", "region", "frameworks").select("region", F.explode("frameworks").alias("framework")).where("framework is not null")
    n = F.count_distinct("region")
    return s.groupBy("framework").agg(n.alias("n_regions"), (n > 1).alias("many"))


@query("SELECT region, name, last FROM (SELECT region, name, added_at AS last, row_number() OVER (PARTITION BY region ORDER BY added_at DESC NULLS LAST, name) AS k FROM sources WHERE region IS NOT NULL) WHERE k = 1")
def group_newest_source(spark, d):
    """The source of each region that was added last."""
    w = Window.partitionBy("region").orderBy(F.desc_nulls_last("added_at"), "name")
    s = table(spark, d, "sources", "region", "name", "added_at").where("region is not null").withColumn("k", F.row_number().over(w))
    return s.where("k = 1").select("region", "name", F.col("added_at").alias("last"))


@query(f"""SELECT file_id, count(*) AS n_chunks, sum(n_mail)::BIGINT AS n_mail, sum(n_phone)::BIGINT AS n_phone, round(CASE WHEN sum(size) = 0 THEN 0 ELSE (sum(n_mail) + sum(n_phone)) / sum(size) END, 9) AS ratio
FROM (SELECT DISTINCT file_id, chunk_id, len(regexp_extract_all(text, '{MAIL}')) AS n_mail, len(regexp_extract_all(text, '{PHONE}')) AS n_phone, length(text) AS size FROM text_chunks WHERE text IS NOT NULL) GROUP BY file_id""")
def group_file_partials(spark, d):
    """Counts of chunks merged per file: sums, and the ratio computed again."""
    c = table(spark, d, "text_chunks", "file_id", "chunk_id", "text").where("text is not null")
    p = c.select("file_id", "chunk_id", P.count(F.col("text"), MAIL).alias("m"), P.count(F.col("text"), PHONE).alias("p"), F.length("text").alias("size")).distinct()
    m, q, size = F.sum("m"), F.sum("p"), F.sum("size")
    return p.groupBy("file_id").agg(_n("n_chunks"), m.alias("n_mail"), q.alias("n_phone"), F.round(F.when(size == 0, 0.0).otherwise((m + q) / size), 9).alias("ratio"))


@query("""SELECT user_id, id, k FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, id)::INT AS k FROM (SELECT user_id, id, min(timestamp) AS t FROM compliance_events WHERE user_id IS NOT NULL GROUP BY ALL)) WHERE k <= 5""")
def history_last_of_user(spark, d):
    """The last five events of each user."""
    e = table(spark, d, "compliance_events", "user_id", "id", "timestamp").where("user_id is not null").groupBy("user_id", "id").agg(F.min("timestamp").alias("t"))
    w = Window.partitionBy("user_id").orderBy(F.desc("t"), "id")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 5").select("user_id", "id", "k")


@query("SELECT id FROM (SELECT id, min(timestamp) AS t FROM content_events GROUP BY id) ORDER BY t DESC, id LIMIT 1000")
def history_last_events(spark, d):
    """The last thousand events (a top-k report)."""
    e = table(spark, d, "content_events", "id", "timestamp").groupBy("id").agg(F.min("timestamp").alias("t"))
    return e.orderBy(F.desc("t"), "id").limit(1000).select("id")


@query("""SELECT user_id, n FROM (SELECT user_id, count(DISTINCT id) AS n FROM compliance_events WHERE event_type = 'compliance_violation' AND user_id IS NOT NULL GROUP BY user_id) WHERE n >= 3""")
def history_repeat_users(spark, d):
    """Users with three violations or more."""
    e = table(spark, d, "compliance_events", "user_id", "id", "event_type").where("event_type = 'compliance_violation' and user_id is not null")
    return e.groupBy("user_id").agg(F.count_distinct("id").alias("n")).where("n >= 3")


@query("""WITH e AS (SELECT DISTINCT id, framework_ids FROM compliance_events), a AS (SELECT framework_id, count(DISTINCT entry_id) AS n_entries FROM audit_entries WHERE framework_id IS NOT NULL GROUP BY framework_id)
SELECT framework_id, n_entries, count(DISTINCT id) AS n_events FROM (SELECT id, unnest(framework_ids) AS framework_id FROM e) JOIN a USING (framework_id) GROUP BY ALL""")
def join_membership(spark, d):
    """Audit entries and events of each framework, which events hold in a list."""
    e = table(spark, d, "compliance_events", "id", "framework_ids").select("id", F.explode("framework_ids").alias("framework_id")).distinct()
    n = e.groupBy("framework_id").agg(_n("n_events"))
    a = table(spark, d, "audit_entries", "entry_id", "framework_id").where("framework_id is not null").groupBy("framework_id").agg(F.count_distinct("entry_id").alias("n_entries"))
    return a.join(n, "framework_id")


@query("""WITH w(name, place) AS (VALUES ('HIPAA', 1), ('GDPR', 2), ('CCPA', 3), ('NONE', 4)) SELECT place, name, count(DISTINCT id) AS n_updates FROM w LEFT JOIN (SELECT id, unnest(frameworks) AS name FROM updates) USING (name) GROUP BY ALL""")
def join_in_asked_order(spark, d):
    """Updates of the frameworks asked for, in the order of the request, missing ones with none."""
    asked = spark.createDataFrame([("HIPAA", 1), ("GDPR", 2), ("CCPA", 3), ("NONE", 4)], "name string, place int")
    n = table(spark, d, "updates", "id", "frameworks").select("id", F.explode("frameworks").alias("name")).groupBy("name").agg(F.count_distinct("id").alias("n"))
    return asked.join(n, "name", "left").select("place", "name", F.coalesce("n", F.lit(0)).alias("n_updates"))


@query("""SELECT t.id, t.rule_id, count(*) AS n_entries FROM (SELECT DISTINCT id, rule_id, framework_id FROM rule_tasks WHERE framework_id IS NOT NULL) t JOIN (SELECT DISTINCT entry_id, framework_id, event_type FROM audit_entries) a USING (framework_id) WHERE a.event_type = 'override' GROUP BY t.id, t.rule_id""")
def join_fan_out(spark, d):
    """For every task the overriding entries of its framework (counted before the join)."""
    t = table(spark, d, "rule_tasks", "id", "rule_id", "framework_id").where("framework_id is not null").distinct()
    a = table(spark, d, "audit_entries", "entry_id", "framework_id", "event_type").where("event_type = 'override'").distinct().groupBy("framework_id").agg(_n("n_entries"))
    return t.join(a, "framework_id").select("id", "rule_id", "n_entries")


_SPANS = f"SELECT chunk_id, s, s + length(h) AS e FROM (SELECT chunk_id, hits[i] AS h, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::INT AS s FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT chunk_id, regexp_extract_all(text, '{{0}}') AS hits, string_split_regex(text, '{{0}}') AS parts FROM {_CH})))"
NUMBER, LONG = "[0-9]+", r"[0-9][0-9.,-]*[0-9]"


@query(f"WITH a AS ({_SPANS.format(NUMBER)}), b AS ({_SPANS.format(LONG)}) SELECT DISTINCT chunk_id, a.s AS start_pos FROM a JOIN b USING (chunk_id) WHERE a.s <= b.e AND b.s <= a.e AND b.e - b.s > a.e - a.s")
def join_overlapping_spans(spark, d):
    """Numbers that overlap a longer one of the same text (ends included)."""
    c = _chunks(spark, d)
    span = lambda p, k: c.select("chunk_id", F.explode(P.matches(F.col("text"), p)).alias("m")).select("chunk_id", F.col("m.start").alias(f"{k}s"), F.col("m.end").alias(f"{k}e"))
    return span(NUMBER, "a").join(span(LONG, "b"), "chunk_id").where("as <= be and bs <= ae and be - bs > ae - as").select("chunk_id", F.col("as").alias("start_pos")).distinct()


@query(f"SELECT entry_id, coalesce(len(list_intersect(map_keys(metadata), ['domain', 'platform'])) = 2, false) AND NOT coalesce(metadata['domain'] = 'retail' AND metadata['platform'] = 'batch', false) AS allowed FROM {_A}")
def predicate_contexts(spark, d):
    """Entries with all contexts that are required and no combination that is forbidden."""
    m = F.col("metadata")
    both = F.size(F.array_intersect(F.map_keys(m), F.array(F.lit("domain"), F.lit("platform")))) == 2
    bad = (F.try_element_at(m, F.lit("domain")) == "retail") & (F.try_element_at(m, F.lit("platform")) == "batch")
    return _audit(spark, d, "metadata").select("entry_id", (F.coalesce(both, F.lit(False)) & ~F.coalesce(bad, F.lit(False))).alias("allowed"))


@query(f"SELECT doc_id, least(1.0, ({_W}) / 100.0) >= 0.5 AND contains(lower(text), 'data') AS topical, contains(lower(text), 'data') AND contains(lower(text), 'audit') AS combined FROM documents WHERE text IS NOT NULL")
def predicate_topics(spark, d):
    """Texts over a topic's threshold, and texts with a combination of topics."""
    t, has = F.col("text"), lambda w: F.lower("text").contains(w)
    return _docs(spark, d).select("doc_id", ((F.least(F.lit(1.0), T.word_count(t) / 100.0) >= 0.5) & has("data")).alias("topical"), (has("data") & has("audit")).alias("combined"))


@query("""SELECT id, array_to_string(list_filter([CASE WHEN json_type(c) IS DISTINCT FROM 'OBJECT' THEN 'type' END, CASE WHEN c->>'$.tz' IS NULL THEN 'tz required' END, CASE WHEN c->>'$.date_order' NOT IN ('dmy', 'mdy') THEN 'date_order' END,
CASE WHEN c->>'$.date_order' IS NOT NULL AND c->>'$.tz' IS NULL THEN 'tz with date_order' END, CASE WHEN length(c->>'$.tz') NOT BETWEEN 3 AND 20 THEN 'tz length' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT id, try_cast(parser_config AS JSON) AS c FROM sources)""")
def predicate_schema(spark, d):
    """Rules of a schema that a source's configuration breaks: type, required, choice, length, and required if."""
    c, at = F.col("parser_config"), lambda k: F.get_json_object("parser_config", f"$.{k}")
    is_object = F.coalesce(F.json_object_keys(c).isNotNull(), F.lit(False))
    checks = [(~is_object, "type"), (at("tz").isNull(), "tz required"), (~at("date_order").isin("dmy", "mdy"), "date_order"), (at("date_order").isNotNull() & at("tz").isNull(), "tz with date_order"), (~F.length(at("tz")).between(3, 20), "tz length")]
    return table(spark, d, "sources", "id", "parser_config").select("id", F.array_join(F.array_compact(F.array(*[F.when(k, F.lit(n)) for k, n in checks])), ",").alias("problems"))


@query(f"SELECT entry_id, count(*) AS n_exempt FROM (SELECT entry_id, rule_id, matched_content FROM {_V}) v JOIN (VALUES ('gdpr_03', '^[a-z]'), ('hipaa_01', 'a'), ('ccpa_02', '[0-9]')) x(rule_id, pattern) USING (rule_id) WHERE regexp_matches(matched_content, pattern) GROUP BY entry_id")
def predicate_exemptions(spark, d):
    """Violations whose rule has an exemption that their content matches."""
    rules = spark.createDataFrame([("gdpr_03", "^[a-z]"), ("hipaa_01", "a"), ("ccpa_02", "[0-9]")], "rule_id string, pattern string")
    v = _violations(spark, d).select("entry_id", "rule_id", "matched_content")
    return v.join(F.broadcast(rules), "rule_id").where("regexp_like(matched_content, pattern)").groupBy("entry_id").agg(_n("n_exempt"))


@query(f"SELECT entry_id, coalesce(framework_id IN ('HIPAA', 'GLBA'), false) OR coalesce(metadata['domain'] IN ('healthcare', 'finance'), false) AS high_risk FROM {_A}")
def predicate_high_risk(spark, d):
    """Entries of a risky framework or domain."""
    risky = F.coalesce(F.col("framework_id").isin("HIPAA", "GLBA"), F.lit(False)) | F.coalesce(F.try_element_at("metadata", F.lit("domain")).isin("healthcare", "finance"), F.lit(False))
    return _audit(spark, d, "framework_id", "metadata").select("entry_id", risky.alias("high_risk"))


@query("SELECT id, name FROM sources WHERE active AND list_contains(frameworks, 'GDPR') AND contains(lower(coalesce(name, '')), 'data')")
def predicate_lookup(spark, d):
    """Active sources of a framework by a part of their name, without case."""
    s = table(spark, d, "sources", "id", "name", "active", "frameworks").where("active")
    return s.where(F.array_contains("frameworks", "GDPR") & F.lower("name").contains("data")).select("id", "name")


_TOK = "list_filter(string_split_regex(lower(title), '[^a-z]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT DISTINCT title, {_TOK} AS ws FROM updates WHERE title IS NOT NULL), g AS (SELECT ws[i] AS gram, 1 AS n FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM w) UNION ALL SELECT ws[i] || ' ' || ws[i + 1], 2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1))
SELECT n::INT AS n, count(*) AS n_grams, count(DISTINCT gram) AS n_distinct FROM g GROUP BY n""")
def scalar_ngrams(spark, d):
    """N-grams of titles up to two words."""
    u = table(spark, d, "updates", "title").where("title is not null").distinct()
    ws = F.filter(F.split(F.lower("title"), "[^a-z]+"), lambda x: x != "")
    g = u.select(F.explode(T.ngrams_upto(ws, 2)).alias("gram"))
    return g.groupBy(F.when(F.col("gram").contains(" "), 2).otherwise(1).alias("n")).agg(_n("n_grams"), F.count_distinct("gram").alias("n_distinct"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_TOK}, lambda w: CASE w WHEN 'banks' THEN 'lenders' WHEN 'map' THEN 'inventory' WHEN 'audit' THEN 'review' WHEN 'register' THEN 'list' END), lambda x: x IS NOT NULL))), ',') AS synonyms FROM (SELECT DISTINCT id, title FROM updates WHERE title IS NOT NULL)")
def scalar_synonyms(spark, d):
    """Synonyms of the words of a title by a map."""
    pairs = {"banks": "lenders", "map": "inventory", "audit": "review", "register": "list"}
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    u = table(spark, d, "updates", "id", "title").where("title is not null").distinct()
    ws = F.filter(F.split(F.lower("title"), "[^a-z]+"), lambda x: x != "")
    return u.select("id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(ws, lambda w: F.try_element_at(m, w))))), ",").alias("synonyms"))


@query(f"WITH a AS ({_SPANS.format(MAIL)}) SELECT chunk_id, s AS start_pos, substring(text, greatest(s - 20, 0) + 1, s - greatest(s - 20, 0)) AS before, substring(text, e + 1, 20) AS behind FROM a JOIN {_CH} USING (chunk_id)")
def scalar_sides(spark, d):
    """Twenty characters on either side of each e-mail address."""
    m = _chunks(spark, d).select("chunk_id", "text", F.explode(P.matches(F.col("text"), MAIL)).alias("m"))
    s, e = F.col("m.start"), F.col("m.end")
    low = F.greatest(s - 20, F.lit(0))
    return m.select("chunk_id", s.alias("start_pos"), F.substring("text", low + 1, s - low).alias("before"), F.substring("text", e + 1, F.lit(20)).alias("behind"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(r, 'gdpr') THEN 'privacy' WHEN contains(r, 'hipaa') THEN 'health' WHEN contains(r, 'glba') OR contains(r, 'pci') THEN 'finance' ELSE 'other' END AS kind FROM (SELECT lower(rule_id) AS r FROM {_V} WHERE rule_id IS NOT NULL)) GROUP BY kind")
def scalar_rule_kinds(spark, d):
    """Rules by a ladder of parts of their ids."""
    r = F.lower("rule_id")
    kind = F.when(r.contains("gdpr"), "privacy").when(r.contains("hipaa"), "health").when(r.contains("glba") | r.contains("pci"), "finance").otherwise("other")
    return _violations(spark, d).where("rule_id is not null").groupBy(kind.alias("kind")).agg(_n())


_SEV = {"n_gram": S.NGRAM, "entity": S.ENTITY, "exponent": S.EXPONENT, "penalty": S.PENALTY}


@query(f"SELECT entry_id, pos::INT AS pos, " + ", ".join(f"CASE severity {' '.join(f'''WHEN '{k}' THEN {float(x)}''' for k, x in m.items())} ELSE 0 END::DOUBLE AS {n}" for n, m in _SEV.items()) + f" FROM {_V}")
def scalar_severity_scales(spark, d):
    """A severity on four scales."""
    return _violations(spark, d).select("entry_id", "pos", *[F.coalesce(S.scale(F.col("severity"), {k: float(x) for k, x in m.items()}), F.lit(0.0)).alias(n) for n, m in _SEV.items()])


@query(f"SELECT entry_id, least(0.99, round(0.5 + list_sum(list_transform(violations, lambda v: CASE v.severity WHEN 'critical' THEN 0.1 WHEN 'high' THEN 0.05 WHEN 'medium' THEN 0.02 ELSE 0 END)), 6)) AS confidence, md5(content_hash || ':' || event_type) AS cache_key FROM {_A} WHERE violations IS NOT NULL AND len(violations) > 0")
def scalar_confidence(spark, d):
    """A base raised by the severities, at most .99, and the key of a cache."""
    step = lambda v: F.coalesce(S.scale(v["severity"], {"critical": 0.1, "high": 0.05, "medium": 0.02}), F.lit(0.0))
    a = _audit(spark, d, "violations", "content_hash", "event_type").where("violations is not null and size(violations) > 0")
    return a.select("entry_id", F.least(F.lit(0.99), F.round(F.aggregate("violations", F.lit(0.5), lambda s, v: s + step(v)), 6)).alias("confidence"), F.md5(F.concat("content_hash", F.lit(":"), "event_type")).alias("cache_key"))


_FIVE = ["audit", "data", "plan", "review", "record"]


@query("SELECT doc_id, CASE WHEN greatest(" + ", ".join(f"n{i}" for i in range(5)) + ") = 0 THEN 'none' " + " ".join(f"WHEN n{i} = greatest({', '.join(f'n{j}' for j in range(5))}) THEN '{w}'" for i, w in enumerate(_FIVE)) + " END AS most FROM (SELECT doc_id, " + ", ".join(f"(length(lower(text)) - length(replace(lower(text), ' {w} ', ''))) // {len(w) + 2} AS n{i}" for i, w in enumerate(_FIVE)) + " FROM documents WHERE text IS NOT NULL)")
def scalar_most_frequent_term(spark, d):
    """The term between spaces that occurs most in a text; the first of equals."""
    return _docs(spark, d).select("doc_id", T.argmax({w: T.plain_count(F.col("text"), f" {w} ") for w in _FIVE}, "none").alias("most"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(text, '"([^"\\n]{2,60})"', 1), '|') AS quoted FROM documents WHERE regexp_matches(text, '"[^"\\n]{2,60}"')""")
def scalar_quoted_terms(spark, d):
    """Quoted terms of texts."""
    q = F.regexp_extract_all("text", F.lit('"([^"\\n]{2,60})"'), F.lit(1))
    return _docs(spark, d).select("doc_id", q.alias("q")).where(F.size("q") > 0).select("doc_id", F.array_join("q", "|").alias("quoted"))


@query(f"SELECT doc_id, round(least(1.0, (2.0 * len(regexp_extract_all(lower(text), 'audit')) + 1.0 * len(regexp_extract_all(lower(text), 'plan'))) / 3.0 / 5), 6) AS weighted, least(0.2, round(0.05 * len(regexp_extract_all(lower(text), 'risk')), 6)) AS added FROM documents WHERE text IS NOT NULL")
def scalar_pattern_weights(spark, d):
    """Weighted mean of pattern counts, and what further matches add."""
    n = lambda w: F.regexp_count(F.lower("text"), F.lit(w))
    return _docs(spark, d).select("doc_id", F.round(F.least(F.lit(1.0), (2.0 * n("audit") + n("plan")) / 3.0 / 5), 6).alias("weighted"), F.least(F.lit(0.2), F.round(0.05 * n("risk"), 6)).alias("added"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - (round_even((x::DOUBLE - lo) / s, 0) * s + lo), 2)))), 6) AS error FROM (SELECT vec_id, embedding, lo, (hi - lo) / 255 AS s FROM (SELECT vec_id, embedding, list_min(list_transform(embedding, lambda x: x::DOUBLE)) AS lo, list_max(list_transform(embedding, lambda x: x::DOUBLE)) AS hi FROM embeddings))""")
def vector_affine_error(spark, d):
    """Distance to eight-bit codes with a scale and a zero point."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    span = F.struct(F.array_min(v).alias("lo"), ((F.array_max(v) - F.array_min(v)) / 255).alias("s"))
    diff = T.let(span, lambda k: F.transform(v, lambda x: x - (F.bround((x - k["lo"]) / k["s"]) * k["s"] + k["lo"])))
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(V.norm(diff), 6).alias("error"))


@query("SELECT label, round(avg(list_sum(list_transform(embedding, lambda x, i: abs(x::DOUBLE) * CASE WHEN i <= 8 THEN 2 ELSE 1 END))), 6) AS importance FROM embeddings GROUP BY label")
def vector_importance(spark, d):
    """Summed sizes of the weights, doubled where the layer matters."""
    one = lambda x, i: F.abs(x.cast("double")) * F.when(i < 8, 2.0).otherwise(1.0)
    s = F.aggregate(F.transform("embedding", one), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings", "label", "embedding").groupBy("label").agg(F.round(F.avg(s), 6).alias("importance"))


@query(f"SELECT chunk_id, array_to_string(list_transform(string_split(text, '. '), lambda s: CASE WHEN regexp_matches(s, '{MAIL}') THEN 'Please note: ' || s ELSE s END), '. ') AS toned FROM {_CH}")
def rewrite_by_sentence(spark, d):
    """Sentences with an address opened by a phrase, the others as they are."""
    return _chunks(spark, d).select("chunk_id", F.array_join(F.transform(F.split("text", r"\. ", -1), lambda s: F.when(s.rlike(MAIL), F.concat(F.lit("Please note: "), s)).otherwise(s)), ". ").alias("toned"))


@query(f"WITH a AS (SELECT chunk_id, s, e, row_number() OVER (PARTITION BY chunk_id ORDER BY s) AS k FROM ({_SPANS.format(MAIL)})) SELECT chunk_id, substring(text, 1, s) || '[MOVED]' || substring(text, e + 1) AS put_back FROM a JOIN {_CH} USING (chunk_id) WHERE k = 1")
def rewrite_reinsert(spark, d):
    """A rewritten piece put back where the first address stood."""
    m = _chunks(spark, d).withColumn("m", F.get(P.matches(F.col("text"), MAIL), F.lit(0))).where("m is not null")
    return m.select("chunk_id", F.concat(F.substring("text", F.lit(1), F.col("m.start")), F.lit("[MOVED]"), F.substring("text", F.col("m.end") + 1, F.length("text"))).alias("put_back"))


@query("""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY w), p AS (SELECT w, n / (SELECT sum(n) FROM w) AS p FROM w)
SELECT w AS token, round(p, 6) AS p FROM p WHERE p >= 0.001 ORDER BY p DESC, w LIMIT 100""")
def select_likely_tokens(spark, d):
    """Words of at least a thousandth of all, the hundred most likely (a top-k report)."""
    n = _docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(_n())
    total = n.agg(F.sum("n").alias("total")).first().total or 1  # one number
    p = n.select(F.col("w").alias("token"), (F.col("n") / total).alias("p")).where("p >= 0.001")
    return p.orderBy(F.desc("p"), "token").limit(100).withColumn("p", F.round("p", 6))


@query("SELECT DISTINCT id, array_to_string(list_transform(list_sort(list_transform(tags, lambda t: {'n': -length(t), 't': t})), lambda x: x.t), '|') AS ordered FROM updates WHERE tags IS NOT NULL AND NOT list_contains(list_transform(tags, lambda t: t IS NULL), true)")
def order_longest_first(spark, d):
    """Tags of an update, the longest first."""
    u = table(spark, d, "updates", "id", "tags").where("tags is not null").where(~F.exists("tags", lambda t: t.isNull()))
    s = F.array_sort(F.transform("tags", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return u.select("id", F.array_join(F.transform(s, lambda x: x["t"]), "|").alias("ordered")).distinct()


_TOPICS = ["risk", "consent", "audit", "health", "credit"]


@query("SELECT doc_id, " + ", ".join(f"round(least(1.0, ((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}) / 10.0), 6) AS {t}" for t in _TOPICS) + ", " + " OR ".join(f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}) / 10.0 + 0.1 > 0.5" for t in _TOPICS[:2]) + " AS drifts FROM documents WHERE text IS NOT NULL")
def gate_topic_state(spark, d):
    """Five topics of a text by their counts, and whether one more mention takes one of two over a bound."""
    n = {t: T.plain_count(F.col("text"), t) / 10.0 for t in _TOPICS}
    drifts = (n["risk"] + 0.1 > 0.5) | (n["consent"] + 0.1 > 0.5)
    return _docs(spark, d).select("doc_id", *[F.round(F.least(F.lit(1.0), x), 6).alias(t) for t, x in n.items()], drifts.alias("drifts"))


@query(f"SELECT entry_id, pos::INT AS pos, coalesce(severity = 'high', false) AND coalesce(rule_id LIKE 'gdpr%', false) AS fits FROM {_V}")
def relation_type_match(spark, d):
    """Violations whose kinds are equal to a pattern's, place by place; a null in the pattern takes any."""
    pattern = [None, "high", "gdpr"]
    given = [F.col("type"), F.col("severity"), F.substring("rule_id", 1, 4)]
    fits = F.lit(True)
    for want, got in zip(pattern, given):
        if want is not None:
            fits = fits & F.coalesce(got == want, F.lit(False))
    return _violations(spark, d).select("entry_id", "pos", fits.alias("fits"))


@query(f"""WITH s AS (SELECT framework_id, avg(compliance_score) FILTER (WHERE timestamp < TIMESTAMPTZ '2024-01-04 00:00:00+00') AS b, avg(compliance_score) FILTER (WHERE timestamp >= TIMESTAMPTZ '2024-01-04 00:00:00+00') AS a FROM {_A} WHERE framework_id IS NOT NULL GROUP BY framework_id)
SELECT framework_id, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS change, round(CASE WHEN b <> 0 THEN (a - b) / b * 100 END, 6) AS relative FROM s""")
def report_change(spark, d):
    """Mean scores of each framework before and after a day, their change, and its share."""
    a = _audit(spark, d, "framework_id", "compliance_score", "timestamp").where("framework_id is not null")
    early = F.col("timestamp") < F.lit("2024-01-04").cast("timestamp")
    s = a.groupBy("framework_id").agg(F.avg(F.when(early, F.col("compliance_score"))).alias("b"), F.avg(F.when(~early, F.col("compliance_score"))).alias("a"))
    diff = F.col("a") - F.col("b")
    return s.select("framework_id", F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), F.round(diff, 6).alias("change"), F.round(F.when(F.col("b") != 0, diff / F.col("b") * 100), 6).alias("relative"))


@query(f"""WITH h AS (SELECT lower(matched_content) AS form, coalesce(type, 'none') AS type, count(*) AS n FROM {_V} WHERE matched_content IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, type) AS r, count(*) OVER (PARTITION BY form) AS n_types FROM h) SELECT form, type, n_types FROM k WHERE r = 1 AND n_types > 1""")
def entity_ambiguous_forms(spark, d):
    """Forms that occur with several types, and the type that most of them have."""
    h = _violations(spark, d).where("matched_content is not null").groupBy(F.lower("matched_content").alias("form"), F.coalesce("type", F.lit("none")).alias("type")).agg(_n())
    best = F.min_by("type", F.struct(-F.col("n"), "type"))
    return h.groupBy("form").agg(best.alias("type"), F.count(F.lit(1)).alias("n_types")).where("n_types > 1").select("form", "type", "n_types")
