"""Queries over entities, relations, concepts, feedback on rules and choice of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridrome.functions import entities as E
from veridrome.functions import patterns as P
from veridrome.functions import text as T
from veridrome.operators import selection
from veridrome.plans.registry import registry
from veridrome.sources.tables import table

query, QUERIES, SQL = registry()
MAIL, SSN, PHONE = P.LOOSE["email"], P.LOOSE["ssn"], P.LOOSE["phone"]
DETAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9.-]+[0-9]"
_CH = "(SELECT DISTINCT chunk_id, text FROM text_chunks WHERE text IS NOT NULL)"
_A = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY entry_id) AS rn FROM audit_entries) WHERE rn = 1)"
_W = "CASE WHEN trim(regexp_replace(text, '[\\x09-\\x0D ]+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\\x09-\\x0D ]+', ' ', 'g'), ' '), ' ')) END"


def _chunks(spark, d):
    return table(spark, d, "text_chunks", "chunk_id", "text").where("text is not null").distinct()


def _docs(spark, d, *more):
    return table(spark, d, "documents", "doc_id", "text", *more).where("text is not null")


def _audit(spark, d, *columns):
    return table(spark, d, "audit_entries", "entry_id", *columns).dropDuplicates(["entry_id"])


def _violations(spark, d, *more):
    a = _audit(spark, d, "violations", *more)
    return a.select("entry_id", *more, F.posexplode("violations").alias("pos", "v")).where("v is not null").select("entry_id", *more, "pos", "v.*")


_V = f"(SELECT entry_id, metadata, compliance_score, event_type, user_id, framework_id, session_id, pos, v.* FROM (SELECT *, unnest(violations) AS v, generate_subscripts(violations, 1) - 1 AS pos FROM {_A}) WHERE v IS NOT NULL)"
RULES = {"PII": (["email", "phone"], [MAIL, SSN]), "identifier": (["case", "number"], [r"^\d{5,}"]), "quantity": (["percent", "costs"], [r"^\d+\.\d+$"])}


def _cls(hit: str, around: str) -> str:
    def one(keys, patterns):
        k = " OR ".join(f"contains(lower({x}), '{w}')" for w in keys for x in (hit, around))
        return f"least(1.0, CASE WHEN {k} THEN 0.3 ELSE 0 END + CASE WHEN {' OR '.join(f'''regexp_matches({hit}, '(?i){p}')''' for p in patterns)} THEN 0.7 ELSE 0 END)::DOUBLE"

    return ", ".join(f"{one(*r)} AS s{i}" for i, r in enumerate(RULES.values()))


_CLASSES = f"""c AS (SELECT chunk_id, hit, {_cls('hit', 'text')} FROM (SELECT chunk_id, text, unnest(regexp_extract_all(text, '{DETAIL}')) AS hit FROM {_CH})),
k AS (SELECT chunk_id, hit, greatest(s0, s1, s2) AS best, CASE WHEN greatest(s0, s1, s2) = 0 THEN 'UNKNOWN' WHEN s0 = greatest(s0, s1, s2) THEN 'PII' WHEN s1 = greatest(s0, s1, s2) THEN 'identifier' ELSE 'quantity' END AS type FROM c),
e AS (SELECT chunk_id, hit, type, CASE WHEN best > 0 THEN best ELSE 0.5 END AS confidence FROM k)"""


def _classified(spark, d):
    hits = _chunks(spark, d).select("chunk_id", "text", F.explode(F.regexp_extract_all("text", F.lit(DETAIL), F.lit(0))).alias("hit"))
    return hits.select("chunk_id", "hit", E.rule_class(F.col("hit"), F.col("text"), RULES).alias("k")).select("chunk_id", "hit", "k.*")


@query(f"WITH {_CLASSES} SELECT type, round(confidence, 6) AS confidence, count(*) AS n_entities FROM e GROUP BY ALL")
def entity_classes(spark, d):
    """Entities of texts classified by rules: the best score wins, the earlier rule on ties."""
    return _classified(spark, d).groupBy("type", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n_entities"))


@query(f"""WITH {_CLASSES} SELECT type, count(*) AS n_entities, round(avg(greatest(0, least(1, CASE WHEN type = 'PII' THEN 0.3 - (confidence - 0.5) * 0.2 - CASE WHEN contains(hit, '@') THEN 0.1 ELSE 0 END ELSE 0.9 + (confidence - 0.5) * 0.2 END))), 6) AS mean_score
FROM e GROUP BY type""")
def entity_scores(spark, d):
    """Mean compliance of entities per type; addresses count as linked."""
    s = E.entity_score(F.col("type"), F.col("confidence"), F.col("hit").contains("@"))
    return _classified(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n_entities"), F.round(F.avg(s), 6).alias("mean_score"))


@query(f"""WITH m AS (SELECT chunk_id, text, regexp_extract_all(text, '{MAIL}') AS hits, string_split_regex(text, '{MAIL}') AS parts FROM {_CH}),
x AS (SELECT chunk_id, text, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT chunk_id, text, hits[i] AS hit, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s FROM x)
SELECT chunk_id, s::INT AS start_pos, length(hit)::INT AS n_chars, round(len(regexp_extract_all(hit, '[A-Z]')) / length(hit), 6) AS capitals, round(len(regexp_extract_all(hit, '[0-9]')) / length(hit), 6) AS digits,
round(len(regexp_extract_all(hit, '[^A-Za-z0-9]')) / length(hit), 6) AS signs, round(s / length(text), 6) AS place FROM s""")
def entity_shapes(spark, d):
    """Length, shares of capitals, digits and signs, and place of every e-mail address."""
    m = _chunks(spark, d).select("chunk_id", F.length("text").alias("n"), F.explode(P.matches(F.col("text"), MAIL)).alias("m"))
    s = m.select("chunk_id", F.col("m.start").alias("start_pos"), E.shape(F.col("m.text"), F.col("m.start"), F.col("n")).alias("s"))
    return s.select("chunk_id", "start_pos", "s.n_chars", *[F.round(f"s.{c}", 6).alias(c) for c in ("capitals", "digits", "signs", "place")])


def _verbs(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} = '{k}' THEN '{r}'" for k, r in E.VERBS.items()) + " " + " ".join(f"WHEN contains({w}, '{k}') THEN '{r}'" for k, r in E.VERBS.items()) + " ELSE 'related_to' END"


@query(f"""SELECT relation, count(*) AS n_words, count(DISTINCT w) AS n_forms FROM (SELECT w, {_verbs('w')} AS relation FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL)) GROUP BY relation""")
def relation_types(spark, d):
    """Words of all documents by the relation they stand for."""
    w = _docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    counts = w.groupBy("w").agg(F.count(F.lit(1)).alias("n"))  # a word is mapped once
    return counts.groupBy(E.relation_type(F.col("w")).alias("relation")).agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_forms"))


_REL = f"""r AS (SELECT entry_id, pos, rule_id, CASE severity WHEN 'critical' THEN 'discloses' WHEN 'high' THEN 'works_for' WHEN 'medium' THEN 'part_of' ELSE 'mentions' END AS relation, CASE type WHEN 'regex' THEN 'regex_pattern' WHEN 'keyword' THEN 'dependency_parsing' ELSE 'other' END AS method,
CASE WHEN user_id IS NOT NULL THEN 'PERSON' ELSE 'PII' END AS source, CASE WHEN framework_id IS NOT NULL THEN 'ORGANIZATION' ELSE 'UNKNOWN' END AS target, compliance_score AS score FROM {_V}),
f AS (SELECT *, greatest(0, least(1, CASE method WHEN 'regex_pattern' THEN 0.7 WHEN 'dependency_parsing' THEN 0.8 ELSE 0.6 END + CASE WHEN relation = 'works_for' THEN CASE WHEN source = 'PERSON' AND target = 'ORGANIZATION' THEN 0.1 ELSE -0.2 END ELSE 0 END
+ coalesce(((score + score) / 2 - 0.5) * 0.2, 0))) AS confidence FROM r)"""


def _relations(spark, d):
    v = _violations(spark, d, "user_id", "framework_id", "compliance_score")
    pick = lambda c, m, o: F.coalesce(*[F.when(F.col(c) == k, x) for k, x in m.items()], F.lit(o))
    r = v.select(
        "entry_id", "pos", "rule_id", pick("severity", {"critical": "discloses", "high": "works_for", "medium": "part_of"}, "mentions").alias("relation"), pick("type", {"regex": "regex_pattern", "keyword": "dependency_parsing"}, "other").alias("method"),
        F.when(F.col("user_id").isNotNull(), "PERSON").otherwise("PII").alias("source"), F.when(F.col("framework_id").isNotNull(), "ORGANIZATION").otherwise("UNKNOWN").alias("target"), F.col("compliance_score").alias("score"),
    )
    return r.withColumn("confidence", E.relation_confidence(*[F.col(c) for c in ("relation", "method", "source", "target", "score", "score")]))


@query(f"WITH {_REL} SELECT entry_id, pos::INT AS pos, relation, round(confidence, 6) AS confidence FROM f")
def relation_confidences(spark, d):
    """Confidence of the relation that a violation stands for."""
    return _relations(spark, d).select("entry_id", "pos", "relation", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_REL} SELECT relation, count(*) AS n, round(avg(greatest(0, least(1, CASE relation WHEN 'discloses' THEN 0.4 WHEN 'works_for' THEN 0.6 WHEN 'part_of' THEN 0.8 ELSE 0.7 END - CASE WHEN source = 'PII' THEN 0.2 ELSE 0 END + (confidence - 0.5) * 0.2))), 6) AS mean_score
FROM f GROUP BY relation""")
def relation_scores(spark, d):
    """Mean compliance per relation."""
    s = E.relation_score(F.col("relation"), F.col("source"), F.col("target"), F.col("confidence"))
    return _relations(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean_score"))


@query(f"WITH {_REL} SELECT relation, source, target, rule_id, round(max(confidence), 6) AS confidence FROM f GROUP BY relation, source, target, rule_id")
def relation_union(spark, d):
    """Relations of one kind between the same ends once, with the highest confidence."""
    return _relations(spark, d).groupBy("relation", "source", "target", "rule_id").agg(F.round(F.max("confidence"), 6).alias("confidence"))


CONCEPTS = {"consent": ["(?i)consent", "(?i)permission"], "data_retention": ["(?i)retention", "(?i)archiv"], "harmful_threat": ["(?i)kill", "(?i)hurt"], "topic_audit": ["(?i)audit"]}
FRAMEWORKS = {"GDPR": ["consent", "data retention", "erasure"], "GLBA": ["audit", "retention"]}


def _act(ps) -> str:
    n = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in ps)
    return f"CASE WHEN {n} > 0 THEN least(1.0, ({n}) * 20.0 / greatest(1, {_W})) ELSE 0 END"


@query(" UNION ALL ".join(f"SELECT doc_id, '{c}' AS concept, round(a, 6) AS activation FROM (SELECT doc_id, {_act(ps)} AS a FROM documents WHERE text IS NOT NULL) WHERE a > 0" for c, ps in CONCEPTS.items()))
def concept_activations(spark, d):
    """Concepts of each document by the matches of their patterns for every twenty words."""
    rows = F.array(*[F.struct(F.lit(c).alias("concept"), F.round(E.activation(F.col("text"), ps), 6).alias("activation")) for c, ps in CONCEPTS.items()])
    return _docs(spark, d).select("doc_id", F.explode(rows).alias("c")).select("doc_id", "c.*").where("activation > 0")


@query(" UNION ALL ".join(f"SELECT '{c}' AS concept, count(*) FILTER (WHERE a > 0) AS n_docs, round(avg(greatest(0, least(1, {s}))) FILTER (WHERE a > 0), 6) AS mean_score FROM (SELECT {_act(CONCEPTS[c])} AS a FROM documents WHERE text IS NOT NULL)" for c, s in (("consent", "0.7 + 0.1 * 0.3"), ("harmful_threat", "1 - a - 0.1 * 0.2"), ("topic_audit", "0.8 + 0.1 * 0.3"))))
def concept_scores(spark, d):
    """Mean compliance of three concepts over the documents that show them."""
    sure = {"consent": 0.8, "harmful_threat": 0.7, "topic_audit": 0.8}
    rows = F.array(*[F.struct(F.lit(c).alias("concept"), E.activation(F.col("text"), CONCEPTS[c]).alias("a")) for c in sure])
    x = _docs(spark, d).select(F.explode(rows).alias("c")).select("c.*")
    score = F.coalesce(*[F.when(F.col("concept") == c, E.concept_score(c, F.col("a"), F.lit(s))) for c, s in sure.items()])
    on = F.col("a") > 0
    return x.groupBy("concept").agg(F.sum(on.cast("long")).alias("n_docs"), F.round(F.avg(F.when(on, score)), 6).alias("mean_score"))


def _fw(f: str) -> str:
    return "(" + " + ".join(f"CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), '{c.replace(' ', '_')}'))) > 0 THEN 1 ELSE 0 END" for c in FRAMEWORKS[f]) + f") / {len(FRAMEWORKS[f])}.0"


@query(f"SELECT DISTINCT id, round({_fw('GDPR')}, 6) AS gdpr, round({_fw('GLBA')}, 6) AS glba FROM (SELECT id, list_transform(string_split(lower(coalesce(title, '')), ' '), lambda x: x) AS tags FROM updates)")
def concept_framework_shares(spark, d):
    """Share of each framework's concepts that an update's title shows."""
    words = F.split(F.lower(F.coalesce("title", F.lit(""))), " ")
    return table(spark, d, "updates", "id", "title").select("id", *[F.round(E.framework_share(words, FRAMEWORKS[f]), 6).alias(f.lower()) for f in FRAMEWORKS]).distinct()


@query(f"""WITH k AS (SELECT doc_id, 'risk' AS concept, least(1.0, len(regexp_extract_all(text, '(?i)risk')) / 10.0) AS activation, 0.8 AS confidence, 'keyword' AS method FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?i)risk')
UNION ALL SELECT doc_id, 'risk', least(1.0, len(regexp_extract_all(text, '(?i)breach')) / 5.0), CASE WHEN contains(text, 'breach register') THEN 0.9 ELSE 0.7 END, 'related' FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?i)breach'))
SELECT doc_id, concept, round(max(activation), 6) AS activation, max(confidence)::DOUBLE AS confidence, arg_max(method, confidence) AS method, count(*) AS n_methods FROM k GROUP BY doc_id, concept""")
def concept_merge(spark, d):
    """A concept found in two ways: the higher activation, and method and confidence of the surer one."""
    t = _docs(spark, d)
    one = t.where(F.col("text").rlike("(?i)risk")).select("doc_id", F.lit("risk").alias("concept"), F.least(F.lit(1.0), F.regexp_count("text", F.lit("(?i)risk")) / 10.0).alias("activation"), F.lit(0.8).alias("confidence"), F.lit("keyword").alias("method"))
    two = t.where(F.col("text").rlike("(?i)breach")).select("doc_id", F.lit("risk").alias("concept"), F.least(F.lit(1.0), F.regexp_count("text", F.lit("(?i)breach")) / 5.0).alias("activation"), F.when(F.col("text").contains("breach register"), 0.9).otherwise(0.7).alias("confidence"), F.lit("related").alias("method"))
    return one.unionByName(two).groupBy("doc_id", "concept").agg(F.round(F.max("activation"), 6).alias("activation"), F.max("confidence").alias("confidence"), F.max_by("method", "confidence").alias("method"), F.count(F.lit(1)).alias("n_methods"))


_S = "list_transform(list_filter(violations, lambda v: v IS NOT NULL), lambda v: v.severity)"


@query(f"""SELECT entry_id, round(s, 6) AS score, s >= 0.7 AS complies FROM (SELECT entry_id, greatest(0, 1 - coalesce(list_sum(list_transform({_S}, lambda s: CASE s WHEN 'low' THEN 1.0 WHEN 'high' THEN 6.0 WHEN 'critical' THEN 10.0 ELSE 3.0 END)), 0) / 10) AS s FROM {_A} WHERE violations IS NOT NULL)""")
def gate_entity_scores(spark, d):
    """Entries gated by the summed severities of what is new in them."""
    s = E.severity_score(F.transform(F.array_compact("violations"), lambda v: v["severity"]))
    return _audit(spark, d, "violations").where("violations is not null").withColumn("s", s).select("entry_id", F.round("s", 6).alias("score"), (F.col("s") >= 0.7).alias("complies"))


TOKENS = ["consent", "audit", "Dunmarrow", "register", "breach"]
_U = "(SELECT DISTINCT id, title, summary, content FROM updates WHERE summary IS NOT NULL AND content IS NOT NULL)"
_N1 = "(" + " + ".join(f"CASE WHEN contains(summary, '{t}') AND NOT contains(content, '{t}') THEN 1 ELSE 0 END" for t in TOKENS) + ")"


def _updates(spark, d):
    return table(spark, d, "updates", "id", "title", "summary", "content").where("summary is not null and content is not null").distinct()


@query(f"SELECT id, round(greatest(0, 1 - 0.1 * {_N1} - 0.05 * {_N1} * {_N1}), 6) AS score FROM {_U}")
def penalty_added_tokens(spark, d):
    """Summaries that name what their content does not."""
    return _updates(spark, d).select("id", F.round(E.added_tokens_score(F.col("summary"), F.col("content"), TOKENS), 6).alias("score"))


DRIFT = ["can also be used for", "additionally", "whatever", "but not"]
_H = "(" + " + ".join(f"CASE WHEN contains(lower(content), '{k}') THEN 1 ELSE 0 END" for k in ("audit", "records", "requests")) + ")"
_DR = "(" + " + ".join(f"CASE WHEN contains(lower(content), '{k}') THEN 1 ELSE 0 END" for k in DRIFT) + ")"


@query(f"SELECT id, round(greatest(0, least(1, least(1, {_H} / 3.0 * 1.5) - 0.15 * {_DR})), 6) AS score FROM {_U}")
def penalty_purpose_drift(spark, d):
    """How well contents keep to a purpose."""
    return _updates(spark, d).select("id", F.round(E.purpose_score(F.col("content"), "the audit of records and requests", DRIFT, ["the", "of", "and"]), 6).alias("score"))


_N3 = "(" + " + ".join(f"CASE WHEN contains(content, '{t}') THEN 1 ELSE 0 END" for t in TOKENS) + ")"
_M3 = "(CASE WHEN contains(content, '|') THEN 0 ELSE 1 END)"


@query(f"SELECT id, round(greatest(0, least(1, 1 - 0.15 * {_N3} - 0.1 * {_N3} * {_N3} - 0.1 * {_M3} + CASE WHEN {_N3} = 0 AND {_M3} = 0 THEN 0.05 ELSE 0 END)), 6) AS score FROM {_U}")
def penalty_disclosure(spark, d):
    """Contents by what they disclose and which marks they lack."""
    return _updates(spark, d).select("id", F.round(E.protection_score(F.col("content"), TOKENS, ["|"]), 6).alias("score"))


SVO = r"([A-Za-z ]+?) ((?:is|are|was|were|must|may|should|can) [a-z]+?) ([A-Za-z ]+)"


@query(f"""SELECT DISTINCT id, trim(s, ' ') AS subject, trim(p, ' ') AS predicate, trim(o, ' ') AS object FROM (SELECT id, unnest(regexp_extract_all(summary, '{SVO}', 1)) AS s, unnest(regexp_extract_all(summary, '{SVO}', 2)) AS p, unnest(regexp_extract_all(summary, '{SVO}', 3)) AS o FROM {_U})""")
def text_triples(spark, d):
    """Subject, predicate and object of the clauses of summaries."""
    return _updates(spark, d).select("id", F.explode(E.triples(F.col("summary"), SVO)).alias("t")).select("id", "t.*").distinct()


@query(f"""WITH w AS (SELECT DISTINCT id, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(title, '')), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(regexp_replace(lower(summary), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS y, summary FROM {_U}),
s AS (SELECT id, summary, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END AS j FROM w)
SELECT summary AS alternative, count(DISTINCT id) AS n_updates, round(max(j), 6) AS similarity FROM s WHERE j BETWEEN 0.1 AND 0.95 GROUP BY summary""")
def alternatives_kept(spark, d):
    """Summaries as alternatives of titles: each text once, if it is neither too like nor too unlike."""
    ws = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", " "), " "), lambda x: x != ""))
    s = _updates(spark, d).select("id", "summary", T.jaccard(ws("title"), ws("summary")).alias("j")).where("j between 0.1 and 0.95")
    return s.groupBy(F.col("summary").alias("alternative")).agg(F.count_distinct("id").alias("n_updates"), F.round(F.max("j"), 6).alias("similarity"))


BENIGN = ["example", "quotation", "quote", "reference", "cited", "mentioned", "for instance", "illustration", "hypothetical"]


@query(f"""SELECT entry_id, pos::INT AS pos, round(greatest(0, 1 - length(matched_content) / 20.0), 6) AS length, round(1 - length(matched_content) / (length(matched_content) + 40.0), 6) AS match_ratio,
CASE WHEN {' OR '.join(f"contains(lower(context), '{b}')" for b in BENIGN)} THEN 0.5 ELSE 0.0 END::DOUBLE AS context FROM {_V} WHERE matched_content IS NOT NULL""")
def rule_false_alarm_signs(spark, d):
    """Signs that a violation is a false alarm: short match, small share, harmless context."""
    v = _violations(spark, d).where("matched_content is not null")
    n = F.length("matched_content")
    s = E.indicator_strength(n, n / (n + 40.0), F.col("context"), BENIGN)
    return v.select("entry_id", "pos", s.alias("s")).select("entry_id", "pos", F.round("s.length", 6).alias("length"), F.round("s.match_ratio", 6).alias("match_ratio"), "s.context")


@query(f"SELECT part, count(*) AS n FROM (SELECT CASE WHEN contains(rule_id, '_') THEN split_part(lower(rule_id), '_', 2) ELSE coalesce(metadata['domain'], 'none') END AS part FROM {_V} WHERE rule_id IS NOT NULL) GROUP BY part")
def rule_id_parts(spark, d):
    """Violations by the second part of their rule's id, else by the domain."""
    v = _violations(spark, d, "metadata").where("rule_id is not null")
    part = F.when(F.col("rule_id").contains("_"), F.get(F.split(F.lower("rule_id"), "_"), F.lit(1))).otherwise(F.coalesce(F.try_element_at("metadata", F.lit("domain")), F.lit("none")))
    return v.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT entry_id, (t = 'financial' AND (contains(c, 'school') OR contains(c, 'student') OR contains(c, 'patient') OR contains(c, 'health'))) OR (t = 'medical' AND NOT (contains(c, 'patient') OR contains(c, 'health'))) AS mismatch
FROM (SELECT entry_id, CASE metadata['domain'] WHEN 'finance' THEN 'financial' WHEN 'healthcare' THEN 'medical' ELSE 'other' END AS t, lower(array_to_string(list_transform(list_filter(violations, lambda v: v IS NOT NULL), lambda v: coalesce(v.matched_content, '')), ' ')) AS c FROM {_A} WHERE violations IS NOT NULL)""")
def rule_context_mismatch(spark, d):
    """Entries whose class does not fit the words around."""
    dom, c = F.try_element_at("metadata", F.lit("domain")), F.lower(F.array_join(F.transform(F.array_compact("violations"), lambda v: F.coalesce(v["matched_content"], F.lit(""))), " "))
    a = _audit(spark, d, "metadata", "violations").where("violations is not null").select("entry_id", F.when(dom == "finance", "financial").when(dom == "healthcare", "medical").otherwise("other").alias("t"), c.alias("c"))
    sick = T.contains_any(F.col("c"), ["patient", "health"])
    return a.select("entry_id", (((F.col("t") == "financial") & (T.contains_any(F.col("c"), ["school", "student"]) | sick)) | ((F.col("t") == "medical") & ~sick)).alias("mismatch"))


TERMS = {"data": 1.0, "consent banner": 1.5, "risk assessment": 1.2, "audit": 1.0}


def _cnt(t: str, c: str = "text") -> str:
    return f"((length(lower({c})) - length(replace(lower({c}), '{t}', ''))) // {len(t)})"


@query(" UNION ALL ".join(f"SELECT doc_id, '{t}' AS concept, round(n * {min(1.0, len(t) / 20) * b}, 6) AS score FROM (SELECT doc_id, {_cnt(t)} AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0" for t, b in TERMS.items()))
def concept_ranking(spark, d):
    """Concepts of a text by frequency, length and a boost of the domain."""
    rows = F.array(*[F.struct(F.lit(t).alias("concept"), F.round(T.plain_count(F.col("text"), t) * (min(1.0, len(t) / 20) * b), 6).alias("score")) for t, b in TERMS.items()])
    return _docs(spark, d).select("doc_id", F.explode(rows).alias("c")).select("doc_id", "c.*").where("score > 0")


_KIND = "CASE WHEN regexp_matches(w, '(?:ed|must)$') THEN 3 WHEN regexp_matches(w, 'ing$') THEN 2 ELSE 1 END"


@query(f"SELECT w AS concept, n * {_KIND} AS weight FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE length(w) >= 4 GROUP BY w) ORDER BY weight DESC, w LIMIT 30")
def concept_top_weights(spark, d):
    """The thirty heaviest concepts: frequency times the weight of their kind (a top-k report)."""
    w = _docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where(F.length("w") >= 4)
    kind = F.when(F.col("w").rlike("(?:ed|must)$"), 3).when(F.col("w").rlike("ing$"), 2).otherwise(1)
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select(F.col("w").alias("concept"), (F.col("n") * kind).alias("weight")).orderBy(F.desc("weight"), "concept").limit(30)


@query()
def select_within_budget(spark, d):
    """Entries of a session that fit a budget, with frameworks mixed; checked against a loop in the tests."""
    a = _audit(spark, d, "session_id", "framework_id", "compliance_score", "violations").withColumn("cost", 40 + 60 * F.size(F.coalesce("violations", F.array().cast("array<struct<type:string,rule_id:string,severity:string,matched_content:string,context:string>>"))))
    return selection.within_budget(a, "session_id", "entry_id", "framework_id", "compliance_score", "cost", 400, 5, least=0.1)


@query("""WITH t AS (SELECT DISTINCT id, priority, created_at FROM rule_tasks WHERE NOT completed AND priority IS NOT NULL) SELECT id, priority FROM t ORDER BY priority, created_at, id LIMIT 16""")
def queue_claim(spark, d):
    """The sixteen waiting tasks that come next (a queue's batch)."""
    t = table(spark, d, "rule_tasks", "id", "priority", "created_at", "completed").where("not completed and priority is not null").select("id", "priority", "created_at").distinct()
    return selection.claim(t, "priority", ["created_at", "id"], 16).select("id", "priority")


@query("""WITH c AS (SELECT lang AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS k FROM documents WHERE lang IS NOT NULL GROUP BY lang),
q AS (SELECT *, greatest(1, floor(16 * n / (SELECT sum(n) FROM c)))::INT AS b FROM c), r AS (SELECT *, b + CASE WHEN k <= greatest(0, 16 - (SELECT sum(b) FROM q)) THEN 1 ELSE 0 END AS quota FROM q),
p AS (SELECT g, n, batch, place, (batch * quota + place) % n + 1 AS at FROM (SELECT *, unnest(range(0, quota)) AS place FROM (SELECT *, unnest(range(0, 5)) AS batch FROM r))),
o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS at FROM documents WHERE lang IS NOT NULL)
SELECT p.batch::INT AS batch, p.g AS lang, p.place::INT AS place, o.doc_id FROM p JOIN o ON o.lang = p.g AND o.at = p.at""")
def sampling_batches(spark, d):
    """Five batches of sixteen documents mixed by language, starting again where one runs out (a sampling operator)."""
    docs = table(spark, d, "documents", "doc_id", "lang")
    return selection.mixture(docs, "lang", [F.md5(F.col("doc_id").cast("string")), "doc_id"], 16, 5).select("batch", "lang", "place", "doc_id")


@query("""WITH k AS (SELECT DISTINCT lower(unnest(keywords)) AS keyword FROM sources), t AS (SELECT DISTINCT lower(unnest(tags)) AS tag FROM updates)
SELECT keyword, tag FROM k JOIN t ON keyword <> '' AND tag <> '' AND (contains(keyword, tag) OR contains(tag, keyword))""")
def phrases_containing(spark, d):
    """Keywords of sources and tags of updates of which one contains the other."""
    k = table(spark, d, "sources", "keywords").select(F.explode("keywords").alias("keyword"))
    return selection.containing(k, table(spark, d, "updates", "tags").select(F.explode("tags").alias("tag")), "keyword", "tag")


@query()
def vector_principal_axes(spark, d):
    """Variance of the vectors on their eight principal axes; checked against a decomposition in the tests."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    mean, axes, _ = selection.principal_axes(e, "embedding", 8)
    p = selection.project(e, "embedding", mean, axes, "p").select(F.posexplode("p").alias("axis", "x"))
    return p.groupBy("axis").agg(F.round(F.var_pop("x"), 6).alias("variance"))


@query("""SELECT label, count(*) AS n, round(sum(c), 6) AS first_half FROM (SELECT label, list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS c FROM embeddings) GROUP BY label""")
def vector_padded_norm(spark, d):
    """Share of the squared length in the first half of the vectors, cut and padded to one width."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    cut = F.concat(F.slice(v, 1, 32), F.array_repeat(F.lit(0.0), 32))
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return table(spark, d, "embeddings", "label", "embedding").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(sq(cut) / sq(v)), 6).alias("first_half"))


@query(f"""SELECT entry_id, round(CASE WHEN p > 0.1 THEN greatest(p * 1.5, exp(p * 2) * 1.5) ELSE p * 1.5 END, 6) AS at_four, CASE WHEN s - 0.3 >= 0.5 THEN 2 WHEN s - 0.1 >= 0.5 THEN 4 WHEN s >= 0.5 THEN 8 ELSE 8 END AS bits
FROM (SELECT entry_id, compliance_score AS s, 1 - compliance_score AS p FROM {_A} WHERE compliance_score IS NOT NULL)""")
def quantise_bits(spark, d):
    """How much a loss of compliance weighs at four bits, and the fewest bits that keep it."""
    s = F.col("compliance_score")
    a = _audit(spark, d, "compliance_score").where("compliance_score is not null")
    return a.select("entry_id", F.round(E.quantisation_sensitivity(1 - s, F.lit(4)), 6).alias("at_four"), E.fewest_bits({2: s - 0.3, 4: s - 0.1, 8: s}, F.lit(0.5)).alias("bits"))


@query("""WITH s AS (SELECT id, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) AS t FROM updates), n AS (SELECT DISTINCT id, """ + ", ".join(f"({' + '.join(_cnt(k, 't') for k in ks)}) AS {f.lower()}" for f, ks in {"GDPR": ["gdpr", "privacy", "consent"], "HIPAA": ["hipaa", "health", "patient"], "FINREG": ["financial", "credit", "card"]}.items()) + """ FROM s)
SELECT id, CASE WHEN greatest(gdpr, hipaa, finreg) = 0 THEN 'none' WHEN gdpr = greatest(gdpr, hipaa, finreg) THEN 'GDPR' WHEN hipaa = greatest(gdpr, hipaa, finreg) THEN 'HIPAA' ELSE 'FINREG' END AS domain FROM n""")
def context_domain(spark, d):
    """Domain of an update by the counts of its indicators; the first wins ties."""
    marks = {"GDPR": ["gdpr", "privacy", "consent"], "HIPAA": ["hipaa", "health", "patient"], "FINREG": ["financial", "credit", "card"]}
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    s = {k: sum((T.plain_count(F.col("t"), w) for w in ws), F.lit(0)) for k, ws in marks.items()}
    return table(spark, d, "updates", "id", "title", "summary").select("id", t.alias("t")).select("id", T.argmax(s, "none").alias("domain")).distinct()


@query("""SELECT doc_id, round(least(1, 0.7 * least(0.6, 0.2 * (""" + " + ".join(f"CASE WHEN contains(text, '{f}') THEN 1 ELSE 0 END" for f in ("GDPR", "HIPAA", "FINREG", "CCPA", "PCI DSS", "SOX")) + ")) + 0.3 * least(0.4, 0.1 * (" + " + ".join(f"CASE WHEN contains(lower(text), '{f}') THEN 1 ELSE 0 END" for f in ("compliance", "regulation", "privacy", "security", "consent", "data subject")) + "))), 6) AS specificity FROM documents WHERE text IS NOT NULL")
def context_specificity(spark, d):
    """How regulatory a text is, by the frameworks and concepts that it names."""
    hit = lambda c, ts: sum((F.when(c.contains(t), 1).otherwise(0) for t in ts), F.lit(0))
    f = F.least(F.lit(0.6), 0.2 * hit(F.col("text"), ["GDPR", "HIPAA", "FINREG", "CCPA", "PCI DSS", "SOX"]))
    c = F.least(F.lit(0.4), 0.1 * hit(F.lower("text"), ["compliance", "regulation", "privacy", "security", "consent", "data subject"]))
    return _docs(spark, d).select("doc_id", F.round(F.least(F.lit(1.0), 0.7 * f + 0.3 * c), 6).alias("specificity"))


@query("""SELECT id, array_to_string(CASE WHEN len(big) > 0 THEN big ELSE list_filter(ws, lambda w: length(w) = list_max(list_transform(ws, lambda x: length(x))) AND length(w) > 3)[1:1] END, '|') AS phrases
FROM (SELECT id, ws, list_filter(ws, lambda w: length(w) > 3 AND regexp_matches(w, '^[A-Z]')) AS big FROM (SELECT DISTINCT id, list_filter(string_split_regex(title, '[\\x09-\\x0D ]+'), lambda w: w <> '') AS ws FROM updates WHERE title IS NOT NULL))""")
def rule_key_phrases(spark, d):
    """Words of a title that a rule against it would name."""
    u = table(spark, d, "updates", "id", "title").where("title is not null").distinct()
    return u.select("id", F.coalesce(F.array_join(E.key_phrases(F.col("title")), "|"), F.lit("")).alias("phrases")).distinct()


@query(f"SELECT entry_id, round(CASE WHEN compliance_result THEN least(0.9, compliance_score + 0.1) ELSE greatest(0.1, compliance_score - 0.1) END, 6) AS threshold FROM {_A} WHERE compliance_score IS NOT NULL AND compliance_result IS NOT NULL")
def rule_threshold_steps(spark, d):
    """Thresholds moved a step by feedback."""
    a = _audit(spark, d, "compliance_score", "compliance_result").where("compliance_score is not null and compliance_result is not null")
    return a.select("entry_id", F.round(E.stepped(F.col("compliance_score"), F.col("compliance_result")), 6).alias("threshold"))


@query("""SELECT id, CASE WHEN place = 0 THEN 'register' WHEN len(b) > 0 THEN '\\b' || regexp_replace(b[-1], '([^A-Za-z0-9_])', '\\\\\\1', 'g') || '\\s+register' WHEN len(a) > 0 THEN 'register\\s+' || regexp_replace(a[1], '([^A-Za-z0-9_])', '\\\\\\1', 'g') || '\\b' ELSE 'register' END AS pattern
FROM (SELECT id, instr(summary, 'register') AS place, list_filter(string_split_regex(substring(summary, 1, instr(summary, 'register') - 1), '[\\x09-\\x0D ]+'), lambda w: w <> '') AS b, list_filter(string_split_regex(substring(summary, instr(summary, 'register') + 8), '[\\x09-\\x0D ]+'), lambda w: w <> '') AS a
FROM (SELECT DISTINCT id, summary FROM updates WHERE summary IS NOT NULL))""")
def rule_narrowed_patterns(spark, d):
    """A pattern made more specific by the word beside each update's match."""
    u = table(spark, d, "updates", "id", "summary").where("summary is not null").distinct()
    return u.select("id", E.narrower(F.lit("register"), F.col("summary"), F.lit("register")).alias("pattern"))
