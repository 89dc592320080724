"""Queries over spans, rules, vectors, retrieval, stored tables and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridrome.functions import patterns as P
from veridrome.functions import scores as S
from veridrome.functions import text as T
from veridrome.functions import vectors as V
from veridrome.functions.keys import id_key
from veridrome.operators import retrieval, rules, sequences, spans, store, vectors
from veridrome.plans.registry import registry
from veridrome.sources.tables import table

query, QUERIES, SQL = registry()

CAPITALS = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"
#: Detectors that stand for models: name, type, pattern, score, weight.
DETECTORS = (
    ("loose", "email", P.LOOSE["email"], 0.9, 1.0),
    ("loose", "phone", P.LOOSE["phone"], 0.6, 1.0),
    ("strict", "ssn", P.STRICT["ssn"], 0.95, 2.0),
    ("strict", "phone", P.STRICT["phone"], 0.8, 2.0),
    ("digits", "number", r"[0-9][0-9.-]+[0-9]", 0.4, 0.5),
    ("capital", "name", CAPITALS, 0.5, 1.0),
)


def _chunks(spark, d):
    return table(spark, d, "text_chunks", "chunk_id", "text").where("text is not null").distinct()


def _spans(spark, d, detectors=DETECTORS):
    c = _chunks(spark, d)

    def rows(model, kind, pattern, score, weight):
        return F.transform(
            P.matches(F.col("text"), pattern),
            lambda m: F.struct(F.lit(kind).alias("type"), F.lit(model).alias("model"), F.lit(score).alias("score"), F.lit(weight).alias("weight"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")),
        )

    return c.select(F.col("chunk_id").alias("doc_id"), F.explode(F.concat(*[rows(*x) for x in detectors])).alias("s")).select("doc_id", "s.*")


def _span_sql(detectors=DETECTORS) -> str:
    parts = []
    for model, kind, p, score, weight in detectors:
        parts.append(f"""SELECT chunk_id AS doc_id, '{kind}' AS type, '{model}' AS model, {score}::DOUBLE AS score, {weight}::DOUBLE AS weight, hits[i] AS text,
(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::INT AS start,
(list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))))::INT AS "end"
FROM (SELECT chunk_id, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT DISTINCT chunk_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS parts FROM text_chunks WHERE text IS NOT NULL))""")
    return " UNION ALL ".join(parts)


_SP = f"sp AS MATERIALIZED ({_span_sql()})"
_GR = """gr AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END AS fresh FROM
(SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", type, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)))"""


@query(f"""WITH {_SP} SELECT doc_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end", type, model ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", type, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp))) GROUP BY doc_id, g""")
def span_union(spark, d):
    """Merged spans of all detectors."""
    return spans.union(_spans(spark, d))


_GROUPED = """gr AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end", type, model ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", type, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)))"""


@query(f"""WITH {_SP}, {_GROUPED} SELECT doc_id, type, n, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY n DESC, type) AS r FROM (SELECT doc_id, g, type, count(*) AS n, max(score) AS score FROM gr GROUP BY ALL)) WHERE r = 1""")
def span_vote(spark, d):
    """Most frequent type of each group of overlapping spans."""
    return spans.vote(_spans(spark, d)).select("doc_id", "type", "n", "score")


@query(f"""WITH {_SP}, {_GROUPED} SELECT doc_id, type, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY total DESC, type) AS r FROM (SELECT doc_id, g, type, round(sum(score * weight), 6) AS total FROM gr GROUP BY ALL)) WHERE r = 1""")
def span_weighted_vote(spark, d):
    """Type with the highest weighted score of each group."""
    return spans.weighted_vote(_spans(spark, d)).select("doc_id", "type", "total")


@query()
def span_greedy(spark, d):
    """Spans kept greedily by falling score; checked against a loop in the tests."""
    s = _spans(spark, d).withColumn("rank", -F.col("score")).select("doc_id", "rank", "start", "end", "type", "model")
    return spans.select_greedy(s, ["rank", "start", "end", "type", "model"])


@query(f"""WITH {_SP}, inn AS (SELECT DISTINCT doc_id, start, "end" FROM sp WHERE type = 'number'), o AS (SELECT DISTINCT doc_id, start, "end" FROM sp WHERE type = 'phone')
SELECT doc_id, start, "end", outer_start, outer_end FROM (SELECT i.doc_id, i.start, i."end", o.start AS outer_start, o."end" AS outer_end, row_number() OVER (PARTITION BY i.doc_id, i.start, i."end" ORDER BY o."end" - o.start, o.start) AS r
FROM inn i JOIN o ON i.doc_id = o.doc_id AND i.start >= o.start AND i."end" <= o."end" AND i."end" - i.start < o."end" - o.start) WHERE r = 1""")
def span_nested(spark, d):
    """Numbers inside phone numbers, with the smallest that holds them."""
    s = _spans(spark, d)
    return spans.within(s.where("type = 'number'").select("doc_id", "start", "end").distinct(), s.where("type = 'phone'"))


@query(f"""WITH {_SP}, x AS (SELECT DISTINCT doc_id, type, start, "end" FROM sp WHERE type IN ('name', 'email')), w AS (SELECT *, lead(type) OVER q AS t2, lead(start) OVER q AS s2 FROM x WINDOW q AS (PARTITION BY doc_id ORDER BY start, "end", type))
SELECT doc_id, start AS first_start, s2 AS second_start FROM w WHERE type = 'name' AND t2 = 'email' AND s2 - "end" <= 200""")
def span_near_pairs(spark, d):
    """A name that an e-mail address follows within 200 characters."""
    s = _spans(spark, d).where("type in ('name', 'email')").select("doc_id", "type", "start", "end").distinct()
    return spans.near_pairs(s, "name", "email", 200)


@query(f"""WITH {_SP} SELECT sp.doc_id, sp.start, n.id::INT AS entity_id, CASE WHEN n.id IS NOT NULL THEN 0.95 END AS confidence FROM (SELECT DISTINCT doc_id, start, text FROM sp WHERE type = 'name') sp
LEFT JOIN (SELECT lower(surface) AS k, min(id) AS id FROM (VALUES ('Port Ilven', 1), ('Quenby Vale', 2), ('Upper Tharn', 3), ('Lowmoor Privacy Bureau', 4)) t(surface, id) GROUP BY 1) n ON lower(sp.text) = n.k""")
def span_dictionary_link(spark, d):
    """Names linked to a dictionary."""
    names = spark.createDataFrame([("Port Ilven", 1), ("Quenby Vale", 2), ("Upper Tharn", 3), ("Lowmoor Privacy Bureau", 4)], "surface string, id int")
    s = _spans(spark, d, (DETECTORS[-1],)).select("doc_id", "start", "text").distinct()
    return spans.link(s, names).select("doc_id", "start", "entity_id", "confidence")


RULES = [
    rules.Rule("r_mail", "regex", "critical", P.LOOSE["email"], framework="GDPR"),
    rules.Rule("r_consent", "keyword", "high", keywords=("consent", "opt-out"), framework="GDPR"),
    rules.Rule("r_audit", "keyword", "low", keywords=("audit", "register"), whole_word=True, framework="GLBA"),
    rules.Rule("r_health", "terms", "medium", keywords=("patient", "genetic", "biometric", "prescription"), framework="HIPAA", languages=("en",)),
]


def _docs(spark, d):
    return table(spark, d, "documents", "doc_id", "text", "lang").where("text is not null")


def _ov(k: str) -> str:
    return f"(SELECT count(*) FROM unnest(range(1, length(text) + 1)) t(i) WHERE substring(lower(text), i, {len(k)}) = '{k}')"


_MAIL = P.LOOSE["email"]
_VERDICTS = f"""SELECT doc_id, rule_id, framework, severity, round(s, 6) AS score, round(s, 6) < 0.85 AS violated FROM (
SELECT doc_id, 'r_mail' AS rule_id, 'GDPR' AS framework, 'critical' AS severity, pow(CASE WHEN regexp_matches(text, '{_MAIL}') THEN 0.0 ELSE 1.0 END, 3.0) AS s FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 'r_consent', 'GDPR', 'high', pow(greatest(0.0, 1 - 0.2 * ({_ov('consent')} + {_ov('opt-out')})), 2.0) FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 'r_audit', 'GLBA', 'low', pow(greatest(0.0, 1 - 0.2 * len(regexp_extract_all(lower(text), '\\b(?:audit|register)\\b'))), 0.5) FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 'r_health', 'HIPAA', 'medium', pow(greatest(0.0, 1 - 0.25 * (CASE WHEN contains(lower(text), 'patient') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'genetic') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'biometric') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'prescription') THEN 1 ELSE 0 END)), 1.0) FROM documents WHERE text IS NOT NULL AND lang IN ('en'))"""


@query(_VERDICTS)
def rule_verdicts(spark, d):
    """Score and verdict of every document under every rule of its language."""
    return rules.verdicts(_docs(spark, d), "doc_id", "text", RULES, lang="lang")


@query(f"SELECT doc_id, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE violated) AS n_violations, round(avg(score), 6) >= 0.85 AS compliant FROM ({_VERDICTS}) GROUP BY doc_id")
def rule_document_scores(spark, d):
    """Mean score, violations and verdict of every document."""
    return rules.document_scores(rule_verdicts(spark, d), "doc_id")


@query(f"""SELECT doc_id, sum(n) = 0 AS compliant, min(least) AS least_score, coalesce(string_agg(CASE WHEN n > 0 THEN framework || ':' || n END, ',' ORDER BY framework), '') AS violations
FROM (SELECT doc_id, framework, min(score) AS least, count(*) FILTER (WHERE violated) AS n FROM ({_VERDICTS}) GROUP BY ALL) GROUP BY doc_id""")
def rule_framework_rollup(spark, d):
    """Roll-up of a document's verdicts over frameworks."""
    return rules.framework_rollup(rule_verdicts(spark, d), "doc_id")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{_MAIL}') THEN 'r_mail' WHEN contains(lower(text), 'consent') OR contains(lower(text), 'opt-out') THEN 'r_consent' WHEN contains(lower(text), 'audit') OR contains(lower(text), 'register') THEN 'r_audit'
WHEN contains(lower(text), 'patient') OR contains(lower(text), 'genetic') OR contains(lower(text), 'biometric') OR contains(lower(text), 'prescription') THEN 'r_health' END AS rule_id FROM documents WHERE text IS NOT NULL""")
def rule_first_hit(spark, d):
    """The first rule that applies, as a filter that stops there finds it."""
    return rules.first_hit(_docs(spark, d), "doc_id", "text", RULES)


@query("""SELECT doc_id, round(CASE WHEN n > 0 THEN 0.7 + 0.3 * n / 4 ELSE 0 END, 6) AS confidence FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'audit') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'breach') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'consent') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'risk') THEN 1 ELSE 0 END AS n FROM documents WHERE text IS NOT NULL)""")
def rule_keyword_confidence(spark, d):
    """Confidence from the share of keywords found."""
    return _docs(spark, d).select("doc_id", F.round(rules.keyword_confidence(F.col("text"), ["audit", "breach", "consent", "risk"]), 6).alias("confidence"))


_C1 = "((CASE WHEN contains(lower(text), 'audit') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(text), 'risk') THEN 1.0 ELSE 0 END) / 3.0)::DOUBLE"


@query(f"""SELECT doc_id, round(0.3 * c1 + 0.7 * c2, 6) AS score, 0.3 * c1 + 0.7 * c2 >= 0.65 AS applies, (CASE WHEN c1 >= 0.65 THEN 1 ELSE 0 END + CASE WHEN c2 >= 0.65 THEN 1 ELSE 0 END) * 2 > 2 AS majority FROM (SELECT doc_id, {_C1} AS c1, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS c2 FROM documents WHERE text IS NOT NULL)""")
def rule_contextual(spark, d):
    """Content and context weighed, and two factors combined."""
    c1 = rules.weighted_share(F.col("text"), {"audit": 2.0, "risk": 1.0})
    c2 = F.when(F.col("lang") == "en", 1.0).otherwise(0.4)
    s = rules.contextual(c1, c2)
    return _docs(spark, d).select("doc_id", F.round(s, 6).alias("score"), (s >= 0.65).alias("applies"), rules.combine([c1, c2], "majority").alias("majority"))


@query("""WITH t AS (SELECT doc_id, list_reverse(list_reverse(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))[1:30]) AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, greatest(0.0, round(1 - (3 * (SELECT count(*) FROM unnest(range(1, len(ws))) q(i) WHERE ws[i] || ' ' || ws[i + 1] IN ('audit trail', 'risk assessment')) + 7 * len(list_filter(ws, lambda w: w = 'breach'))) / 10.0, 6)) AS score FROM t""")
def rule_tail_ngrams(spark, d):
    """Listed n-grams among the last thirty words, weighed by severity."""
    ws = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    tail = F.slice(F.reverse(ws), 1, 30)
    docs = _docs(spark, d).withColumn("w", F.reverse(tail))
    two = F.size(F.filter(T.ngrams(F.col("w"), 2), lambda g: g.isin("audit trail", "risk assessment")))
    one = F.size(F.filter("w", lambda g: g == "breach"))
    return docs.select("doc_id", F.greatest(F.lit(0.0), F.round(1 - (S.NGRAM["medium"] * two + S.NGRAM["high"] * one) / 10.0, 6)).alias("score"))


INFERENCES = [
    rules.Inference(("personal",), "regulated"),
    rules.Inference(("regulated", "consent"), "lawful"),
    rules.Inference(("regulated",), "unlawful", ("lawful",)),
    rules.Inference(("unlawful", "health"), "notify"),
]


@query("""WITH f AS (SELECT doc_id, contains(lower(text), 'personal') OR contains(lower(text), 'biometric') OR contains(lower(text), 'genetic') AS p, contains(lower(text), 'consent') AS c, contains(lower(text), 'prescription') AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter([CASE WHEN p THEN 'personal' END, CASE WHEN c THEN 'consent' END, CASE WHEN h THEN 'health' END, CASE WHEN p THEN 'regulated' END, CASE WHEN p AND c THEN 'lawful' END, CASE WHEN p AND NOT c THEN 'unlawful' END, CASE WHEN p AND NOT c AND h THEN 'notify' END], lambda x: x IS NOT NULL), ',') AS facts FROM f""")
def inference_forward_chain(spark, d):
    """Facts that follow from a document's flags."""
    t = F.col("text")
    flags = {"personal": T.contains_any(t, ["personal", "biometric", "genetic"]), "consent": T.contains_any(t, ["consent"]), "health": T.contains_any(t, ["prescription"])}
    return _docs(spark, d).select("doc_id", F.array_join(rules.forward_chain(rules.premises(flags), INFERENCES), ",").alias("facts"))


@query("""SELECT id, severity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY layer DESC) AS r FROM (VALUES ('a', 'low', 0), ('b', 'high', 0), ('c', 'low', 1), ('a', 'medium', 1), ('b', 'critical', 2)) t(id, severity, layer)) WHERE r = 1""")
def rule_override(spark, d):
    """Generated, static and dynamic rules; later layers win."""
    layer = lambda *rows: spark.createDataFrame(list(rows), "id string, severity string")
    return rules.override(layer(("a", "low"), ("b", "high")), layer(("c", "low"), ("a", "medium")), layer(("b", "critical")))


@query("""SELECT s.id, replace(replace('Sources of {country} must name {region}', '{country}', coalesce(country, '?')), '{region}', coalesce(region, '?')) AS rule FROM sources s""")
def rule_templates(spark, d):
    """Rule texts from a template and columns."""
    s = table(spark, d, "sources", "id", "country", "region").select("id", F.coalesce("country", F.lit("?")).alias("country"), F.coalesce("region", F.lit("?")).alias("region"), F.lit("Sources of {country} must name {region}").alias("rule"))
    return rules.instantiate(s, "rule", {"country": "country", "region": "region"}).select("id", "rule")


@query("""WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), k AS (SELECT label, list(m ORDER BY i) AS c FROM c GROUP BY label)
SELECT vec_id, concept, round(1 / (1 + exp(-10 * (s - 0.5))), 6) AS score FROM (SELECT e.vec_id, k.label AS concept, list_cosine_similarity(e.embedding::DOUBLE[], k.c) AS s FROM embeddings e, k)""")
def vector_concept_scores(spark, d):
    """Sigmoid of the cosine of each vector with each label's centroid."""
    e = table(spark, d, "embeddings")
    s = vectors.label_scores(e, vectors.centroids(e, "label", "embedding", 64), "vec_id", "embedding", "label")
    return s.select("vec_id", "concept", F.round(S.sigmoid(F.col("cosine")), 6).alias("score"))


@query("""SELECT query, vec_id, score, rank FROM (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INT AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""")
def vector_nearest(spark, d):
    """The five nearest vectors of the query set (ids divisible by 20) among all."""
    e = table(spark, d, "embeddings")
    return vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - round_even(x::DOUBLE * 127 / m, 0) * m / 127, 2)))), 6) AS error FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)""")
def vector_quantise_error(spark, d):
    """Distance between vectors and their eight-bit codes."""
    v = F.col("embedding")
    back = V.dequantise(V.quantise(v), V.peak(v) / 127.0)
    diff = F.zip_with(v, back, lambda a, b: a.cast("double") - b)
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(V.norm(diff), 6).alias("error"))


@query("""SELECT vec_id, round(s, 6) AS distance, CASE WHEN s >= 0 THEN 'none' WHEN -s > 0.3 THEN 'high' WHEN -s > 0.1 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT vec_id, list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)) / sqrt(8.0) - 0.05 AS s FROM embeddings)""")
def vector_boundary(spark, d):
    """Signed distance to a hyperplane and its severity."""
    normal = F.array(*[F.lit(0.3535533905932738 if i < 8 else 0.0) for i in range(64)])
    s = V.boundary(F.col("embedding"), normal, F.lit(0.05))
    severity = F.when(s >= 0, "none").when(-s > 0.3, "high").when(-s > 0.1, "medium").otherwise("low")
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(s, 6).alias("distance"), severity.alias("severity"))


@query("""SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - m)) AS e FROM (SELECT vec_id, embedding, list_max(embedding)::DOUBLE AS m FROM embeddings))""")
def vector_softmax_top(spark, d):
    """Greatest softmax entry."""
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(F.array_max(V.softmax(F.col("embedding"))), 6).alias("top"))


@query("""SELECT vec_id, round(len(list_filter(embedding, lambda x: abs(x::DOUBLE) > list_sort(list_transform(embedding, lambda y: abs(y::DOUBLE)))[16])) / 64.0, 6) AS kept FROM embeddings""")
def vector_prune(spark, d):
    """Share of entries that stay when the least quarter is dropped."""
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(V.nonzero_share(V.prune(F.col("embedding"), 0.25)), 6).alias("kept"))


_HITS = """a AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'audit', ''))) / 5 / 10.0 AS score FROM documents WHERE contains(lower(text), 'audit')), b AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'risk', ''))) / 4 / 10.0 AS score FROM documents WHERE contains(lower(text), 'risk')),
m AS (SELECT doc_id, round(0.7 * coalesce(a.score, 0) + 0.3 * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (doc_id))"""


def _hits(spark, d):
    docs = _docs(spark, d)

    def hits(term):
        return docs.where(F.lower("text").contains(term)).select("doc_id", (T.plain_count(F.col("text"), term) / 10.0).alias("score"))

    return retrieval.merge_hits(hits("audit"), hits("risk"), "doc_id")


@query(f"WITH {_HITS} SELECT doc_id, score FROM m")
def retrieval_merge(spark, d):
    """Two hit lists merged with weights."""
    return _hits(spark, d)


@query(f"WITH {_HITS} SELECT m.doc_id, round(m.score * (1 + 0.05 * (CASE WHEN contains(text, 'GDPR') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'consent') THEN 1 ELSE 0 END)), 6) AS score FROM m JOIN documents USING (doc_id)")
def retrieval_rerank(spark, d):
    """Hits reranked by words of the context."""
    j = _hits(spark, d).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return retrieval.rerank(j, "text", ["GDPR", "consent"]).select("doc_id", "score")


@query(f"WITH {_HITS} SELECT framework_id, doc_id, score FROM (SELECT framework_id, m.doc_id, m.score, row_number() OVER (PARTITION BY framework_id ORDER BY m.score DESC, m.doc_id) AS r FROM m JOIN documents USING (doc_id)) WHERE r = 1")
def retrieval_diverse(spark, d):
    """The best hit of each framework."""
    j = _hits(spark, d).join(table(spark, d, "documents", "doc_id", "framework_id"), "doc_id")
    return retrieval.first_per_group(j, "framework_id", "doc_id").select("framework_id", "doc_id", "score")


@query("SELECT source, n, round(n / sum(n) OVER (), 6) AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def sampling_weights(spark, d):
    """Share of each source."""
    return retrieval.normalised_weights(table(spark, d, "documents", "source"), "source")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE (source = 'helpdesk_export' AND r <= 50) OR (source = 'forum_dump' AND r <= 20)""")
def sampling_mixture(spark, d):
    """Fifty documents of one source and twenty of another (a sampling operator)."""
    return retrieval.mix(table(spark, d, "documents", "doc_id", "source"), "source", "doc_id", {"helpdesk_export": 50, "forum_dump": 20})


@query("""SELECT id, source_id, found_date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY found_date DESC NULLS LAST) AS r FROM (SELECT DISTINCT id, source_id, found_date FROM updates)) WHERE r = 1""")
def store_upsert(spark, d):
    """Updates after an upsert of the second half of the year into the first."""
    u = table(spark, d, "updates", "id", "source_id", "found_date").distinct()
    mid = F.lit("2024-07-01").cast("timestamp")
    return store.upsert(u.where(F.col("found_date") < mid), u.where((F.col("found_date") >= mid) | F.col("found_date").isNull()), "id", "found_date")


@query("""SELECT DISTINCT id FROM updates WHERE id NOT IN (SELECT id FROM updates WHERE processed)""")
def store_insert_new(spark, d):
    """Updates that an insert-unless-stored adds to the processed ones."""
    u = table(spark, d, "updates", "id", "processed")
    return store.insert_new(u.where("processed"), u, "id").select("id")


@query("""SELECT DISTINCT id FROM updates WHERE found_date IS NULL OR found_date >= TIMESTAMPTZ '2024-12-31 00:00:00+00' - INTERVAL 60 DAY""")
def store_purge(spark, d):
    """Updates that a purge keeps."""
    return store.purge(table(spark, d, "updates", "id", "found_date"), "found_date", "2024-12-31", 60).select("id").distinct()


@query("""SELECT DISTINCT md5(id || ':' || CAST(floor(epoch(found_date)) AS BIGINT)) AS alert_id, id AS update_id FROM updates WHERE impact_level = 'high' AND found_date IS NOT NULL""")
def store_alerts(spark, d):
    """Alerts of high-impact updates."""
    u = table(spark, d, "updates", "id", "impact_level", "found_date").where("impact_level = 'high' and found_date is not null").select("id", "found_date").distinct()
    return store.alert_rows(u, "id", F.unix_timestamp("found_date"))


_IDK = r"nullif(lower(regexp_replace({}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')), '')"


@query(f"""SELECT DISTINCT u.id, s.id AS source, s.country FROM updates u JOIN sources s ON {_IDK.format('u.source_id')} = {_IDK.format('s.id')} WHERE list_has_any(u.frameworks, ['GDPR', 'CCPA']) AND u.found_date >= TIMESTAMPTZ '2024-06-01 00:00:00+00'""")
def update_recent_by_framework(spark, d):
    """Recent updates of two frameworks with their source, whatever the spelling of its id."""
    u = table(spark, d, "updates", "id", "source_id", "found_date", "frameworks")
    u = u.where(F.arrays_overlap("frameworks", F.array(F.lit("GDPR"), F.lit("CCPA"))) & (F.col("found_date") >= F.lit("2024-06-01").cast("timestamp")))
    s = table(spark, d, "sources", "id", "country").select(F.col("id").alias("source"), "country", id_key(F.col("id")).alias("key"))
    return u.select("id", id_key(F.col("source_id")).alias("key")).distinct().join(s, "key").select("id", "source", "country").distinct()


@query("""SELECT impact_level, count(*) AS n, count(*) FILTER (WHERE processed) AS n_processed FROM (SELECT id, any_value(impact_level) AS impact_level, bool_or(processed) AS processed FROM updates GROUP BY id) GROUP BY impact_level""")
def update_stats(spark, d):
    """Updates and processed ones per impact."""
    u = table(spark, d, "updates", "id", "impact_level", "processed").groupBy("id").agg(F.any_value("impact_level").alias("impact_level"), F.bool_or("processed").alias("processed"))
    return u.groupBy("impact_level").agg(F.count(F.lit(1)).alias("n"), F.count_if("processed").alias("n_processed"))


@query("""SELECT f, count(DISTINCT id) AS n FROM (SELECT id, unnest(frameworks) AS f FROM updates) GROUP BY f""")
def update_framework_counts(spark, d):
    """Updates per framework they name."""
    return table(spark, d, "updates", "id", "frameworks").select("id", F.explode("frameworks").alias("f")).groupBy("f").agg(F.count_distinct("id").alias("n"))


@query("""SELECT DISTINCT u.id, f, list_filter(['consent', 'breach', 'audit'], lambda k: contains(lower(u.content), k))[1] AS keyword FROM (SELECT DISTINCT id, content, unnest(frameworks) AS f FROM updates) u WHERE len(list_filter(['consent', 'breach', 'audit'], lambda k: contains(lower(u.content), k))) > 0""")
def update_rule_impact(spark, d):
    """Updates per framework with the first rule keyword in their content."""
    u = table(spark, d, "updates", "id", "content", "frameworks").select("id", F.get(T.terms_found(F.col("content"), ["consent", "breach", "audit"]), F.lit(0)).alias("keyword"), F.explode("frameworks").alias("f"))
    return u.where("keyword is not null").select("id", "f", "keyword").distinct()


@query("""SELECT k AS key, count(*) AS n FROM (SELECT lower(trim(id, E' \\t')) AS k FROM sources) GROUP BY k""")
def source_keys(spark, d):
    """Sources by their normalised key."""
    return table(spark, d, "sources", "id").groupBy(id_key(F.col("id")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT content_id, id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY "timestamp" DESC NULLS LAST, id DESC) AS r FROM (SELECT DISTINCT content_id, id, event_type, "timestamp" FROM content_events WHERE content_id IS NOT NULL)) WHERE r = 1""")
def content_latest_event(spark, d):
    """The latest event of each content."""
    e = table(spark, d, "content_events", "content_id", "id", "event_type", "timestamp").where("content_id is not null").distinct()
    return sequences.last_rows(e, "content_id", 1, [F.desc_nulls_last("timestamp"), F.desc("id")]).select("content_id", "id", "event_type")


@query("""SELECT id, (event_type = 'published' OR (event_type IN ('created', 'updated') AND ascii(substring(md5(id), 1, 1)) % 2 = 0)) AS verify FROM (SELECT DISTINCT id, event_type FROM content_events)""")
def content_sampling_gate(spark, d):
    """Published content always, created and updated content at half rate by hash."""
    half = F.ascii(F.substring(F.md5("id"), 1, 1)) % 2 == 0
    gate = (F.col("event_type") == "published") | (F.col("event_type").isin("created", "updated") & half)
    return table(spark, d, "content_events", "id", "event_type").distinct().select("id", gate.alias("verify"))
