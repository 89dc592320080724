"""Queries over text: patterns, measures, pieces, rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridrome.functions import patterns as P
from veridrome.functions import rewrite as W
from veridrome.functions import text as T
from veridrome.functions.keys import strip
from veridrome.plans.registry import registry
from veridrome.sources.tables import table

query, QUERIES, SQL = registry()
TEXTS = ("text_chunks", "chunk_id", "text")
EMAIL, SSN, PHONE, CARD, IP = (P.LOOSE[k] for k in ("email", "ssn", "phone", "credit_card", "ip_address"))


def _once(spark, d, name, key, *columns):
    """One row a key: repeated deliveries are equal in these columns."""
    return table(spark, d, name, key, *columns).distinct()


def _chunks(spark, d):
    return _once(spark, d, *TEXTS).where("text is not null")


_CH = "(SELECT DISTINCT chunk_id, text FROM text_chunks WHERE text IS NOT NULL) c"
_EV = "(SELECT DISTINCT id, content_type, content FROM content_events WHERE content IS NOT NULL) c"


def _n(p: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, '{p}'))"


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS type, sum({_n(P.LOOSE[k])})::BIGINT AS n_matches, count(*) FILTER (WHERE {_n(P.LOOSE[k])} > 0) AS n_texts FROM {_CH}" for k in ("email", "ssn", "phone", "credit_card", "ip_address")
    )
)
def text_pattern_counts(spark, d):
    """Matches and texts with a match per pattern type (one pass, no join)."""
    kinds = ("email", "ssn", "phone", "credit_card", "ip_address")
    c = _chunks(spark, d).select(*[P.count(F.col("text"), P.LOOSE[k]).alias(k) for k in kinds])
    long = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")
    return long.groupBy("type").agg(F.sum("n").alias("n_matches"), F.sum((F.col("n") > 0).cast("long")).alias("n_texts"))


@query(f"SELECT content_type, sum({_n(EMAIL, 'content')})::BIGINT AS n_email, sum({_n(PHONE, 'content')})::BIGINT AS n_phone FROM {_EV} GROUP BY content_type")
def text_pattern_by_content_type(spark, d):
    """E-mail and phone matches per content type."""
    c = _once(spark, d, "content_events", "id", "content_type", "content").where("content is not null")
    return c.groupBy("content_type").agg(F.sum(P.count(F.col("content"), EMAIL)).alias("n_email"), F.sum(P.count(F.col("content"), PHONE)).alias("n_phone"))


@query(f"""WITH m AS (SELECT chunk_id, text, regexp_extract_all(text, '{EMAIL}') AS hits, string_split_regex(text, '{EMAIL}') AS parts FROM {_CH}),
e AS (SELECT chunk_id, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0)
SELECT chunk_id, hits[i] AS match, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::INT AS start_pos,
(list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))))::INT AS end_pos FROM e""")
def text_match_offsets(spark, d):
    """Every e-mail match with its offsets, found without a UDF."""
    m = _chunks(spark, d).select("chunk_id", F.explode(P.matches(F.col("text"), EMAIL)).alias("m"))
    return m.select("chunk_id", F.col("m.text").alias("match"), F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos"))


@query(f"""SELECT chunk_id, type, unnest(hits) AS match FROM (SELECT chunk_id, 'email' AS type, regexp_extract_all(text, '{EMAIL}') AS hits FROM {_CH}
UNION ALL SELECT chunk_id, 'phone', regexp_extract_all(text, '{P.STRICT["phone"]}') FROM {_CH}
UNION ALL SELECT chunk_id, 'ssn', regexp_extract_all(text, '{P.STRICT["ssn"]}') FROM {_CH})""")
def text_issue_rows(spark, d):
    """One issue row per match of the strict family."""
    family = {k: P.STRICT[k] for k in ("email", "phone", "ssn")}
    return P.issues(_chunks(spark, d), "chunk_id", "text", family).select("chunk_id", "type", F.col("text").alias("match"))


@query(f"SELECT chunk_id, length(text)::BIGINT AS n_chars, ({_n(EMAIL)} + {_n(PHONE)})::BIGINT AS n_matches, round(CASE WHEN length(text) = 0 THEN 0 ELSE ({_n(EMAIL)} + {_n(PHONE)}) / length(text) END, 9) AS ratio FROM {_CH}")
def text_match_ratio(spark, d):
    """Matches per character of each text."""
    n, size = P.count(F.col("text"), EMAIL) + P.count(F.col("text"), PHONE), F.length("text").cast("long")
    return _chunks(spark, d).select("chunk_id", size.alias("n_chars"), n.alias("n_matches"), F.round(F.when(size == 0, 0.0).otherwise(n / size), 9).alias("ratio"))


@query(f"SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{SSN}', '[SSN]', 'g'), '{PHONE}', '[PHONE]', 'g'), '{CARD}', '[CREDIT_CARD]', 'g') AS redacted FROM {_CH}")
def text_redacted(spark, d):
    """Texts with four pattern types replaced one after the other."""
    return _chunks(spark, d).select("chunk_id", P.redact(F.col("text"), P.LOOSE).alias("redacted"))


@query(f"SELECT chunk_id, regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@', '***@', 'g') AS masked FROM {_CH} WHERE regexp_matches(text, '{EMAIL}')")
def text_mask_keep_domain(spark, d):
    """E-mail addresses reduced to their domain."""
    return _chunks(spark, d).where(F.col("text").rlike(EMAIL)).select("chunk_id", F.regexp_replace("text", r"\b[A-Za-z0-9._%+-]+@", "***@").alias("masked"))


@query(f"SELECT chunk_id, (regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{SSN}') OR regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{CARD}') OR regexp_matches(text, '{IP}')) AND length(text) < 1000 AS has_personal FROM {_CH}")
def text_has_personal(spark, d):
    """Whether a text is short and holds a match of any of five patterns; longer ones are left to other means."""
    hit = F.lit(False)
    for p in (EMAIL, SSN, PHONE, CARD, IP):
        hit = hit | F.col("text").rlike(p)
    return _chunks(spark, d).select("chunk_id", (hit & (F.length("text") < 1000)).alias("has_personal"))


@query(f"""WITH m AS (SELECT chunk_id, text, regexp_extract_all(text, '{EMAIL}') AS hits, string_split_regex(text, '{EMAIL}') AS parts FROM {_CH}),
x AS (SELECT chunk_id, text, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
e AS (SELECT chunk_id, text, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n FROM x)
SELECT chunk_id, s::INT AS start_pos, substring(text, (greatest(s - 50, 0) + 1)::BIGINT, (s + n + 50 - greatest(s - 50, 0))::BIGINT) AS around FROM e""")
def text_context_windows(spark, d):
    """Fifty characters around every e-mail match of a text."""
    m = _chunks(spark, d).select("chunk_id", "text", F.explode(P.matches(F.col("text"), EMAIL)).alias("m"))
    return m.select("chunk_id", F.col("m.start").alias("start_pos"), P.context(F.col("text"), F.col("m.start"), F.col("m.end")).alias("around"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(hit, '^({EMAIL})') THEN 'email' WHEN regexp_matches(hit, '^({SSN})') THEN 'ssn' WHEN regexp_matches(hit, '^({PHONE})') THEN 'phone' ELSE 'generic' END AS kind
FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9.-]+[0-9]')) AS hit FROM {_CH})) GROUP BY kind""")
def text_detail_types(spark, d):
    """Details of texts by the first pattern that matches at their beginning."""
    hits = _chunks(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9.-]+[0-9]"), F.lit(0))).alias("hit"))
    kind = P.detail_type(F.col("hit"), {k: P.LOOSE[k] for k in ("email", "ssn", "phone")})
    return hits.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def text_health_flags(spark, d):
    """Texts of every language by the set of health patterns they match; checked against a loop in the tests."""
    bits = sum(F.when(F.col("text").rlike(P.any_script(p)), 2**i).otherwise(0) for i, p in enumerate(P.HEALTH.values()))
    return _docs(spark, d).groupBy(bits.cast("int").alias("hex")).agg(F.count(F.lit(1)).alias("n"))


_DOC = "(SELECT * FROM documents WHERE text IS NOT NULL)"
_WORDS = "CASE WHEN trim(regexp_replace(text, '[\\x09-\\x0D ]+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\\x09-\\x0D ]+', ' ', 'g'), ' '), ' ')) END"


def _docs(spark, d, *more):
    return table(spark, d, "documents", "doc_id", "text", *more).where("text is not null")


@query(f"SELECT lang, count(*) AS n_docs, sum({_WORDS})::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM {_DOC} GROUP BY lang")
def text_word_counts(spark, d):
    """Words and characters per language."""
    g = _docs(spark, d, "lang").groupBy("lang")
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(T.word_count(F.col("text"))).alias("n_words"), F.sum(F.length("text").cast("long")).alias("n_chars"))


def _pc(t: str) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})"


@query(f"SELECT doc_id, round(CASE WHEN {_WORDS} > 0 THEN ({_pc('consent')} + {_pc('retention')}) * 1000.0 / {_WORDS} ELSE 0 END, 6) AS per_thousand FROM {_DOC}")
def text_keyword_density(spark, d):
    """Occurrences of two keywords per thousand words."""
    return _docs(spark, d).select("doc_id", F.round(T.density(F.col("text"), ["consent", "retention"]), 6).alias("per_thousand"))


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(?:audit|policy|register)\\b'))::BIGINT AS n_whole, {_pc('audit')}::BIGINT AS n_plain FROM {_DOC}")
def text_whole_words(spark, d):
    """Whole-word and plain occurrences."""
    return _docs(spark, d).select("doc_id", T.whole_word_count(F.col("text"), ["audit", "policy", "register"]).alias("n_whole"), T.plain_count(F.col("text"), "audit").alias("n_plain"))


@query(f"SELECT doc_id, (SELECT count(*) FROM unnest(range(1, length(text) + 1)) t(i) WHERE substring(lower(text), i, 2) = 'ss')::BIGINT AS n_overlapping FROM {_DOC}")
def text_overlapping_terms(spark, d):
    """Occurrences of a term that may overlap."""
    return _docs(spark, d).select("doc_id", T.overlapping_count(F.col("text"), "ss").alias("n_overlapping"))


@query(f"SELECT doc_id, round(least(1.0, ({_pc('data')} + {_pc('record')}) / greatest(1.0, ({_WORDS}) / 50.0)), 6) AS loose, round(least(1.0, ({_pc('risk')} + {_pc('breach')}) / greatest(10.0, ({_WORDS}) / 5.0)), 6) AS strict FROM {_DOC}")
def text_topic_scores(spark, d):
    """Topic hits scaled by text length, on two scales."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.round(T.topic_score(t, ["data", "record"], 50.0), 6).alias("loose"), F.round(T.topic_score(t, ["risk", "breach"], 5.0, 10.0), 6).alias("strict"))


@query(f"SELECT doc_id, floor(({_WORDS}) * 1.3 + {_n('[.,!?;:()\\[\\]{}]')} * 0.8 + {_n('[0-9]+')} * 0.2 + len(list_filter(string_split(trim(regexp_replace(text, '[\\x09-\\x0D ]+', ' ', 'g'), ' '), ' '), lambda w: regexp_full_match(w, '[A-Z][A-Z]+'))) * 0.5 + 1e-9)::BIGINT AS n_tokens FROM {_DOC}")
def text_token_estimate(spark, d):
    """Estimated model tokens from words, punctuation, numbers and capitals."""
    return _docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


@query("""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT array_to_string(ws[i:i + 2], ' ') AS gram FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))
SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 50""")
def text_top_trigrams(spark, d):
    """The fifty most frequent word trigrams (a top-k report)."""
    ws = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    g = _docs(spark, d).select(F.explode(T.ngrams(ws, 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@query()
def text_sentence_counts(spark, d):
    """Sentences of each document of every language; checked against a loop in the tests."""
    return _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"), P.SPACE)).cast("long").alias("n_sentences"))


@query("""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents WHERE text <> '') GROUP BY ALL),
t AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM c)
SELECT doc_id, round(0 - sum(n / total * log2(n / total)), 6) AS bits FROM t GROUP BY doc_id""")
def text_entropy(spark, d):
    """Entropy of the characters of each text that is not empty."""
    return _docs(spark, d).where("text <> ''").select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("bits"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS excerpt FROM documents WHERE text IS NOT NULL")
def text_excerpts(spark, d):
    """The first two hundred characters."""
    return _docs(spark, d).select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"))


@query("""WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS s FROM documents WHERE text IS NOT NULL AND length(text) > 0)
SELECT doc_id, s::INT AS start_pos, least(s + 600, length(text))::INT AS end_pos, md5(substring(text, s + 1, least(s + 600, length(text)) - s)) AS digest FROM p""")
def text_overlapping_chunks(spark, d):
    """Chunks of 500 characters that overlap by 100."""
    c = _docs(spark, d).select("doc_id", F.explode(T.chunks(F.col("text"), 500, 100)).alias("c"))
    return c.select("doc_id", F.col("c.start").cast("int").alias("start_pos"), F.col("c.end").cast("int").alias("end_pos"), F.md5("c.text").alias("digest"))


@query("""WITH u AS (SELECT DISTINCT id, lower(title) AS a, lower(summary) AS b FROM updates WHERE title IS NOT NULL AND summary IS NOT NULL),
s AS (SELECT id, list_distinct(list_filter(string_split(regexp_replace(a, '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(regexp_replace(b, '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')) AS y FROM u)
SELECT id, round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS similarity FROM s""")
def text_title_summary_jaccard(spark, d):
    """Shared words of title and summary."""
    u = _once(spark, d, "updates", "id", "title", "summary").where("title is not null and summary is not null")
    ws = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda x: x != ""))
    return u.select("id", ws("title").alias("x"), ws("summary").alias("y")).distinct().select("id", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("SELECT id, array_to_string(list_distinct_ordered, '|') AS phrases FROM (SELECT id, list_reverse(list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_extract_all(title, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(b, a) END)) AS list_distinct_ordered FROM (SELECT DISTINCT id, title FROM updates WHERE title IS NOT NULL))")
def text_capital_phrases(spark, d):
    """Capitalised phrases of each title, distinct, in order."""
    u = _once(spark, d, "updates", "id", "title").where("title is not null")
    return u.select("id", F.array_join(T.capital_phrases(F.col("title")), "|").alias("phrases"))


@query("""SELECT DISTINCT id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, md5(title) AS digest FROM updates WHERE title IS NOT NULL""")
def text_escaped_titles(spark, d):
    """Titles escaped for HTML, and their hash."""
    return _once(spark, d, "updates", "id", "title").where("title is not null").select("id", T.escape_html(F.col("title")).alias("escaped"), F.md5("title").alias("digest"))


_IND = {"formal": ["shall", "pursuant", "hereby", "whereas", "whatever"], "casual": ["lol", "hey", "please", "ok "], "technical": ["model", "encryption", "scoring", "prompt"]}


def _ind(ts: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in ts)


@query(f"""SELECT tone, count(*) AS n FROM (SELECT CASE WHEN greatest(f, c, t) = 0 THEN 'neutral' WHEN f = greatest(f, c, t) THEN 'formal' WHEN c = greatest(f, c, t) THEN 'casual' ELSE 'technical' END AS tone
FROM (SELECT {_ind(_IND["formal"])} AS f, {_ind(_IND["casual"])} AS c, {_ind(_IND["technical"])} AS t FROM {_DOC})) GROUP BY tone""")
def text_tone(spark, d):
    """Documents by the indicator list of which most terms occur."""
    tone = T.argmax({k: T.n_terms_found(F.col("text"), v) for k, v in _IND.items()}, "neutral")
    return _docs(spark, d).groupBy(tone.alias("tone")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, array_to_string(list_filter(keywords, lambda k: contains(lower(t), lower(k))), '|') AS tags FROM (SELECT DISTINCT u.id, coalesce(u.title, '') || ' ' || coalesce(u.summary, '') AS t, s.keywords FROM updates u JOIN sources s ON u.source_id = s.id WHERE s.keywords IS NOT NULL)""")
def text_source_tags(spark, d):
    """Keywords of the source that occur in an update's title or summary."""
    u = _once(spark, d, "updates", "id", "source_id", "title", "summary")
    s = table(spark, d, "sources").where("keywords is not null").select(F.col("id").alias("source_id"), "keywords")
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    tags = F.filter("keywords", lambda k: F.contains(F.col("t"), F.lower(k)))
    return u.join(s, "source_id").withColumn("t", t).select("id", F.array_join(tags, "|").alias("tags")).distinct()


@query("""SELECT DISTINCT id, CASE WHEN contains(t, 'breach') OR contains(t, 'mandatory') THEN 'high' WHEN contains(t, 'guidance') OR contains(t, 'review') THEN 'medium' ELSE 'low' END AS impact
FROM (SELECT id, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) AS t FROM updates)""")
def text_impact_level(spark, d):
    """Impact of an update by the first of two term lists with a hit."""
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    level = F.when(T.contains_any(t, ["breach", "mandatory"]), "high").when(T.contains_any(t, ["guidance", "review"]), "medium").otherwise("low")
    return table(spark, d, "updates", "id", "title", "summary").select("id", level.alias("impact")).distinct()


_TERMS = {"chairman": "chairperson", "blacklist": "blocklist", "complaint": "concern", "suspended": "paused"}


@query()
def text_term_replacement(spark, d):
    """Whole words of documents of every language replaced by an ordered term map; checked against a loop in the tests."""
    return _docs(spark, d).select("doc_id", W.replace_terms(F.col("text"), _TERMS, False, P.EDGES).alias("rewritten"))


@query(f"SELECT chunk_id, array_to_string(list_filter(string_split(text, '. '), lambda s: NOT (regexp_matches(s, '{EMAIL}') OR regexp_matches(s, '{PHONE}'))), '. ') AS kept FROM {_CH}")
def text_drop_sentences(spark, d):
    """Texts without the sentences that hold an e-mail address or a phone number."""
    kept = F.filter(F.split("text", r"\. ", -1), lambda s: ~(s.rlike(EMAIL) | s.rlike(PHONE)))
    return _chunks(spark, d).select("chunk_id", F.array_join(kept, ". ").alias("kept"))


@query("""SELECT DISTINCT id, source_id, length(source_id)::INT AS n_before, length(regexp_replace(source_id, '^[\\s]+|[\\s]+$', '', 'g'))::INT AS n_after FROM updates WHERE source_id IS NOT NULL""")
def text_stripped_keys(spark, d):
    """Keys before and after outer white space is removed."""
    u = table(spark, d, "updates", "id", "source_id").where("source_id is not null")
    return u.select("id", "source_id", F.length("source_id").alias("n_before"), F.length(strip(F.col("source_id"))).alias("n_after")).distinct()


@query("SELECT doc_id, least(1.0, round(0.5 * length(text) / 1000.0 + 0.3 * (CASE WHEN contains(text, '?') THEN 0.3 ELSE 0 END) + 0.2 * (CASE WHEN contains(lower(text), 'risk') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'consent') THEN 1 ELSE 0 END), 6)) AS complexity FROM documents WHERE text IS NOT NULL")
def text_complexity(spark, d):
    """A score from length, questions and topic hits."""
    t = F.col("text")
    s = 0.5 * F.length(t) / 1000.0 + 0.3 * F.when(t.contains("?"), 0.3).otherwise(0.0) + 0.2 * T.n_terms_found(t, ["risk", "consent"])
    return _docs(spark, d).select("doc_id", F.least(F.lit(1.0), F.round(s, 6)).alias("complexity"))
