"""Scores of entities, relations and concepts: arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridrome.functions.scores import ENTITY, scale
from veridrome.functions.text import argmax, contains_any, let, word_count

# Kinds of entities, base scores, and relation types by verb.
PRIVATE, SENSITIVE = ("PII", "PHI"), ("quasi-identifier", "sensitive")
METHOD = {"dependency_parsing": 0.8, "semantic_role_labeling": 0.85, "regex_pattern": 0.7}
RELATION_RISK = {
    0.4: ("discloses", "has_access_to", "transfers", "provides", "sends"),
    0.6: ("works_for", "owns", "controls"),
    0.8: ("located_at", "part_of", "related_to"),
}
VERBS = {
    "work": "works_for", "employ": "works_for", "hire": "works_for", "locate": "located_at", "access": "has_access_to", "use": "has_access_to", "belong": "part_of", "include": "part_of",
    "disclose": "discloses", "share": "discloses", "provide": "discloses", "send": "discloses", "own": "owns", "possess": "owns",
}


def within_unit(score: Column) -> Column:
    """A score cut to 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def rule_class(text: Column, around: Column, rules: dict[str, tuple[list[str], list[str]]], given: Column | None = None, given_types: dict[str, list[str]] | None = None) -> Column:
    """The type of an entity by rules, with its confidence: struct(type, confidence).

    A rule is (keywords, patterns): .3 for any keyword in the text or around it,
    .7 for any pattern in the text; without either, .8 where the type ``given`` by
    a recogniser is one of the rule's.  The best wins, ties go to the earlier
    rule; ``UNKNOWN`` with .5 where no rule holds.  Null texts have no score.
    """
    scores = {}
    for kind, (keywords, patterns) in rules.items():
        k = F.when(contains_any(text, keywords) | contains_any(around, keywords), 0.3).otherwise(0.0) if keywords else F.lit(0.0)
        p = F.when(text.rlike("(?i)" + "|".join(f"(?:{x})" for x in patterns)), 0.7).otherwise(0.0) if patterns else F.lit(0.0)
        own = F.least(F.lit(1.0), F.coalesce(k, F.lit(0.0)) + F.coalesce(p, F.lit(0.0)))
        named = F.coalesce(given.isin((given_types or {}).get(kind, [])), F.lit(False)) if given is not None else F.lit(False)
        scores[kind] = F.when(own > 0, own).when(named, 0.8).otherwise(0.0)
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.struct(argmax(scores, "UNKNOWN").alias("type"), F.when(best > 0, best).otherwise(0.5).alias("confidence"))


def entity_score(kind: Column, confidence: Column, linked: Column) -> Column:
    """Compliance of an entity: private kinds score low, and lower the surer they are; links to a knowledge base cost private kinds .1."""
    low = kind.isin(*PRIVATE, *SENSITIVE)
    base = F.when(kind.isin(*PRIVATE), 0.3).when(kind.isin(*SENSITIVE), 0.6).otherwise(0.9)
    sure = F.coalesce((confidence - 0.5) * 0.2, F.lit(0.0))
    link = F.when(linked & kind.isin(*PRIVATE, "sensitive"), 0.1).otherwise(0.0)
    return within_unit(base + F.when(low, -sure).otherwise(sure) - link)


def shape(text: Column, start: Column, length: Column) -> Column:
    """Length, and shares of capitals, digits, other signs and of the place in the text, of an entity: a struct."""
    n = F.greatest(F.lit(1), F.length(text))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    return F.struct(
        F.length(text).alias("n_chars"), share("[A-Z]").alias("capitals"), share("[0-9]").alias("digits"), share("[^A-Za-z0-9]").alias("signs"), (start / F.greatest(F.lit(1), length)).alias("place")
    )


def relation_type(verb: Column) -> Column:
    """Relation that a verb stands for: the verb itself, else the first known verb inside it, else ``related_to``."""
    v = F.lower(verb)
    out = F.lit("related_to")
    for k, r in reversed(VERBS.items()):
        out = F.when(v.contains(k), r).otherwise(out)
    for k, r in VERBS.items():
        out = F.when(v == k, r).otherwise(out)
    return out


def relation_confidence(relation: Column, method: Column, source: Column, target: Column, source_confidence: Column, target_confidence: Column) -> Column:
    """Confidence of a relation by how it was found, by the kinds of its ends and by how sure those are."""
    fit = F.when(relation == "works_for", F.when((source == "PERSON") & (target == "ORGANIZATION"), 0.1).otherwise(-0.2)).otherwise(0.0)
    sure = F.coalesce(((source_confidence + target_confidence) / 2 - 0.5) * 0.2, F.lit(0.0))
    return within_unit(scale(method, METHOD, 0.6) + fit + sure)


def relation_score(relation: Column, source: Column, target: Column, confidence: Column) -> Column:
    """Compliance of a relation: risky ones score low, private ends cost .2."""
    base = F.lit(0.7)
    for value, kinds in RELATION_RISK.items():
        base = F.when(relation.isin(*kinds), value).otherwise(base)
    private = source.isin(*PRIVATE, "sensitive") | target.isin(*PRIVATE, "sensitive")
    return within_unit(base - F.when(private, 0.2).otherwise(0.0) + (confidence - 0.5) * 0.2)


def activation(text: Column, patterns: list[str]) -> Column:
    """Matches of all patterns for every twenty words of a text, at most 1; 0 without a match."""
    hits = sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))
    return let(F.struct(hits.alias("n"), word_count(text).alias("w")), lambda s: F.when(s["n"] > 0, F.least(F.lit(1.0), s["n"] * 20.0 / F.greatest(s["w"], F.lit(1)))).otherwise(0.0))


def concept_score(concept: str, active: Column, confidence: Column) -> Column:
    """Compliance of a concept by the prefix of its name."""
    harmful = concept.startswith("harmful_")
    base = 1.0 - active if harmful else F.lit(0.9 if concept.startswith("sentiment_") else 0.8 if concept.startswith("topic_") else 0.7)
    return within_unit(base + (-0.1 if harmful else 0.1) * (F.coalesce(confidence, F.lit(0.5)) - 0.5))


def framework_share(found: Column, concepts: list[str]) -> Column:
    """Share of a framework's concepts that are equal to, or part of, a found concept (an array of names)."""
    names = [c.lower().replace(" ", "_") for c in concepts]
    has = lambda n: F.exists(found, lambda f: F.lower(f).contains(n)).cast("int")
    hits = sum(map(has, names), F.lit(0))
    return hits / len(names)


def severity_score(severities: Column) -> Column:
    """1 less a tenth of the summed severities of an array; nulls count as medium, never below 0."""
    return F.greatest(F.lit(0.0), 1.0 - F.aggregate(severities, F.lit(0.0), lambda a, s: a + F.coalesce(scale(s, {k: float(v) for k, v in ENTITY.items()}), F.lit(3.0))) / 10.0)


def added_tokens_score(output: Column, source: Column, tokens: list[str]) -> Column:
    """1 less .1 n + .05 n squared for n of the tokens that the output has and its source has not."""
    n = sum((F.when(output.contains(t) & ~source.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))
    return within_unit(1.0 - 0.1 * n - 0.05 * n * n)


def purpose_score(text: Column, purpose: str, drift: list[str], stop: list[str]) -> Column:
    """One and a half times the share of a purpose's words in a text, less .15 for each phrase of drift."""
    keys = [w for w in purpose.lower().split() if w not in stop and len(w) > 3]
    low = F.lower(text)
    hits = sum((F.when(low.contains(k), 1).otherwise(0) for k in keys), F.lit(0))
    base = F.least(F.lit(1.0), hits / len(keys) * 1.5) if keys else F.lit(0.7)
    return within_unit(base - 0.15 * sum((F.when(low.contains(d), 1).otherwise(0) for d in drift), F.lit(0)))


def protection_score(text: Column, private: list[str], marks: list[str]) -> Column:
    """1 less .15 n + .1 n squared for n private tokens and .1 for each missing mark, with .05 more for none of either."""
    n = sum((F.when(text.contains(t), 1).otherwise(0) for t in private), F.lit(0))
    missed = sum((F.when(~text.contains(m), 1).otherwise(0) for m in marks), F.lit(0))
    return within_unit(1.0 - 0.15 * n - 0.1 * n * n - 0.1 * missed + F.when((n == 0) & (missed == 0), 0.05).otherwise(0.0))


def triples(sentence: Column, verbs: str) -> Column:
    """Subject, predicate and object of every match of a pattern with three groups: an array of structs."""
    part = lambda i: F.regexp_extract_all(sentence, F.lit(verbs), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"))
    return F.transform(zipped, lambda x: F.struct(F.trim(x["subject"]).alias("subject"), F.trim(x["predicate"]).alias("predicate"), F.trim(x["object"]).alias("object")))


def narrower(pattern: Column, content: Column, matched: Column) -> Column:
    """A pattern made more specific by the word before its match, else by the word behind it; whole words where the match is unknown."""
    at = F.instr(content, matched)
    after = F.get(F.filter(F.split(F.substring(content, at + F.length(matched), F.length(content)), r"\s+"), lambda w: w != ""), F.lit(0))
    known = content.isNotNull() & F.coalesce(matched != "", F.lit(False)) & (at > 0)
    before = F.try_element_at(F.filter(F.split(F.substring(content, F.lit(1), at - 1), r"\s+"), lambda w: w != ""), F.lit(-1))
    quoted = lambda w: F.regexp_replace(w, r"([^A-Za-z0-9_])", r"\\$1")
    by_context = F.when(before.isNotNull(), F.concat(F.lit(r"\b"), quoted(before), F.lit(r"\s+"), pattern)).when(after.isNotNull(), F.concat(pattern, F.lit(r"\s+"), quoted(after), F.lit(r"\b"))).otherwise(pattern)
    whole = F.when(pattern.contains(r"\b"), pattern).otherwise(F.concat(F.lit(r"\b"), pattern, F.lit(r"\b")))
    return F.when(known, by_context).when(content.isNull(), whole).otherwise(pattern)


def stepped(threshold: Column, up: Column, step: float = 0.1) -> Column:
    """A threshold moved by a step within .1 and .9."""
    return F.when(up, F.least(F.lit(0.9), threshold + step)).otherwise(F.greatest(F.lit(0.1), threshold - step))


def key_phrases(text: Column) -> Column:
    """Capitalised words of more than three letters; without any, the first of the longest words of more than three."""
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    big = F.filter(ws, lambda w: (F.length(w) > 3) & w.rlike("^[A-Z]"))
    most = F.array_max(F.transform(ws, lambda w: F.length(w)))
    longest = F.slice(F.filter(ws, lambda w: (F.length(w) == most) & (F.length(w) > 3)), 1, 1)
    return F.when(F.size(big) > 0, big).otherwise(longest)


def indicator_strength(length: Column, ratio: Column, context: Column, benign: list[str]) -> Column:
    """Strengths of the signs of a false alarm: short match, small ratio, harmless context: a struct."""
    return F.struct(within_unit(1.0 - length / 20).alias("length"), within_unit(1.0 - ratio).alias("match_ratio"), F.when(F.coalesce(contains_any(context, benign), F.lit(False)), 0.5).otherwise(0.0).alias("context"))


def quantisation_sensitivity(drop: Column, bits: Column) -> Column:
    """How much a drop at so many bits weighs; drops over a tenth grow exponentially."""
    factor = 8.0 / bits - 0.5
    return F.when(drop > 0.1, F.greatest(drop * factor, F.exp(drop * 2) * factor)).otherwise(drop * factor)


def fewest_bits(scores: dict[int, Column], least: Column) -> Column:
    """The fewest bits whose score reaches a bound, else the most bits."""
    out = F.lit(max(scores))
    for b in sorted(scores, reverse=True):
        out = F.when(scores[b] >= least, b).otherwise(out)
    return out

