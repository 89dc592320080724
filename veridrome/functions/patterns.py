"""Pattern families and matching with offsets, as Column functions.

Offsets come without a UDF: with all matches and the pieces between them, match
i starts behind the first i pieces and the i - 1 matches before it.  This holds
for patterns that cannot match the empty string; :func:`check` rejects others.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern families.  The strict and the loose family differ on purpose.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
LOOSE = {
    "email": EMAIL,
    "ssn": r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
    "phone": r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-.\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "date_of_birth": r"\b(?:0[1-9]|1[0-2])[/.-](?:0[1-9]|[12][0-9]|3[01])[/.-](?:19|20)\d{2}\b",
}
STRICT = {
    "email": EMAIL,
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "phone": r"\b(?:\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
HEALTH = {
    "mrn": r"(?i)\b(?:MRN|Medical Record Number)[:\s]*\d{4,10}\b",
    "patient_id": r"(?i)\b(?:Patient ID|PID)[:\s]*\d{4,10}\b",
    "diagnosis_code": r"\b[A-Z]\d{2}(?:\.\d{1,2})?\b",
    "npi": r"(?i)\bNPI[:\s]*\d{10}\b",
}
#: Order in which text is rewritten.
REDACTION = ("email", "ssn", "phone", "credit_card")

#: White space and word characters of any script; Java's ``\\s``, ``\\d`` and ``\\w`` know those of ASCII, its ``\\b`` differs between versions.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
EDGES = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")

MATCH = "array<struct<text:string,start:int,end:int>>"


def check(pattern: str) -> str:
    """A pattern that compiles and cannot match the empty string, else ValueError (on the driver)."""
    try:
        empty = re.compile(pattern).match("")
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern}") from e
    if empty:
        raise ValueError(f"matches the empty string: {pattern}")
    return pattern


def any_script(pattern: str) -> str:
    """A pattern that begins and ends with ``\\b`` around word characters, for texts of any script."""
    flags, begin, rest = check(pattern).partition(r"\b")
    body, end, after = rest.rpartition(r"\b")
    if flags not in ("", "(?i)") or not begin or not end or after or r"\b" in body:
        raise ValueError(f"not between two word edges: {pattern}")
    return flags.replace("i", "iu") + EDGES[0] + "(?:" + body.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}") + ")" + EDGES[1]


def matches(text: Column, pattern: str) -> Column:
    """All matches with their half-open 0-based offsets; an empty array for none, null for null."""
    p = F.lit(check(pattern))
    found, pieces = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        row = F.struct(x["hit"].alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    first = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(MATCH).alias("rows"))
    zipped = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda a, b: F.struct(a.alias("piece"), b.alias("hit")))
    return F.when(F.size(found) == 0, F.array().cast(MATCH)).otherwise(F.aggregate(zipped, first, step, lambda a: a["rows"]))


def count(text: Column, pattern: str) -> Column:
    """Number of matches; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(check(pattern))), F.lit(0)).cast("long")


def typed_matches(text: Column, family: dict[str, str]) -> Column:
    """Matches of a family as one array of (type, text, start, end), by family order then place."""

    def named(k: str):
        return lambda m: F.struct(F.lit(k).alias("type"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"))

    parts = [F.transform(matches(text, p), named(k)) for k, p in family.items()]
    return F.concat(*parts)


def issues(df: DataFrame, key: str, text: str, family: dict[str, str]) -> DataFrame:
    """One row a match: (key, type, text, start, end).  No join: the family is part of the expression."""
    return df.select(key, F.explode(typed_matches(F.col(text), family)).alias("m")).select(key, "m.*")


def redact(text: Column, family: dict[str, str], order: tuple[str, ...] = REDACTION, mark: str = "[{}]") -> Column:
    """Replace the matches of the types in ``order``, one type after the other."""
    for k in order:
        text = F.regexp_replace(text, check(family[k]), mark.format(k.upper()).replace("$", r"\$"))
    return text


def context(text: Column, start: Column, end: Column, width: int = 50) -> Column:
    """The text up to ``width`` characters around a span."""
    a = F.greatest(start - width, F.lit(0))
    return F.substring(text, a + 1, end + width - a)


def detail_type(text: Column, family: dict[str, str], default: str = "generic") -> Column:
    """The first type of a family whose pattern matches at the beginning."""
    out = F.lit(default)
    for k, p in reversed(list(family.items())):
        out = F.when(text.rlike(f"^(?:{check(p)})"), F.lit(k)).otherwise(out)
    return out
