"""Rewriting of text as Column functions: numbered marks, span removal, term maps, tone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridrome.functions import patterns as P
from veridrome.functions.text import let


def numbered_marks(text: Column, pattern: str, name: str) -> Column:
    """Every match replaced by ``[NAME_1]``, ``[NAME_2]``, ... in order."""

    def build(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(f"[{name}_"), i.cast("string"), F.lit("]"), p))), "")

    return let(F.split(text, P.check(pattern), -1), build)


def without_spans(text: Column, spans: Column) -> Column:
    """A text without an ordered array of disjoint spans (structs with start and end)."""
    kind = "struct<at:int,out:string>"
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    keep = lambda a, s: F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]))
    return F.aggregate(spans, first, lambda a, s: F.struct(s["end"].cast("int").alias("at"), keep(a, s).alias("out")).cast(kind), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, 2147483647)))


def replace_terms(text: Column, terms: dict[str, str], keep_case: bool = True, edges: tuple[str, str] = (r"\b", r"\b")) -> Column:
    """Whole words (between ``edges``) replaced in the given order; capitalised and upper-case forms keep their case."""
    begin, end = edges
    for a, b in terms.items():
        text = F.regexp_replace(text, f"{begin}{a}{end}", b)
        if keep_case:
            text = F.regexp_replace(text, f"{begin}{a.capitalize()}{end}", b.capitalize())
            text = F.regexp_replace(text, f"{begin}{a.upper()}{end}", b.upper())
    return text


def spaced(text: Column) -> Column:
    """White space collapsed, none before punctuation."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r" +([,.;:!?])", "$1"), "  +", " ")


def with_notice(text: Column, notice: str, where: str = "end") -> Column:
    """A notice put before or behind a text that does not hold it yet."""
    made = F.concat(F.lit(notice + "\n\n"), text) if where == "begin" else F.concat(text, F.lit("\n\n" + notice))
    return F.when(text.contains(notice), text).otherwise(made)


def keep_area_code(text: Column) -> Column:
    """Ten-digit phone numbers reduced to their area code."""
    return F.regexp_replace(text, r"\b(\d{3})[-. ]\d{3}[-. ]\d{4}\b", "$1-***-****")


def render(title: Column, steps: Column, form: str) -> Column:
    """A report of ordered steps (structs with rule and note) as text, html or markdown; ValueError for other forms."""
    from veridrome.functions.text import escape_html

    if form == "text":
        return F.concat(title, F.lit("\n"), F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["rule"], F.lit(": "), s["note"])), "\n"))
    if form == "markdown":
        return F.concat(F.lit("# "), title, F.lit("\n"), F.array_join(F.transform(steps, lambda s: F.concat(F.lit("- **"), s["rule"], F.lit("** "), s["note"])), "\n"))
    if form == "html":
        items = F.transform(steps, lambda s: F.concat(F.lit("<li><b>"), escape_html(s["rule"]), F.lit("</b> "), escape_html(s["note"]), F.lit("</li>")))
        return F.concat(F.lit("<h1>"), escape_html(title), F.lit("</h1><ol>"), F.array_join(items, ""), F.lit("</ol>"))
    raise ValueError(f"unknown form of report: {form}")
