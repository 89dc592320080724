"""Text measures and pieces as Column functions (all in the JVM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it inside functions of elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Pieces between white space; an empty array for blank or null text."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t != "", F.split(t, " ")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sentences(text: Column, space: str | None = None) -> Column:
    """Sentences: split behind ``.``, ``!`` or ``?`` that white space follows; trimmed, none blank.

    ``space`` is a character class that stands for ASCII white space in the split and blanks in the trimming.
    """
    trim = (lambda s: F.regexp_replace(s, f"^{space}+|{space}+$", "")) if space else F.trim
    parts = F.transform(F.split(text, rf"(?<=[.!?]){space or chr(92) + 's'}+"), trim)
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by blanks."""

    def runs(t: Column) -> Column:
        last = F.greatest(F.size(t) - n + 1, F.lit(0))
        out = F.slice(t, 1, last)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(t, k + 1, last), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    return let(tokens, runs)


def ngrams_upto(tokens: Column, most: int) -> Column:
    """Runs of one to ``most`` tokens."""
    return F.concat(*[ngrams(tokens, n) for n in range(1, most + 1)])


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether a term occurs in the lower-cased text."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in terms], F.lit(False))


def terms_found(text: Column, terms: list[str]) -> Column:
    """The terms that occur in the lower-cased text, in the order given."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]))


def n_terms_found(text: Column, terms: list[str]) -> Column:
    return F.coalesce(F.size(terms_found(text, terms)), F.lit(0)).cast("long")


def plain_count(text: Column, term: str) -> Column:
    """Occurrences of a term in the lower-cased text that do not overlap."""
    low = F.lower(text)
    return F.coalesce((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term), F.lit(0)).cast("long")


def overlapping_count(text: Column, term: str) -> Column:
    """Occurrences that may overlap: "aaaa" holds "aa" three times."""
    t = term.lower()
    if t and not any(t[:k] == t[-k:] for k in range(1, len(t))):  # such a term cannot overlap itself
        return plain_count(text, term)
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in term.lower())
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(f"(?={quoted})")), F.lit(0)).cast("long")


def whole_word_count(text: Column, terms: list[str]) -> Column:
    """Whole-word occurrences of any term in the lower-cased text."""
    quoted = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in t.lower()) for t in terms)
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(rf"\b(?:{quoted})\b")), F.lit(0)).cast("long")


def density(text: Column, terms: list[str], per: int = 1000) -> Column:
    """Occurrences of the terms per ``per`` words; 0 for blank text."""
    n = reduce(lambda a, b: a + b, [plain_count(text, t) for t in terms])
    return F.when(word_count(text) > 0, n * float(per) / word_count(text)).otherwise(0.0)


def topic_score(text: Column, terms: list[str], words_per_hit: float, least: float = 1.0) -> Column:
    """min(1, hits / max(least, words / words_per_hit))."""
    n = reduce(lambda a, b: a + b, [plain_count(text, t) for t in terms])
    return F.least(F.lit(1.0), n / F.greatest(F.lit(least), word_count(text) / words_per_hit))


def token_estimate(text: Column) -> Column:
    """floor(1.3 words + 0.8 punctuation + 0.2 numbers + 0.5 upper-case words)."""
    t = F.coalesce(text, F.lit(""))
    punctuation = F.regexp_count(t, F.lit(r"[.,!?;:()\[\]{}]"))
    numbers = F.regexp_count(t, F.lit(r"[0-9]+"))
    upper = F.size(F.filter(words(t), lambda w: w.rlike("^[A-Z]{2,}$")))
    return F.floor(word_count(t) * 1.3 + punctuation * 0.8 + numbers * 0.2 + upper * 0.5 + 1e-9).cast("long")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty text.

    The characters are sorted once; runs of equal ones add up.
    """

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        weight = lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0)
        step = lambda a, c: F.when(a["c"] == c, F.struct(a["c"].alias("c"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), (a["sum"] + weight(a["run"])).alias("sum")))
        total = F.aggregate(F.array_sort(chars), start, step, lambda a: a["sum"] + weight(a["run"]))
        return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)

    return let(F.filter(F.split(text, ""), lambda c: c != ""), bits)


def low_entropy(text: Column, short: int = 4, bits: float = 3.0) -> Column:
    """Shorter than ``short`` or of less than ``bits`` of entropy."""
    return (F.length(text) < short) | (entropy(text) < bits)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def excerpt(text: Column, most: int = 2000) -> Column:
    """The beginning of a text, with dots where it is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of a text as structs (start, end, text)."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    made = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"), F.least(s + size + overlap, n).alias("end"), F.substring(text, s + 1, F.least(s + size + overlap, n) - s).alias("text")
        ),
    )
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def within_budget(pieces: Column, budget: int, cost) -> Column:
    """The leading pieces whose summed cost stays within the budget; stops at the first that does not fit."""
    kind = "struct<left:bigint,open:boolean,kept:array<string>>"
    first = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        fits = acc["open"] & (cost(x) <= acc["left"])
        return F.struct(
            F.when(fits, acc["left"] - cost(x)).otherwise(acc["left"]).alias("left"),
            fits.alias("open"),
            F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
        ).cast(kind)

    return F.aggregate(pieces, first, step, lambda a: a["kept"])


def capital_phrases(text: Column) -> Column:
    """Runs of capitalised words, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)))


def escape_html(text: Column) -> Column:
    """The five characters that HTML reserves."""
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with every ``{name}`` replaced."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def balanced(text: Column) -> Column:
    """Non-blank, and every parenthesis has its partner."""
    chars = F.filter(F.split(text, ""), lambda c: c.isin("(", ")"))
    depth = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda a, c: F.struct(
            (a["d"] + F.when(c == "(", 1).otherwise(-1)).alias("d"), (a["ok"] & (a["d"] + F.when(c == "(", 1).otherwise(-1) >= 0)).alias("ok")
        ),
        lambda a: a["ok"] & (a["d"] == 0),
    )
    return (F.trim(text) != "") & depth


def argmax(scores: dict[str, Column], default: str | None = None) -> Column:
    """The name of the highest score; the first of equals; ``default`` if none is above 0."""
    names = list(scores)
    best = F.greatest(*scores.values()) if len(names) > 1 else scores[names[0]]
    out = F.lit(default)
    for k in reversed(names):
        out = F.when(scores[k] == best, F.lit(k)).otherwise(out)
    return F.when(best > 0, out).otherwise(F.lit(default))
