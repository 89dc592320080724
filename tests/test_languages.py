"""Queries over documents of every language against loops in Python."""

import re
from collections import Counter

import duckdb
import pytest

from veridrome.functions import patterns as P
from veridrome.plans import catalog
from veridrome.plans.more_queries import _MAP
from veridrome.plans.text_queries import _TERMS

SMALL = "/root/testdata/sf0.001"
ODD = [
    ("en", "It must hold. It may."), ("de", "Das ist gut. Ja!　Nein?"), ("EN", "The chairman shall. SHALL Shall shallé éshall blacklist_ blacklisté"), (None, "complaint. Whatever x. no one\rmay be"),
    ("und", "MRN: 12345 éMRN: 12345"), ("fr", "PID 12345"), ("fr", "code A12.5 noted"), ("fr", "A12é"), ("fr", "NPI:١١١١١١١١١١"), ("es", ""), ("es", "  "), ("es", "\x1fA.\x1fB.\x85"), ("en", None),
]


def sentences(t):
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", t)) if s]


def replaced(t, terms, forms):
    for a, b in terms.items():
        for f in forms:
            t = re.sub(rf"\b{f(a)}\b", f(b), t)
    return t


def kind(s):
    return next((k for k, p in (("prohibition", "must not|may not|prohibited|no .* may be"), ("obligation", "must|shall|have to|required"), ("permission", "may|can|allowed")) if re.search(p, s.lower())), "other")


def flags(t):
    return sum(2**i for i, p in enumerate(P.HEALTH.values()) if re.search(p, t))


@pytest.fixture(scope="module", params=["given", "odd"])
def folder(request, spark, tmp_path_factory):
    if request.param == "given":
        return SMALL
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(ODD)], "doc_id bigint, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def test_all_languages(spark, folder):
    at = f"{folder}/documents.parquet" + ("" if folder == SMALL else "/*.parquet")
    docs = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{at}' WHERE text IS NOT NULL").fetchall())
    rows = lambda q: {r[0]: r[1] for r in catalog.queries()[q](spark, folder).collect()}
    assert rows("text_sentence_counts") == {i: len(sentences(t)) for i, t in docs.items()}
    assert rows("text_term_replacement") == {i: replaced(t, _TERMS, (str,)) for i, t in docs.items()}
    assert rows("rewrite_terms_keep_case") == {i: replaced(t, _MAP, (str, str.capitalize, str.upper)) for i, t in docs.items()}
    assert rows("rule_sentence_kinds") == Counter(kind(s) for t in docs.values() for s in sentences(t))
    assert rows("text_health_flags") == Counter(flags(t) for t in docs.values())


def test_any_script_takes_only_edges():
    with pytest.raises(ValueError):
        P.any_script(r"\bx\b|y")
