"""Abusive, hateful or sexual content (problem 10).

Two Kneser-Ney trigram models of words, one of abusive and one of ordinary
passages, back off to the same distribution: the counts of every word over the
whole corpus, so an expression that is rare everywhere speaks for neither.  A
passage is a window of at most ``WINDOW`` words of a sentence or line; its score is
the difference of its length-normalised log-likelihoods, and a document has the
score of its worst passage.

Ratings are given for documents, abuse stands in passages, and a few ratings are
wrong.  A passage of a document rated abusive belongs to the abusive model only if
its expressions are much more frequent in other documents rated abusive, and in
the labelled passages of this library, than in all documents; all its others are
ordinary.  The counts over all documents are made in Spark, for the expressions of
the rated sample.  The threshold comes from folds that the models have not seen;
the labelled passages are part of them, so one rule holds for any number of
ratings.

Words are coded on the bytes of many texts at once, so that counting and scoring
are array operations.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridrome.llm import rated_passages
from veridrome.llm.codes import hash_words, mix

#: Rated documents, and characters of them together, up to which the fit uses them all; beyond, those with the smallest hashes, each whole.
FIT_ROWS, FIT_CHARS = 8_000, 32_000_000
FOLDS, DISCOUNT, WINDOW, LEAST = 5, 0.75, 10, 8
#: Words in a row that must be so much more frequent.
CORE = 6
#: Times by which expressions of a passage must be more frequent among abusive documents to make it abuse.
LIFT = 8.0
#: Documents of usual frequency that are added to the abusive ones, so that few ratings prove little.
PRIOR = 30
#: Score that abuse has at least: so much likelier is each word of a passage on average.
FLOOR = 1.0
#: How much rarer abuse is in the corpus than among the ratings.
RARER = 2
#: Characters of text that are coded at once.
BATCH_CHARS = 1 << 21

#: Characters that are written for Latin letters.
LOOKS = str.maketrans("аеорсухіјѕԁһӏкмтвнАЕОРСУХІЈЅКМТВНαονρτικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlkmtbhaeopcyxijskmtbhaovptikuabezhikmnoptyx")
DIGITS = str.maketrans("013456789@$!|", "oleasgtbgasil")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){3,}[^\W\d_](?![^\W_])")
LONG = re.compile(r"([^\W\d_])\1{2,}")
TOKEN = re.compile(r"[^\W_](?:[\w@$!|*'’]*[\w$@*])?|[!?]+")
MASKED = re.compile(r"^[^\W\d_]\*{2,}[^\W\d_]$|^[^\W\d_]+\*+[^\W\d_]+$")
LEET = re.compile(r"^(?=.*[a-z])(?=.*[013456789@$!|])[a-z013456789@$!|]+$")
QUOTE = re.compile(r"[\"“”„«»]")
BREAK = re.compile(r"(?<=[.!?])\s+|[\n\r]+|\s{2,}")
#: Latin letters without their marks, and common typographic signs.
FOLD = {c: n[0] for c in range(0xC0, 0x180) if len(n := unicodedata.normalize("NFD", chr(c))) == 2} | str.maketrans({"’": "'", "‘": "'", "–": " ", "—": " ", "…": " ", "·": " ", "•": " ", "\xa0": " ", "¿": " ", "¡": " "} | dict.fromkeys("“”„«»", '"'))
#: Kinds of bytes: 1 letters, 2 what disguises letters beside them, 3 what is not ASCII.
ODD = np.zeros(256, np.uint8)
ODD[97:123] = 1
ODD[list(b"0123456789@$|*")] = 2
ODD[128:] = 3


def _latin(word: str) -> str:
    mixed = any("a" <= c <= "z" for c in word)
    return word.translate(LOOKS) if mixed else word


def tokens(passage: str) -> list[str]:
    """Words of a passage with common disguises undone: look-alike letters, digits for letters, spaced, stretched and masked letters."""
    s = passage
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
        s = "".join(c for c in s if c < "\x80" or unicodedata.category(c) != "Cf")
    s = s.lower()
    s = SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), s)
    out = []
    for w in TOKEN.findall(s):
        if not (w.isascii() and w.isalpha()):
            w = _latin(w)
            if MASKED.match(w):
                w = "⟦masked⟧"
            elif w.isdigit():
                w = "0"
            elif LEET.match(w):
                w = w.translate(DIGITS)
            if not w.isascii():
                w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
        out.append(LONG.sub(r"\1", w).replace("’", "'").strip("*'"))
    return [w for w in out if w]


def plain_passages(texts: list[str]) -> tuple[str, np.ndarray]:
    """Sentences and lines of all texts in plain writing and lower case, one a line, and how many each text has.

    A last word marks those that quote.  Only passages with other letters than
    ASCII, letters beside digits or signs, stretched or spaced letters go
    through :func:`tokens`; the rest are plain.
    """
    parts = [BREAK.split(t) for t in texts]
    per = np.array([len(p) for p in parts], np.int64)
    lines = [p for ps in parts for p in ps]
    if not lines:
        return "", per
    plain = [p.lower() if p.isascii() else p.lower().translate(FOLD) for p in lines]
    low = "\n".join(plain)
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass") + b"\n\n\n", np.uint8)
    kind = ODD[raw]
    letter = kind == 1
    odd = kind == 3
    odd[:-1] |= (letter[:-1] & (kind[1:] == 2)) | ((kind[:-1] == 2) & letter[1:])
    odd[:-2] |= letter[:-2] & (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:])
    # four letters that stand alone, close to each other
    alone = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])) & ~np.concatenate((letter[1:], [False])))
    odd[alone[:-3][alone[3:] - alone[:-3] <= 9]] = True
    ends = np.flatnonzero(raw == 10)
    of = lambda hit: np.unique(np.searchsorted(ends, np.flatnonzero(hit))).tolist()
    for k in of(raw == 34):
        plain[k] += " ⟦quote⟧"
    for k in of(odd):
        plain[k] = " ".join(tokens(lines[k])) + (" ⟦quote⟧" if QUOTE.search(lines[k]) else "")
    return "\n".join(plain), per


@dataclass
class Grams:
    """Coded passages: keys of the trigram, the bigram, its context and the word at each place.

    Every passage has one place for each word and one for its end.  ``starts``
    are the first places of passages (and the last end), ``doc`` the text of each.
    """

    tri: np.ndarray
    bi: np.ndarray
    context: np.ndarray
    word: np.ndarray
    before: np.ndarray
    starts: np.ndarray
    doc: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The passage of each place."""
        return np.repeat(np.arange(len(self.doc)), np.diff(self.starts))


OPEN, CLOSE = np.uint64(1), np.uint64(2)


def grams(texts: list) -> Grams:
    """Code the passages of texts; values that are no text have none."""
    plain, per = plain_passages([t if isinstance(t, str) else "" for t in texts])
    code, passage = hash_words(plain)
    used, passage = np.unique(passage, return_inverse=True)
    n = np.bincount(passage, minlength=len(used)) if len(used) else np.empty(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(n + 3)))
    s = np.full(starts[-1], OPEN)
    if len(used):
        s[starts[1:] - 1] = CLOSE
        s[np.arange(len(code)) + 3 * passage + 2] = code
    event = np.ones(len(s), bool)
    event[starts[:-1]] = event[np.minimum(starts[:-1] + 1, max(0, len(s) - 1))] = False
    i = np.flatnonzero(event)
    bi = mix(s[i - 1], s[i])
    context = mix(s[i - 2], s[i - 1])
    doc = np.repeat(np.arange(len(texts)), per)[used] if len(used) else np.empty(0, np.int64)
    return Grams(mix(context, s[i]), bi, context, s[i], s[i - 1], np.concatenate(([0], np.cumsum(n + 1))), doc)


class Table:
    """Sorted keys with columns of values; keys that are not held give a default."""

    BITS = np.uint64((1 << 22) - 1)

    def __init__(self, keys: np.ndarray, columns: np.ndarray, default: list[float]):
        order = np.argsort(keys)
        self.keys, self.columns = keys[order], columns[order].astype(np.float32)
        self.default = np.array(default, np.float32)
        self.maybe = None

    def index(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that are held, and where."""
        if self.maybe is None:
            self.maybe = np.zeros(int(self.BITS) + 1, bool)
            self.maybe[(self.keys & self.BITS).astype(np.int64)] = True
        at = np.flatnonzero(self.maybe[(keys & self.BITS).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[where] == keys[at] if len(self.keys) else np.zeros(0, bool)
        return at[hit], where[hit]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.tile(self.default, (len(keys), 1))
        at, where = self.index(keys)
        out[at] = self.columns[where]
        return out

    def __getstate__(self):
        return self.__dict__ | {"maybe": None}


class KneserNey:
    """Interpolated Kneser-Ney trigram model over the expressions of a sample.

    Lower orders count in how many contexts a word follows; the lowest backs off
    to ``base``, the shared share of each word in the corpus.
    """

    def __init__(self, sample: Sample, weight: np.ndarray):
        s = sample
        n3 = np.bincount(s.tri_at, weight[s.owner], len(s.tri))
        n2 = np.bincount(s.bi_of_tri[n3 > 0], minlength=len(s.bi)).astype(float)
        n1 = np.bincount(s.word_of_bi[n2 > 0], minlength=len(s.word)).astype(float)
        part = lambda n, of, size: (np.bincount(of, n, size), np.bincount(of[n > 0], minlength=size))
        (c3, t3), (c2, t2) = part(n3, s.context_of_tri, len(s.bi)), part(n2, s.before_of_bi, len(s.word))
        share = lambda n, c: np.maximum(n - DISCOUNT, 0) / np.maximum(c, 1)
        rest = lambda c, t: np.where(c > 0, DISCOUNT * t / np.maximum(c, 1), 1.0)
        c1, t1 = n1.sum(), (n1 > 0).sum()
        self.p1 = share(n1, c1) + rest(c1, t1) * s.base
        self.p2, self.p3 = share(n2, c2[s.before_of_bi]), share(n3, c3[s.context_of_tri])
        self.w2, self.w3 = rest(c2, t2), rest(c3, t3)


class Sample:
    """Passages of the fit: their expressions as numbers, with the counts of the corpus.

    ``share`` is the share of the corpus's documents that hold each trigram,
    bigram and word of the sample; ``base`` the share of each word in all words.
    """

    def __init__(self, g: Grams, toxic: np.ndarray, seed: np.ndarray):
        self.g, self.owner = g, g.owner
        self.toxic, self.seed = toxic[g.doc], seed[g.doc]  # of each passage
        self.tri, first, self.tri_at = np.unique(g.tri, return_index=True, return_inverse=True)
        bi, context, before, word = g.bi[first], g.context[first], g.before[first], g.word[first]
        self.bi = np.unique(np.concatenate([bi, context]))
        of = lambda table, keys: np.searchsorted(table, keys)
        self.word = np.unique(np.concatenate([g.word, g.before, [OPEN, CLOSE]]))
        self.bi_of_tri, self.context_of_tri, self.word_of_tri = of(self.bi, bi), of(self.bi, context), of(self.word, word)
        # pairs that are only contexts end no event, so what they point at does not count
        self.word_of_bi, self.before_of_bi = np.zeros(len(self.bi), np.int64), np.zeros(len(self.bi), np.int64)
        self.word_of_bi[self.bi_of_tri], self.before_of_bi[self.bi_of_tri] = self.word_of_tri, of(self.word, before)
        self.bi_at, self.word_at = self.bi_of_tri[self.tri_at], self.word_of_tri[self.tri_at]
        self.base = np.full(len(self.word), 1.0 / len(self.word))
        self.held = [np.zeros(len(k)) for k in (self.tri, self.bi, self.word)]
        self.n_docs = 0

    def counted(self, rows: pd.DataFrame, n_docs: int, n_words: int) -> None:
        """Take the corpus's counts: rows of (kind, at, docs, times)."""
        for k, held in enumerate(self.held):
            part = rows[rows["kind"] == k]
            held[part["at"]] = part["docs"]
        part = rows[rows["kind"] == 2]
        times = np.zeros(len(self.word))
        times[part["at"]] = part["times"]
        self.n_docs = n_docs
        self.base = (times + 0.5) / (n_words + 0.5 * (len(self.word) + 1))

    def lift(self, fold_of_doc: np.ndarray, fold: int, bad: np.ndarray) -> np.ndarray:
        """For each place the log of how much more frequent its expression is in bad passages outside the fold than in the corpus.

        The longest expression (trigram, bigram, word) decides that any of them holds.
        """
        g = self.g
        rest = bad & (fold_of_doc[g.doc] != fold)
        docs = max(1, len(np.unique(g.doc[rest & ~self.seed]))) + len(np.unique(g.doc[rest & self.seed])) / 4
        out = np.full(len(g.tri), -1.0)
        done = np.zeros(len(g.tri), bool)
        for at, held in zip((self.tri_at, self.bi_at, self.word_at), self.held):
            pick = rest[self.owner]
            key = np.unique(at[pick] * np.int64(len(fold_of_doc)) + g.doc[self.owner[pick]]) // len(fold_of_doc)
            n = np.bincount(key, minlength=len(held))
            usual = np.maximum(held, 1.0) / max(1, self.n_docs)
            rate = np.log((n + PRIOR * usual) / (docs + PRIOR) / usual)
            fresh = ~done & (n[at] > 0)
            out[fresh] = rate[at[fresh]]
            done |= fresh
        return out

    def abusive(self) -> tuple[np.ndarray, np.ndarray]:
        """Which passages are abuse, and which are left out of both models.

        Abuse are the seeds, and passages of documents rated abusive whose
        expressions other abuse shares.  Passages like them in documents rated
        ordinary are left out, for those ratings are wrong.
        """
        fold_of_doc = np.arange(int(self.g.doc.max(initial=-1)) + 1) % FOLDS
        bad = self.toxic.copy()
        for _ in range(2):
            kept = bad & self.seed
            for fold in range(FOLDS):
                here = np.flatnonzero(self.toxic & ~self.seed & (fold_of_doc[self.g.doc] == fold))
                if len(here):
                    kept[here] = best_windows(self.lift(fold_of_doc, fold, bad), self.g.starts, CORE, CORE)[here] > np.log(LIFT)
            bad = kept
        like = best_windows(self.lift(fold_of_doc, -1, bad), self.g.starts, CORE, CORE) > np.log(LIFT)
        return bad, like & ~self.toxic & ~self.seed


def best_windows(gain: np.ndarray, starts: np.ndarray, window: int = WINDOW, least: int = LEAST) -> np.ndarray:
    """For each passage the mean of its best window of at most ``window`` places; shorter ones are measured as ``least`` at least."""
    n = np.diff(starts)
    if not len(n):
        return np.empty(0)
    total = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
    out = (total[starts[1:]] - total[starts[:-1]]) / np.maximum(n, least)
    long = np.flatnonzero(n > window)
    if len(long):
        span = n[long] - window + 1
        first = np.concatenate(([0], np.cumsum(span)[:-1]))
        i = np.arange(span.sum()) - np.repeat(first, span) + np.repeat(starts[long], span)
        out[long] = np.maximum.reduceat(total[i + window] - total[i], first) / window
    return out


class Judge:
    """Tables of both models for every expression of the fit, and the threshold."""

    def __init__(self, sample: Sample, bad: np.ndarray, without: np.ndarray, threshold: float = 0.0):
        use = (~without).astype(float)
        twice = np.where(sample.seed, 2.0, 1.0)
        a, o = KneserNey(sample, use * twice * bad), KneserNey(sample, use * twice * ~bad)
        self.tri = Table(sample.tri, np.stack([a.p3, o.p3], 1), [0, 0])
        self.bi = Table(sample.bi, np.stack([a.p2, o.p2, a.w3, o.w3], 1), [0, 0, 1, 1])
        self.word = Table(sample.word, np.stack([a.p1, o.p1, a.w2, o.w2], 1), [0, 0, 1, 1])
        self.threshold = threshold

    def gains(self, g: Grams) -> np.ndarray:
        """Log-likelihood ratio of each place; 0 for words that the fit has not seen."""
        p3, b, c, w, x = self.tri(g.tri), self.bi(g.bi), self.bi(g.context), self.word(g.word), self.word(g.before)
        p = p3 + c[:, 2:] * (b[:, :2] + x[:, 2:] * w[:, :2])
        ok = w[:, 0] > 0
        out = np.zeros(len(g.tri))
        out[ok] = np.log(p[ok, 0] / p[ok, 1])
        return out

    def documents(self, texts: list) -> np.ndarray:
        """The score of each text: that of its worst passage, -5 without one."""
        g = grams(texts)
        out = np.full(len(texts), -5.0)
        np.maximum.at(out, g.doc, best_windows(self.gains(g), g.starts))
        return out


def sample_of(labelled: pd.DataFrame) -> Sample:
    """The passages of rated documents (``text``, ``toxic``) and of this library's table; null texts and ratings are left out."""
    rated = [(t, int(y)) for t, y in zip(labelled["text"], labelled["toxic"]) if isinstance(t, str) and y == y]
    seeds = [(t, 1) for t in rated_passages.ABUSIVE] + [(t, 0) for t in rated_passages.ORDINARY]
    both = seeds + rated
    return Sample(grams([t for t, _ in both]), np.array([y == 1 for _, y in both]), np.arange(len(both)) < len(seeds))


def corpus_counts(docs: DataFrame, sample: Sample) -> tuple[pd.DataFrame, int, int]:
    """Documents that hold each expression of the sample, over all (doc_id, text), with the number of documents and words.

    One job; what reaches the driver has the size of the sample's expressions.
    """
    keys = docs.sparkSession.sparkContext.broadcast([Table(k, np.arange(len(k))[:, None], [-1]) for k in (sample.tri, sample.bi, sample.word)])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = keys.value
        held = [np.zeros(len(t.keys), np.int64) for t in tables]
        times, n_docs, n_words = np.zeros(len(tables[2].keys), np.int64), 0, 0
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in slices(texts):
                g = grams(texts[a:b])
                doc = g.doc[g.owner]
                n_docs, n_words = n_docs + b - a, n_words + len(doc)
                for k, column in enumerate((g.tri, g.bi, g.word)):
                    at, where = tables[k].index(column)
                    if k == 2:
                        times += np.bincount(where, minlength=len(times))
                    one = np.unique(where * np.int64(b - a) + doc[at]) // (b - a)
                    held[k] += np.bincount(one, minlength=len(held[k]))
        for k, h in enumerate(held):
            at = np.flatnonzero(h)
            yield pd.DataFrame({"kind": k, "at": at, "docs": h[at], "times": times[at] if k == 2 else 0})
        yield pd.DataFrame({"kind": [3], "at": [0], "docs": [n_docs], "times": [n_words]})

    rows = docs.select("text").where("text is not null").mapInPandas(count, "kind int, at long, docs long, times long")
    found = rows.groupBy("kind", "at").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")).toPandas()
    whole = found[found["kind"] == 3]
    return found[found["kind"] < 3], int(whole["docs"].sum()), int(whole["times"].sum())


def slices(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``BATCH_CHARS`` characters, at least one text each."""
    begin = size = 0
    for k, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if size and size + n > BATCH_CHARS:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def fit(labelled: pd.DataFrame, docs: DataFrame | None = None) -> Judge:
    """Fit on rated documents, with the counts of the corpus (default: of the documents rated ordinary)."""
    s = sample_of(labelled)
    if docs is None:
        g, n, size = s.g, int(s.g.doc.max()) + 1, len(s.g.tri)
        use = ~s.toxic[s.owner]
        rows = []
        for k, at in enumerate((s.tri_at, s.bi_at, s.word_at)):
            held = np.bincount(np.unique(at[use] * np.int64(n) + g.doc[s.owner[use]]) // n, minlength=len(s.held[k]))
            rows.append(pd.DataFrame({"kind": k, "at": np.arange(len(held)), "docs": held, "times": np.bincount(at, minlength=len(held))}))
        s.counted(pd.concat(rows), len(np.unique(g.doc[~s.toxic])), size)
    else:
        s.counted(*corpus_counts(docs, s))
    bad, out = s.abusive()
    return Judge(s, bad, out, _threshold(s, bad, out))


def _threshold(s: Sample, bad: np.ndarray, left_out: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with nearly the best F1, on documents that the models have not seen.

    The labelled passages count as documents.  Abuse is over-represented among
    the ratings, so an ordinary document that is cut off wrongly counts
    ``RARER`` times.  No cut lies below ``FLOOR``.
    """
    n = int(s.g.doc.max()) + 1
    scores = np.full(n, -5.0)
    for fold in range(FOLDS):
        out = s.g.doc % FOLDS == fold
        gain = Judge(s, bad, out | left_out).gains(s.g)
        best = best_windows(gain, s.g.starts)
        np.maximum.at(scores, s.g.doc[out], best[out])
    labels = np.zeros(n, int)
    labels[s.g.doc[s.toxic]] = 1
    pairs = sorted(zip(scores.tolist(), labels.tolist()))
    total = int(labels.sum())
    hit, wrong, cuts = total, RARER * (n - total), []
    for (x, y), nxt in zip(pairs, [*pairs[1:], (pairs[-1][0] + 1, 0)]):
        hit, wrong = hit - y, wrong - RARER * (1 - y)
        cuts.append((2 * hit / max(1, hit + wrong + total), x, nxt[0]))
    best = max(c[0] for c in cuts)
    _, a, b = max((c for c in cuts if c[0] >= best - 0.01), key=lambda c: c[2] - c[1])
    return max(FLOOR, (a + b) / 2)


def rated_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> pd.DataFrame:
    """Rated documents, whole, with one rating each: the larger share decides.

    At most ``rows`` documents and ``chars`` characters together, by the smallest
    hashes of their ids; the first that does not fit ends the sample.
    """
    votes = labels.where("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("v")).select("doc_id", (F.col("v") >= 0.5).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = votes.orderBy(*order).limit(rows)
    texts = docs.select("doc_id", "text").where("text is not null")
    sizes = picked.join(texts.select("doc_id", F.length("text").alias("n")), "doc_id").orderBy(*order).toPandas()
    kept = sizes[sizes["n"].cumsum() <= chars]
    few = docs.sparkSession.createDataFrame(kept[["doc_id", "toxic"]], "doc_id long, toxic int")
    return F.broadcast(few).join(texts, "doc_id").dropDuplicates(["doc_id"]).orderBy(*order).toPandas()


def score(docs: DataFrame, judge: Judge) -> DataFrame:
    """Score every document of (doc_id, text): (doc_id, score, abusive).

    Whole texts are read.  Null, empty and blank texts score -5 and are not
    abusive.
    """
    wrapped = docs.sparkSession.sparkContext.broadcast(judge)  # bounded by the sample of the fit

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = wrapped.value
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in slices(texts):
                s = j.documents(texts[a:b])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "score": s, "abusive": s > j.threshold})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, abusive boolean")
