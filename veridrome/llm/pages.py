"""Main body of web pages against what stands around it (problem 6).

A page is a flat sequence of text blocks, here its non-blank lines.  Each block
is described by its number of words and its link density, by those of its two
neighbours on each side, and by a few marks of form; a decision tree fitted on a
small labelled table decides.  The pages hold no markup any more, so link density
is estimated from the words: the labelled blocks give every word and pair of
words a weight for captions, prompts and notices (a ridge regression), and the
density of a block is their sum.  Those of the labelled blocks themselves are
what the other blocks give them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veridrome.llm import labelled_pages
from veridrome.llm.tree import Tree, fit

SPACES = re.compile(r"\s+")
PIECES = re.compile(r"\s*(?:\||·|»|«|›|→|←|↓|<<|>>|\s/\s|\s>\s|\s-\s)\s*|\s{2,}")
MARKED = re.compile(r"[|·»«›→←↓>/]|<<|\s-\s|\s{2}")
MARKS = re.compile(r"\s*[|·»«›→←↓]\s*")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
BULLET = re.compile(r"^(?:[•*·>–-]|\(?[a-z0-9]{1,2}[.)])\s+")
LINK_BULLET = re.compile(r"^[>*»→]\s+")
DEPTH, LEAST, RIDGE = 5, 20, 0.3
#: Pages whose blocks are looked at together.
PAGES = 500


def plain(line: str) -> str:
    """Lower case, single spaces, trimmed."""
    return SPACES.sub(" ", line.lower()).strip()


def _words(line: str) -> list[str]:
    """Words of a block in plain form; all numbers are one."""
    return ["0" if w[0].isdigit() else w for w in WORD.findall(line.lower())]


def _units(words: list[str]) -> set:
    """Words, and pairs of neighbours with the block's ends."""
    return {*words, *zip(["⟨", *words], [*words, "⟩"])}


class Captions:
    """Weights of units, fitted on labelled blocks by ridge regression: how much they speak for captions, prompts and notices.

    ``alone`` has the density of each labelled block as the others give it.
    """

    def __init__(self, blocks: list[tuple[str, bool]], shrink: float = RIDGE):
        labels: dict[tuple[str, ...], list[bool]] = {}
        for t, a in blocks:
            labels.setdefault(tuple(_words(t)), []).append(a)
        sets = [_units(list(k)) for k in labels]
        names = sorted(set().union(*sets), key=str)
        place = {u: i for i, u in enumerate(names)}
        x = np.zeros((len(sets), len(names)))
        for row, us in zip(x, sets):
            row[[place[u] for u in us]] = 1 / max(1, len(us)) ** 0.5
        y = np.array([2 * np.mean(v) - 1 for v in labels.values()])
        self.base = 0.0  # a block of unknown words is neither
        inverse = np.linalg.inv(x @ x.T + shrink * np.eye(len(y)))
        dual = inverse @ (y - self.base)
        self.weight = dict(zip(names, (x.T @ dual).tolist()))
        self.alone = dict(zip(labels, (y - dual / np.diag(inverse)).tolist()))

    def density(self, words: list[str]) -> float:
        """Link density of a block, about -1 to 1; unknown units count 0."""
        us, weight = _units(words), self.weight
        return self.base + sum([weight[u] for u in us if u in weight]) / len(us) ** 0.5


def _own(line: str, captions: Captions, alone: bool = False) -> tuple[float, ...]:
    """Words, link density (``alone``: as the other labelled blocks give it) and marks of form of one block."""
    words = _words(line)
    n = len(words)
    stripped = line.strip()
    pieces = [s for s in PIECES.split(stripped) if s] if MARKED.search(stripped) else [stripped]
    short = sum(k for k in (len(WORD.findall(s)) for s in pieces) if k <= 3) if len(pieces) > 1 else 0
    letters = [w for w in stripped.split() if w[0].isalpha()]
    return (
        n,
        captions.alone[tuple(words)] if alone else captions.density(words),
        short / max(1, n),
        len(pieces),
        sum(w[0].isupper() for w in letters) / max(1, len(letters)),
        float(stripped.endswith((".", "!", "?"))),
        float(bool(BULLET.match(stripped.lower()))),
        float(bool(LINK_BULLET.match(stripped))),
        float(any(s.strip().isdigit() for s in MARKS.split(stripped)[1:])) if len(pieces) > 1 else 0.0,
        stripped.count(":"),
    )


def _with_neighbours(own: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Features of the blocks of pages of the given sizes.

    Own ones; words and link density of one neighbour before and behind; their
    means over two on each side and the block itself; the place on the page.
    """
    near = own[:, [0, 1]]
    sizes = np.array(sizes, np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = np.arange(len(own)) - first
    left, right = i[:, None].astype(float), (np.repeat(sizes, sizes) - 1 - i)[:, None].astype(float)

    def at(step: int) -> np.ndarray:
        ok = (left if step < 0 else right) >= abs(step)
        return np.where(ok, near[np.clip(np.arange(len(own)) + step, 0, max(0, len(own) - 1))], 0.0)

    mean = (near + at(-1) + at(1) + at(-2) + at(2)) / (np.minimum(left, 2) + np.minimum(right, 2) + 1)
    return np.hstack([own, at(-1), at(1), mean, (mean + near) / 2, np.minimum(left, 8), np.minimum(right, 8)])


class PageModel:
    """The tree with the weights that its link densities come from."""

    def __init__(self, tree: Tree, captions: Captions):
        self.tree, self.captions = tree, captions

    def around_all(self, pages: list[list[str]]) -> list[np.ndarray]:
        """For each page which of its blocks stand around the article."""
        own = np.array([_own(t, self.captions) for p in pages for t in p], float)
        sizes = [len(p) for p in pages]
        if not len(own):
            return [np.zeros(0, bool) for _ in pages]
        return np.split(self.tree.predict(_with_neighbours(own, sizes)) > 0.5, np.cumsum(sizes)[:-1])

    def around(self, lines: list[str]) -> np.ndarray:
        """Which blocks of one page stand around the article."""
        return self.around_all([lines])[0]


def fit_pages(pages: list[list[tuple[str, bool]]]) -> PageModel:
    """Fit a tree on labelled pages; the densities of a block come from the other blocks."""
    captions = Captions([b for p in pages for b in p])
    own = np.array([_own(t, captions, True) for p in pages for t, _ in p], float)
    tree = fit(_with_neighbours(own, [len(p) for p in pages]), np.array([float(a) for p in pages for _, a in p]), depth=DEPTH, least=LEAST)
    return PageModel(tree, captions)


@lru_cache(maxsize=1)
def page_model() -> PageModel:
    """The model of the labelled table, fitted once on the driver and sent with the work."""
    return fit_pages(labelled_pages.pages())


def keep_title(outside: np.ndarray, lines: list[str], title: str | None) -> np.ndarray:
    """Lines around the article without those that repeat the page's title, which belong to the article."""
    if len(lines) and outside.any() and isinstance(title, str) and title.strip():
        t = plain(title)
        return outside & np.array([not b or plain(x) != t for x, b in zip(lines, outside)])
    return outside


def split_lines(text) -> tuple[list[int], list[str]]:
    """Numbers (from 1) and texts of the non-blank lines of a field."""
    if not isinstance(text, str):
        return [], []
    kept = [(i, t) for i, t in enumerate(text.split("\n"), 1) if t.strip()]
    return [i for i, _ in kept], [t for _, t in kept]


def _marker(model: PageModel, skip):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for begin in range(0, len(pdf), PAGES):
                part = pdf.iloc[begin : begin + PAGES]
                split = [split_lines(t) for name in ("content", "summary") for t in part[name]]
                outside = model.around_all([lines for _, lines in split])
                n = len(part)
                for k, (i, title, content) in enumerate(zip(part["id"], part["title"], part["content"])):
                    if skip and skip(title, content, split[k][1], outside[k]):
                        continue
                    for name, j in (("content", k), ("summary", n + k)):
                        numbers, lines = split[j]
                        rows += [(i, name, m) for m, b in zip(numbers, keep_title(outside[j], lines, title)) if b]
            yield pd.DataFrame(rows, columns=["id", "field", "line_no"])

    return run


def lines_around(pages: DataFrame, model: PageModel | None = None, skip=None) -> DataFrame:
    """Lines of (id, title, content, summary) that are no part of the article: (id, field, line_no).

    One pass over the pages; only the lines found are shuffled, to unify those
    of repeated rows.  Null, empty and blank fields give no row.  ``skip`` is a
    predicate of title, content, its lines and which of them stand around; records for which it holds give no row.
    """
    slim = pages.select("id", "title", "content", "summary")
    return slim.mapInPandas(_marker(model or page_model(), skip), "id string, field string, line_no int").distinct()


def main_body(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """Pages reduced to their article: (id, content, summary); blank lines inside it stay."""
    model = model or page_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = {"id": pdf["id"]}
            for name in ("content", "summary"):
                split = [split_lines(t) for t in pdf[name]]
                kept = []
                for title, text, (numbers, lines), outside in zip(pdf["title"], pdf[name], split, model.around_all([x for _, x in split])):
                    if not isinstance(text, str):
                        kept.append(None)
                        continue
                    gone = {m for m, b in zip(numbers, keep_title(outside, lines, title)) if b}
                    kept.append("\n".join(t for m, t in enumerate(text.split("\n"), 1) if m not in gone).strip("\n"))
                out[name] = kept
            yield pd.DataFrame(out)

    return pages.select("id", "title", "content", "summary").mapInPandas(run, "id string, content string, summary string")
