"""Evaluation texts inside training text (problem 9).

Every window of the items is hashed under a few fixed masks that ignore some of
its positions.  The corpus is hashed the same way in one pass, and its windows
are joined with those of the items inside that pass: the items are a small table
that every task holds, sorted by hash.  Around each hit the words of both texts
are compared at once, for the task still has them, which gives the longest run of
equal words and the longest overlap that tolerates substitutions.  No text and no
window of the corpus is ever shuffled or collected; only found pairs leave the
pass.

Items are the stated query set.  They are held in blocks of at most
``BLOCK_WORDS`` words, one pass for each block, so their number has no limit and
no task holds more than one block.

Words are the maximal runs of a-z and 0-9 after lower-casing.  They are found and
coded on the bytes of a whole batch of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridrome.llm.codes import ODD, powers

#: Equal words that make a leak.
RUN = 15
#: Masks: 1 counts, 0 is ignored.  Together they hit every passage of 15 words with up to 3 substitutions.
MASKS = ("110101101", "11011101", "1111011", "1110111", "111111", "1101010011")
#: Share of equal words that an overlap with substitutions keeps.
TOLERANCE = 0.8
#: Words of items that one pass holds, and characters of text that are coded at once.
BLOCK_WORDS, BATCH_BYTES = 500_000, 1 << 22
#: Hits whose surroundings are compared at once.
HITS = 1 << 15
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def word_codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, one after the other, and where each text's words start (and the last end).

    Values that are no text have no words.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    raw = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    size = end - begin
    at = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(raw[at].astype(np.uint64) * powers(int(size.max()))[place], first)
        h = (h ^ (h >> np.uint64(31))) * ODD
    return h, np.concatenate(([0], np.searchsorted(begin, ends)))


def window_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each window of the mask's length, from the words' codes."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, 17, np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ codes[i : i + n]) * ODD
                h ^= h >> np.uint64(29)
    return h


def _owner(starts: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


class Items:
    """Words of a block of items, and for each mask their window hashes in order with their places."""

    def __init__(self, ids: list, texts: list):
        self.ids = np.array(ids, dtype=object)
        self.codes, self.starts = word_codes(texts)
        self.owner = _owner(self.starts)
        self.index = []
        for m in MASKS:
            h = window_hashes(self.codes, m)
            place = np.flatnonzero(self.owner[: len(h)] == self.owner[len(m) - 1 :]) if len(h) else np.empty(0, np.int64)
            order = place[np.argsort(h[place], kind="stable")]
            # a bit for each value of the low bits: most windows of the corpus end here
            maybe = np.zeros(1 << 20, bool)
            maybe[(h[order] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.index.append((h[order], order, maybe))

    def hits(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the corpus batch and in the items of all pairs of windows that agree under a mask, each pair once."""
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m, (known, place, maybe) in zip(MASKS, self.index):
            h = window_hashes(codes, m)
            if not len(h) or not len(known):
                continue
            at = np.flatnonzero(maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[owner[at] == owner[at + len(m) - 1]]
            lo, hi = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            n = hi - lo
            a.append(np.repeat(at, n))
            b.append(place[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        a, b = np.concatenate(a), np.concatenate(b)
        _, first = np.unique(a * len(self.codes) + b, return_index=True)
        return a[first], b[first]

    def _rich(self, codes: np.ndarray, starts: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, run: int) -> np.ndarray:
        """Which hits have a passage of ``run`` words around them with enough equal words."""
        off = np.arange(-run + 1, run)
        x, y = a[:, None] + off, b[:, None] + off
        d, t = owner[a], self.owner[b]
        ok = (x >= starts[d][:, None]) & (x < starts[d + 1][:, None]) & (y >= self.starts[t][:, None]) & (y < self.starts[t + 1][:, None])
        same = ok & (codes[np.where(ok, x, 0)] == self.codes[np.where(ok, y, 0)])
        full, whole = (np.pad(np.cumsum(z, axis=1), ((0, 0), (1, 0))) for z in (same, ok))
        return ((full[:, run:] - full[:, :-run] >= TOLERANCE * run - 1e-9) & (whole[:, run:] - whole[:, :-run] == run)).any(axis=1)

    def overlaps(self, texts: list, run: int) -> list[tuple[int, object, int, int]]:
        """(number of the text, item id, longest equal run, longest tolerant overlap) of all pairs with an overlap of ``run`` words."""
        codes, starts = word_codes(texts)
        owner = _owner(starts)
        a, b = self.hits(codes, owner)
        diagonals = set()
        for k in range(0, len(a), HITS):
            x, y = a[k : k + HITS], b[k : k + HITS]
            rich = self._rich(codes, starts, owner, x, y, run)
            x, y = x[rich], y[rich]
            d, t = owner[x], self.owner[y]
            diagonals.update(zip(d.tolist(), t.tolist(), ((x - starts[d]) - (y - self.starts[t])).tolist()))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, t, at in diagonals:
            got = stretch(codes[starts[d] : starts[d + 1]], self.codes[self.starts[t] : self.starts[t + 1]], at)
            was = best.get((d, t), (0, 0))
            best[d, t] = max(was[0], got[0]), max(was[1], got[1])
        return [(d, self.ids[t], *r) for (d, t), r in best.items() if r[1] >= run]


def stretch(a: np.ndarray, b: np.ndarray, d: int) -> tuple[int, int]:
    """Longest equal run and longest tolerant overlap of two word arrays on the diagonal ``d``."""
    lo, hi = max(0, d), min(len(a), len(b) + d)
    same = a[lo:hi] == b[lo - d : hi - d]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    best = int((edge[1::2] - edge[::2]).max(initial=0))
    # longest stretch whose share of equal words stays at TOLERANCE: prefix sums of gain
    gain = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - TOLERANCE, -TOLERANCE))))
    low = np.minimum.accumulate(gain)
    high = np.maximum.accumulate(gain[::-1])[::-1]
    near = i = j = 0
    while i < len(low) and j < len(high):
        if low[i] <= high[j] + 1e-9:
            near = max(near, j - i)
            j += 1
        else:
            i += 1
    return best, near


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``BATCH_BYTES`` characters, at least one text each."""
    begin = size = 0
    for k, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if size and size + n > BATCH_BYTES:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def _matcher(items, run: int):
    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = items.value
        for pdf in frames:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a, b in _slices(texts):
                rows = [(ids[a + k], *r) for k, *r in block.overlaps(texts[a:b], run)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "near"])

    return match


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most ``BLOCK_WORDS`` words (or of one item); one block is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        n = len(r.text) // 2 + 1  # a word has at least one character and one behind it
        if ids and size + n > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    if ids:
        yield Items(ids, texts)


def overlaps(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Pairs of (doc_id, text) and (item_id, text) that share a passage.

    Result: distinct (doc_id, item_id, run, near) with the longest run of equal
    words and the longest overlap of which ``TOLERANCE`` of the words are equal,
    where that has at least ``run`` words.  Null and short texts give no pair;
    ids that are delivered twice count as one where their pairs are equal.
    Runs of ``run`` equal words are found without exception.
    """
    spark, texts = docs.sparkSession, docs.select("doc_id", "text").where(F.col("text").isNotNull())
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, run int, near int"
    out = None
    for block in item_blocks(items):
        found = texts.mapInPandas(_matcher(spark.sparkContext.broadcast(block), run), kind)
        out = found if out is None else out.unionByName(found)
    return (spark.createDataFrame([], kind) if out is None else out).distinct()


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Documents with a run of ``run`` equal words of an item: distinct (doc_id, item_id)."""
    return overlaps(docs, items, run).where(F.col("run") >= run).select("doc_id", "item_id").distinct()
