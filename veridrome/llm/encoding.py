"""Encoding of a corpus with a public tokenizer (problem 8).

Every text is cut into overlapping chunks of ``CHUNK`` code points.  The chunks
are pre-tokenised on their own; two neighbours are stitched at the first
pre-token boundary that both find in their overlap, for from there on their
scanners agree.  Where an overlap has none (a run of one kind of characters that
is longer), it is doubled until one is found or the text ends.  The pieces between
the stitches are encoded in batches and their ids concatenated.

One pass over the texts without an exchange: all chunks of a text are handled in
the task that read it.  A scan split bounds the bytes of such a task, so a long
text makes none longer than many short ones do, but for a single text that is
larger than a split.

Null and empty texts have an empty list of ids.  Special tokens in a text are
ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points of a chunk, and those that it shares with the next one at first.
CHUNK, OVERLAP = 2_000, 200
BATCH = 256


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def _merges(path: str):
    """The encoder of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, path: str) -> list[int]:
    """Where the pre-tokens of a text start."""
    return [a for _, (a, _) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def _found(text: str, start: int, lo: int, hi: int, path: str) -> set[int]:
    """Boundaries in [lo, hi) that a scan from ``start`` finds.

    A piece that ends in white space would be split otherwise without what
    follows, so those are left out, and so is the end of what was scanned.
    """
    at = (start + b for b in boundaries(text[start : hi + 1], path))
    return {b for b in at if lo <= b < hi and b > start and not text[b - 1].isspace()}


def stitches(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where a text is cut into pieces that can be encoded on their own, with 0 and its end."""
    n, cuts = len(text), [0]
    while cuts[-1] + chunk + overlap < n:
        last = cuts[-1]
        start, width = last + chunk, overlap
        while True:
            hi = min(n, start + width)
            # the chunk before was scanned from its own stitch, so what it finds is right
            met = _found(text, last, start, hi, path) & _found(text, start, start, hi, path)
            if met:
                cuts.append(min(met))
                break
            if hi == n:
                return [*cuts, n]
            width *= 2
    return [*cuts, n]


def _ids(texts: list[str], path: str, chunk: int, overlap: int) -> list[list[int]]:
    """Ids of each text, over the pieces of all of them."""
    owner, pieces = [], []
    for k, t in enumerate(texts):
        cuts = stitches(t, path, chunk, overlap) if len(t) > chunk + overlap else [0, len(t)]
        owner += [k] * (len(cuts) - 1)
        pieces += [t[a:b] for a, b in zip(cuts, cuts[1:])]
    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):  # the same vocabulary for a faster library
        encode = _merges(ranks).encode_ordinary
        parts = [encode(p) for p in pieces]
    else:
        parts = [e.ids for i in range(0, len(pieces), BATCH) for e in _tokenizer(path).encode_batch(pieces[i : i + BATCH], add_special_tokens=False)]
    out: list[list[int]] = [[] for _ in texts]
    for k, ids in zip(owner, parts):
        out[k].extend(ids)
    return out


def _encoder(path: str | None, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = path or vocabulary()
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                ids = _ids([t or "" for t in part.column("text").to_pylist()], p, chunk, overlap)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids of each text of (doc_id, text): (doc_id, ids), one row for each row.

    ``path`` is the vocabulary file (default: the byte-level one of the installed
    public tokenizers on each executor); a rank file of the same name beside it
    is used for the merges.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, chunk, overlap), f"doc_id {kind}, ids array<int>")


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> dict[int, bytes]:
    """Raw bytes of each id of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    extra = [b for b in range(256) if b not in plain]
    shown |= {chr(256 + i): b for i, b in enumerate(extra)}
    out = {}
    for token, i in _tokenizer(path).get_vocab().items():
        out[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
    return out


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Texts of (doc_id, ids): (doc_id, text), by joining the raw bytes of the ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = _bytes_of(path or vocabulary())
        for pdf in frames:
            texts = [b"".join(raw[int(i)] for i in ids).decode("utf-8", "replace") for ids in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
