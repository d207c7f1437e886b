"""Token counts by section: whole texts are encoded once and token spans are joined with section spans."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.byte_words import added_strings, loaded, plain, signs

#: Pieces that the byte-level tokenizer never joins: a word with the one space before it, or white space.
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
SCHEMA = "section bigint, start bigint, `end` bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"


class SpanEncoder:
    """Character spans of a text's tokens under a byte-level tokenizer; pieces are encoded once and remembered.

    A text with a string of an added token, or a sign on which notions of white space differ, is encoded as it is.
    """

    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer = loaded(path)
        self.model = self.tokenizer.model
        self.odd = (*added_strings(self.tokenizer), "\x1c", "\x1d", "\x1e", "\x1f")
        self.most = most
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _tokens(self, piece: str) -> list[str]:
        word = piece[1:] if piece[0] == " " else piece
        if plain(word):
            return [t.value for t in self.model.tokenize(signs(piece))]
        if word and word[-1] in ",." and plain(word[:-1]):
            return [*self._tokens(piece[:-1]), *self._tokens(word[-1])]
        return self.tokenizer.encode(piece, add_special_tokens=False).tokens

    def _spans(self, piece: str, tokens: list[str]) -> tuple[bytes, bytes]:
        """Starts and ends in characters; each sign of a byte-level token stands for one byte."""
        ends = list(accumulate(map(len, tokens)))
        starts = [0, *ends[:-1]]
        if not piece.isascii():
            owner = [i for i, c in enumerate(piece) for _ in c.encode()]
            starts, ends = [owner[s] for s in starts], [owner[e - 1] + 1 for e in ends]
        return array("i", starts).tobytes(), array("i", ends).tobytes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if any(x in text for x in self.odd):
            # Strings of added tokens are cut out before the pieces are made; the separators are no white space there.
            whole = self._spans(text, self.tokenizer.encode(text, add_special_tokens=False).tokens)
            return tuple(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in whole)
        pieces = _PIECE.findall(text)
        if len(self.known) > self.most:
            self.known.clear()
        for p in set(pieces).difference(self.known):
            self.known[p] = self._spans(p, self._tokens(p))
        spans = [self.known[p] for p in pieces]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.fromiter((len(s) for s, _ in spans), dtype=np.int64, count=len(pieces)) // 4
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        starts = np.frombuffer(b"".join([s for s, _ in spans]), dtype=np.int32)
        ends = np.frombuffer(b"".join([e for _, e in spans]), dtype=np.int32)
        return starts + base, ends + base


@lru_cache(maxsize=2)
def encoder(path: str) -> SpanEncoder:
    """One encoder for all tasks of a worker."""
    return SpanEncoder(path)


def line_sections(text: str) -> list[tuple[int, int]]:
    """Spans of a text's lines, each with its line feed; an empty text has one empty line."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text) or not text:
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section and, last, of no section. Sections are ordered and don't overlap.

    A token goes to the section that holds most of its characters, the first of equals; characters outside sections
    count for none. A token is crossing when more than one section, or a section and none, holds some of it.
    """
    low = np.array([s for s, _ in sections], dtype=np.int64)
    high = np.array([e for _, e in sections], dtype=np.int64)
    n = len(sections)
    counts, crossing = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    if not len(starts):
        return counts, crossing
    if not n:
        counts[0] = len(starts)
        return counts, crossing
    at = np.searchsorted(low, starts, side="right") - 1
    inside = (at >= 0) & (ends <= high[at])
    counts[:n] += np.bincount(at[inside], minlength=n)
    for i in np.flatnonzero(~inside):
        s, e = int(starts[i]), int(ends[i])
        near = range(max(0, int(at[i])), int(np.searchsorted(low, e, side="left")))
        held = [(min(e, int(high[k])) - max(s, int(low[k])), k) for k in near]
        held = [(h, k) for h, k in held if h > 0]
        best = max(held, key=lambda x: (x[0], -x[1]), default=(0, n))
        rest = (e - s) - sum(h for h, _ in held)
        own = n if rest > best[0] else best[1]
        counts[own] += 1
        crossing[own] += bool(held)
    return counts, crossing


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
) -> DataFrame:
    """(id_col, section, start, end, n_tokens, n_crossing, doc_tokens), a row for each section of each document.

    Sections are the text's lines or, with sections_col, an array of (start, end) character spans, ordered and apart.
    The whole text is encoded once; each token is joined to sections by its characters and allocated whole, to the one
    that holds most of it, the first of equals. Tokens outside all sections are in a row with section -1, if there are
    any; a document's n_tokens sum to doc_tokens.

    A null or empty text has one empty line with 0 tokens; null sections, and null ones among them, are no sections. Repeated rows and null ids
    are kept, each with its own rows; an empty table gives no rows. Nothing is shuffled.
    """
    names = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            owners: list[int] = []
            given = batch.column(2).to_pylist() if sections_col else None
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py() or ""
                spans = line_sections(text) if given is None else [tuple(x.values())[:2] for x in given[i] or [] if x is not None]
                starts, ends = encode(text)
                counts, crossing = attribute(starts, ends, spans)
                rows = [(k, *s, counts[k], crossing[k], len(starts)) for k, s in enumerate(spans)]
                if counts[-1] or not rows:
                    rows.append((-1, 0, 0, counts[-1], crossing[-1], len(starts)))
                out += rows
                owners += [i] * len(rows)
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *cols], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    extra = [F.col(sections_col)] if sections_col else []
    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string"), *extra)
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
