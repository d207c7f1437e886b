"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.byte_words import added_strings, loaded, plain, signs

SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_tokens bigint, padding bigint"
)


class WordEncoder:
    """Token ids of whole texts; words between white space are encoded once and remembered as bytes.

    The tokenizer lower-cases, drops white space and never joins what stands on its two sides, so the ids of a text are
    those of its words in turn; a letter and the comma or stop after it are apart as well. It composes signs before it
    lowers them, so this holds for texts that are composed before and after. Other texts, those with signs on which the
    two notions of white space or of lower case differ, and those with a string of an added token are encoded as they
    are. The memory has two generations of about `most` words; what is met again moves to the newer one, and the older
    one goes when that is full, which only costs time.
    """

    def __init__(self, path: str, most: int = 100_000):
        self.tokenizer = loaded(path)
        self.model = self.tokenizer.model
        self.added = added_strings(self.tokenizer)
        self.most = most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is not None:
            return found
        found = self.older.pop(word, None)
        if found is not None:
            self.known[word] = found
            return found
        if plain(word):
            found = self._ids([t.id for t in self.model.tokenize(signs(word))])
        elif word[-1] in ",." and plain(word[:-1]):
            found = self._word(word[:-1]) + self._word(word[-1])
        else:
            found = self._ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.known[word] = found
        return found

    def _by_words(self, text: str, lower: str) -> bool:
        if any(x in lower for x in self.added):
            return False
        return text.isascii() and not _ODD.search(text) or self._composed(text, lower)

    def _composed(self, text: str, lower: str) -> bool:
        return is_normalized("NFC", text) and is_normalized("NFC", lower) and not _ODD.search(text)

    def __call__(self, text: str) -> np.ndarray:
        lower = text.lower()
        if not self._by_words(text, lower):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        words = lower.split()
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        for word in set(words).difference(self.known):
            self._word(word)
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.uint32)


_ODD = re.compile("[\x1c-\x1f\u0130\u03a3]")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


class Windows:
    """One task's windows. Levels are fills of partly filled windows; squares of their counts steer the placing.

    When more than most windows are open, the fullest is filled with what is cut from the emptiest.
    """

    def __init__(self, window: int, first_id: int, most: int = 1024):
        self.window, self.next_id, self.most = window, first_id, most
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def _close(self, pieces: list) -> tuple[int, list]:
        self.next_id += 1
        return self.next_id - 1, pieces

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _keep(self, level: int, pieces: list) -> None:
        self.open.setdefault(level, []).append(pieces)
        self.counts[level] += 1
        self.n_open += 1

    def place(self, piece) -> list[tuple[int, list]]:
        """Put a piece (key, start, ids, doc_tokens) where the sum of squared counts ends smallest; the fullest on ties.

        What is returned are the windows that became full.
        """
        size = len(piece[2])
        if size == self.window:
            return [self._close([piece])]
        here, there = self.counts[: self.window - size + 1], self.counts[size:]
        change = 2 * there + 1 - np.where(here > 0, 2 * here - 1, 0)
        change[-1] -= 2 * there[-1] + 1  # a window that becomes full leaves the count
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max  # no window has that level; level 0 is a new one
        change[0] = 2 * there[0] + 1 if size < self.window else 0
        level = len(change) - 1 - int(change[::-1].argmin())
        pieces = self._take(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            return [self._close(pieces)]
        self._keep(level + size, pieces)
        return [self._fill_fullest()] if self.n_open > self.most else []

    def _fill_fullest(self) -> tuple[int, list]:
        level = int(np.flatnonzero(self.counts)[-1])
        pieces, room = self._take(level), self.window - level
        while room:
            level = int(np.flatnonzero(self.counts)[0])
            spare = self._take(level)
            while room and spare:
                head, rest = _split(spare.pop(), room)
                pieces.append(head)
                room -= len(head[2])
                level -= len(head[2])
                if rest is not None:
                    spare.append(rest)
            if spare:
                self._keep(level, spare)
        return self._close(pieces)

    def finish(self) -> Iterator[tuple[int, list]]:
        """Close what is open: pieces of the emptiest windows are cut to fill the fullest, the rest takes powers of two."""
        left = deque(w for level in sorted(self.open, reverse=True) for w in self.open[level])
        spare: list = []
        while left or spare:
            pieces = left.popleft() if left else []
            room = self.window - sum(len(p[2]) for p in pieces)
            while room and (spare or left):
                if not spare:
                    spare = left.pop()
                head, rest = _split(spare.pop(), room)
                pieces.append(head)
                if rest is not None:
                    spare.append(rest)
                room -= len(head[2])
            if not room:
                yield self._close(pieces)
                continue
            # No more pieces: what remains is cut into lengths that need no padding.
            size = self.window - room
            queue = pieces[::-1]
            for bit in range(size.bit_length() - 1, -1, -1):
                want = size & (1 << bit)
                own = []
                while want:
                    head, rest = _split(queue.pop(), want)
                    own.append(head)
                    want -= len(head[2])
                    if rest is not None:
                        queue.append(rest)
                if own:
                    yield self._close(own)


def _split(piece, room: int):
    key, start, ids, total = piece
    if len(ids) <= room:
        return piece, None
    return (key, start, ids[:room], total), (key, start + room, ids[room:], total)


def _packed(path: str, end_id: int, window: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        windows = Windows(window, TaskContext.get().partitionId() << 36)
        out: list[tuple] = []

        def give(sequence_id: int, pieces: list) -> None:
            size, offset = sum(len(p[2]) for p in pieces), 0
            padding = 0 if size & (size - 1) == 0 else window - size
            for key, start, ids, total in pieces:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                out.append((key, start, len(ids), crc, total, sequence_id, offset, size, padding))
                offset += len(ids)

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), [key_type, *[pa.int64()] * 8], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, [id_col, *[x.split()[0] for x in SCHEMA.split(", ")]])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                for at in range(0, len(ids), window):
                    for done in windows.place((key, at, ids[at : at + window], len(ids))):
                        give(*done)
                if len(out) >= 8192:
                    yield flush()
        for done in windows.finish():
            give(*done)
        if out:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padding.

    A document is its token ids and end_id. Whole windows are cut from it first; the rest is placed online, as it
    comes, into the fill level that makes the sum of squared counts of partly filled windows smallest. Each input
    partition packs on its own, without a shuffle, and numbers its sequences in its own range. It holds 1,024 open
    windows at most, 8 MB of ids at 2,048 tokens a window: with more, the fullest is filled by cuts of the emptiest. At
    the end all fill one another so, and what remains is cut into powers of two, so no sequence needs padding.

    A null or empty text is the one token end_id. Repeated rows are packed as often as they come; a null id is kept.
    Very long texts give many whole windows. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return wanted.mapInArrow(_packed(tokenizer, end_id, window, id_col), f"`{id_col}` {kind}, {SCHEMA}")
