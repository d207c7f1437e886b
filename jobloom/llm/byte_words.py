"""Encoding single words by a byte-level tokenizer's model, without the cost of a whole text's steps."""

from __future__ import annotations

from unicodedata import is_normalized

from tokenizers import Tokenizer

#: Byte-level signs: printable Latin-1 bytes stand for themselves, the rest for what follows U+0100.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHIFTED = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
SIGNS = [chr(b) if b in set(_PRINTED) else _SHIFTED[b] for b in range(256)]


def loaded(path: str) -> Tokenizer:
    """The tokenizer with its own settings."""
    return Tokenizer.from_file(path)


def added_strings(tokenizer: Tokenizer) -> tuple[str, ...]:
    """The strings, in lower case, that the tokenizer finds in a text before it cuts words."""
    return tuple(sorted({t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()}))


def plain(word: str) -> bool:
    """True for letters only, of scripts whose letters every Unicode version agrees on, in composed form."""
    return word.isalpha() and (word.isascii() or (max(word) < "԰" and is_normalized("NFC", word)))


def signs(piece: str) -> str:
    """A piece as the model sees it: one sign for each byte."""
    return piece if piece.isascii() and piece.isalpha() else "".join([SIGNS[b] for b in piece.encode()])
