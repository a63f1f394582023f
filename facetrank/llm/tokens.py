"""Token ids of texts by a byte-level BPE vocabulary of the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np

from facetrank.llm.common import held

#: Pieces that a worker remembers (about 200 bytes each); further ones are encoded each time they come.
REMEMBERED = 1_000_000

ID = "<u4"

# Letters and white space below U+0250; of these, all Unicode versions hold the same characters to be such.
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_BLANK = "\t-\r \u0085\u00a0"

_OTHER_SCRIPT = re.compile("[\u0250-\U0010ffff']")
_WORD = re.compile(f" ?[{_LETTER}]+")
_LATIN = re.compile(f" ?[{_LETTER}]+|[{_BLANK}](?=[{_LETTER}])|(?:(?![{_BLANK}][{_LETTER}])[^{_LETTER}])+")

# Byte-level vocabularies write a byte as the character of that number if it prints, else as the next one from 256 on.
_PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {byte: chr(256 + i) for i, byte in enumerate(b for b in range(256) if b not in _PRINTING)}


class Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers; the library encodes what is not remembered."""

    def __init__(self, tokenizer):
        super().__init__()
        self.encode = tokenizer.encode
        self.merge = tokenizer.model.tokenize
        self.is_byte_bpe = type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and tokenizer.normalizer is None
        # Tokens that the library finds in a text before it splits it, the leftmost and then longest first.
        added = {token.content: (i, token) for i, token in tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: np.array([i], ID).tobytes() for content, (i, _) in added.items()}
        by_length = sorted(added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, by_length))})") if added else None
        # Those that take blanks or word ends into account are left to the library.
        self.plain_added = not any(t.lstrip or t.rstrip or t.single_word for _, t in added.values())

    def of(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.__getitem__, split_pieces(text)))
        if not self.plain_added:
            return np.array(self.encode(text, add_special_tokens=False).ids, ID).tobytes()
        parts = self.cut.split(text)
        return b"".join(
            self.added[part] if i % 2 else b"".join(map(self.__getitem__, split_pieces(part))) if part else b""
            for i, part in enumerate(parts))

    def __missing__(self, piece: str) -> bytes:
        if self.is_byte_bpe and _WORD.fullmatch(piece):  # one word needs no further splitting, only the merges
            ids = [token.id for token in self.merge(piece.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        else:
            ids = self.encode(piece, add_special_tokens=False).ids
        ids = np.array(ids, ID).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


def _start(path: str) -> Pieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Pieces(Tokenizer.from_file(path))


def split_pieces(text: str) -> list[str]:
    """Cut a text only where the vocabulary's own splitting cuts too, so that its ids are those of its pieces in turn.

    In Latin script without apostrophes: words (with one blank before), a lone white space before a word, and what
    lies between. Otherwise: before each blank that follows a visible character.
    """
    if not _OTHER_SCRIPT.search(text):
        return _LATIN.findall(text)
    first, *rest = text.split(" ")
    pieces = [first] if first else []
    for part in rest:
        if pieces and pieces[-1][-1].isspace():
            pieces[-1] += " " + part
        else:
            pieces.append(" " + part)
    return pieces


def encode(path: str, text: str | None) -> bytes:
    """Ids of a whole text (null: none), as little-endian unsigned 32-bit integers.

    As the library by default, a text that spells an added token gets the id of that token.
    """
    if not text:
        return b""
    return held(("pieces", path), lambda: _start(path)).of(text)
