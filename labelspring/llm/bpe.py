"""Token ids of whole texts by the byte-level tokenizer, with a bounded memory of words.

The tokenizer splits text before merging, and a space followed by a character
that is not white space always starts a new piece.  So a text may be cut there,
each part encoded by the library once, and its ids kept for the next occurrence.
A part of letters only is one piece, which goes to the library's merging directly.
Signs behind letters are a piece of their own, and so are a line end and the letters
and signs behind it; such a part is put together from its pieces and need not be kept.
"""

from __future__ import annotations

import os
import re
from array import array

from public_tokenizers import path

from labelspring.llm.common import keeps

KEPT_PARTS = 200_000  # parts in each of two generations remembered by one worker
KEPT_CHARS = 48  # longer parts are not remembered

# letters, signs (no apostrophe, which may take letters with it), and the same again on a new line
_SIGNS = r"[!-&(-/:-@\[-`{-~]*"
_SIGN_LETTERS = "".join(c for c in map(chr, range(128)) if re.fullmatch(_SIGNS, c))
_PIECES = re.compile(rf"([^\W\d_]+)({_SIGNS})(?:\n([^\W\d_]+)({_SIGNS}))?")

_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def _byte_letters() -> dict[int, str]:
    """How the vocabulary spells bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_SPELLED = _byte_letters()
_SPACE = _SPELLED[32]


class Memory(dict):
    """Values made on demand; what was not used for a generation is forgotten."""

    def __init__(self, make, kept: int = KEPT_PARTS):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_CHARS:
            self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value


class _Parts(Memory):
    """Parts of one piece are remembered, others put together from them."""

    def __init__(self, encoder: Encoder):
        super().__init__(encoder._word)
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        if not part.isalpha():
            return self.encoder._composed(part)
        # as in Memory, without further calls: every new word of a text comes here
        ids = self.old.get(part)
        if ids is None:
            ids = self.make(part)
        if len(part) <= KEPT_CHARS:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    _shared: dict[str, Encoder] = {}

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.merges = self.library.model
        self.parts = _Parts(self)
        self.first_words = Memory(self._bare, KEPT_PARTS // 8)  # words that begin a line
        self.others = Memory(self.whole, KEPT_PARTS // 8)
        self.line_end = self.whole("\n")

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()  # 32 bits, little-endian on every platform Spark runs on

    def whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _merged(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece[0] != " " else piece.encode().decode("latin-1").translate(_SPELLED)
        return self._bytes([t.id for t in self.merges.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        """Ids of a word behind its space."""
        if word.isascii():
            return array("I", [t.id for t in self.merges.tokenize(_SPACE + word)]).tobytes()
        return self._merged(" " + word)

    _bare = _merged

    def _composed(self, part: str) -> bytes:
        """Ids of a part that is not one word, behind its space."""
        word = part.rstrip(_SIGN_LETTERS)
        if word.isalpha():
            return self.parts[word] + self.others[part[len(word) :]]
        found = _PIECES.fullmatch(part)
        if found:
            word, signs, line_word, line_signs = found.groups()
            if word.isalpha() and (line_word is None or line_word.isalpha()):
                ids = self.parts[word] + (self.others[signs] if signs else b"")
                if line_word is not None:
                    ids += self.line_end + self.first_words[line_word] + (self.others[line_signs] if line_signs else b"")
                return ids
        return self.others[" " + part]

    @classmethod
    def shared(cls, name: str = "byte_bpe_50k.json") -> Encoder:
        """One for each worker process."""
        if name not in cls._shared:
            cls._shared[name] = cls(path(name))
        return cls._shared[name]

    def encode(self, text: str) -> bytes:
        parts = _CUT.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")
        first = self.whole(parts[0]) if parts[0] else b""
        return first + b"".join(map(self.parts.__getitem__, parts[1:]))


keeps("bpe", Encoder._shared.clear)
