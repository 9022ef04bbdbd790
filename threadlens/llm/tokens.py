"""Token ids of whole texts, with repeated words encoded once.

The two public vocabularies used here split a text before they merge symbols, and
no merge crosses that split. A text is therefore cut where the split certainly
cuts it too (at spaces), each distinct piece is encoded once per worker, and the
ids are joined. The ids equal those of one call over the whole text; the tests
compare them.

Most pieces are Latin words and punctuation. How both vocabularies split those is
plain: a run of letters (the first with the space before it), a run of punctuation, a
line break before letters. Such parts go straight to the
library's merges, each once, without its pattern matching; the words of many pieces are
the same. All other pieces are encoded by the whole library, as are all pieces of a
vocabulary that splits or rewrites a probe of every such character in another way.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np

#: Pieces remembered by a worker before it starts anew, and the longest one that is remembered.
REMEMBERED, LONGEST = 1_000_000, 64

_beside_a_space = re.compile(r" \s|[^\S ] ")
_other_spaces = re.compile(r"[^\S \n]")
# Letters that normal forms leave as they are; punctuation without that of contractions and special tokens.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=?@\[-`{}~"
_plain = re.compile(f" ?[{LETTERS}](?:[{LETTERS}{MARKS}]|\\n(?=[{LETTERS}]))*").fullmatch
_parts = re.compile(f" ?[{LETTERS}]+|[{MARKS}]+|\n").findall
_encoders: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, cut: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]


def byte_level() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, are
    written as the characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """Encodes texts to packed little-endian unsigned 32-bit ids.

    ``cut`` names where texts may be cut: ``"dropped"`` for vocabularies that drop
    white space, ``"leading"`` for those whose pieces may start with one space. With
    ``plain`` the strings of special tokens are text like any other. The remembered
    pieces are the items of this dictionary.
    """

    def __init__(self, path: str, cut: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain
        self._merged = self._tokenizer.model.tokenize
        self._pieces = {"dropped": self._words, "leading": self._spaced}[cut]
        self._characters = {b: c for c, b in byte_level().items()}
        self._known_parts: dict[str, bytes] = {}
        rewrite = self._tokenizer.normalizer.normalize_str if self._tokenizer.normalizer else str
        self._lowers = rewrite("AÉ") == "aé"
        latin = "".join(re.findall(f"[{LETTERS}]", "".join(map(chr, range(256)))))
        probe = latin + "".join(re.findall(f"[{MARKS}]", "".join(map(chr, range(128)))))
        if cut == "leading":
            probe = f" {probe}\n{probe}a\na"
        split = self._tokenizer.pre_tokenizer.pre_tokenize_str(rewrite(probe)) if self._tokenizer.pre_tokenizer else []
        self._splits = [x for x, _ in split] == [self._written(x) for x in _parts(probe)]

    @staticmethod
    def _words(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    @staticmethod
    def _spaced(text: str) -> list[str]:
        # A space beside other white space belongs to it: such a text stays whole.
        if "\0" in text or "  " in text or " \n" in text or "\n " in text:
            return [text]
        if _other_spaces.search(text) and _beside_a_space.search(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self._whole(piece)
        if self._splits and _plain(piece):
            known = self._known_parts
            ids = b"".join([known.get(x) or self._part(x) for x in _parts(piece)])
        else:
            ids = self._whole(piece)
        self[piece] = ids
        return ids

    def _whole(self, piece: str) -> bytes:
        return array("I", self._tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def _written(self, part: str) -> str:
        """The part as the merges see it: a character for each byte."""
        return (part.lower() if self._lowers else part).encode().decode("latin-1").translate(self._characters)

    def _part(self, part: str) -> bytes:
        ids = self._known_parts[part] = array("I", [t.id for t in self._merged(self._written(part))]).tobytes()
        return ids

    def encode(self, texts: Sequence[str], end: int | None = None) -> list[bytes]:
        """The packed ids of each text, with ``end`` after the last one."""
        # Parts cost more to find again than the pieces made of them.
        if len(self) + len(self._known_parts) > REMEMBERED:
            self.clear()
        if len(self._known_parts) > REMEMBERED // 2:
            self._known_parts.clear()
        tail, ids = b"" if end is None else np.array([end], "<u4").tobytes(), self.__getitem__
        return [b"".join(map(ids, self._pieces(t))) + tail for t in texts]
