"""Token ids of texts, as little-endian bytes, with the words already met kept per Python worker.

Both encoders return what the ``tokenizers`` library returns for the same vocabulary file with
``add_special_tokens=False``. A text is cut only where its pre-tokenizer must cut it too, so that
the ids of a piece do not depend on its neighbours; other texts are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Pieces held by one worker before its cache starts anew (about 200 bytes each).
CACHE_PIECES = 1_000_000

#: Fixed value: the pre-tokenizer of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Pieces(dict):
    """ids of a piece, encoded when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        found = self[piece] = self.encode(piece)
        return found


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: visible Latin-1 ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE vocabulary in the tokenizers JSON format, merged by rank."""

    _two_spaces = re.compile(r"\s\s")

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._coder = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)
        self._pieces = _Pieces(lambda p: self._plain(p if p[:1] == "\n" else " " + p))

    def _plain(self, text: str) -> bytes:
        return np.array(self._coder.encode_ordinary(text), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return np.array(self._coder.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        if self._two_spaces.search(text) or text[:1].isspace():
            return self._plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._plain(first) + b"".join(map(self._pieces.__getitem__, rest))


class WordLevel:
    """A BPE vocabulary with word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._coder = Tokenizer.from_file(path)
        self._model = self._coder.model
        self._letters = {b: c for c, b in _byte_alphabet().items()}
        self._special = tuple(t.content for t in self._coder.get_added_tokens_decoder().values())
        self._pieces = _Pieces(self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self._coder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ".," and piece[-2].isalpha() and piece[-2] < "\u0130":
            return self._pieces[piece[:-1]] + self._pieces[piece[-1]]
        if piece.isalpha() and piece.islower() and max(piece) < "\u0130":  # nothing to normalise or to cut
            return np.array([t.id for t in self._model.tokenize("".join(map(self._letters.__getitem__, piece.encode())))], dtype="<u4").tobytes()
        return self._whole(piece) if piece else b""

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return self._whole(text)
        try:  # lower case is one to one there, and composition changes nothing
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(self._pieces.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(kind: str, path: str) -> ByteLevel | WordLevel:
    """One encoder for each worker and vocabulary file."""
    return {"byte": ByteLevel, "word": WordLevel}[kind](path)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
