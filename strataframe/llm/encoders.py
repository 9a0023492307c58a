"""Tokenizer files of public vocabularies, applied by the tokenizers library with a cache of what it gave for each word.

No token reaches from a word into the whitespace that follows it: in both known shapes of file (see `_kind`) a run of
whitespace belongs to the word after it or to the text's end. So a text is cut before its whitespace runs, the library
encodes each different piece once, and the ids are put together. The cache is bounded. Texts with special tokens or
rare spaces, and all texts under files of another shape, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

CACHE_WORDS = 700_000  # about 150 MB
SPACE = chr(256 + 32)  # of byte-level vocabularies
CACHE_CHARS = 64  # longer pieces are encoded each time
#: whitespace other than space, tab, line feed and carriage return
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: letters and the ASCII punctuation that ends the piece: a token ends between them
_TAILED = re.compile(r"([ \t\r\n]*[^\W\d_]+)([!-/:-@\[-`{-~]+)")
_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


class _Cache(dict):
    """piece -> packed ids; emptied when full, so its memory is bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        m = _TAILED.fullmatch(piece)
        v = self[m[1]] + self[m[2]] if m and m[1].lstrip(" \t\r\n").isalpha() else self.encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = v
        return v


class Encoder:
    """Ids of a text as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.kind, self.known, self.model = self._kind(spec), _Cache(self._piece), self.library.model

    def _kind(self, spec) -> str:
        """Which of the two known shapes the file has: byte (whitespace counts) or word (it only separates); any other is left to the library."""
        if spec.get("post_processor") or spec.get("truncation") or spec["model"]["type"] != "BPE":
            return ""
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            return "byte"
        kinds = [x["type"] for x in norm["normalizers"]] if norm and norm["type"] == "Sequence" else []
        if kinds == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            return "word"
        return ""

    def _piece(self, piece: str) -> bytes:
        """Plain ASCII words meet the library's model at once: their pre-token is the word, after a space with its stand-in."""
        word = piece[1:] if self.kind == "byte" and piece[0] == " " else piece
        if not (word.isascii() and word.isalpha()):
            return self.by_library(piece)
        word = word.lower() if self.kind == "word" else SPACE + word if word is not piece else word
        return packed([t.id for t in self.model.tokenize(word)])

    def by_library(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.kind or any(x in text for x in self.special) or _RARE_SPACE.search(text):
            return self.by_library(text)
        return b"".join(map(self.known.__getitem__, text.split() if self.kind == "word" else _PIECE.findall(text)))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ids_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u4")
