"""Token ids of texts through a public tokenizer, with a cache of words per Python worker."""

from __future__ import annotations

import json
import os
import sys
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import tokenizers  # noqa: E402

DEFAULT = "word_bpe_49k.json"
# Entries kept per worker, of stretches between white space and of words; beyond these bounds
# a cache starts anew.
CACHED_STRETCHES, CACHED_WORDS = 400_000, 600_000
# Characters that normal forms leave alone and whose case and class all libraries agree on.
PLAIN = bytes([*range(9, 14), *range(32, 127), *range(192, 215), *range(216, 247), *range(248, 256)])


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenIds:
    """Ids of whole texts without special tokens around them, as little-endian uint32 bytes.

    The tokenizer itself does all work. Where its file says that it lower-cases, splits by a
    pattern that never takes in white space and then handles each word alone, plain texts are
    split here, at white space and by that same pattern, and only words that the worker has
    not yet seen go through its model.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.pattern = self._word_pattern(config)

    @staticmethod
    def _word_pattern(config: dict):
        normal = (config["normalizer"] or {}).get("normalizers", [])
        steps = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or len(steps) != 2:
            return None
        split, level = steps
        if split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel":
            return None
        if split["behavior"] != "Removed" or level["add_prefix_space"] or level["use_regex"]:
            return None
        pattern = split["pattern"]["Regex"]
        words = regex.compile(pattern)
        return None if "(?" in pattern or words.search("\t\n\v\f\r ") else words

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(word)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _stretch(self, stretch: str) -> bytes:
        out = []
        for word in self.pattern.findall(stretch):
            ids = self.words.get(word)
            if ids is None:
                ids = self.words[word] = self._word(word)
            out.append(ids)
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            return False

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pattern is None or not self._plain(text) or any(s in text for s in self.special):
            return self._whole(text)
        stretches = text.lower().split()
        try:
            return b"".join(map(self.stretches.__getitem__, stretches))
        except KeyError:
            if len(self.stretches) > CACHED_STRETCHES:
                self.stretches.clear()
            if len(self.words) > CACHED_WORDS:
                self.words.clear()
            for stretch in set(stretches).difference(self.stretches):
                self.stretches[stretch] = self._stretch(stretch)
            return b"".join(map(self.stretches.__getitem__, stretches))


@cache
def token_ids(path: str) -> TokenIds:
    """One tokenizer, and one cache, per Python worker."""
    return TokenIds(path)
