"""Token ids of whole texts, exactly as the tokenizers library gives them, through a cache of pre-tokens.

For the word-end BPE file, text falls into pre-tokens that never span white space. Each worker looks its
pre-tokens up in a dictionary and asks the library only for new ones: the model alone for letters whose
normal form is certain (ASCII, Latin-1, Latin Extended-A), the whole library for any other chunk between
ASCII white space. Tokenizers of another build get every chunk, or every text, from the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import numpy as np
from tokenizers import Tokenizer

from .common import Cache

_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-įı-ſ"
#: A character whose lower case, normal form or class may differ between libraries, or that may start a special token.
UNSURE = re.compile("[^\t-\r -~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ]|<\\|")
PRE_TOKEN = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}0-9]+")
_CHUNK = re.compile("[^\t-\r ]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """of(text) is the list of `pack`ed values of its pre-tokens; pack gets the ids of one pre-token.

    frequent: a first tier of known values; the second tier holds the last `limit` to twice as many words.
    """

    def __init__(self, path: str, pack: Callable[[list[int]], Any], frequent: dict[str, Any] | None = None, limit: int = 100_000):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pack = pack
        spec = json.loads(self.library.to_str())
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = (spec.get("normalizer") or {}).get("normalizers") or []
        self.by_word = (
            pre[0].get("pattern") == {"Regex": _SPLIT}
            and len(pre) == 2
            and pre[1].get("type") == "ByteLevel"
            and not pre[1].get("add_prefix_space")
            and not pre[1].get("use_regex")
            and [x.get("type") for x in normal] == ["NFC", "Replace", "Lowercase"]
            and all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) and x["content"].startswith("<|") and not re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        )
        self.letters = _byte_letters()
        self.model = self.library.model
        self.words = Cache(self._word, limit, frequent)
        self.chunks = Cache(self._chunk, limit // 8)

    def _word(self, word: str) -> Any:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(spelt)])

    def _chunk(self, chunk: str) -> Any:
        return self.pack(self.library.encode(chunk, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> list[str]:
        """The cached pre-tokens of a text; parts that only the library can cut are left out."""
        if not self.by_word:
            return []
        return PRE_TOKEN.findall(text.lower()) if not UNSURE.search(text) else [w for c in _CHUNK.findall(text) if not UNSURE.search(c) for w in PRE_TOKEN.findall(c.lower())]

    def of(self, text: str) -> list[Any]:
        if not text:
            return []
        if not self.by_word:
            return [self._chunk(text)]
        if not UNSURE.search(text):
            return list(map(self.words.__getitem__, PRE_TOKEN.findall(text.lower())))
        out: list[Any] = []
        for chunk in _CHUNK.findall(text):
            if UNSURE.search(chunk):
                out.append(self.chunks[chunk])
            else:
                out += map(self.words.__getitem__, PRE_TOKEN.findall(chunk.lower()))
        return out


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()
