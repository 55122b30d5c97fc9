"""Token ids of whole texts with the tokenizers library, each distinct pre-token encoded once per worker.

The vocabulary lower-cases, drops white space and never merges across pre-tokens, so a text's ids are those of its
pre-tokens in order. Texts with characters for which that shortcut isn't certain go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

END_ID = 1
CACHE_WORDS = 300_000

_PLAIN = re.compile(r"[\t\n\r -~¡-įı-ňŊ-ž]*")
_LETTERS = "a-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_PRETOKEN = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")

# Byte-level vocabularies write a byte that has no visible Latin-1 character as one beyond 255, in rising order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers, without an end id."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def pretoken(self, word: str) -> bytes:
        """Ids of a normalised pre-token, straight from the library's model, which takes bytes as characters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if "<|" in t or not _PLAIN.fullmatch(t)]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        if len(self.known) > self.cache_words:
            self.known.clear()
        get, split, held = self.known.get, _PRETOKEN.findall, []
        new: dict[str, None] = {}
        for i in sorted(set(range(len(texts))).difference(odd)):
            words = split(texts[i].lower())
            found = list(map(get, words))
            if None in found:
                missed = [(k, words[k]) for k, ids in enumerate(found) if ids is None]
                new.update(dict.fromkeys([w for _, w in missed]))
                held.append((i, found, missed))
            else:
                out[i] = b"".join(found)
        for w in new:
            self.known[w] = self.pretoken(w)
        for i, found, missed in held:
            for k, w in missed:
                found[k] = self.known[w]
            out[i] = b"".join(found)
        return out

    @functools.cached_property
    def sentence_ends(self) -> np.ndarray:
        """Ids that end a sentence: those of ``.``, ``!`` and ``?`` standing alone."""
        return np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in self.whole([".", "!", "?"])]))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    return Encoder(path)
