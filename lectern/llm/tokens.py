"""Token ids of whole texts, by the public tokenizers, with a bounded cache of words.

The vocabulary used here never joins characters across a space or a newline, so a text's ids are
those of its space-separated parts, one after the other. Each Python worker keeps the ids of parts
that it has met; a repeated part costs one dictionary look-up. Parts of letters and closing
punctuation are looked up once more without case, since the vocabulary is lower case and splits
letters from punctuation.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


@functools.cache
def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(rest)) for b in range(256)]


class WordIds:
    """Ids as little-endian unsigned 32-bit integers.

    most: entries of each cache (parts as written, and stems without case), which then starts anew.
    """

    def __init__(self, path: str, most: int = 450_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _plain(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _stem(self, stem: str) -> bytes:
        if (found := self.stems.get(stem)) is None:
            if len(self.stems) >= self.most:
                self.stems.clear()
            letters = stem if stem.isascii() else "".join([_byte_letters()[b] for b in stem.encode()])
            found = self.stems[stem] = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return found

    def _end(self, end: str) -> bytes:
        if (found := self.stems.get(end)) is None:
            found = self.stems[end] = self._plain(end)
        return found

    def _ids(self, part: str) -> bytes:
        if m := _PLAIN.fullmatch(part):
            end = m[2]
            return self._stem(m[1].lower()) + self._end(end) if end else self._stem(m[1].lower())
        return self._plain(part)

    def encode(self, text: str | None) -> bytes:
        parts = (text or "").replace("\n", " ").split(" ")
        found = list(map(self.known.get, parts))
        try:
            return b"".join(found)
        except TypeError:  # some part isn't known yet
            pass
        if len(self.known) >= self.most:
            self.known.clear()
        known, longest = self.known, self.longest
        for n in [n for n, ids in enumerate(found) if ids is None]:
            part = parts[n]
            if (ids := known.get(part)) is None:
                ids = self._ids(part)
                if len(part) <= longest:
                    known[part] = ids
            found[n] = ids
        return b"".join(found)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return list(map(self.encode, texts))


@functools.cache
def word_ids(path: str, most: int = 450_000) -> WordIds:
    """One for each worker and vocabulary. Full caches of 450,000 entries take some 350 MB of a worker that is used again and again."""
    return WordIds(path, most)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
