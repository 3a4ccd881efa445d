"""Token ids by a byte-level tokenizer of the tokenizers library, each word merged once."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

REMEMBERED = 250_000   # words remembered with their ids; two generations are kept
LONG = 64              # characters from which a word is not remembered
# The library's pattern for words, with its classes of letters, numbers and white space
# written out for characters below U+0250, which are the same in every edition of Unicode.
LETTER, NUMBER, SPACE = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼½¾", r"\t-\r \x85\xa0"
WORD = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
        rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[ɐ-\U0010ffff]")


class Known(dict):
    """Words with their ids; looked up at the speed of a dict, as only new words come here."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.merge(word)
        if len(word) < LONG:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Words:
    """Ids of whole texts, equal to the library's own with its defaults.

    The library cuts a text into words by a pattern and merges the bytes of each word by itself. Here
    words are cut by the same pattern and go to the library's model once, as long as they are
    remembered. Texts with characters beyond U+024F or with a special string, which the library
    cuts out first, go to it as they are.
    """

    def __init__(self, library):
        self.library = library
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.cut = re.compile(WORD).findall
        wide = library.get_vocab_size() > 1 << 16
        self.kind, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.known = Known(self._merge)
        # how the library writes each byte: as one character
        own = sorted(set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256)))
        rest = [b for b in range(256) if b not in set(own)]
        self.written = {b: chr(256 + i) for i, b in enumerate(rest)}
        vocabulary = library.get_vocab()
        if any(self.written.get(b, chr(b)) not in vocabulary for b in range(256)):
            raise ValueError("not a byte-level tokenizer")

    def _merge(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            written = word.replace(" ", self.written[32])
        else:
            written = word.encode("utf-8").decode("latin-1").translate(self.written)
        return array(self.code, [t.id for t in self.library.model.tokenize(written)]).tobytes()

    def parts(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """For each text the ids of its words, or of the whole in one; null and empty: none."""
        for text in texts:
            if not text:
                yield []
            elif not text.isascii() and BEYOND.search(text) or any(
                    s in text for s in self.special):
                found = self.library.encode_batch_fast([text], add_special_tokens=False)[0]
                yield [array(self.code, found.ids).tobytes()]
            else:
                yield list(map(self.known.__getitem__, self.cut(text)))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(p) for p in self.parts(texts)]

    def counts(self, texts: list[str | None]) -> list[int]:
        size = self.kind.itemsize
        return [sum(map(len, p)) // size for p in self.parts(texts)]
