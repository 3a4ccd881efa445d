"""Byte-level BPE with the last valid token of every prefix, for exact appends and near edits."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lindero.llm.common import small_batches

# Pieces of text, prefixes and pairs remembered by one worker; two generations of each are kept.
REMEMBERED = 150_000
# Words of more bytes keep their prefixes to themselves: no deep recursion, no large keys.
SHORT = 64


class Memo(dict):
    """A bounded memory: when full, entries not used since the last change of generation go."""

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.shrink()
        self[key] = value
        return value

    def shrink(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


class Vocabulary:
    """Tokens by rank, and which pairs of tokens can stand side by side.

    Merging by rank never undoes a merge, so a row of tokens is the encoding of its bytes exactly
    when each two neighbours are the encoding of their own bytes. A token that its own bytes do
    not merge to is never the last of any prefix.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.whole = Memo(lambda rank: self.merge(self.bytes_of[rank]) == [rank])
        self.fits = Memo(self._fits)
        self.prefix = Memo(self._prefix)

    def merge(self, data: bytes, border: int = 0) -> list[int] | None:
        """The encoding by its definition: join the leftmost pair of lowest rank until none is left.

        None as soon as a token would reach over `border`, if one is given.
        """
        ranks, none = self.ranks, 1 << 30
        parts = [data[i:i + 1] for i in range(len(data))]
        found = [ranks.get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while found:
            low = min(found)
            if low == none:
                break
            at = found.index(low)
            if at + 1 == border:
                return None
            border -= at + 1 < border
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def _prefix(self, data: bytes) -> tuple[int, bytes]:
        """Last token of a short prefix and its ids; words share what their common prefixes have."""
        ranks, end = self.ranks, len(data)
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(data[start:])
            if token is None:
                continue
            if start == 0:
                if self.whole[token]:
                    return token, token.to_bytes(4, "little")
            else:
                last, ids = self.prefix[data[:start]]
                if self.fits[last << 32 | token]:
                    return token, ids + token.to_bytes(4, "little")
        raise ValueError(f"no token of the vocabulary ends {data!r}")

    def _fits(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        data = self.bytes_of[left]
        return self.merge(data + self.bytes_of[right], len(data)) == [left, right]


class Prefixes:
    """One word (a match of the splitting pattern) and the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last(self, data: bytes, last: list[int], end: int) -> int:
        """The unique token that ends the prefix of `end` bytes, from those of shorter prefixes."""
        v = self.vocabulary
        ranks, fits = v.ranks, v.fits
        for start in range(max(0, end - v.longest), end):
            token = ranks.get(data[start:end])
            if token is None:
                continue
            if start == 0:
                if v.whole[token]:
                    return token
            elif fits[last[start - 1] << 32 | token]:
                return token
        raise ValueError(f"no token of the vocabulary ends {data[:end]!r}")

    def append(self, more: bytes) -> None:
        """Longer by `more`: nothing before it is looked at again but the last few prefixes."""
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(self.data, self.last, end))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start to stop; returns how many prefixes were worked out anew.

        The last token of a prefix depends on the bytes of one token length and the last tokens
        in that stretch. As soon as a whole stretch after the edit has its old tokens, so has the
        rest.
        """
        old, tail = self.last, self.data[stop:]
        self.data = self.data[:start] + new + tail
        last, shift = old[:start], len(new) - (stop - start)
        same, done = 0, 0
        for end in range(start + 1, len(self.data) + 1):
            last.append(self._last(self.data, last, end))
            done += 1
            if end > start + len(new):
                same = same + 1 if last[-1] == old[end - 1 - shift] else 0
                if same >= self.vocabulary.longest and end - self.vocabulary.longest >= start + len(new):
                    last.extend(old[end - shift:])
                    break
        self.last = last
        return done

    def ids(self) -> list[int]:
        out, end, sizes = [], len(self.last), self.vocabulary.bytes_of
        while end:
            out.append(self.last[end - 1])
            end -= len(sizes[out[-1]])
        return out[::-1]


class _Unsafe(Exception):
    pass


class Encoder:
    """Encodes whole texts; each match of the pattern is encoded on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.piece = Memo(self._piece)

    def word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        if len(data) <= SHORT:
            return self.vocabulary.prefix[data][1]
        return np.array(Prefixes(self.vocabulary, data).ids(), dtype="<u4").tobytes()

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.word, self.pattern.findall(text)))

    def _piece(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsafe
        return self._words(" " + piece)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between two other characters always starts a new match of the usual
        patterns, so pieces between such spaces can be remembered with their ids; a text with
        other white space next to a space is matched as a whole.
        """
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Unsafe
            return self._words(first) + b"".join(map(self.piece.__getitem__, rest))
        except _Unsafe:
            return self._words(text)


class EncodedText:
    """A text with the prefixes of its words, for appends and edits that touch few words."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.words = encoder, "", []
        self.edit(0, 0, text)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters start to stop; returns how many words were encoded anew."""
        old, shift = self.words, len(new) - (stop - start)
        keep = 0  # a match looks at most two characters beyond its end
        while keep < len(old) and old[keep][0] + len(old[keep][1]) + 3 <= start:
            keep += 1
        at = old[keep][0] if keep < len(old) else (old[-1][0] + len(old[-1][1]) if old else 0)
        self.text = self.text[:start] + new + self.text[stop:]
        later = {w[0] + shift: i for i, w in enumerate(old) if w[0] >= stop}
        fresh, done = old[:keep], 0
        for match in self.encoder.pattern.finditer(self.text, at):
            if match.start() in later and match.start() >= start + len(new):
                fresh += [(w[0] + shift, w[1], w[2]) for w in old[later[match.start()]:]]
                break
            word = match.group()
            fresh.append((match.start(), word,
                          Prefixes(self.encoder.vocabulary, word.encode("utf-8"))))
            done += 1
        self.words = fresh
        return done

    def ids(self) -> list[int]:
        return [i for _, _, prefixes in self.words for i in prefixes.ids()]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder, with what it remembers, for all tasks of a worker."""
    return Encoder(load_ranks(path), pattern)


def _with(schema: T.StructType, **added: T.DataType) -> T.StructType:
    kept = [f for f in schema.fields if f.name.lower() not in {a.lower() for a in added}]
    return T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])


def _put(batch: pa.RecordBatch, names: list[str], **added: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(n) for n in names if n not in added}
    return pa.RecordBatch.from_pydict({**kept, **added})


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit integers) and n_tokens to every row.

    Null and empty texts have no ids. A text of any length is encoded whole; rows with equal
    text get equal ids. Input columns named ids or n_tokens are replaced. Narrow: no shuffle.
    """
    small_batches(docs.sparkSession)
    schema = _with(docs.schema, ids=T.BinaryType(), n_tokens=T.LongType())
    names = schema.names

    def run(batches):
        own = encoder(ranks_path, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield _put(batch, names, ids=pa.array(ids, pa.binary()),
                       n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()))

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (binary): the bytes of all tokens of ids. Null ids: no bytes."""
    schema = _with(encoded.schema, decoded=T.BinaryType())
    names = schema.names

    def run(batches):
        ranks = load_ranks(ranks_path)
        of = dict(zip(ranks.values(), ranks.keys()))
        for batch in batches:
            out = [b"".join(map(of.__getitem__, np.frombuffer(i or b"", "<u4").tolist()))
                   for i in batch.column("ids").to_pylist()]
            yield _put(batch, names, decoded=pa.array(out, pa.binary()))

    return encoded.mapInArrow(run, schema)
