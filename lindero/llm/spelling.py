"""Spelling variants: words one edit apart, found with bitsets over blocks of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import small_batches
from lindero.session import settle

MUTATED = 97          # one word form of a document in so many loses a letter
SHORTEST = 5          # code points of a word; a pair one edit apart then shares two at an end
RAREST = 3            # occurrences of a word
EDGE = 2              # code points at the start or end of a word that name its blocks
TILE = 1 << 13        # words of a block compared at once; larger blocks are split
TOGETHER = 256        # words looked up side by side
HELD = 300_000        # distinct words a task counts before it hands them on
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)


def words_of(doc_id, text: str) -> Counter:
    """Occurrences of the words of one document, of SHORTEST or more code points.

    Only A to Z are made small. A word whose hash with the document's id is divisible by MUTATED
    loses one code point.
    """
    found = Counter(RUN.findall(text.encode("utf-8").lower().decode("utf-8")))
    start = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode() + b":")
    hashed = ((run, zlib.crc32(run.encode("utf-8"), start)) for run in found)
    shortened = Counter()
    for run, h in [(r, h) for r, h in hashed if h % MUTATED == 0]:
        n, at = found.pop(run), h % len(run)
        if len(run) > SHORTEST:
            shortened[run[:at] + run[at + 1:]] += n
    found.update(shortened)
    return found


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of SHORTEST code points with RAREST occurrences over all documents.

    Each task adds up its documents' words before the shuffle. Null and empty texts have no words;
    repeated rows count each time; a null doc_id is hashed as `null`.
    """
    small_batches(docs.sparkSession)

    def handed(held):
        return pa.RecordBatch.from_pydict({
            "word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").to_pylist()):
                for word, n in words_of(doc_id, text or "").items():
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield handed(held)
                held = {}
        if held:
            yield handed(held)

    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST))


# --- one block

def letters(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, one row each, filled up with zeros."""
    return np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)


class PositionIndex:
    """For each position and letter the set of words that have it there, as bits of a row of words."""

    def __init__(self, words: list[str], width: int):
        self.letters = letters(words, width)
        self.sizes = np.array([len(w) for w in words])
        self.n = len(words)
        self.row = -(-self.n // 64)
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []
        for p in range(width):
            kinds, which = np.unique(self.letters[:, p], return_inverse=True)
            self.sets.append((kinds, self._bits(len(kinds), which)))

    def _bits(self, n_sets: int, which: np.ndarray) -> np.ndarray:
        """Sets of the words by number, and an empty one behind them."""
        flags = np.zeros((n_sets + 1, 64 * self.row), dtype=np.uint8)
        flags[which, np.arange(self.n)] = 1
        return np.packbits(flags, axis=1, bitorder="little").view("<u8")

    def having(self, position: int, wanted: np.ndarray) -> np.ndarray:
        """For each wanted letter the words that have it at the position."""
        if position >= len(self.sets):
            return np.zeros((len(wanted), self.row), dtype=np.uint64)
        kinds, sets = self.sets[position]
        at = np.minimum(np.searchsorted(kinds, wanted), len(kinds) - 1)
        return sets[np.where(kinds[at] == wanted, at, len(kinds))]

    def of_size(self, size: int) -> np.ndarray:
        return self._bits(1, np.where(self.sizes == size, 0, 1))[0]

    def near(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of wanted, word) exactly one edit apart; wanted holds words of one length.

        After each letter four sets of words are known: those without an error so far, and those
        with one replaced, missing or additional letter. The last two are read one position to the
        left or right.
        """
        count, size = wanted.shape
        same = np.full((count, self.row), ~np.uint64(0))
        replaced = np.zeros_like(same)
        shorter = np.zeros_like(same)
        longer = same.copy()
        for i in range(size):
            asked = wanted[:, i]
            here = self.having(i, asked)
            replaced &= here
            replaced |= same
            if i:
                shorter &= self.having(i - 1, asked)
            shorter |= same
            longer &= self.having(i + 1, asked)
            same &= here
            longer |= same
        found = ((replaced & ~same & self.of_size(size)) | (shorter & self.of_size(size - 1))
                 | (longer & self.of_size(size + 1)))
        rows, places = np.nonzero(found)
        bits = np.unpackbits(found[rows, places].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        return rows[hit], places[hit] * 64 + bit


def neighbours(words: list[str], counts: np.ndarray, indexed: np.ndarray, asking: np.ndarray,
               at_end: bool) -> dict:
    """Number of near words among the indexed ones, and the most frequent, of each asking word.

    In a block of equal ends, pairs of equal starts are left to the block of that start.
    """
    sizes = np.array([len(w) for w in words])
    order = np.lexsort((np.argsort(np.argsort(np.array(words, dtype=object))), -counts))
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    near = np.zeros(len(words), dtype=np.int64)
    best = np.full(len(words), len(words), dtype=np.int64)
    for size in np.unique(sizes[asking]).tolist():
        base = np.flatnonzero(indexed & (np.abs(sizes - size) <= 1))
        if not len(base):
            continue
        index = PositionIndex([words[i] for i in base], size + 1)
        asked = np.flatnonzero(asking & (sizes == size))
        for low in range(0, len(asked), TOGETHER):
            some = asked[low:low + TOGETHER]
            wanted = letters([words[i] for i in some], size)
            who, hit = index.near(wanted)
            if at_end:
                apart = (wanted[who, :EDGE] != index.letters[hit, :EDGE]).any(axis=1)
                who, hit = who[apart], hit[apart]
            near += np.bincount(some[who], minlength=len(words))
            np.minimum.at(best, some[who], rank[base[hit]])
    got = np.flatnonzero(near)
    top = order[best[got]]
    return {"word": [words[i] for i in got], "near": near[got],
            "best_n": counts[top], "best": [words[i] for i in top]}


# --- jobs

def blocks(vocabulary: DataFrame) -> DataFrame:
    """Each word in the block of its first and of its last two code points.

    Two words one edit apart have four or more code points in common at their ends, so two at one
    of them. A block of more than TILE words is cut by hash; each tile's words are indexed once
    for every tile that asks (`asked_by`), and ask every tile (`tile`).
    """
    ends = vocabulary.select("word", "n", F.explode(F.array(
        F.struct(F.lit(False).alias("at_end"), F.substring("word", 1, EDGE).alias("edge")),
        F.struct(F.lit(True).alias("at_end"), F.substring("word", -EDGE, EDGE).alias("edge"))
    )).alias("e")).select("word", "n", "e.*")
    # as many rows as there are pairs of letters, whatever the size of the vocabulary
    sizes = ends.groupBy("at_end", "edge").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    meets = F.sequence(F.lit(0), F.col("tiles") - 1)
    return (
        ends.join(F.broadcast(sizes), ["at_end", "edge"]).withColumn("own", own)
        .withColumn("m", F.explode(F.concat(
            F.transform(meets, lambda t: F.struct(
                F.col("own").alias("tile"), t.alias("asked_by"), F.lit(True).alias("indexed"),
                (t == F.col("own")).alias("asking"))),
            F.transform(F.filter(meets, lambda t: t != F.col("own")), lambda t: F.struct(
                t.alias("tile"), F.col("own").alias("asked_by"), F.lit(False).alias("indexed"),
                F.lit(True).alias("asking"))))))
        .select("word", "n", "at_end", "edge", "m.*"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, best_n, best): near words of each word in each tile that has any."""
    def run(group: pa.Table) -> pa.Table:
        at_end = group.column("at_end")[0].as_py()
        found = neighbours(
            group.column("word").to_pylist(), group.column("n").to_numpy(),
            np.asarray(group.column("indexed")), np.asarray(group.column("asking")), at_end)
        return pa.table({
            "word": pa.array(found["word"], pa.string()), "near": pa.array(found["near"], pa.int64()),
            "best_n": pa.array(found["best_n"], pa.int64()),
            "best": pa.array(found["best"], pa.string())})

    return blocks(vocabulary).groupBy("at_end", "edge", "tile", "asked_by").applyInArrow(
        run, "word string, near bigint, best_n bigint, best string")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word reached from form to form.

    Each form is at least twice as frequent as its word, so there is no circle, and every round
    doubles the steps already taken: six rounds are enough for any count of 64 bits.
    """
    steps = settle(forms.filter(F.col("form").isNotNull()).select(
        "word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(steps.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "forms")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents.

    A word's form is its near word of largest n (ties: the smallest by code points) if that has at
    least twice its n, else null; root is the word itself where there is none. An empty table, or
    one without words, gives an empty result. Columns beside doc_id and text are not looked at.
    """
    vocabulary = settle(count_words(docs), "vocabulary")
    nothing = vocabulary.select(
        "word", "n", F.lit(0).cast("bigint").alias("near"),
        F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best"))
    found = near_words(vocabulary).withColumn("n", F.lit(None).cast("bigint"))
    # the smallest of (negative n, word) is the most frequent near word
    best = F.min(F.when(F.col("best").isNotNull(), F.struct(
        (-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    joined = nothing.unionByName(found).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    known = -F.col("b.less") >= 2 * F.col("n")
    forms = settle(joined.select(
        "word", "n", "n_near", F.when(known, F.col("b.word")).alias("form"),
        F.when(known, -F.col("b.less")).alias("form_n")), "near")
    return forms.join(follow(forms), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))
