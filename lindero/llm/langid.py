"""Language identification with a small convolutional network over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import small_batches, unit_hash

LENGTH = 128           # bytes of a window
WIDTHS = (2, 3, 5)     # bytes seen by the filters
FILTERS = 12           # of each width
SIZE = 8               # of a byte's vector
SAMPLE = 6000          # documents the network learns from, at most
CROPS = 3              # stretches taken from each of them
CHUNK = 128            # windows worked on at once
SURE = 0.9             # probability from which a window of a longer text has one language
ENOUGH = 2 * LENGTH    # letter bytes of a longer text
SHARE = 0.25           # of a text's letters in such windows, from which it has languages
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
# ASCII letters count as small ones.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
# Bytes of letters: ASCII ones (folded) and all parts of longer characters.
LETTERS = (np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122))


@dataclass
class Network:
    """Byte vectors, filters of several widths (padded to the widest), max pooling, softmax."""

    names: list[str]
    vectors: np.ndarray    # (256, SIZE)
    filters: np.ndarray    # (widest * SIZE, len(WIDTHS) * FILTERS)
    bias: np.ndarray
    dense: np.ndarray      # (len(WIDTHS) * FILTERS, classes)
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strongest answer of each filter in each window, where it was, and the patches."""
        n, widest = len(windows), max(WIDTHS)
        places = LENGTH - widest + 1
        seen = self.vectors[windows]
        patches = np.lib.stride_tricks.as_strided(
            seen, (n, places, widest * SIZE),
            (seen.strides[0], seen.strides[1], seen.strides[2])).reshape(n * places, -1)
        out = (patches @ self.filters).reshape(n, places, -1)
        at = None
        top = out.max(axis=1) + self.bias
        return np.maximum(top, 0), (out, at), patches.reshape(n, places, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.names)), dtype=np.float32)
        for i in range(0, len(windows), CHUNK):
            pooled, _, _ = self.pooled(windows[i:i + CHUNK])
            out[i:i + CHUNK] = softmax(pooled @ self.dense + self.offset)
        return out

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Name and probability for each whole text: the mean over its windows, by their bytes."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.names and LETTER.search(t)]
        if not known:
            return found
        windows, first, filled = cut([texts[i] for i in known])
        weighted = self.probabilities(windows) * filled[:, None]
        total = np.add.reduceat(weighted, first, axis=0)
        mean = total / total.sum(axis=1, keepdims=True)
        best = mean.argmax(axis=1)
        for i, b, p in zip(known, best, mean[np.arange(len(known)), best]):
            found[i] = (self.names[b], float(min(1.0, max(0.0, p))))
        return found

    def recognised(self, texts: list[str | None]) -> list[bool]:
        """Whether each text has any language, one or several.

        It has none without a letter, or when less than SHARE of its letter bytes lie in sure
        windows. A window is sure when its best name has a probability of SURE; the fewer letter
        bytes than ENOUGH the text has, the less they can tell, and the bound falls in proportion
        to the probability of a guess. So texts of every length are judged by the network. Where
        nothing was learned a text with a letter passes.
        """
        found = [bool(t and LETTER.search(t)) for t in texts]
        known = [i for i, f in enumerate(found) if f] if self.names else []
        if not known:
            return found
        windows, first, _ = cut([texts[i] for i in known])
        letters = LETTERS[windows].sum(axis=1)
        total = np.add.reduceat(letters, first)
        guess = 1.0 / len(self.names)
        bound = guess + (SURE - guess) * np.minimum(1.0, total / ENOUGH)
        best = self.probabilities(windows).max(axis=1)
        sure = letters * (best >= np.repeat(bound, np.diff(np.append(first, len(windows)))))
        for i, all_of, sure_of in zip(known, total, np.add.reduceat(sure, first)):
            found[i] = bool(sure_of >= SHARE * all_of)
        return found


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts in windows of equal length, each text's first window, bytes in each."""
    parts = [np.frombuffer(t.encode("utf-8"), dtype=np.uint8) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // LENGTH))
    first = np.cumsum(counts) - counts
    flat = np.full(int(counts.sum()) * LENGTH, 32, dtype=np.uint8)
    filled = np.full(int(counts.sum()), LENGTH, dtype=np.float32)
    for part, at in zip(parts, first * LENGTH):
        flat[at:at + len(part)] = part
    filled[first + counts - 1] = np.maximum(1, sizes - (counts - 1) * LENGTH)
    return FOLD[flat].reshape(-1, LENGTH), first, filled


def fit(texts: list[str], labels: list[str], rounds: int = 6, seed: int = 5) -> Network:
    """Trained by Adam on stretches of labelled text; equal input gives an equal network."""
    names = sorted(set(labels))
    random = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.zeros((widest * SIZE, n_filters), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * SIZE, k * FILTERS:(k + 1) * FILTERS] = 1
    net = Network(
        names, random.normal(0, 0.5, (256, SIZE)).astype(np.float32),
        random.normal(0, 0.2, mask.shape).astype(np.float32) * mask,
        np.zeros(n_filters, dtype=np.float32),
        random.normal(0, 0.2, (n_filters, max(1, len(names)))).astype(np.float32),
        np.zeros(max(1, len(names)), dtype=np.float32))
    if not names:
        return net
    windows, first, _ = cut(texts)
    counts = np.diff(np.append(first, len(windows)))
    wanted = np.repeat(np.array([names.index(x) for x in labels]), counts)
    parameters = [net.vectors, net.filters, net.bias, net.dense, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for turn in range(rounds):
        order = random.permutation(len(windows))
        for i in range(0, len(order), CHUNK):
            pick = order[i:i + CHUNK]
            some, y, n = windows[pick], wanted[pick], len(pick)
            pooled, (out, _), patches = net.pooled(some)
            at = out.argmax(axis=1)
            error = softmax(pooled @ net.dense + net.offset)
            error[np.arange(n), y] -= 1
            error /= n
            back = (error @ net.dense.T) * (pooled > 0)
            chosen = patches[np.arange(n)[:, None], at]              # (n, filters, widest * SIZE)
            into = (back[:, :, None] * net.filters.T[None]).reshape(-1, widest, SIZE)
            bytes_at = some[np.arange(n)[:, None, None],
                            at[:, :, None] + np.arange(widest)].reshape(-1, widest)
            vectors = np.zeros_like(net.vectors)
            np.add.at(vectors, bytes_at, into)
            slopes = [vectors, np.einsum("nfp,nf->pf", chosen, back) * mask, back.sum(axis=0),
                      pooled.T @ error, error.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - turn / rounds) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for p, g, (m, v) in zip(parameters, slopes, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


def draw(docs: DataFrame, allowed, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(lang, stretch) to learn from: about sample / languages documents of each language.

    `allowed` is a condition on the documents that may be learned from. The driver receives the
    number of documents by language and at most `sample` * CROPS stretches of LENGTH characters,
    taken at hashed places of the sampled texts. A surplus is cut from all languages alike.
    """
    own = docs.filter(allowed & F.col("lang").isNotNull()).withColumn(
        "has", F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).filter("has")
    counts = {r["lang"]: r["n"] for r in
              own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    each = sample / len(counts)
    rates = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, each / n)])
    # the hash as a share of the language's rate: below 1 in the sample
    turn = unit_hash(F.col("doc_id"), F.lit("langid")) / F.element_at(rates, F.col("lang"))
    drawn = own.withColumn("turn", turn).filter("turn < 1").select(
        "lang", "turn", F.explode(F.transform(
            F.sequence(F.lit(1), F.lit(CROPS)),
            lambda k: F.substr(
                F.col("text"),
                (unit_hash(F.col("doc_id"), k)
                 * F.greatest(F.lit(1), F.length("text") - F.lit(LENGTH))).cast("int") + 1,
                F.lit(LENGTH)))).alias("crop"))
    return sorted((r["lang"], r["crop"]) for r in
                  drawn.orderBy("turn", "crop").limit(sample * CROPS).collect())


def learn(docs: DataFrame, allowed, sample: int = SAMPLE) -> Network:
    """The network of the bounded sample of `draw`; nothing to learn from: one without names."""
    rows = draw(docs, allowed, sample)
    return fit([r[1] for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """Adds lang_pred and lang_score to every row; replaces input columns of these names.

    The whole text is classified in windows of LENGTH bytes; the answer is the name of largest
    mean probability, and that probability. A null text, or one without a letter, is `und` with
    score 0, as is every text when nothing was learned. Narrow: no shuffle.
    """
    small_batches(docs.sparkSession)
    own = {"lang_pred": T.StringType(), "lang_score": T.DoubleType()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in own]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in own.items()])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            found = network.classify(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                **{n: batch.column(n) for n in names},
                "lang_pred": pa.array([x[0] for x in found], pa.string()),
                "lang_score": pa.array([x[1] for x in found], pa.float64())})

    return docs.mapInArrow(run, schema)


def keep_recognised(docs: DataFrame, network: Network) -> DataFrame:
    """Rows whose text has any language by `Network.recognised`. Narrow: no shuffle.

    Null and empty texts, and others without a letter, go; equal rows are kept or rejected alike. All
    columns are kept whatever their names. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            kept = network.recognised(batch.column("text").to_pylist())
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
