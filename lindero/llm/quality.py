"""Document quality by attention over passages (multiple-instance learning)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import join_texts, mix64, small_batches, unit_hash, word_hashes

PASSAGE = 512        # bytes
CLASSES = 103        # of bytes: 95 printable, newline, tab, other control, high bytes by kind
GRAMS = 512          # bins for runs of four bytes
MEASURES = 6
FEATURES = CLASSES + MEASURES
HIDDEN, ATTENTION = 24, 12
SAMPLE = 6000        # labelled documents the model learns from, at most
BAG = 24             # passages of one document used in learning, at most
PASSAGES_AT_ONCE = 4096

KIND = np.full(256, 97, dtype=np.uint8)
KIND[32:127] = np.arange(95)
KIND[10], KIND[9] = 95, 96
KIND[128:192], KIND[192:194], KIND[194:196] = 98, 99, 100
KIND[196:224], KIND[224:256] = 101, 102


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text and each text's first passage (none: an empty one).

    Worked out in stretches of whole passages, so a text of any length takes bounded memory
    besides its own bytes and features.
    """
    stretch = PASSAGES_AT_ONCE * PASSAGE
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    pending: list[bytes] = []
    owners: list[int] = []
    size = 0

    def work():
        part, n = _features(pending)
        out.append(part)
        np.add.at(counts, owners, n)

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8")
        for at in range(0, max(1, len(data)), stretch - PASSAGE):
            pending.append(data[at:at + stretch - PASSAGE])
            owners.append(i)
            size += len(pending[-1]) + 1
            if size >= stretch:
                work()
                pending, owners, size = [], [], 0
    if pending:
        work()
    first = np.cumsum(counts) - counts
    return (np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)), first


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, starts = join_texts(texts)
    sizes = np.diff(starts)                       # with the closing space: never 0
    counts = np.maximum(1, -(-(sizes - 1) // PASSAGE))
    first = np.cumsum(counts) - counts
    of = np.repeat(first, sizes) + np.minimum(
        (np.arange(len(data)) - np.repeat(starts[:-1], sizes)) // PASSAGE,
        np.repeat(counts - 1, sizes))
    n = int(counts.sum())
    length = np.bincount(of, minlength=n).astype(np.float32)
    shares = np.bincount(of * CLASSES + KIND[data], minlength=n * CLASSES)
    shares = np.sqrt(shares.reshape(n, CLASSES) / length[:, None])
    quad = data.astype(np.uint32)
    run = quad.copy()
    for k in (1, 2, 3):
        run[k:] = run[k:] * np.uint32(1) + (quad[:-k] << np.uint32(8 * k))
    bins = (run * np.uint32(2654435761)) >> np.uint32(32 - 9)
    seen = np.zeros(n * GRAMS, dtype=bool)
    seen[of * GRAMS + bins] = True
    spread = seen.reshape(n, GRAMS).sum(axis=1) / np.minimum(length, GRAMS)
    where, hashes = word_hashes(data)
    holder = of[where]
    words = np.bincount(holder, minlength=n).astype(np.float32)
    pairs = np.unique(mix64(hashes ^ mix64(holder.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(holder[pairs], minlength=n)
    per_word = length / np.maximum(words, 1)
    upper = ((data >= 65) & (data <= 90)).astype(np.float32)
    caps = np.bincount(of, weights=upper, minlength=n) / length
    measures = np.stack([
        spread, distinct / np.maximum(words, 1), np.log1p(per_word) / 3,
        np.log1p(length) / 6, caps, np.log1p(words) / 5], axis=1)
    return np.concatenate([shares, measures], axis=1).astype(np.float32), counts


@dataclass
class Model:
    """Passage encoder, gated attention and logistic output, all in plain arrays."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]   # encoder, its bias, attention V, U, w, output, its bias

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representation and attention score of each passage."""
        w, b, v, u, a, _, _ = self.parts
        h = np.tanh(((x - self.mean) / self.scale) @ w + b)
        return h, (np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ a

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text from its passages, softmax weights over all."""
        h, a = self.encode(x)
        counts = np.diff(np.append(first, len(x)))
        weight = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        z = np.add.reduceat(h * weight[:, None], first, axis=0)
        z /= np.add.reduceat(weight, first)[:, None]
        return 1 / (1 + np.exp(-np.clip(z @ self.parts[5] + self.parts[6][0], -30, 30)))


def fit(bags: list[np.ndarray], labels: list[int], rounds: int = 30, seed: int = 3) -> Model:
    """Trained by Adam on whole bags; equal input gives an equal model. No bags: score 0.5."""
    random = np.random.default_rng(seed)
    parts = [random.normal(0, s, shape).astype(np.float32) for s, shape in (
        (0.1, (FEATURES, HIDDEN)), (0.0, HIDDEN), (0.2, (HIDDEN, ATTENTION)),
        (0.2, (HIDDEN, ATTENTION)), (0.2, ATTENTION), (0.2, HIDDEN), (0.0, 1))]
    if not bags:
        parts[5][:] = 0
        return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), parts)
    everything = np.concatenate(bags)
    model = Model(everything.mean(axis=0), everything.std(axis=0) + 0.02, parts)
    y = np.array(labels, dtype=np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    step = 0
    for turn in range(rounds):
        order = random.permutation(len(bags))
        for i in range(0, len(order), 64):
            pick = order[i:i + 64]
            x = (np.concatenate([bags[k] for k in pick]) - model.mean) / model.scale
            counts = np.array([len(bags[k]) for k in pick])
            first = np.cumsum(counts) - counts
            w, b, v, u, a, c, d = parts
            h = np.tanh(x @ w + b)
            left, right = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
            s = (left * right) @ a
            e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), counts))
            weight = e / np.repeat(np.add.reduceat(e, first), counts)
            z = np.add.reduceat(h * weight[:, None], first, axis=0)
            p = 1 / (1 + np.exp(-(z @ c + d)))
            g = (p - y[pick]) / len(pick)
            dz = np.repeat(g[:, None] * c, counts, axis=0)
            dweight = (dz * h).sum(axis=1)
            inner = np.repeat(np.add.reduceat(dweight * weight, first), counts)
            ds = weight * (dweight - inner)
            gate = ds[:, None] * a
            dleft, dright = gate * right * (1 - left ** 2), gate * left * right * (1 - right)
            dh = (dz * weight[:, None] + dleft @ v.T + dright @ u.T) * (1 - h ** 2)
            slopes = [x.T @ dh + 1e-4 * w, dh.sum(axis=0), h.T @ dleft, h.T @ dright,
                      (left * right).T @ ds, z.T @ g + 1e-4 * c, np.array([g.sum()])]
            step += 1
            rate = 0.01 * (1 - turn / rounds) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for q, slope, (m, r) in zip(parts, slopes, moments):
                m += 0.1 * (slope - m)
                r += 0.001 * (slope * slope - r)
                q -= (rate * m / (np.sqrt(r) + 1e-7)).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents for which `allowed` (on doc_id) holds.

    The documents are drawn by a hash of doc_id. Their passages become features on the executors;
    the driver receives at most `sample` bags of BAG passages, spread evenly over the text.
    Several labels of one document count as the largest; several documents of one doc_id as one.
    """
    small_batches(docs.sparkSession)
    chosen = (labels.filter(allowed & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(unit_hash(F.col("doc_id"), F.lit("quality")), "doc_id").limit(sample))
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            x, first = passages(batch.column("text").to_pylist())
            ends = np.append(first[1:], len(x))
            bags = []
            for start, end in zip(first, ends):
                step = -(-(end - start) // BAG)
                bags.append(x[start:end:step].tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
                "bag": pa.array(bags, pa.binary())})

    rows = own.mapInArrow(run, T.StructType([
        T.StructField("doc_id", own.schema["doc_id"].dataType),
        T.StructField("quality", own.schema["quality"].dataType),
        T.StructField("bag", T.BinaryType())]))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("bag").alias("bag"))
    found = sorted((r["doc_id"], r["quality"], bytes(r["bag"])) for r in rows.collect())
    return fit([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, _, b in found],
               [int(q) for _, q, _ in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds quality_score (0 to 1) to every row; an input column of this name is replaced.

    Every passage of the whole text is encoded; the attention weights are a softmax over all of
    them. A null or empty text is one passage without words and gets that passage's score.
    Narrow: no shuffle.
    """
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name.lower() != "quality_score"]
    schema = T.StructType(kept + [T.StructField("quality_score", T.DoubleType())])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first = passages(batch.column("text").to_pylist())
            found = model.scores(x, first).astype(np.float64)
            yield pa.RecordBatch.from_pydict({
                **{n: batch.column(n) for n in names},
                "quality_score": pa.array(np.clip(found, 0, 1), pa.float64())})

    return docs.mapInArrow(run, schema)
