import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lindero.llm import queries, spelling


def edit_distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(docs):
    """The contract, word by word and pair by pair."""
    n = Counter()
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in words if edit_distance_is_one(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def made_up(seed, n_docs, letters="abcß"):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(90)]
    vocabulary += [w[:2] + rng.choice(letters) + w[2:] for w in vocabulary]
    vocabulary += [w.upper().replace("SS", "ß") for w in vocabulary[:20]] + ["é" * 5, "é" * 6, "x" * 300,
                                                                             "x" * 301]
    weights = [1 / (1 + i % 60) for i in range(len(vocabulary))]
    return [(i, rng.choice([" ", ", ", "7", "-"]).join(rng.choices(vocabulary, weights, k=60)))
            for i in range(n_docs)]


def result(found):
    return sorted(tuple(r) for r in found.select(
        "word", "form", "root", "n", "n_near", "form_n").collect())


def test_near_sets_equal_pairwise_comparison():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(400)})
    counts = np.arange(1, len(words) + 1)
    every = np.ones(len(words), dtype=bool)
    got = spelling.neighbours(words, counts, every, every, at_end=False)
    want = {w: [x for x in words if edit_distance_is_one(w, x)] for w in words}
    assert dict(zip(got["word"], got["near"])) == {w: len(x) for w, x in want.items() if x}
    n = dict(zip(words, counts))
    assert dict(zip(got["word"], got["best"])) == {
        w: min(x, key=lambda y: (-n[y], y)) for w, x in want.items() if x}


@pytest.mark.parametrize("tile", [spelling.TILE, 7])
def test_variants_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    docs = made_up(1, 120) + [(None, "Lettre lettre lettres lettres lettres lettres"), (500, None),
                              (501, ""), (502, "12 !"), (503, "lettre lettre " * 400)]
    docs += docs[:3]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string")
    assert result(spelling.variants(frame)) == brute(docs)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registered_query(spark, tmp_path):
    docs = made_up(2, 150, "abcd")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op13_spelling"](spark, str(tmp_path))
    assert result(found) == brute(docs)
