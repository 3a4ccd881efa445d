import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lindero.llm import collocations, queries


def brute(docs, frequent, top):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(small)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, own in f.items():
        many = {p: a for p, a in own.items() if a >= frequent}
        rows = []
        for p, a in many.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in many.items()):
                continue
            best = min((1000 * a * n[lang] // (own[p[:c]] * own[p[c:]]), c) for c in range(1, len(p)))
            rows.append((-best[0], -a, " ".join(p).encode(), own[p[:best[1]]], own[p[best[1]:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made_up(seed, n_docs):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "new york", "Zürich", "naïve", "x y", "o'neil", "to be or not to be",
             "a a", "la la la"] + [f"w{i}" for i in range(40)]
    gaps = [" "] * 14 + ["  ", "\t", ", ", ". ", "\n", " ! ", "\x0b", ";"]
    docs = []
    for _ in range(n_docs):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 80)))
        docs.append((rng.choice(["en", "en", "de", None]), text))
    return docs + [("en", None), ("en", ""), (None, " \t\n"), ("fr", "à côté")] + docs[:5]


def result(found):
    return sorted(tuple(r) for r in found.select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shards,top,part", [(3, 2000, 1 << 20), (1, 7, 60)])
def test_collocations_equal_brute_force(spark, monkeypatch, shards, top, part):
    monkeypatch.setattr(collocations, "PART", part)
    docs = made_up(4, 160)
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs],
                                  "lang string, text string, phrase string, n int")
    found = collocations.collocations(frame, frequent=12, top=top, shards=shards)
    want = brute(docs, 12, top)
    assert len(want) > 20
    assert result(found) == want


def test_places_that_collide_change_nothing(monkeypatch):
    monkeypatch.setattr(collocations, "places_of",
                        lambda h: (collocations.mix64(h) >> np.uint64(62)).astype(np.int32))
    data = np.frombuffer(b"a b a b\na b c\n", np.uint8)
    reached = np.zeros((4, 4), dtype=np.uint8)
    found = {(k, p): n for k, _, phrases, _, counts in collocations.scan(data, 1, reached, 1, 3)
             for p, n in zip(phrases.to_pylist(), counts.tolist())}
    assert found == {(1, "a"): 3, (1, "b"): 3, (1, "c"): 1, (2, "a b"): 3, (2, "b a"): 1,
                     (2, "b c"): 1, (3, "a b a"): 1, (3, "b a b"): 1, (3, "a b c"): 1,
                     (4, "a b a b"): 1}


def test_a_place_reached_before_its_phrase_is_counted(spark):
    rare, other = "a3911", "x2102"  # "a3911 b" has the place of "x2102 y"
    seed = collocations.mix64(np.array([zlib.crc32(b"en")], dtype=np.uint64))[0]
    data = np.frombuffer(f"{rare} b {other} y ".encode(), np.uint8)
    h = collocations.word_hashes(data)[1] ^ seed
    pairs = collocations.places_of(h[::2] * np.uint64(collocations.FACTOR) + h[1::2])
    assert pairs[0] == pairs[1]
    docs = [("en", f"{other} y. b c" + (f". {rare} b c" if i < 120 else "")) for i in range(300)]
    frame = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    assert result(collocations.collocations(frame)) == brute(docs, 100, 2000)


def test_stretches_are_counted_exactly_in_small_gatherings(monkeypatch):
    monkeypatch.setattr(collocations, "GATHERED", 5)
    data = np.frombuffer("ab cd ab éé ab".encode(), np.uint8)
    low, high = np.array([0, 3, 6, 9, 14]), np.array([2, 5, 8, 13, 16])
    total = Counter()
    for phrases, places, n in collocations.tally(data, low, high, np.array([4, 5, 4, 6, 4])):
        total.update(dict(zip(zip(phrases.to_pylist(), places.tolist()), n.tolist())))
    assert total == {("ab", 4): 3, ("cd", 5): 1, ("éé", 6): 1}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(empty).collect() == []


def test_registered_query(spark, tmp_path):
    docs = made_up(6, 900)
    spark.createDataFrame(docs, "lang string, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert result(queries.QUERIES["op12_collocations"](spark, str(tmp_path))) == brute(docs, 100, 2000)
