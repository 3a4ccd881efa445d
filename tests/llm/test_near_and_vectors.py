import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lindero.llm import forest, probminhash, subspace
from lindero.llm.graph import components

DOCS = "doc_id long, text string, key string, sig int, label string, norm string"


def shingle_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in set(a) & set(b))


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def corpus(seed=6):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdefgh", k=4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(pick.randint(1, 90))]
        texts.append(" ".join(base))
        for _ in range(pick.randint(0, 4)):
            copy = list(base)
            for _ in range(pick.randint(0, 3)):
                copy[pick.randrange(len(copy))] = word()
            copy += copy[:pick.choice([0, 0, 8])]
            texts.append(pick.choice([" ", "\n", "  "]).join(copy).replace("a", pick.choice("aA")))
    base = [word() for _ in range(120)]
    for i in range(60):   # a large group of near copies, each with an edit of its own
        copy = list(base)
        copy[2 * i] = word()
        texts.append(" ".join(copy))
    texts += [texts[0]] * 6 + ["", " \n", None, None, "one", "one", "One two", "one  two"]
    pick.shuffle(texts)
    return texts


def test_probability_jaccard_and_signatures():
    pick = random.Random(2)
    errors = []
    for _ in range(40):
        a = [pick.choice("abcdefghijklmnop") for _ in range(pick.randint(5, 60))]
        b = list(a)
        for _ in range(pick.randint(0, 6)):
            b[pick.randrange(len(b))] = pick.choice("xyz")
        a, b = " ".join(a), " ".join(b + b[:pick.randint(0, 20)])
        sets = [probminhash.shingles([t])[1:] for t in (a, b)]
        exact = probminhash.probability_jaccard(*sets)
        assert exact == pytest.approx(jaccard(shingle_counts(a), shingle_counts(b)))
        x, y = (np.frombuffer(s, "<u2") for s in probminhash.signatures([a, b]))
        errors.append((x == y).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert probminhash.signatures(["", "a", "a"])[0] is None
    assert probminhash.signatures([]) == []


@pytest.mark.parametrize("tile", [256, 7])
def test_near_duplicates_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(probminhash, "TILE", tile)
    texts = corpus()
    sets = [shingle_counts(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i)
              if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8]
    want = groups(len(texts), linked)
    docs = spark.createDataFrame(
        [(i, t, "k", 1, "l", "n") for i, t in enumerate(texts)], DOCS).repartition(5)
    found = {r["doc_id"]: r for r in probminhash.near_duplicates(docs).collect()}
    assert len(found) == len(texts)
    for i, label in enumerate(want):
        r = found[i]
        assert r["component_id"] == label and r["kept"] == (i == label)
        same = [j for j in range(len(texts)) if sets[j] == sets[i] and sets[i]]
        assert r["class_id"] == (min(same) if same else i)
    kept = probminhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in enumerate(want) if x == i]


def test_near_duplicates_ties_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "k", 1, "l", "n")] * 3 + [
        (1, "other words stand here now", "k", 1, "l", "n"), (None, "a b c d e f", "k", 1, "l", "n"),
        (None, "only null ids", "k", 1, "l", "n"), (4, None, None, None, None, None),
        (4, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert probminhash.near_duplicates(docs).count() == len(rows)
    kept = probminhash.deduplicate(docs).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, [
        (1, "a b c d e f"), (1, "other words stand here now"), (None, "only null ids"),
        (4, None), (4, None)]))
    empty = spark.createDataFrame([], DOCS)
    assert probminhash.near_duplicates(empty).count() == 0
    assert probminhash.deduplicate(empty).count() == 0


def test_long_text_gives_the_hashes_of_its_parts(monkeypatch):
    from lindero.llm import common
    data, _ = common.join_texts(["some words to hash " * 50])
    whole = common.word_hashes(data)
    monkeypatch.setattr(common, "STRETCH", 64)
    parts = common.word_hashes(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    pick = random.Random(seed)
    n = 300
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)]
    edges += [(pick.randrange(180, n), pick.randrange(180, n)) for _ in range(70)] + [(5, 5)]
    pick.shuffle(edges)
    frame = spark.createDataFrame([*edges, *edges[:9], (None, 3)], "a long, b long")
    want = groups(n, edges)
    found = {r["node"]: r["label"] for r in components(frame.filter("a is not null")).collect()}
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert found == {x: want[x] for x in touched}
    assert components(frame.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, key string, n int"


def vectors(seed=1, d=64):
    random_ = np.random.default_rng(seed)
    x = random_.standard_normal((400, d))
    close = x[0] + 0.2 * random_.standard_normal((120, d))           # a group of near copies
    chain = [x[1]]
    for _ in range(6):
        chain.append(chain[-1] + 0.28 * random_.standard_normal(d))
    x = np.concatenate([x, close, chain, np.repeat(x[2:3], 50, axis=0), 3 * x[3:6], x[7:8] * 1e30])
    return x.astype(np.float32)


def as_rows(x):
    rows = [(i, v.tolist(), 0, "k", 1) for i, v in enumerate(x)]
    n, nan = len(x), float("nan")
    odd = [None, [], [0.0] * 64, [nan] * 64, [float("inf")] + [1.0] * 63, [1.0] * 3,
           [None] + [1.0] * 63]
    return rows + [(n + i, v, 0, "k", 1) for i, v in enumerate(odd)]


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(subspace, "CELL_ROWS", 100)   # several cells and tiles at this size
    monkeypatch.setattr(subspace, "TILE", 60)
    x = vectors()
    u = x.astype(np.float64)
    u /= np.abs(u).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = groups(len(u), np.argwhere(linked).tolist())
    rows = as_rows(x)
    frame = spark.createDataFrame(rows, VECTORS).repartition(6)
    found = {r["vec_id"]: r for r in subspace.near_vectors(frame).collect()}
    assert len(found) == len(rows)
    for i in range(len(rows)):
        r = found[i]
        if i < len(x):
            assert (r["n_links"], r["component_id"]) == (linked[i].sum(), want[i])
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
        assert r["kept"] == (r["component_id"] == i)


def test_near_vectors_small_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert subspace.near_vectors(empty).count() == 0
    rows = [(1, [1.0, 0.0], 0, "k", 1), (1, [1.0, 0.0], 0, "k", 1), (None, [1.0, 0.1], 0, "k", 1),
            (9, [0.0, 1.0], 0, "k", 1), (None, None, 0, "k", 1)]
    found = subspace.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [
        (1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, True), (9, 0, 9, True), (None, 0, None, True)]))


def test_search_is_exact_when_all_leaves_are_visited(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 60)
    monkeypatch.setattr(forest, "CHUNK_ROWS", 40)
    monkeypatch.setattr(forest, "QUERIES_AT_ONCE", 3)
    x = vectors(3)
    u = x.astype(np.float64)
    u /= np.abs(u).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1)[:, None]
    frame = spark.createDataFrame(as_rows(x), VECTORS).repartition(6)
    found = {}
    for r in forest.search(frame, F.col("vec_id") % 50 == 0, visited=1.0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in range(len(x)) if i % 50 == 0}
    for q, got in found.items():
        score = u @ u[q]
        score[q] = -9
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert [g[2] for g in got] == pytest.approx(sorted(score)[-5:][::-1], abs=1e-12)
        for (_, a, s), (_, b, t) in zip(got, got[1:]):
            assert s > t or (s == t and a < b)
            assert score[a] == pytest.approx(s, abs=1e-12)
    equal = [i for i in range(len(x)) if (x[i] == x[2]).all()]
    assert len(equal) > 5


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    from lindero.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    u = np.array([r["embedding"] for r in rows], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    ids = np.array([r["vec_id"] for r in rows])
    found = QUERIES["op6_neighbours"](spark, sf).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = u @ u[q]
        score[q] = -9
        best = set(ids[np.argsort(-score)[:5]].tolist())
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == ids[q]})
        total += 5
    assert hits >= 0.9 * total


def test_search_small_tables(spark):
    assert forest.search(spark.createDataFrame([], VECTORS), F.col("vec_id") >= 0).count() == 0
    rows = [(0, [1.0, 0.0], 0, "k", 1), (2, [1.0, 0.0], 0, "k", 1), (1, [1.0, 0.0], 0, "k", 1),
            (None, [1.0, 0.0], 0, "k", 1), (4, None, 0, "k", 1)]
    found = forest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(found, key=lambda r: r["rank"])] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, None, 1.0)]


def test_search_leaves_out_its_own_row_only(spark):
    rows = [(50, [1.0, 0.0], 0, "k", 1), (50, [1.0, 0.1], 0, "k", 1), (50, [1.0, 0.1], 0, "k", 1),
            (7, [0.0, 1.0], 0, "k", 1), (50, [1.0, 2.0, 3.0], 0, "k", 1), (8, [1.0, 2.0, 3.1], 0, "k", 1)]
    found = forest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 50).collect()
    near = 1 / np.sqrt(1 + np.float64(np.float32(0.1)) ** 2)
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in found)
    assert [g[1:] for g in got if g[0] == 1 and g[1] == 50] == [(50, round(near, 6)), (50, 1.0), (50, 1.0)]
    assert [g[0] for g in got if g[1] == 8] == [1]
    # two dimensions: three queries with three candidates each; three dimensions: one with one
    assert len(found) == 3 * 3 + 1


def test_near_vectors_of_two_widths(spark):
    wide = vectors(5)[:30]
    rows = [(i, v.tolist(), 0, "k", 1) for i, v in enumerate(wide)]
    rows += [(100, [1.0, 2.0], 0, "k", 1), (101, [1.0, 2.0], 0, "k", 1), (99, [2.0, 4.1], 0, "k", 1),
             (102, [-1.0, 2.0], 0, "k", 1), (103, [0.0, 0.0], 0, "k", 1)]
    found = {r["vec_id"]: tuple(r)[1:] for r in
             subspace.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(found) == len(rows)
    assert [found[i] for i in (99, 100, 101, 102, 103)] == [
        (2, 99, True), (2, 99, False), (2, 99, False), (0, 102, True), (0, 103, True)]
    assert all(found[i][1] < 30 for i in range(30))


def test_registered_vector_queries_over_a_small_table(spark, tmp_path):
    """The registered queries, with a repeated id and two widths, against all pairs."""
    from lindero.llm.queries import QUERIES
    x = vectors(4)[380:480]
    rows = [(i, v.tolist(), 0, "k", 1) for i, v in enumerate(x)]
    rows += [(50, x[3].tolist(), 0, "k", 1), (200, [1.0, 2.0], 0, "k", 1), (201, [1.0, 2.1], 0, "k", 1),
             (202, None, 0, "k", 1)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")

    def cosine(a, b):
        a, b = np.float64(np.float32(a)), np.float64(np.float32(b))
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    good = [r for r in rows if r[1]]
    near = [[j for j, b in enumerate(good) if j != i and len(a[1]) == len(b[1])]
            for i, a in enumerate(good)]
    links = [[j for j in near[i] if cosine(good[i][1], good[j][1]) >= 0.9] for i in range(len(good))]
    found = QUERIES["op1_subspace"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in found) == sorted(
        [(good[i][0], len(links[i])) for i in range(len(good))] + [(202, 0)])
    by_query = {}
    for r in QUERIES["op6_neighbours"](spark, str(tmp_path)).collect():
        by_query.setdefault(r["query_id"], []).append(r["score"])
    for q, scores in by_query.items():
        want = [sorted((cosine(good[i][1], good[j][1]) for j in near[i]), reverse=True)[:5]
                for i in range(len(good)) if good[i][0] == q]
        assert sorted(scores) == pytest.approx(sorted(s for w in want for s in w), abs=1e-9)
    assert set(by_query) == {0, 50, 200}
