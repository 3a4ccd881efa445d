import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lindero.llm import langid, quality
from lindero.llm.queries import ORACLE, QUERIES
from lindero.session import settle

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, quality_score int"


def test_held_out_language_accuracy(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    right = sum(truth[r["doc_id"]]["lang"] == r["lang_pred"] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op10_quality"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in found
            if r["held_out"] and r["doc_id"] in labels]
    good = [p for y, p in held if y == 1]
    bad = [p for y, p in held if y == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_language_of_odd_texts(spark):
    pick = random.Random(1)
    word = lambda a: "".join(pick.choices(a, k=5))
    train = [(k, " ".join(word(a) for _ in range(40))) for a, k in
             (("abcdef", "xx"), ("éèuvwx", "yy")) for _ in range(60)]
    net = langid.fit([t for _, t in train], [k for k, _ in train])
    texts = [None, "", " 12 ##", "abc fed", "éèéè wxv" * 4000, "日本語"]
    found = net.classify(texts)
    assert [f[0] for f in found[:5]] == ["und", "und", "und", "xx", "yy"]
    assert all(0 <= f[1] <= 1 for f in found) and found[5][0] in ("xx", "yy")
    assert [net.classify([t])[0][0] for t in texts] == [f[0] for f in found]
    rows = [(i, t, "xx", "s", 1, 5, 6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    done = langid.identify(docs, net)
    assert set(done.columns) == {*docs.columns, "lang_score"} and done.count() == len(rows)
    assert langid.identify(docs.limit(0), net).count() == 0
    none = langid.learn(docs.filter("lang = 'none'"), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_windows_cover_the_whole_text():
    texts = ["a" * n for n in (1, 127, 128, 129, 1000)]
    windows, first, filled = langid.cut(texts)
    assert filled.tolist() == [1, 127, 128, 128, 1] + [128] * 7 + [104]
    assert first.tolist() == [0, 1, 2, 3, 5] and (windows == 97).sum() == sum(map(len, texts))


def test_passages_of_odd_texts(spark, monkeypatch):
    texts = [None, "", "x", "word " * 3000, "é" * 256, "\n"]
    x, first = quality.passages(texts)
    assert np.isfinite(x).all()
    assert np.diff(np.append(first, len(x))).tolist() == [1, 1, 1, 30, 1, 1]
    monkeypatch.setattr(quality, "PASSAGES_AT_ONCE", 4)
    y, second = quality.passages(texts)
    assert (first == second).all() and np.abs(x - y).max() < 0.02
    model = quality.fit([], [])
    assert model.scores(x, first).tolist() == pytest.approx([0.5] * 6)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2) for i, t in enumerate(texts)], DOCS)
    done = quality.score(docs, model)
    assert set(done.columns) == set(docs.columns) and done.count() == 6
    assert quality.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (2, None, 0), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    fitted = quality.learn(docs.union(docs), labels, F.lit(True))
    assert fitted.scores(x, first).min() >= 0


def test_attention_finds_the_bad_passage():
    pick = random.Random(2)
    good = lambda n: " ".join("".join(pick.choices("etaoin", k=5)) for _ in range(n))
    bad = lambda n: " ".join("".join(pick.choices("etaoin", k=5)) + "###" for _ in range(n))
    texts, y = [], []
    for i in range(300):
        parts = [good(90) for _ in range(4)]
        if i % 3 == 0:
            parts[pick.randrange(4)] = bad(90)
        texts.append("\n".join(parts))
        y.append(int(i % 3 != 0))
    x, first = quality.passages(texts)
    ends = np.append(first[1:], len(x))
    model = quality.fit([x[a:b] for a, b in zip(first[:200], ends[:200])], y[:200])
    p = model.scores(x, first)[200:] >= 0.5
    assert (p == np.array(y[200:])).mean() > 0.95


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb
    base = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        base.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = base.sql(ORACLE[name])
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(want.columns) == sorted(found.columns)
    order = ", ".join(sorted(want.columns))
    mine = sorted(map(repr, (tuple(r) for r in found.select(*sorted(found.columns)).collect())))
    assert mine == sorted(map(repr, base.sql(f"select {order} from want").fetchall()))


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        done = settle(stage(spark, docs, sf), name)
        if name != "tokens":
            assert done.columns == columns
        seen[name] = done.select("doc_id").collect()
        docs = done
    n = {k: len(v) for k, v in seen.items()}
    assert 0 < n["language"] <= n["quality"] < 1000 and n["near_duplicates"] < n["language"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"]}
    assert all(i in kept for i, q in labels.items() if q == 1)
    passed = {r["doc_id"] for r in seen["language"]}
    assert passed <= kept and len(kept - passed) <= 0.01 * len(kept)
    assert len({r["doc_id"] for r in seen["near_duplicates"]}) == n["near_duplicates"]
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["near_duplicates"]}
    assert sorted(r["doc_id"] for r in seen["tokens"]) == sorted(r["doc_id"] for r in seen["mixing"])


def test_pipeline_of_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", None, 0), (2, "12 34", "en", "a", 5),
            (3, "plain words here", "en", "a", 16), (3, "plain words here", "en", "a", 16)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # One of the two copies is left, and its source, the only one, makes up the whole mix.
    assert [r["doc_id"] for r in found] == [3]


def test_pipeline_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_language_stage_rejects_letters_without_a_language(spark):
    pick = random.Random(3)
    given = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    some = {r["lang"]: r["text"] for r in given.filter("length(text) > 2000").collect()}
    texts = ["".join(pick.choices("0123456789abcdef", k=1500)) for _ in range(20)]
    texts += ["".join(t[:700] for t in some.values()), some["en"][:900] + some["de"][:900], "Re.",
              "Total 12 34 " + "5 6 7 8 " * 100, "12 34", None]
    rows = [(-1 - i, t, None, "s", 1) for i, t in enumerate(texts)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = given.select(*odd.columns).union(odd)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, both, SF)
            .filter("doc_id < 0").collect()}
    assert kept == {-21, -22, -23, -24}
    # Nothing to learn from: texts with a letter stay.
    alone = corpus_pipeline.keep_known_language(spark, odd, SF).collect()
    assert {r["doc_id"] for r in alone} == set(range(-24, 0))


def plain_probabilities(net, text):
    """Convolution, pooling and softmax of one window, number by number."""
    data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    data = (data + [32] * langid.LENGTH)[:langid.LENGTH]
    widest, pooled = max(langid.WIDTHS), []
    for f in range(net.filters.shape[1]):
        best = -1e30
        for at in range(langid.LENGTH - widest + 1):
            best = max(best, sum(float(net.vectors[data[at + w], s]) * float(
                net.filters[w * langid.SIZE + s, f]) for w in range(widest) for s in range(langid.SIZE)))
        pooled.append(max(0.0, best + float(net.bias[f])))
    out = [sum(p * float(net.dense[f, c]) for f, p in enumerate(pooled)) + float(net.offset[c])
           for c in range(len(net.names))]
    out = [np.exp(o - max(out)) for o in out]
    return [o / sum(out) for o in out]


def test_network_against_plain_loops():
    net = langid.fit(["the cat and the dog", "der Hund und die Katze"] * 20, ["en", "de"] * 20, rounds=2)
    for text in ("the HOUSE", "die Straße ist lang", "x"):
        windows, _, _ = langid.cut([text])
        assert net.probabilities(windows)[0].tolist() == pytest.approx(
            plain_probabilities(net, text), abs=1e-4)


def test_surplus_is_cut_from_all_languages_alike(spark):
    rows = [(i, f"word {i} " * 3, f"l{i % 119}") for i in range(11900)]
    rows += [(20000 + i, f"rare {i} " * 3, "rare") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.draw(docs, F.lit(True), sample=6000)
    n = [sum(1 for r in drawn if r[0] == x) for x in {r[0] for r in drawn}]
    rare = sum(1 for r in drawn if r[0] == "rare")
    assert len(n) == 120 and len(drawn) <= 6000 * langid.CROPS
    assert rare > 0.8 * np.mean(n)


def test_short_texts_are_judged_by_the_network(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    net = langid.learn(given, F.lit(True), sample=1200)
    pick = random.Random(4)
    real = [r["text"][:n] for r in given.filter("length(text) > 400").limit(60).collect()
            for n in (40, 120, 250)]
    noise = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=250)) for _ in range(100)]
    assert sum(net.recognised(real)) >= 0.97 * len(real)
    assert sum(net.recognised(noise)) <= 50
    assert net.recognised(["Re.", "12", "", None]) == [True, False, False, False]
