import random
import zlib

import pytest
from pyspark.sql import functions as F

from lindero.llm import chat, mixing, sharding
from lindero.session import settle

PARTS = "conv_id long, turn int, role string, parts " + chat.PARTS


def test_chat_parts_and_escapes(spark):
    rows = [
        (1, 0, "user", [("text", "see <b> \\ <turn x>", None, None),
                        ("image", None, "s3://a", 2.2), (None, "after", None, None)]),
        (1, 1, "assistant", [("text", "\\### Assistant: </turn> ok", None, None)]),
        (1, 2, "assistant", [("audio", None, "b", 3.0), ("Document", None, "c", None),
                             ("text", "é🙂", None, None)]),
        (2, None, None, None), (2, None, None, None), (2, 5, "a>b<c\\", []),
        (None, 0, "assistant", [("text", "", None, None)]),
    ]
    done = chat.format_chats(spark.createDataFrame(rows, PARTS))
    read = done.select("*", chat.read_turns(F.col("formatted")).alias("t"),
                       chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"))
    found = {r["conv_id"]: r for r in read.collect()}
    one = found[1]
    assert [tuple(t) for t in one["t"]] == [
        ("user", "see <b> \\ <turn x>after"), ("assistant", "\\### Assistant: </turn> ok"),
        ("assistant", "é🙂")]
    assert one["l"] == "\\### Assistant: </turn> oké🙂"
    assert [tuple(a) for a in one["attachments"]] == [
        (0, 1, "image", "s3://a", 564), (2, 0, "audio", "b", 75), (2, 1, "document", "c", 0)]
    assert one["attachment_tokens"] == 639
    assert "<image 0.1>after</turn>\n" in one["formatted"]
    spans = [one["formatted"][s["start"]:s["start"] + s["length"]] for s in one["loss"]]
    assert spans[1] == "<audio 2.0><document 2.1>é🙂"
    assert [tuple(t) for t in found[2]["t"]] == [("", ""), ("", ""), ("a>b<c\\", "")]
    assert found[2]["l"] == "" and found[2]["loss"] == []
    assert found[None]["l"] == "" and len(found[None]["t"]) == 1


def test_chat_random_texts_come_back(spark):
    pick = random.Random(4)
    rows = [(c, t, pick.choice(["user", "assistant", "system", "\\g<"]),
             [("text", "".join(pick.choices("\\<>blg/turn é\n", k=pick.randint(0, 30))), None, None)])
            for c in range(60) for t in range(pick.randint(1, 5))]
    done = chat.format_chats(spark.createDataFrame(rows, PARTS))
    read = {r[0]: (r[1], r[2]) for r in done.select(
        "conv_id", chat.read_turns(F.col("formatted")),
        chat.read_loss(F.col("formatted"), F.col("loss"))).collect()}
    for c in range(60):
        own = [(r[2], r[3][0][1]) for r in rows if r[0] == c]
        assert [tuple(t) for t in read[c][0]] == own
        assert read[c][1] == "".join(t for role, t in own if role == "assistant")


def test_chat_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], PARTS + ", at int, formatted string")
    assert chat.format_chats(empty).count() == 0


DOCS = "doc_id long, text string, lang string, source string, size int, shard string"


def targets_by_hand(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        if not open_weight:
            return {s: float(cap * sizes[s]) for s in order}
        more = {s for s in order if s not in full
                and cap * sizes[s] <= weight[s] * rest / open_weight}
        if not more:
            return {s: float(cap * sizes[s]) if s in full else weight[s] * rest / open_weight
                    for s in order}
        full |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_against_hand(spark, seed):
    pick = random.Random(seed)
    rows = []
    for i in range(400):
        source = pick.choice(["a", "b", "é", "ü", None, "empty", "big", "big", "big"])
        words = 0 if source == "empty" else pick.choice([0, 1, 5, 300 if source == "big" else 9])
        rows.append((i, None if words == 0 and i % 2 else " w\t" * words, "en", source, 7, "x"))
    docs = spark.createDataFrame(rows + rows[:3], DOCS)
    planned = mixing.plan_copies(docs).collect()
    sizes = {}
    for r in rows + rows[:3]:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = targets_by_hand(sizes)
    assert len(planned) == len(rows) + 3
    taken = {}
    for r in planned:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= min(3, int(rate) + 1)
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert abs(taken["big"] - want["big"]) < 0.2 * want["big"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in planned)
    again = sorted(map(repr, mixing.plan_copies(docs).collect()))
    assert again == sorted(map(repr, planned))


def test_mixing_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.plan_copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_sharding_law(spark):
    pick = random.Random(3)
    rows = [(i, "x" * pick.choice([0, 3, 200, 4000]), "en", "s", 1, "old") for i in range(3000)]
    rows += [(10_000 + i, "copy", "en", "s", 1, "old") for i in range(1500)]   # a hot text
    rows += [(20_000 + i, f"pair {i // 3}", "en", "s", 1, "old") for i in range(300)]
    rows += [(None, None, None, None, None, None)] * 5 + rows[:4]
    docs = spark.createDataFrame(rows, DOCS)
    placed = sharding.shard(docs)
    assert set(placed.columns) == set(docs.columns) | {"slot"}
    found = placed.select("doc_id", "text", "shard", "slot").collect()
    assert sorted(map(repr, ((r[0], r[1]) for r in found))) == sorted(
        map(repr, ((r[0], r[1]) for r in rows)))
    slots, sizes, where = {}, {}, {}
    for _, text, shard, slot in found:
        slots.setdefault(shard, []).append(slot)
        sizes[shard] = sizes.get(shard, 0) + len(text or "") + 1
        where.setdefault(text or "", set()).add(shard)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    assert all(abs(s - mean) <= 4100 for s in sizes.values())
    assert all(len(where[f"pair {i}"]) == 1 for i in range(100))
    again = sharding.shard(docs).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_sharding_small_tables(spark, tmp_path):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    one = sharding.shard(spark.createDataFrame([(1, "a b", "en", "s", 1, "x")], DOCS))
    assert [(r["shard"], r["slot"]) for r in one.collect()] == [(8, 0)]
    sharding.write_shards(one, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_size_of_word_pattern(spark):
    row = spark.createDataFrame([("a\u00a0b \x0bc\td\n",)], "t string").select(
        F.regexp_count("t", F.lit(mixing.WORD))).first()
    assert row[0] == 3 and zlib.crc32(b"") == 0


def test_loss_is_read_in_time_linear_in_the_text(spark):
    """A conversation of many turns, and spans that are no whole bodies."""
    import time
    turns = spark.range(8000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("a < b \\ "), F.repeat(F.lit("é"), 300), F.col("id").cast("string")).alias("text"))
    done = chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    done = settle(done.select("formatted", "loss"), "chats")
    began = time.time()
    got = done.select(chat.read_loss(F.col("formatted"), F.col("loss")).alias("x")).first()["x"]
    assert time.time() - began < 20
    assert got == "".join(f"a < b \\ {'é' * 300}{i}" for i in range(1, 8000, 2))
    odd = spark.createDataFrame([("<turn user>abc</turn>\n<turn assistant>defg</turn>\n",)], "f string")
    spans = F.array(F.struct(F.lit(12).cast("bigint").alias("start"), F.lit(2).cast("bigint").alias("length")),
                    F.struct(F.lit(38).cast("bigint").alias("start"), F.lit(4).cast("bigint").alias("length")))
    assert odd.select(chat.read_loss(F.col("f"), spans).alias("x")).first()["x"] == "bcdefg"
    none = spark.createDataFrame([("", )], "f string")
    assert none.select(chat.read_loss(F.col("f"), F.array().cast(
        "array<struct<start:bigint,length:bigint>>")).alias("x")).first()["x"] == ""
