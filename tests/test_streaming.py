import datetime as dt
import os

from pyspark.sql import functions as F

from lindero import schemas
from lindero.operators import calibration as C
from lindero.sources.sinks import VersionedTable, append_new, read_done
from lindero.streaming import labels as ST

T0 = dt.datetime(2024, 1, 1)
NAMES = [p.split()[0] for p in schemas.LABELS.split(", ")]


def label(rc, action, dx, minute, seq):
    return (rc, action, dx, 0, 0, 0, 0.5, None, seq, T0 + dt.timedelta(minutes=minute))


def write(spark, rows, path):
    spark.createDataFrame(rows, schemas.LABELS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(schemas.LABELS).option("maxFilesPerTrigger", 1).parquet(path)


def test_upsert_over_batches_with_delete_and_compaction(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "store")
    store = ST.LabelStore(spark, base)
    write(spark, [label("a", "skip", 1, 0, 1), label("b", "accept", 2, 1, 2)], src)
    ST.upsert_labels(stream(spark, src), store, base + "/cp").awaitTermination()
    write(spark, [label("a", "accept", 3, 5, 3)], src)
    ST.upsert_labels(stream(spark, src), store, base + "/cp").awaitTermination()
    # A late label that is older than the stored one changes nothing.
    write(spark, [label("a", "skip", 9, 2, 4)], src)
    ST.upsert_labels(stream(spark, src), store, base + "/cp").awaitTermination()
    assert {r.rc: r.dx for r in store.current().collect()} == {"a": 3, "b": 2}
    store.compact()
    gone = spark.createDataFrame([label("b", "skip", 0, 9, 5)], schemas.LABELS).withColumn(
        "deleted", F.lit(True))
    store.append(gone, 90)
    assert {r.rc: r.dx for r in store.current().collect()} == {"a": 3}
    store.append(gone, 90)
    assert store.current().count() == 1


def test_a_second_query_keeps_what_the_first_has_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "FOLD_EVERY", 2)
    store = ST.LabelStore(spark, str(tmp_path / "store"))
    counter = ST.AcceptCounter(spark, str(tmp_path / "count"), 3)
    want = {}
    for q in ("one", "two"):   # each with a checkpoint and batch numbers of its own
        src = str(tmp_path / q)
        for i in range(3):
            write(spark, [label(f"{q}{i}", "accept", i, i, i), label("both", "skip", i, 9 + i, i)], src)
            want[f"{q}{i}"] = i

        def handle(batch, batch_id):
            store.append(batch, batch_id)
            counter.add(batch, batch_id)

        ST._start(stream(spark, src), handle, str(tmp_path / f"cp{q}"), False).awaitTermination()
    got = {r.rc: r.dx for r in store.current().collect()}
    assert got == want | {"both": 2}
    assert len(store.snapshots.versions()) == 2
    rows = counter.batches().collect()
    assert len(rows) == 6 and sum(r.accepts for r in rows) == 6 and sum(r.fired for r in rows) == 2
    assert store.compact() == 3 and {r.rc: r.dx for r in store.current().collect()} == got


def test_threshold_fires_across_batches_and_replays(spark, tmp_path):
    counter = ST.AcceptCounter(spark, str(tmp_path / "count"))
    batch = spark.createDataFrame([label(f"k{i}", "accept", 0, i, i) for i in range(20)],
                                  schemas.LABELS)
    assert [counter.add(batch, 0), counter.add(batch, 1), counter.add(batch, 1),
            counter.add(batch, 2)] == [0, 1, 1, 1]
    assert {r.batch_id: r.carry for r in counter.batches().collect()} == {0: 20, 1: 10, 2: 0}


def test_recalibration_loop_publishes_and_readers_see_it(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "job")
    coords = spark.createDataFrame([(f"{i:07d}TP0000A", 270012.86, 4805037.449) for i in range(40)],
                                   "rc14 string, x double, y double")
    cal = VersionedTable(spark, base + "/cal")
    store, counter = ST.LabelStore(spark, base + "/l"), ST.AcceptCounter(spark, base + "/c")

    def run():
        ST.recalibrate_on_labels(stream(spark, src), store, counter, coords, cal,
                                 base + "/cp").awaitTermination()
    write(spark, [label(f"{i:07d}TP0000A", "accept", 3, i, i) for i in range(29)], src)
    run()
    assert cal.current() is None
    write(spark, [label("0000030TP0000A", "accept", 3, 60, 60)], src)
    run()
    got = {r.key: (r.dx, r.n) for r in cal.current().filter("level = 'quadrant'").collect()}
    assert got == {"16-K-I": (6.0, 30)}
    keys = spark.createDataFrame([("16-K", "I")], "cell string, sub string")
    row = C.attach_quality(C.attach_offsets(keys, cal.current()), cal.current()).first()
    assert (row.cal_dx, row.source, row.reliability) == (6, "quadrant", "high")


def test_versions_fall_back_to_the_last_readable(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.current() is None
    t.publish(spark.range(3))
    v = t.publish(spark.range(5))
    assert t.current().count() == 5
    for name in os.listdir(t.path(v)):
        if name.endswith(".parquet"):
            with open(f"{t.path(v)}/{name}", "wb") as f:
                f.write(b"broken")
        elif name.endswith(".crc"):
            os.truncate(f"{t.path(v)}/{name}", 0)
    assert t.current().count() == 3


def test_append_resumes(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "rc string, n int"
    append_new(spark.createDataFrame([("a", 1), ("b", 1)], schema), path, "rc", schema)
    append_new(spark.createDataFrame([("b", 2), ("c", 2)], schema), path, "rc", schema)
    with open(f"{path}/part-bad.json", "w") as f:
        f.write("{oops\n")
    rows = {r.rc: r.n for r in read_done(spark, path, schema).collect() if r.rc}
    assert rows == {"a": 1, "b": 1, "c": 2}


def test_single_label_has_zero_spread_and_merge_keeps_old(spark):
    est = spark.createDataFrame([("1-A-I", 10, 5), ("2-B-I", 1, 1), ("2-B-I", 4, 1)],
                                "key string, ex int, ey int")
    new = C.quadrant_offsets(est)
    got = {r.key: r for r in new.collect()}
    assert (got["1-A-I"].std_x, got["1-A-I"].n) == (0.0, 1)
    assert got["2-B-I"].dx == 2.5 and got["2-B-I"].std_x == 2.12
    old = spark.createDataFrame([("1-A-I", 1.0, 1.0, 4, 1.0, 1.0, 9.0), ("9-Z-I", 7.0, 7.0, 2, 1.0, 1.0, 3.0)],
                                "key string, dx double, dy double, n long, std_x double, std_y double, residual_px double")
    merged = {r.key: (r.dx, r.old_dx, r.updated) for r in C.merge_offsets(old, new).collect()}
    assert merged["1-A-I"] == (10.0, 1.0, True) and merged["9-Z-I"] == (7.0, 7.0, False)
