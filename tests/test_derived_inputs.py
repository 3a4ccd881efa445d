import re

from parity import derived as D
from parity import sources
from parity.base import QUERIES


def tables(spark, path):
    spark.range(1, 41).selectExpr(
        "id AS l_orderkey", "id * 3 AS l_partkey", "id * 5 AS l_suppkey", "1 AS l_linenumber",
        "7D AS l_quantity", "DATE'1995-02-03' AS l_shipdate").repartition(3).write.parquet(
        f"{path}/lineitem.parquet")
    spark.range(1, 41).selectExpr(
        "id AS o_orderkey", "id % 9 AS o_custkey", "1D AS o_totalprice").write.parquet(
        f"{path}/orders.parquet")
    for name, key in (("customer", "c"), ("supplier", "s")):
        spark.range(1, 41).selectExpr(
            f"id AS {key}_{name[:4]}key", f"id % 25 AS {key}_nationkey").coalesce(1).write.parquet(
            f"{path}/{name}.parquet")
    return str(path)


def test_parcels_of_one_small_file_are_dealt_to_all_cores(spark, tmp_path):
    parcels = D.parcels(spark, tables(spark, tmp_path))
    assert parcels.rdd.getNumPartitions() > 2
    assert parcels.count() == 40


def test_unit_responses_gather_figures_only(spark, tmp_path):
    bodies = sources.unit_bodies(spark, tables(spark, tmp_path))
    plan = bodies._jdf.queryExecution().optimizedPlan().toString()
    gathered = re.search(r"collect_list\((.*)", plan).group(1)
    assert "CALLE" not in plan[plan.index("Aggregate"):] and "_plain" not in gathered
    assert bodies.count() == 40


def test_rates_land_in_as_many_files_as_tasks_wrote(spark, tmp_path, monkeypatch):
    made = []
    fresh = sources.fresh_path
    monkeypatch.setattr(sources, "fresh_path", lambda *a: made.append(fresh(*a)) or made[-1])
    found = QUERIES["st5_rates"](spark, tables(spark, tmp_path))
    rows = found.collect()
    assert {(r["batches"], r["timed"]) for r in rows} == {(4, True)}
    assert sum(r["n"] for r in rows) == 40
    files = spark.read.parquet(f"{made[0]}/lines").inputFiles()
    assert len(files) > 4
