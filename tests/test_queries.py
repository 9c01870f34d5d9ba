"""Queries and the operators under them on rows that the smallest tables lack."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meshvoyage.functions import units
from meshvoyage.operators import costing, mesh, paths
from meshvoyage.plans import more_queries, queries


def test_units_round_halves_as_their_sql_does(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.createDataFrame([(1, 198500.0), (2, 65450.0), (3, 9725.0), (4, 1234.0)], "o_orderkey long, o_totalprice double")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    expected = duckdb.sql(queries.ORACLES["m37_units"]).fetchall()
    assert sorted(map(tuple, queries.m37_units(spark, str(tmp_path)).collect())) == sorted(expected)
    assert [r.sig3 for r in queries.m37_units(spark, str(tmp_path)).orderBy("o_orderkey").collect()] == [199000.0, 65500.0, 9730.0, 1230.0]
    assert rows.select(units.round_sigfig(F.lit(198500.0), 3)).first()[0] == 198000.0


def test_path_costs_need_no_hops_and_equal_those_of_paths(spark, monkeypatch):
    r = random.Random(5)
    rows = [(str(a), str(b), r.choice([0.0, 0.5, r.random()]), 0.25) for a in range(40) for b in r.sample(range(40), 3)]
    edges = spark.createDataFrame([*rows, ("x", "y", 1.0, 1.0), ("0", "z", float("inf"), 1.0)], "src string, dst string, t1 double, t2 double")
    sources = spark.createDataFrame([(s,) for s in ("0", "7", "13", "x", "nowhere")], "source string")
    targets = spark.createDataFrame([(t,) for t in ("0", "3", "29", "y", "z", "nowhere")], "target string")
    hops = paths.shortest_paths(edges, sources.crossJoin(targets)).groupBy("source", "target").agg(F.sum("cost").alias("cost"))
    expected = {(h.source, h.target): pytest.approx(h.cost, rel=1e-12) for h in hops.collect()}
    assert len(expected) > 8
    monkeypatch.setattr(paths, "shortest_paths", None)
    costs = lambda: {(c.source, c.target): c.cost for c in paths.path_costs(edges, sources, targets).collect()}
    assert costs() == expected
    monkeypatch.setattr(paths, "HELD_COSTS", 1)
    assert costs() == expected
    monkeypatch.setattr(paths, "COST_EDGES", 1)
    assert costs() == expected


def test_all_tasks_share_the_pairs_of_waypoints(spark):
    points = spark.range(40).coalesce(1).select(F.concat(F.lit("P"), "id").alias("Name"), F.col("id").cast("double").alias("Lat"), F.lit(0.0).alias("Long"), F.lit("X").alias("Source"), F.when(F.col("id") < 10, "X").alias("Destination"), F.lit("0").alias("cell"))
    pairs = paths.route_pairs(points)
    sizes = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(s["count"] for s in sizes) == 40 * 10 - 10 and len(sizes) == 4


def test_held_cells_cut_as_joins_do(spark, monkeypatch):
    # Along borders, through corners, over uneven cells, out of the mesh, and routes longer than a batch or a part.
    r = random.Random(8)
    k = F.col("id").cast("int")
    cells = mesh.quad_split(spark.range(60).select(F.col("id").cast("string").alias("id")).withColumns({"cx": k % 10 + 0.5, "cy": F.floor(k / 10) + 0.5, "dcx": F.lit(0.5), "dcy": F.lit(0.5)}), k % 4 == 1)
    k = F.floor(F.col("id").cast("double")).cast("int")
    cells = cells.withColumns({"uC": k % 3 * 0.1, "vC": k % 2 * 0.2, "inaccessible": F.when(k % 5 > 0, k % 5 == 1), "speed": F.array_repeat(F.lit(10.0), 8), "fuel": F.array_repeat(k % 7 * 1.0, 8)})
    at = lambda: r.choice([r.uniform(-1.0, 11.0), float(r.randrange(11)), r.randrange(20) / 2])
    points = spark.createDataFrame([(f"R{n}", i, at(), at() * 0.6) for n in range(12) for i in range(2 + n * 3)], "route_id string, order int, Long double, Lat double").repartition(3)
    lines, rows = costing.route_lines(points), lambda df: sorted(tuple(str(v + 0.0 if isinstance(v, float) else v) for v in x) for x in df.collect())
    monkeypatch.setattr(costing, "TILES_AT_ONCE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        held_cut, held = rows(costing.cut_at_cells(lines, cells)), costing.cost_route(points, cells)
        held_rows, held_sums = rows(held.drop("seq", "gap", "cum_distance", "cum_traveltime", "cum_fuel")), rows(costing.route_summary(held).select("route_id", "pieces", "cells_crossed"))
        gaps = held.where("gap").count()
        assert held.groupBy("route_id").agg((F.max("seq") + 1 == F.count("*")).alias("x")).where("NOT x").isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(costing, "HELD_CELLS", -1)
    joined = costing.cost_route(points, cells)
    assert rows(costing.cut_at_cells(lines, cells)) == held_cut and len(held_cut) > 500
    assert rows(joined.drop("seq", "gap", "cum_distance", "cum_traveltime", "cum_fuel")) == held_rows and joined.where("gap").count() == gaps
    assert rows(costing.route_summary(joined.drop("first_visit")).select("route_id", "pieces", "cells_crossed")) == held_sums


def test_pieces_of_drawn_routes_are_not_moved(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("p_partkey"), F.lit(10).alias("p_size"), F.lit(900.0).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(90).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit("2024-01-01").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    for query in (queries.r12_costed_routes, more_queries.j16_borrowed_costs):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and not {"Join", "Expand"} & set(plan.replace("'", " ").split())
        assert "Window" not in plan[: plan.index("MapInArrow")]


def test_points_meet_only_cells_near_them(spark):
    # Rows of cells with closed ones between; every point against every open cell, by hand.
    k = F.col("id").cast("int")
    cells = spark.range(200).select(F.col("id").cast("string").alias("id")).withColumns({"cx": k % 20 * 0.5, "cy": F.floor(k / 20) * 0.5, "dcx": F.lit(0.25), "dcy": F.lit(0.25), "inaccessible": (k % 7 != 1) | (k > 120)})
    r = random.Random(4)
    points = [(f"P{i}", r.choice([r.uniform(-7.0, 12.0), r.randrange(20) / 4]), r.choice([r.uniform(-7.0, 17.0), r.randrange(40) / 4])) for i in range(300)]
    open_ = [c for c in cells.collect() if not c.inaccessible]
    nearest = lambda y, x: min(open_, key=lambda c: (math.hypot(max(abs(x - c.cx) - c.dcx, 0.0), max(abs(y - c.cy) - c.dcy, 0.0)), c.id))
    moved = {p.Name: p for p in mesh.adjust(spark.createDataFrame(points, "Name string, Lat double, Long double"), cells).collect()}
    stayed = 0
    for name, lat, lon in points:
        c, to = nearest(lat, lon), moved[name]
        if (to.Lat, to.Long) == (lat, lon):
            share = max([0.0, *(1 - c.dcx / abs(d) for d in (c.cx - lon, c.cy - lat) if abs(d) > c.dcx)])
            assert max(abs(lon - c.cx), abs(lat - c.cy)) < 0.25 or share * math.hypot(c.cx - lon, c.cy - lat) > 5
            stayed += 1
        else:
            assert abs(to.Long - c.cx) < c.dcx and abs(to.Lat - c.cy) < c.dcy
    assert len(moved) == 300 and 20 < stayed < 280


def test_adjusting_meets_few_cells_a_point(spark, monkeypatch):
    kept, tables = [], mesh.written
    monkeypatch.setattr(mesh, "written", lambda df, name: kept.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or tables(df, name))
    cells = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10 * 0.1).alias("cx"), (F.floor(F.col("id") / 10) * 0.1).alias("cy"), F.lit(0.05).alias("dcx"), F.lit(0.05).alias("dcy"), F.lit(False).alias("inaccessible"))
    mesh.adjust(spark.createDataFrame([("A", 0.42, 0.42)], "Name string, Lat double, Long double"), cells)
    assert [n for n, _ in kept] == ["boxes", "nearest", "afar"]  # one round, by tiles as large as a cell


def test_larger_tables_make_more_tasks_not_larger_ones(spark, monkeypatch, tmp_path):
    spark.range(1200).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(300).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    made = (queries.j01_locate, more_queries.j02_border_points, more_queries.u06_split_around_points, more_queries.j03_adjust)
    rows = lambda q: sorted(map(tuple, q(spark, str(tmp_path)).collect()))
    expected = [rows(q) for q in made]
    monkeypatch.setattr(mesh, "ROWS_PER_TASK", 100)
    assert [rows(q) for q in made] == expected and all(expected)
    plans = [q(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString() for q in made[:2]]
    assert all(p.count("RepartitionByExpression [_tx") == 2 and p.count("RepartitionByExpression [Name") == 1 for p in plans)
