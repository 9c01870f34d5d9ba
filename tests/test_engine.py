"""The mesh engine against fixed numbers, brute force and closed forms."""

import heapq
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from meshvoyage.functions import geodesy, travel, units
from meshvoyage.functions import vessel as physics
from meshvoyage.operators import costing, mesh, paths, smoothing, vessel
from meshvoyage.plans.config import RouteConfig, VesselConfig
from meshvoyage.plans.planner import calculate_route, plan_routes
from meshvoyage.sources import readers, synthetic, writers
from meshvoyage.tables import written

SHIP = VesselConfig("SDA", 26.5, "km/hr", 80.0, 10.0, beam=24.0, hull_type="slender", force_limit=96634.5)
ROUTE = RouteConfig("traveltime", ("fuel", "traveltime"), ("uC", "vC"))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("args, expected", [((30, 15, 2, -4, math.sqrt(65)), 5.0), ((30, 15, -2, -4, math.sqrt(65)), 8.33333), ((30, 15, 2, -4, 5), 15.0), ((0, 1, 0, -2, 1), math.inf)])
def test_travel_time(spark, args, expected):
    assert value(spark, travel.travel_time(*[F.lit(float(a)) for a in args])) == pytest.approx(expected, abs=1e-5)


def test_ship_physics(spark):
    lit = F.lit
    rows = [
        (physics.ice_resistance(lit(5.56), lit(60.0), lit(1.0), lit(980.0), 24.0, "slender"), 64543.75549708632),
        (physics.inverted_resistance(96634.5, lit(60.0), lit(1.0), lit(980.0), 24.0, "slender"), 7.842665122593933),
        (physics.fuel_rate(lit(0.0), lit(0.0)), 6.06970392),
        (physics.fuel_rate(lit(26.5), lit(0.0)), 27.3186897),
        (physics.fuel_rate(lit(5.56), lit(64543.76)), 24.48333122),
        (physics.wind_coefficient(lit(0.0)), 0.94),
        (physics.wind_coefficient(lit(math.pi / 4)), 0.595),
        (physics.wind_resistance(lit(10.0), lit(20.0), lit(0.0)), 129543.75),
        (physics.wind_resistance(lit(10.0), lit(20.0), lit(math.pi)), -105656.25),
        (physics.apparent_wind(lit(0.0), lit(10.0), lit(10.0), 0.0)["speed"], 7.22222),
        (physics.apparent_wind(lit(10.0), lit(0.0), lit(10.0), 0.0)["angle"], 1.299849),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(rows)]).first()
    assert list(got) == pytest.approx([e for _, e in rows], rel=1e-6)


def test_units_and_texts(spark):
    got = spark.range(1).select(
        units.decimal_days_text(F.lit(1.5)), units.decimal_days_text(F.lit(0.25)), units.decimal_days_text(F.lit(2.51), True), units.round_sigfig(F.lit(123456.0), 3), units.round_sigfig(F.lit(0.0012345), 2),
        units.degrees_minutes(F.lit(-70.5), "lat"), geodesy.lon_difference(F.lit(179.0), F.lit(-179.0)), geodesy.case_from_angle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), units.month_fraction(F.lit(2024), F.lit(2), F.to_date(F.lit("2024-02-15")), F.to_date(F.lit("2024-03-10"))),
    ).first()
    assert list(got)[:3] == ["1 day 12.0 hours", "6.0 hours", "2 days 12 hours 14 minutes"]
    assert list(got)[3:5] == pytest.approx([123000.0, 0.0012])
    assert list(got)[5:8] == ["70-30.000'S", -2.0, 1]
    assert got[8] == pytest.approx(15 / 29)


def even(cells, speed=10.0):
    return cells.withColumns({"inaccessible": F.lit(False), "speed": F.array_repeat(F.lit(speed), 8), "fuel": F.array_repeat(F.lit(8.65), 8), "uC": F.lit(0.0), "vC": F.lit(0.0)})


def test_adjacency_split_and_prune(spark):
    cells = synthetic.regular_cells(spark, 3, 2, 0.0, 0.0, 2.0, 1.0)
    edges = mesh.adjacency(cells)
    assert {(r.src, r.case, r.dst) for r in edges.where("src = '0'").collect()} == {("0", 2, "1"), ("0", -4, "3"), ("0", 1, "4")}
    parts = mesh.quad_split(cells, F.col("id") == "1")
    assert parts.count() == 9
    around = {(r.src, r.case, r.dst) for r in mesh.adjacency(parts).where("src = '0'").collect()}
    assert {("0", 2, "1.0"), ("0", 2, "1.2")} <= around
    total = parts.agg(F.sum(F.col("dcx") * F.col("dcy") * 4)).first()[0]
    assert total == pytest.approx(12.0)
    closed = even(cells).withColumn("inaccessible", F.col("id") == "1")
    assert not {r.src for r in mesh.prune(edges, closed).collect()} & {"1"}


def test_adjacency_crosses_the_antimeridian(spark):
    cells = spark.createDataFrame([("0", 177.5, 0.0, 2.5, 1.25), ("1", -177.5, 0.0, 2.5, 1.25)], "id string, cx double, cy double, dcx double, dcy double")
    assert {tuple(r) for r in mesh.adjacency(cells).collect()} == {("0", 2, "1"), ("1", -2, "0")}


def test_split_around_closed_cells(spark):
    cells = even(synthetic.regular_cells(spark, 3, 1, 0.0, 0.0, 1.0, 1.0))
    mixed = mesh.quad_split(cells, F.col("id") == "1").withColumn("inaccessible", F.col("id") == "1.0")
    done = mesh.split_around_inaccessible(mixed)
    assert done.where("id LIKE '0%'").count() == 4 and done.where("id = '2'").count() == 1


def test_locate_and_adjust(spark):
    cells = even(synthetic.regular_cells(spark, 2, 1, 0.0, 0.0, 2.0, 2.0)).withColumn("inaccessible", F.col("id") == "1")
    points = spark.createDataFrame([("in", 1.0, 0.5), ("border", 1.0, 2.0), ("out", 1.0, 3.0), ("far", 1.0, 30.0)], "Name string, Lat double, Long double")
    moved = {r.Name: r.Long for r in mesh.adjust(points, cells).collect()}
    assert moved["in"] == 0.5 and moved["far"] == 30.0 and 1.99 < moved["out"] < 2.0 and 1.99 < moved["border"] < 2.0
    open_ = cells.withColumn("inaccessible", F.lit(False))
    assert {r.Name: r.cell for r in mesh.locate(points, open_).collect()} == {"in": "0", "border": "1", "out": "1"}


def test_ship_accessibility_and_performance(spark):
    rows = [("open", -100.0, 0.0, 0.5, 900.0), ("land", 5.0, 0.0, 0.5, 900.0), ("ice", -100.0, 95.0, 1.0, 900.0), ("slow", -100.0, 77.5, 0.775, 775.0), ("blank", None, None, None, None)]
    cells = spark.createDataFrame(rows, "id string, elevation double, SIC double, thickness double, density double")
    model = vessel.Ship(SHIP)
    done = {r.id: r for r in vessel.with_performance(vessel.with_accessibility(cells, model), model).collect()}
    assert [done[k].inaccessible for k in ("open", "land", "ice", "slow", "blank")] == [False, True, True, False, False]
    assert done["open"].speed == [26.5] * 8 and done["open"].ice_resistance == 0.0 and done["land"].speed is None
    assert done["slow"].speed[0] == pytest.approx(7.69229, rel=1e-5) and done["slow"].ice_resistance == pytest.approx(96634.5)
    assert done["blank"].speed == [26.5] * 8 and done["blank"].ice_resistance is None


def two_cells(spark):
    return even(spark.createDataFrame([("0", 2.5, 0.0, 2.5, 1.25), ("1", 7.5, 0.0, 2.5, 1.25)], "id string, cx double, cy double, dcx double, dcy double"))


def test_one_hop_route_and_its_outputs(spark, tmp_path):
    bundle = readers.MeshBundle(two_cells(spark), mesh.ordered(mesh.adjacency(two_cells(spark))), {"mesh_info": {"region": {"lat_min": -1.25, "lat_max": 1.25, "long_min": 0.0, "long_max": 10.0}}})
    points = spark.createDataFrame([("A", 0.0, 2.5, "X", None), ("B", 0.0, 7.5, " ", "x ")], "Name string, Lat double, Long double, Source string, Destination string")
    plan = plan_routes(bundle, points, ROUTE)
    feature = writers.dijkstra_features(plan.legs, ROUTE.path_variables)[0]
    assert feature["properties"]["total_traveltime"] == pytest.approx(2.319188, rel=1e-6)
    assert feature["geometry"]["coordinates"] == [[2.5, 0.0], [5.0, 0.0], [7.5, 0.0]] and feature["properties"]["cases"] == [2, 2]
    smooth = writers.smoothed_features(plan.smoothed(), ROUTE.path_variables)[0]
    assert smooth["properties"]["traveltime"][0] == 0.0 and smooth["properties"]["total_traveltime"] == pytest.approx(2.319188, rel=1e-4)
    for kind in ("geojson", "gpx", "kml", "csv"):
        writers.save_feature(smooth, str(tmp_path / f"r.{kind}"))
    assert readers.parse_gpx((tmp_path / "r.gpx").read_text())[0] == [(2.5, 0.0), (5.0, pytest.approx(0.0, abs=1e-6)), (7.5, 0.0)]
    assert (tmp_path / "r.csv").read_text().startswith("Route Name:,A_B\n")
    with pytest.raises(ValueError):
        writers.save_feature(smooth, "r.txt")
    again = readers.read_mesh(spark, json.loads(json.dumps(writers.mesh_document(plan.bundle, [smooth], points))))
    assert again.cells.count() == 2 and again.edges.count() == 2 and len(again.routes) == 1 and again.waypoints.count() == 2
    with pytest.raises(ValueError):
        plan_routes(bundle, points.withColumn("Lat", F.lit(9.0)), ROUTE)


def scalar_newton(x, a, length, u1, v1, u2, v2, s1, s2):
    """Steps, crossing and leg times of one edge."""
    y, c1, c2 = length * x / (x + a), s1 * s1 - u1 * u1 - v1 * v1, s2 * s2 - u2 * u2 - v2 * v2
    for n in range(1, 1001):
        d1, d2 = x * u1 + y * v1, a * u2 + (length - y) * v2
        x1, x2 = math.sqrt(d1 * d1 + c1 * (x * x + y * y)), math.sqrt(d2 * d2 + c2 * (a * a + (length - y) ** 2))
        g1, g2 = (d1 * v1 + c1 * y) / x1, (-d2 * v2 - c2 * (length - y)) / x2
        f = x2 * (y - v1 * (x1 - d1) / c1) + x1 * (y - length + v2 * (x2 - d2) / c2)
        df = x1 + x2 + y * (g1 + g2) - v1 / c1 * (g2 * (x1 - d1) + x2 * (g1 - v1)) + v2 / c2 * (g1 * (x2 - d2) + x1 * (g2 + v2)) - length * g1
        y -= f / df
        if abs(f / df / (x1 * x2)) <= 1e-3:
            return n, y, (x1 - d1) / c1, (x2 - d2) / c2
    raise AssertionError("not settled")


def test_slow_gliders_on_small_cells_settle(spark):
    r, half, speed = random.Random(3), 0.001, 1.5 / 3.6
    rows = []
    for _ in range(300):
        x, a, length = half * 111321.0 * r.uniform(0.5, 1.0), half * 111321.0 * r.uniform(0.5, 1.0), half * 111386.0 * r.uniform(-1.0, 1.0)
        rows.append((x, a, length, *[r.uniform(-0.2, 0.2) for _ in range(4)], speed, speed))
    expected = [scalar_newton(*row) for row in rows]
    assert sum(n > 2 for n, *_ in expected) > 30
    names = ("_x", "_a", "_len", "_u1", "_v1", "_u2", "_v2", "_s1", "_s2")
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = travel.with_newton(df).orderBy("i").collect()
    for g, (_, y, t1, t2) in zip(got, expected, strict=True):
        assert (g._y, g._t1, g._t2) == pytest.approx((y, t1, t2), rel=1e-9, abs=1e-9)


def test_shortest_paths_match_brute_force(spark, monkeypatch):
    cells = even(synthetic.regular_cells(spark, 3, 3, 0.0, 50.0, 2.0, 1.0)).withColumns({"uC": (F.col("id").cast("int") % 3 - 1) * 0.5, "vC": (F.col("id").cast("int") % 4 - 1) * 0.4})
    cells = written(cells, "cells")
    costs = written(paths.edge_costs(written(mesh.adjacency(cells), "edges"), cells), "costs")
    graph = {}
    for r in costs.collect():
        graph.setdefault(r.src, []).append((r.t1 + r.t2, r.dst))

    def best(a):
        found, heap = {}, [(0.0, a)]
        while heap:
            c, n = heapq.heappop(heap)
            if n not in found:
                found[n] = c
                for w, m in graph[n]:
                    heapq.heappush(heap, (c + w, m))
        return found

    requests = spark.createDataFrame([("0", "8"), ("0", "2"), ("7", "2"), ("3", "3")], "source string, target string")
    total = lambda df: {(r.source, r.target): r.c for r in df.groupBy("source", "target").agg(F.sum("cost").alias("c")).collect()}
    expected = {(a, b): pytest.approx(best(a)[b]) for a, b in (("0", "8"), ("0", "2"), ("7", "2"))}
    assert total(paths.shortest_paths(costs, requests)) == expected
    monkeypatch.setattr(paths, "SEARCH_EDGES", 1)
    assert total(paths.shortest_paths(costs, requests)) == expected


def test_planned_routes_are_the_ships_between_all_waypoints(spark, tmp_path):
    from meshvoyage.plans import queries

    # Land in each cell of the eighth column but its third; sources by nation 0, destinations by nation 1.
    size = F.when((F.col("id") % 20 == 8) & (F.expr("id DIV 20") != 2), 1).otherwise(F.col("id") % 3 * 10 + 10)
    spark.range(100).select(F.col("id").alias("p_partkey"), size.cast("int").alias("p_size"), F.lit(900.0).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 9).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    legs = queries.r11_planned_routes(spark, str(tmp_path)).collect()
    sources, destinations = [3, 6], [1, 3, 4, 6, 7]
    assert {r.route_id for r in legs} == {f"Route - C{a} to C{b}" for a in sources for b in destinations if a != b}
    assert all(r.fuel is None or r.fuel > 0 for r in legs) and not {r.cell for r in legs} & {str(k) for k in range(8, 100, 20) if k != 48}
    assert len({round(r.fuel / r.traveltime, 3) for r in legs if r.traveltime}) > 1


def test_both_searches_take_the_same_of_equal_paths(spark, monkeypatch):
    # A grid with costs of 1 and one near tie; "b" comes before "c", and the dear way is dearer by less than 1e-9.
    grid = [(f"{x}{y}", f"{x + dx}{y + dy}", 1.0) for x in range(4) for y in range(4) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)) if 0 <= x + dx < 4 and 0 <= y + dy < 4]
    near = [("a", "b", 1.0 + 1e-10), ("a", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0)]
    edges = spark.createDataFrame([(s, d, c, 0.0) for s, d, c in grid + near], "src string, dst string, t1 double, t2 double")
    requests = spark.createDataFrame([("33", "00"), ("00", "33"), ("12", "30"), ("a", "d")], "source string, target string")
    hops = lambda: sorted(map(tuple, paths.shortest_paths(edges, requests).collect()))
    held = hops()
    assert [h[3] for h in held if h[0] == "a"] == ["a", "c"]
    monkeypatch.setattr(paths, "SEARCH_EDGES", 1)
    assert hops() == held


def test_edges_that_cost_nothing_make_no_loop(spark, monkeypatch):
    # From p, q and t one can go round for nothing; q is reached at once, or at the same cost by x.
    costs = {"sp": 1.0, "sq": 1.0, "pq": 0.0, "qp": 0.0, "pt": 0.0, "qt": 0.0, "tp": 0.0, "sx": 0.5, "xq": 0.5, "tu": 0.0, "uv": 0.0, "vt": 0.0, "ps": 0.0}
    edges = spark.createDataFrame([(k[0], k[1], c, 0.0) for k, c in costs.items()], "src string, dst string, t1 double, t2 double")
    requests = spark.createDataFrame([("s", t) for t in "qtvsz"], "source string, target string")
    ways = lambda: walked(paths.shortest_paths(edges, requests).orderBy("hop").collect())
    walked = lambda rows: {t: way for t in "qtvsz" if (way := [r.src + r.dst for r in rows if r.target == t])}
    expected = {"q": ["sq"], "t": ["sp", "pt"], "v": ["sp", "pt", "tu", "uv"]}
    assert ways() == expected
    monkeypatch.setattr(paths, "SEARCH_EDGES", 1)
    monkeypatch.setattr(paths, "MERGE_ROUNDS", 2)
    assert ways() == expected


def test_query_routes_are_smoothed_with_the_default_passes():
    from meshvoyage.plans import queries

    assert queries.ROUTE.smoothing_max_iterations == 2000


def test_smoothing_keeps_within_edges_and_does_not_lengthen(spark):
    cells = {str(i): smoothing.Cell(str(i), 2.0 * i + 1, 60.0, 1.0, 2.0, 0.0, 0.0, 0.0, (10.0,) * 8) for i in range(4)}
    around = {str(i): [(2, str(i + 1))] * (i < 3) + [(-2, str(i - 1))] * (i > 0) for i in range(4)}
    crossings = {(str(i), str(i + 1), 2): (2.0 * i + 2, 60.0) for i in range(3)} | {(str(i + 1), str(i), -2): (2.0 * i + 2, 60.0) for i in range(3)}
    graph = smoothing.Graph(cells, around, crossings)
    path = [graph.step(cells[str(i)], cells[str(i + 1)], 2) for i in range(3)]
    start, end = (0.5, 60.0), (7.5, 61.5)
    before = smoothing.path_values(path, start, end, (), 1.0)[-1]["traveltime"]
    done = smoothing.Smoother(graph, ROUTE).run(path, start, end)
    assert smoothing.path_values(done, start, end, (), 1.0)[-1]["traveltime"] <= before
    assert all(58.0 <= s.at[1] <= 62.0 for s in done)


def test_smoothing_by_parts_equals_smoothing_with_the_whole_graph(spark, monkeypatch):
    k = F.col("id").cast("int")
    cells = even(synthetic.regular_cells(spark, 8, 8, 0.0, 50.0, 2.0, 1.0)).withColumns({"uC": (k % 3 - 1) * 0.9, "vC": (k % 5 - 2) * 0.5, "inaccessible": k.isin(18, 27, 44)})
    bundle = readers.MeshBundle(cells, mesh.ordered(mesh.adjacency(cells)), {})
    points = spark.createDataFrame([("A", 50.2, 0.3, "X", "X"), ("B", 57.7, 15.6, "X", "X"), ("C", 57.6, 0.4, None, "X")], "Name string, Lat double, Long double, Source string, Destination string")
    plan = plan_routes(bundle, points, ROUTE)
    rows = lambda: sorted(map(tuple, plan.smoothed().collect()))
    whole = rows()
    assert len({r[0] for r in whole}) == 4
    monkeypatch.setattr(smoothing, "GRAPH_EDGES", 1)
    monkeypatch.setattr(smoothing, "RINGS", 0)
    assert rows() == whole


def test_overflow_and_corner_rules():
    big, small = smoothing.Cell("a", 0, 0, 1, 2), smoothing.Cell("b", 2, 0, 1, 1)
    step = smoothing.Step(big, small, 2, (1.0, 0.0))
    assert smoothing.overflow(step, (1.0, 0.5)) is None
    assert smoothing.overflow(step, (1.0, 1.5)) == (2, -4) and smoothing.overflow(step, (1.0, -1.5)) == (2, 4)
    assert smoothing.overflow(smoothing.Step(small, big, -2, (1.0, 0.0)), (1.0, 1.5)) == (-4, 2)
    assert smoothing.corner_sides(1, True) == (-4, -2) and smoothing.corner_sides(3, False) == (4, -2)


def test_drawn_route_costs_add_up(spark):
    cells = even(synthetic.regular_cells(spark, 4, 1, 0.0, -1.0, 2.0, 2.0)).withColumn("inaccessible", F.col("id") == "2")
    points = spark.createDataFrame([("1", 0, 1.0, 0.0), ("1", 1, 7.0, 0.0), ("2", 0, 1.0, 5.0), ("2", 1, 3.0, 0.0)], "route_id string, order int, Long double, Lat double")
    bundle = readers.MeshBundle(cells, mesh.adjacency(cells), {"mesh_info": {"region": {"lat_min": -1.0, "lat_max": 1.0, "long_min": 0.0, "long_max": 8.0}}})
    rows = calculate_route(bundle, points).orderBy("seq").collect()
    assert {r.route_id for r in rows} == {"1"} and [r.cell for r in rows] == ["0", "1", "2", "3"]
    assert [r.borrowed for r in rows] == [False, False, True, False] and not any(r.gap for r in rows)
    assert rows[-1].cum_traveltime == pytest.approx(6 * 111321.0 / (10 / 3.6) / 86400)
    assert costing.cost_route(points, cells).where("route_id = '2'").count() > 0


def test_a_sliver_at_a_corner_takes_no_pieces_place(spark):
    # The mesh of the queries around the corner of cells 526 (south east) and 546, 545, 525.
    k = F.col("id").cast("int")
    cells = spark.range(500, 580).select(F.col("id").cast("string").alias("id")).withColumns({"cx": k % 20 * 0.2 + 0.1, "cy": F.floor(k / 20) * 0.1 - 69.95, "dcx": F.lit(0.1), "dcy": F.lit(0.05)})
    points = [("0", 0, 1.397462, -67.40127), ("0", 1, 1.402538, -67.39873), ("1", 0, 1.4, -67.39), ("1", 1, 1.4, -67.36)]
    lines = costing.route_lines(spark.createDataFrame(points, "route_id string, order int, Long double, Lat double"))
    pieces = costing.cut_at_cells(lines, cells).collect()
    for route in ("0", "1"):
        assert sum(p.t_out - p.t_in for p in pieces if p.route_id == route) == pytest.approx(1.0, abs=1e-8)


def test_config_errors():
    with pytest.raises(ValueError):
        VesselConfig.from_dict({"vessel_type": "raft", "max_speed": 1, "unit": "km/hr", "max_ice_conc": 1, "min_depth": 1})
    with pytest.raises(ValueError):
        VesselConfig.from_dict({"vessel_type": "Slocum", "max_speed": -1, "unit": "km/hr", "max_ice_conc": 1, "min_depth": 1})
    with pytest.raises(ValueError):
        RouteConfig.from_dict({"objective_function": "fuel", "path_variables": ["fuel"], "vector_names": ["u"]})
    assert RouteConfig.from_dict({"objective_function": "fuel", "path_variables": ["fuel"], "vector_names": ["u", "v"]}).seconds_per_unit == 86400


def test_synthetic_fields():
    field = synthetic.gaussian_field(16, seed=3)
    assert field.shape == (16, 16) and field.min() == 0.0 and field.max() == 1.0
    assert (field == synthetic.gaussian_field(16, seed=3)).all()


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "m19_travel_time" in entry.queries()


def test_chained_pieces_follow_one_another(spark):
    rows = [("1", 0, 0.0, 1.0), ("1", 5, 2.01, 3.0), ("1", 9, 1.02, 2.0), ("1", 7, 9.0, 9.5), ("2", 3, 0.0, 1.0)]
    pieces = spark.createDataFrame([(r, s, a, 0.0, b, 0.0) for r, s, a, b in rows], "route_id string, seq int, start_lon double, start_lat double, end_lon double, end_lat double")
    got = {(r.route_id, r.seq): r.place for r in costing.chained(pieces).collect()}
    assert got == {("1", 0): 0, ("1", 9): 1, ("1", 5): 2, ("1", 7): None, ("2", 3): 0}


def test_a_ship_of_ones_own(spark):
    class Steady(vessel.Ship):
        def resistance(self, speed, cells):
            return F.lit(1000.0)

        def fuel(self, speed, resistance):
            return resistance / 100.0

    cells = spark.createDataFrame([("a", -100.0, 50.0, 1.0, 900.0)], "id string, elevation double, SIC double, thickness double, density double")
    done = vessel.with_performance(vessel.with_accessibility(cells, Steady(SHIP)), Steady(SHIP)).first()
    assert done.speed == [26.5] * 8 and done.ice_resistance == 1000.0 and done.fuel == [10.0] * 8


def test_routing_table_and_time_within_a_cell(spark):
    hops = spark.createDataFrame([("a", "c", 0, "a", "b", 1.0), ("a", "c", 1, "b", "c", 2.5)], "source string, target string, hop int, src string, dst string, cost double")
    assert [(r.cell, r.via, r.cost) for r in paths.routing_table(hops).orderBy("hop").collect()] == [("b", "a", 1.0), ("c", "b", 3.5)]
    lit = [F.lit(x) for x in (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0)]
    assert value(spark, travel.time_between(*lit)) == pytest.approx(111321.0 / 2)


def test_command_line(spark, tmp_path):
    from meshvoyage.cli import main

    cells = [{"id": str(i), "geometry": "", "cx": 2.5 + 5 * i, "cy": 0.0, "dcx": 2.5, "dcy": 1.25, "uC": 0.0, "vC": 0.0, "SIC": 0.0, "elevation": -100.0, "thickness": 1.0, "density": 900.0} for i in range(3)]
    graph = {str(i): {str(c): [] for c in (1, 2, 3, 4, -1, -2, -3, -4)} for i in range(3)}
    for i in range(2):
        graph[str(i)]["2"], graph[str(i + 1)]["-2"] = [i + 1], [i]
    region = {"lat_min": -1.25, "lat_max": 1.25, "long_min": 0.0, "long_max": 15.0}
    files = {
        "mesh": {"config": {"mesh_info": {"region": region}}, "cellboxes": cells, "neighbour_graph": graph},
        "ship": {"vessel_type": "SDA", "max_speed": 26.5, "unit": "km/hr", "beam": 24.0, "hull_type": "slender", "force_limit": 96634.5, "max_ice_conc": 80, "min_depth": 10},
        "route": {"objective_function": "fuel", "path_variables": ["fuel", "traveltime"], "vector_names": ["uC", "vC"]},
    }
    for name, doc in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "points.csv").write_text("Name,Lat,Long,Source,Destination\nA,0.5,1.0,X,\nB,-0.5,14.0,,X\n")
    (tmp_path / "drawn.csv").write_text("Name,Lat,Long\nA,0.5,1.0\nM,0.0,7.0\nB,-0.5,14.0\n")
    at = lambda n: str(tmp_path / n)
    assert main(["add-vehicle", at("ship.json"), at("mesh.json"), "-o", at("vessel.json")]) == 0
    assert main(["resimulate-vehicle", at("vessel.json"), "-o", at("again.json")]) == 0
    speeds = [[c["speed"] for c in json.loads((tmp_path / f"{n}.json").read_text())["cellboxes"]] for n in ("vessel", "again")]
    assert speeds[0] == speeds[1] == [[26.5] * 8] * 3
    assert main(["optimise-routes", at("route.json"), at("vessel.json"), at("points.csv"), "-o", at("out.json"), "-p", "-d", "--path-gpx", "--path-kml", "--chart-track"]) == 0
    assert {p.name for p in tmp_path.iterdir()} >= {"out.json", "out.geojson", "out_dijkstra.json", "out_dijkstra.geojson", "out_AB.gpx", "out_AB.kml", "out.r0.csv"}
    made = json.loads((tmp_path / "out.json").read_text())
    assert len(made["paths"]["features"]) == 1 and made["paths"]["features"][0]["properties"]["to"] == "B"
    assert main(["extract-routes", at("out.json"), "-o", at("one.gpx")]) == 0 and (tmp_path / "one_AB.gpx").exists()
    assert main(["extract-routes", at("out.json"), "-o", at("one.txt")]) == 1
    assert main(["calculate-route", at("vessel.json"), at("drawn.csv"), "-o", at("cost.json")]) == 0
    cost = json.loads((tmp_path / "cost.json").read_text())["features"][0]["properties"]
    assert cost["from"] == "A" and cost["traveltime"][-1] > 0
    points, begin, end = readers.read_route(spark, at("out_AB.gpx"))
    assert points.count() == len(made["paths"]["features"][0]["geometry"]["coordinates"])
    with pytest.raises(TypeError):
        readers.document(3)
