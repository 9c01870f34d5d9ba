"""The mesh as a graph: adjacency, pruning, splitting, and points in cells.

Geometry joins are equi-joins on rounded coordinates and tiles, so that no operator
holds all cells against all cells.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import written

#: Coordinates are compared in units of 1e-9 degrees.
GRAIN = 1e9
#: About so many points and cells meet in a task: larger tables make more tasks, not larger ones.
ROWS_PER_TASK = 50_000


def _key(x: Column) -> Column:
    return F.round(x * GRAIN).cast("bigint")


def _turn(lon: Column) -> Column:
    """A longitude's key on the circle: the antimeridian has one."""
    return F.pmod(_key(lon + 180.0), F.lit(int(360 * GRAIN)))


def _corners(cells: DataFrame, tag: str) -> DataFrame:
    c = lambda n: F.col(n)
    west, east, south, north = c("cx") - c("dcx"), c("cx") + c("dcx"), c("cy") - c("dcy"), c("cy") + c("dcy")
    named = {"id": c("id"), "west": _key(west), "east": _key(east), "south": _key(south), "north": _key(north), "west_turn": _turn(west), "east_turn": _turn(east)}
    return cells.select(*[v.alias(f"{tag}_{k}") for k, v in named.items()])


def _tiles(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def adjacency(cells: DataFrame) -> DataFrame:
    """Edges (src, case, dst) between cells that share an edge (2, 4, -2, -4) or a corner (1, 3, -1, -3).

    Cells touch across the antimeridian too.  East and south contacts and the eastern
    corners are joined; the other four directions mirror them.  A contact along an
    edge is found in the one tile, as high or wide as the largest cell, where the
    shared stretch begins.
    """
    size = cells.agg((F.max("dcy") * 2.000001 * GRAIN).cast("bigint").alias("tall"), (F.max("dcx") * 2.000001 * GRAIN).cast("bigint").alias("broad"))
    a = _corners(cells, "a").join(F.broadcast(size))  # one row
    b = _corners(cells, "b").join(F.broadcast(size.toDF("tall_b", "broad_b")))
    rows = lambda df, t, lo, hi, size: df.withColumn(f"{t}_tile", F.explode(_tiles(F.col(f"{t}_{lo}"), F.col(f"{t}_{hi}"), F.col(size))))
    tall_a, tall_b = rows(a, "a", "south", "north", "tall"), rows(b, "b", "south", "north", "tall_b")
    start = F.greatest("a_south", "b_south")
    east = tall_a.join(tall_b, (F.col("a_east_turn") == F.col("b_west_turn")) & (F.col("a_tile") == F.col("b_tile"))).where((F.least("a_north", "b_north") > start) & (F.floor(start / F.col("tall")) == F.col("a_tile")))
    broad_a, broad_b = rows(a, "a", "west", "east", "broad"), rows(b, "b", "west", "east", "broad_b")
    begin = F.greatest("a_west", "b_west")
    south = broad_a.join(broad_b, (F.col("a_south") == F.col("b_north")) & (F.col("a_tile") == F.col("b_tile"))).where((F.least("a_east", "b_east") > begin) & (F.floor(begin / F.col("broad")) == F.col("a_tile")))
    plain_a, plain_b = _corners(cells, "a"), _corners(cells, "b")
    north_east = plain_a.join(plain_b, (F.col("a_east_turn") == F.col("b_west_turn")) & (F.col("a_north") == F.col("b_south")))
    south_east = plain_a.join(plain_b, (F.col("a_east_turn") == F.col("b_west_turn")) & (F.col("a_south") == F.col("b_north")))
    parts = [df.select(F.col("a_id").alias("src"), F.lit(case).alias("case"), F.col("b_id").alias("dst")) for df, case in ((east, 2), (south, 4), (north_east, 1), (south_east, 3))]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    both = F.array(F.struct("src", "case", "dst"), F.struct(F.col("dst").alias("src"), (-F.col("case")).alias("case"), F.col("src").alias("dst")))
    return one.select(F.explode(both).alias("e")).select("e.*")


def ordered(edges: DataFrame) -> DataFrame:
    """``edges`` with ord, the place of an edge among those of its source."""
    place = F.row_number().over(W.partitionBy("src").orderBy("case", "dst"))
    return edges.withColumn("ord", place)


def prune(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``edges`` without those that begin or end in an inaccessible cell."""
    open_ = cells.where(~F.col("inaccessible")).select("id")
    return edges.join(open_.withColumnRenamed("id", "src"), "src", "left_semi").join(open_.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def neighbours(edges: DataFrame, cell_id: str) -> DataFrame:
    return edges.where(F.col("src") == cell_id).select("dst", "case")


def quad_split(cells: DataFrame, which: Column) -> DataFrame:
    """The cells for which ``which`` holds, replaced by their four quarters.

    Quarters keep their parent's attributes; their ids are the parent's with .0 to .3,
    from the south west by rows.  Sizes halve.
    """
    quarter = F.explode(F.when(F.coalesce(which, F.lit(False)), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(-1))))
    rows = cells.withColumn("_q", quarter)
    is_part = F.col("_q") >= 0
    east, north = F.col("_q") % 2 * 2 - 1, F.floor(F.col("_q") / 2) * 2 - 1
    half = lambda c: F.when(is_part, F.col(c) / 2).otherwise(F.col(c))
    return rows.withColumns({
        "id": F.when(is_part, F.concat_ws(".", "id", F.col("_q").cast("string"))).otherwise(F.col("id")),
        "cx": F.when(is_part, F.col("cx") + F.col("dcx") / 2 * east).otherwise(F.col("cx")),
        "cy": F.when(is_part, F.col("cy") + F.col("dcy") / 2 * north).otherwise(F.col("cy")),
        "dcx": half("dcx"),
        "dcy": half("dcy"),
    }).drop("_q")


def split_around_inaccessible(cells: DataFrame, most_rounds: int = 16) -> DataFrame:
    """Accessible neighbours of inaccessible cells, quartered until none is wider or taller.

    Each round splits all such cells at once and is written; sizes halve, so the
    number of rounds is the logarithm of the largest ratio of sizes.
    """
    for _ in range(most_rounds):
        closed = cells.where("inaccessible").select(F.col("id").alias("src"), F.col("dcx").alias("_x"), F.col("dcy").alias("_y"))
        limit = adjacency(cells).join(closed, "src").groupBy(F.col("dst").alias("id")).agg(F.min("_x").alias("_x"), F.min("_y").alias("_y"))
        marked = cells.join(limit, "id", "left")
        large = ~F.col("inaccessible") & ((F.col("dcx") > F.col("_x") * 1.000001) | (F.col("dcy") > F.col("_y") * 1.000001))
        marked = written(marked.withColumn("_large", F.coalesce(large, F.lit(False))).select(*cells.columns, "_large"), "split")
        if marked.where("_large").isEmpty():
            return marked.drop("_large")
        cells = quad_split(marked, F.col("_large")).drop("_large")
    raise RuntimeError(f"cells differ too much in size for {most_rounds} rounds")


def split_around_points(cells: DataFrame, points: DataFrame, width: float, height: float, depth: int) -> DataFrame:
    """Cells that hold a point, quartered until they are ``depth`` halvings below the mesh's cell size."""
    for _ in range(depth):
        held = _dealt(located_all(points, cells.select("id", "cx", "cy", "dcx", "dcy")).select("id"), cells.count(), "id").distinct().withColumn("_held", F.lit(True))
        large = (F.col("dcx") * 2 > width / 2**depth * 1.000001) | (F.col("dcy") * 2 > height / 2**depth * 1.000001)
        marked = _dealt(cells, cells.count(), "id").join(held, "id", "left").select(*cells.columns, (F.coalesce("_held", F.lit(False)) & large).alias("_split"))
        cells = written(quad_split(marked, F.col("_split")).drop("_split"), "split")
    return cells


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``rows`` need; left alone where the session's own number does."""
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def tile_size(cells: DataFrame) -> Column:
    """The largest width or height of the cells, one number: a literal, so that tiles are plain arithmetic in the plan."""
    return F.lit(cells.agg(F.max(F.greatest("dcx", "dcy") * 2)).first()[0]).cast("double")


def located_all(points: DataFrame, cells: DataFrame, x: str = "Long", y: str = "Lat", rows: int | None = None) -> DataFrame:
    """Every pair of a point and a cell that holds it, borders included; ``rows`` is the number of both, if known."""
    tile = tile_size(cells)
    rows = points.count() + cells.count() if rows is None else rows
    # A little beyond the borders, so that rounding parts no point on a border from its cells.
    span = lambda c, d: F.explode(F.sequence(F.floor((F.col(c) - F.col(d)) / tile - 1e-9), F.floor((F.col(c) + F.col(d)) / tile + 1e-9)))
    tiled = cells.withColumn("_tx", span("cx", "dcx")).withColumn("_ty", span("cy", "dcy"))
    at = points.withColumns({"_tx": F.floor(F.col(x) / tile), "_ty": F.floor(F.col(y) / tile)})
    inside = (F.abs(F.col(x) - F.col("cx")) <= F.col("dcx") + 1e-12) & (F.abs(F.col(y) - F.col("cy")) <= F.col("dcy") + 1e-12)
    return _dealt(at, rows, "_tx", "_ty").join(_dealt(tiled, rows, "_tx", "_ty"), ["_tx", "_ty"]).where(inside).drop("_tx", "_ty")


def locate(points: DataFrame, cells: DataFrame, name: str = "Name", order: str = "id") -> DataFrame:
    """Points with ``cell``, the accessible cell that holds them; points in none are left out.

    On a border the first two cells in mesh order count: the second is taken if it
    lies east, north-east or north of the first.
    """
    rows = points.count() + cells.count()
    found = located_all(points, cells.where(~F.col("inaccessible")).select("id", "cx", "cy", "dcx", "dcy", *([order] if order != "id" else [])), rows=rows)
    found = _dealt(found, rows, name)
    per_point = W.partitionBy(name).orderBy(F.col(order).cast("double").asc_nulls_last(), F.col(order))
    ranked = found.withColumns({"_rank": F.row_number().over(per_point)}).where("_rank <= 2")
    box = F.struct("_rank", "id", "cx", "cy", "dcx", "dcy")
    keep = [F.first(c).alias(c) for c in points.columns if c != name]
    pair = ranked.groupBy(name).agg(F.array_sort(F.collect_list(box)).alias("_b"), *keep)  # two at most
    a, b = F.get("_b", F.lit(0)), F.get("_b", F.lit(1))
    west, south = _key(a["cx"] + a["dcx"]) == _key(b["cx"] - b["dcx"]), _key(a["cy"] + a["dcy"]) == _key(b["cy"] - b["dcy"])
    second = F.coalesce(west & ~(_key(b["cy"] + b["dcy"]) == _key(a["cy"] - a["dcy"])) | (south & ~(_key(b["cx"] + b["dcx"]) == _key(a["cx"] - a["dcx"]))), F.lit(False))
    return pair.withColumn("cell", F.when(second, b["id"]).otherwise(a["id"])).select(*points.columns, "cell")


def within_bounds(points: DataFrame, region: dict, strict_margin: bool = True) -> DataFrame:
    """``points`` with ``inside``: strictly within the region, widened by 1e-10 unless it touches the antimeridian.

    A region whose west lies east of its east goes across the antimeridian.
    """
    tiny = 0.0 if not strict_margin or region["long_min"] == -180 or region["long_max"] == 180 else 1e-10
    west, east = F.col("Long") > region["long_min"] - tiny, F.col("Long") < region["long_max"] + tiny
    lon = (west | east) if region["long_min"] > region["long_max"] else (west & east)
    lat = (F.col("Lat") > region["lat_min"] - tiny) & (F.col("Lat") < region["lat_max"] + tiny)
    return points.withColumn("inside", lon & lat)


def adjust(points: DataFrame, cells: DataFrame, name: str = "Name", most_degrees: float = 5.0) -> DataFrame:
    """Points outside the accessible cells, moved just inside the nearest one.

    The way leads straight to that cell's centre and ends a thousandth of its inner
    part beyond the border, as far as a circle of 64 sides reaches.  A point whose way
    outside is longer than ``most_degrees`` stays.  Cells are looked for in rounds: those
    that hold a point, then those within a tile of it, then twice as far each time; a
    point is done when its nearest cell lies within the reach of its round.
    """
    boxes = written(cells.where(~F.col("inaccessible")).select("id", "cx", "cy", "dcx", "dcy"), "boxes")
    size = boxes.agg(F.max(F.greatest("dcx", "dcy") * 2)).first()[0] or most_degrees
    gap = lambda p, c, d: F.greatest(F.abs(F.col(p) - F.col(c)) - F.col(d), F.lit(0.0))
    away = F.sqrt(gap("Long", "cx", "dcx") * gap("Long", "cx", "dcx") + gap("Lat", "cy", "dcy") * gap("Lat", "cy", "dcy"))
    tiles = lambda a, b, tile: F.explode(F.sequence(F.floor(a / tile - 1e-9), F.floor(b / tile + 1e-9)))
    left, found, reach = points.select(name, "Long", "Lat"), [], 0.0
    rows = points.count() + boxes.count()
    while True:
        tile = max(size, reach)
        near = left.withColumn("_tx", tiles(F.col("Long") - reach, F.col("Long") + reach, tile)).withColumn("_ty", tiles(F.col("Lat") - reach, F.col("Lat") + reach, tile))
        held = boxes.withColumn("_tx", tiles(F.col("cx") - F.col("dcx"), F.col("cx") + F.col("dcx"), tile)).withColumn("_ty", tiles(F.col("cy") - F.col("dcy"), F.col("cy") + F.col("dcy"), tile))
        both = _dealt(near, rows, "_tx", "_ty").join(_dealt(held, rows, "_tx", "_ty"), ["_tx", "_ty"]).withColumn("_away", away).where(F.col("_away") <= reach)
        best = _dealt(both, rows, name).groupBy(name).agg(F.min_by(F.struct("cx", "cy", "dcx", "dcy"), F.struct("_away", "id")).alias("_c"))
        found.append(written(best, "nearest"))
        if reach >= most_degrees:
            break
        left = written(left.join(found[-1], name, "left_anti"), "afar")
        if left.isEmpty():
            break
        reach = min(max(reach * 2, size), most_degrees * 1.000001)  # a cell further off is further to go to
    best = reduce(DataFrame.unionByName, found)
    dx, dy = F.col("_c.cx") - F.col("Long"), F.col("_c.cy") - F.col("Lat")
    share = lambda d, half: F.when(F.abs(d) > half, 1.0 - half / F.abs(d)).otherwise(F.lit(0.0))
    enter = F.greatest(share(dx, F.col("_c.dcx")), share(dy, F.col("_c.dcy")))
    whole = F.sqrt(dx * dx + dy * dy)
    inner, outer = whole * (1.0 - enter), whole * enter
    sides = 2 * math.pi / 64
    theta = F.pmod(F.atan2(dy, dx), F.lit(sides))
    reach = inner * 1e-3 * math.cos(sides / 2) / F.cos(theta - sides / 2)
    strictly = (F.abs(dx) < F.col("_c.dcx")) & (F.abs(dy) < F.col("_c.dcy"))
    moved = ~strictly & (outer <= most_degrees) & (whole > 0)
    step = enter + reach / F.when(whole == 0, F.lit(1.0)).otherwise(whole)
    joined = points.join(best, name, "left")
    return joined.withColumns({"Long": F.when(moved, F.col("Long") + dx * step).otherwise(F.col("Long")), "Lat": F.when(moved, F.col("Lat") + dy * step).otherwise(F.col("Lat"))}).select(*points.columns)


def boundary(cells: DataFrame) -> DataFrame:
    """Cells with the coordinates of their sides: min_long, max_long, min_lat, max_lat."""
    c = F.col
    return cells.withColumns({"min_long": c("cx") - c("dcx"), "max_long": c("cx") + c("dcx"), "min_lat": c("cy") - c("dcy"), "max_lat": c("cy") + c("dcy")})


def with_common_boundary(cells: DataFrame, others: DataFrame) -> DataFrame:
    """The cells whose sides are those of one of ``others`` too, to a 1e-9th of a degree."""
    sides = ("min_long", "max_long", "min_lat", "max_lat")
    keyed = lambda df: boundary(df).withColumns({f"_{n}": _key(F.col(n)) for n in sides})
    keys = [f"_{n}" for n in sides]
    return keyed(cells).join(keyed(others).select(*keys).distinct(), keys, "left_semi").select(*cells.columns)
