"""Nearest points: cells that are split where points are dense, and a search that opens only cells that can matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrflow.functions.geo import degrees_of, distance_m
from addrflow.sources.scratch import kept

from .relational import top_k, union_all, within_radius

#: Points of a cell that is not split, cells along a split cell's side, and times that a cell is split at most.
CELL_POINTS, SPLIT, DEEPEST = 64, 4, 10
#: Metres by which bounds give way to rounding.
_SLACK = 0.001


def _bounds(side_x: float, side_y: float) -> tuple[Column, Column]:
    """(least, greatest) distance in metres of an input to any place of the cell (_x, _y): the haversine's terms are bounded
    one by one."""
    west, south = F.col("_x") * side_x, F.col("_y") * side_y
    east, north = (F.col("_x") + 1) * side_x, (F.col("_y") + 1) * side_y
    zero = F.lit(0.0)
    near = F.greatest(zero, west - F.col("lon"), F.col("lon") - east), F.greatest(zero, south - F.col("lat"), F.col("lat") - north)
    far = F.greatest(F.abs(F.col("lon") - west), F.abs(F.col("lon") - east)), F.greatest(F.abs(F.col("lat") - south), F.abs(F.col("lat") - north))
    # Meridians are closest where the latitude is greatest.
    wide, narrow = F.when(south * north <= 0, 0.0).otherwise(F.least(F.abs(south), F.abs(north))), F.greatest(F.abs(south), F.abs(north))

    def metres(lon: Column, lat: Column, other: Column) -> Column:
        turn = F.cos(F.radians("lat")) * F.cos(F.radians(other))
        h = F.pow(F.sin(F.radians(lat) / 2), 2) + turn * F.pow(F.sin(F.radians(lon) / 2), 2)
        return 2 * 6371008.8 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    return metres(*near, narrow) - _SLACK, metres(*far, wide) + _SLACK


def split_cells(points: DataFrame, side_x: float, side_y: float, cell_points: int = CELL_POINTS) -> tuple[DataFrame, DataFrame, int]:
    """(cells, leaves, levels): cells (_level, _x, _y, n) of a grid that is refined where a cell has more than
    ``cell_points``, and each point with the cell that is not split further."""
    at = lambda j: (F.floor(F.col("plon") / side_x * SPLIT**j).alias("_x"), F.floor(F.col("plat") / side_y * SPLIT**j).alias("_y"))
    cells, leaves, rest = [], [], points
    for j in range(DEEPEST + 1):
        own = rest.select(*points.columns, F.lit(j).alias("_level"), *at(j))
        here = kept("cells", own.groupBy("_level", "_x", "_y").agg(F.count("*").alias("n")))
        cells.append(here)
        dense = here.where(F.col("n") > cell_points).select("_x", "_y")
        if j == DEEPEST or dense.isEmpty():
            leaves.append(own)
            break
        leaves.append(own.join(dense, ["_x", "_y"], "left_anti"))
        # Written, so that no level's plan holds those of all levels above it.
        rest = kept("dense", own.join(dense, ["_x", "_y"], "left_semi").select(points.columns))
    return union_all(*cells), union_all(*leaves), len(cells)


def cells_to_read(inputs: DataFrame, cells: DataFrame, levels: int, side_x: float, side_y: float, k: int, max_m: float, cell_points: int = CELL_POINTS) -> DataFrame:
    """(input_id, lon, lat, _level, _x, _y, n): the unsplit cells that can hold one of an input's nearest ``k`` points.

    Level by level: the cells known so far say within what distance ``k`` points lie for sure; cells that begin farther
    away are left, and of the others the split ones are opened."""
    around = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    front = inputs.select("input_id", "lon", "lat").withColumn("_i", around).withColumn("_j", around)
    front = front.select("input_id", "lon", "lat", (F.floor(F.col("lon") / side_x) + F.col("_i")).alias("_x"), (F.floor(F.col("lat") / side_y) + F.col("_j")).alias("_y"))
    done: DataFrame | None = None
    for j in range(levels):
        least, most = _bounds(side_x / SPLIT**j, side_y / SPLIT**j)
        found = front.join(cells.where(F.col("_level") == j), ["_x", "_y"]).withColumn("_least", least).withColumn("_most", most)
        both = found if done is None else done.unionByName(found)
        # The distance by which the cells that end there hold k points.
        held = F.sum("n").over(Window.partitionBy("input_id", "lon", "lat").orderBy("_most").rangeBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("_held") >= k, F.col("_most"))).over(Window.partitionBy("input_id", "lon", "lat"))
        both = both.withColumn("_held", held).withColumn("_bound", F.least(F.coalesce(bound, F.lit(max_m)), F.lit(float(max_m)))).where("_least <= _bound").drop("_held", "_bound")
        both = kept("front", both)
        if j == levels - 1:
            return both.drop("_least", "_most")
        opened = (F.col("_level") == j) & (F.col("n") > cell_points)
        done = both.where(~opened)
        inner = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))
        front = both.where(opened).withColumn("_i", inner).withColumn("_j", inner).select("input_id", "lon", "lat", (F.col("_x") * SPLIT + F.col("_i")).alias("_x"), (F.col("_y") * SPLIT + F.col("_j")).alias("_y"))
    raise ValueError("a grid has at least one level")


def nearest(inputs: DataFrame, points: DataFrame, k: int, max_m: float, cell_points: int = CELL_POINTS) -> DataFrame:
    """The nearest ``k`` points (point_id, plon, plat) within ``max_m`` metres of each input (input_id, lon, lat), with
    ``distance`` and ``rank``; ties go to the lesser id (L5, W8, J12).

    The first grid's cells are no smaller than ``max_m``.  A map without dense cells is joined at once; else cells are split
    where they are dense, so that an input reads some cells' points, however many lie around it.  Inputs and points without
    a position are left out.

    Positions are searched, not points and inputs: of the points at one place only the ``k`` least ids can count, and of
    equally distant places those with the least ids.  So a tower of flats is one place, and is never split in vain."""
    side_x, side_y = degrees_of(max_m)
    inputs, points = inputs.where("lon IS NOT NULL AND lat IS NOT NULL"), points.where("plon IS NOT NULL AND plat IS NOT NULL")
    spots = kept("spots", inputs.select("lon", "lat").distinct().select(F.struct("lon", "lat").alias("input_id"), "lon", "lat"))
    places = kept("places", points.groupBy("plon", "plat").agg(F.min("point_id").alias("_first")))
    cells, leaves, levels = split_cells(places, side_x, side_y, cell_points)
    if levels == 1:
        near = within_radius(spots, places, max_m)
    else:
        read = cells_to_read(spots, cells, levels, side_x, side_y, k, max_m, cell_points)
        near = read.join(leaves, ["_level", "_x", "_y"]).withColumn("distance", distance_m(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))).where(F.col("distance") <= max_m)
    near = kept("near", top_k(near, ["lon", "lat"], [F.asc("distance"), F.asc("_first")], k).select("lon", "lat", "plon", "plat", "distance"))
    there = points.join(near.select("plon", "plat").distinct(), ["plon", "plat"], "left_semi")
    least = top_k(there, ["plon", "plat"], [F.asc("point_id")], k).select("plon", "plat", "point_id")
    best = top_k(near.join(least, ["plon", "plat"]), ["lon", "lat"], [F.asc("distance"), F.asc("point_id")], k)
    return inputs.join(best, ["lon", "lat"]).select("input_id", "rank", "point_id", "distance")
