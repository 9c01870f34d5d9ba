"""Command line: add-vehicle, optimise-routes, extract-routes, calculate-route, resimulate-vehicle."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from .plans.config import RouteConfig, VesselConfig
from .plans.planner import add_vehicle, calculate_route, plan_routes
from .sources import readers, writers


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meshvoyage", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *files: str, output: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        for f in files:
            p.add_argument(f)
        p.add_argument("-o", "--output", default=output)
        p.add_argument("-v", "--verbose", action="store_true")
        return p

    job("add-vehicle", "vessel", "mesh", output="vessel_mesh.json")
    job("resimulate-vehicle", "mesh", output="vessel_mesh.json")
    p = job("optimise-routes", "route_config", "mesh", "waypoints", output="routes.json")
    p.add_argument("-p", "--path-geojson", action="store_true", help="also write routes alone")
    p.add_argument("-d", "--dijkstra", action="store_true", help="also write unsmoothed routes")
    for kind in ("chart-track", "path-gpx", "path-kml"):
        p.add_argument(f"--{kind}", action="store_true")
    job("extract-routes", "source", output="route.json")
    job("calculate-route", "mesh", "route", output="calculated_route.json")
    return top


def _dump(doc: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f)


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, stream=sys.stderr)
    stem, _, kind = a.output.rpartition(".")
    if a.job == "extract-routes":
        routes = readers.routes_in(readers.document(a.source))
        if kind not in ("json", "geojson", "gpx", "kml", "csv"):
            logging.warning("routes can't be written as %s", kind)
            return 1
        for r in routes:
            writers.save_feature(r, f"{writers.file_stem(stem, r)}.{kind}")
        return 0
    spark = SparkSession.builder.appName(a.job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    bundle = readers.read_mesh(spark, readers.document(a.mesh))
    if a.job in ("add-vehicle", "resimulate-vehicle"):
        config = readers.document(a.vessel) if a.job == "add-vehicle" else bundle.config["vessel_info"]
        _dump(writers.mesh_document(add_vehicle(bundle, VesselConfig.from_dict(config))), a.output)
    elif a.job == "calculate-route":
        points, begin, end = readers.read_route(spark, a.route)
        pieces = calculate_route(bundle, points)
        if pieces.isEmpty():
            logging.warning("the route leaves the mesh")
            return 1
        _dump(writers.costed_feature(pieces, begin, end), a.output)
    else:
        config = RouteConfig.from_dict(readers.document(a.route_config))
        plan = plan_routes(bundle, readers.read_waypoints(spark, a.waypoints), config)
        if a.dijkstra:
            rough = writers.dijkstra_features(plan.legs, config.path_variables)
            _dump(writers.mesh_document(plan.bundle, rough, plan.waypoints), f"{stem}_dijkstra.{kind}")
            if a.path_geojson:
                _dump(writers.collection(rough), f"{stem}_dijkstra.geojson")
        smooth = writers.smoothed_features(plan.smoothed(), config.path_variables)
        _dump(writers.mesh_document(plan.bundle, smooth, plan.waypoints), a.output)
        if a.path_geojson:
            _dump(writers.collection(smooth), f"{stem}.geojson")
        for i, r in enumerate(smooth):
            if a.path_kml:
                writers.save_feature(r, f"{writers.file_stem(stem, r)}.kml")
            if a.path_gpx:
                writers.save_feature(r, f"{writers.file_stem(stem, r)}.gpx")
            if a.chart_track:
                writers.save_feature(r, f"{stem}.r{i}.csv")
    return 0


if __name__ == "__main__":
    sys.exit(main())
