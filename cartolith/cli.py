"""Builds derived tables, or tells land from water: python -m cartolith.cli [options] DATASET. Exit code 2 when nothing is asked for."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from .model import Dataset
from .session import build_session
from .sources.store import BuildOptions, build


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cartolith", description="Build derived tables of a map dataset.")
    p.add_argument("dataset")
    p.add_argument("-o", "--output", help="folder to write to; DATASET.ext unless given")
    p.add_argument("--all", action="store_true", help="everything that needs no other input")
    p.add_argument("--classify", nargs=2, type=float, action="append", metavar=("LON", "LAT"), help="print whether a point is on land; builds nothing, may be repeated")
    for f in fields(BuildOptions):
        flag = "--" + f.name.replace("_", "-")
        if f.name == "land_polygons":
            p.add_argument(flag, metavar="SHAPEFILE")
        else:
            p.add_argument(flag, action="store_true")
    return p


def classify(dataset: str, points: list[list[float]]) -> int:
    """Prints longitude, latitude and land or water of each point, by the dataset's coastline."""
    from .operators.rings import shore_segments
    from .operators.shore import classify_points

    spark = build_session()
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "id bigint, lon double, lat double")
    land = dict(map(tuple, classify_points(df, shore_segments(Dataset(spark, dataset.rstrip("/")))).collect()))
    for k, (x, y) in enumerate(points):
        print(x, y, "land" if land[k] else "water")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    chosen = {f.name: getattr(a, f.name) for f in fields(BuildOptions)}
    if a.all:
        chosen |= {k: True for k in chosen if k != "land_polygons"}
    options = BuildOptions(**chosen)
    if a.classify:
        return classify(a.dataset, a.classify)
    if not options.any():
        print("nothing to build; name at least one part", file=sys.stderr)
        return 2
    spark = build_session()
    build(Dataset(spark, a.dataset.rstrip("/")), a.output or a.dataset.rstrip("/") + ".ext", options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
