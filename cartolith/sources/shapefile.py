"""Polygons of ESRI shapefiles.

Fixed values of the published format: 100 bytes of header, records with a
big-endian number and length in 16-bit words, shape types 5, 15 and 25 for
polygons, outer rings clockwise.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

HEADER, POLYGONS = 100, (5, 15, 25)
SCHEMA = "path string, record int, ring int, outer boolean, xs array<double>, ys array<double>"


def polygons(data: bytes) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """record, ring, whether it is outer, and vertices (n, 2) of each ring of a .shp file; other shapes are passed over."""
    at = HEADER
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        body = at + 8
        at = body + 2 * words
        if words < 2 or struct.unpack_from("<i", data, body)[0] not in POLYGONS:
            continue
        parts, points = struct.unpack_from("<ii", data, body + 36)
        starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
        xy = np.frombuffer(data, "<f8", 2 * points, body + 44 + 4 * parts).reshape(-1, 2)
        for k in range(parts):
            ring = xy[starts[k] : starts[k + 1]]
            nxt = np.roll(ring, -1, axis=0)
            yield number, k, float(np.sum(ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1])) <= 0, ring


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """path, record, ring, outer, xs, ys of the polygons of all .shp files under path, a file a row of work."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, c in zip(f["path"], f["content"]):
                rows = [(p, n, k, o, r[:, 0].tolist(), r[:, 1].tolist()) for n, k, o, r in polygons(bytes(c))]
                yield pd.DataFrame(rows, columns=["path", "record", "ring", "outer", "xs", "ys"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, SCHEMA)
