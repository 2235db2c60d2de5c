"""Land or water of many points against a shore, by rays to the east.

Points and shore meet in strips of latitude. Of a strip, shore that lies wholly
east of a point counts by its latitudes alone: going north adds one from its
lower end up, and takes it back from its upper end up. These steps, in order of
longitude, make a tree of blocks of two, four, eight ... steps, each sorted by
latitude with running sums; what is east of a point is a few whole blocks, in
each of which one lookup gives the sum up to its latitude. Only shore that the
point's longitude cuts is tested by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT, saved, ship

#: Degrees by which rounding of a crossing could pass the ends of its segment; closer ones are tested by themselves.
_EDGE = 1e-9
#: Points a strip may have in one task; a fuller one is dealt to several, its shore sent to each.
STRIP_MOST = 500_000


class Strip:
    """Segments that cross a strip of latitude, prepared for counting."""

    def __init__(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray):
        order = np.argsort(np.minimum(ax, bx), kind="stable")
        ax, ay, bx, by = ax[order], ay[order], bx[order], by[order]
        up = ay < by
        self.way = np.where(up, 1, -1)
        self.x0, self.y0 = np.where(up, ax, bx), np.where(up, ay, by)
        self.x1, self.y1 = np.where(up, bx, ax), np.where(up, by, ay)
        self.west, self.east = np.minimum(ax, bx), np.maximum(ax, bx)
        width = self.east - self.west
        self.reach = 4 * float(np.median(width)) + _EDGE
        self.short, self.long = np.flatnonzero(width <= self.reach), np.flatnonzero(width > self.reach)
        self._steps()

    def _steps(self) -> None:
        """For each size of blocks the steps' places in (block, latitude), and the sums before each."""
        n = 2 * len(self.way)
        size = 1 << max(0, n - 1).bit_length()
        self.lats = np.unique(np.concatenate([self.y0, self.y1]))
        self.rows = len(self.lats) + 1
        place, step = np.full(size, self.rows - 1), np.zeros(size, np.int64)
        place[0:n:2], place[1:n:2] = np.searchsorted(self.lats, self.y0), np.searchsorted(self.lats, self.y1)
        step[0:n:2], step[1:n:2] = self.way, -self.way
        self.levels = []
        for level in range(size.bit_length()):
            keys = (np.arange(size) >> level) * self.rows + place
            by = np.argsort(keys, kind="stable")
            self.levels.append((keys[by], np.concatenate([[0], np.cumsum(step[by])])))
        self.size = size

    def _wholly_east(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        at = 2 * np.searchsorted(self.west, lon + _EDGE, "right")
        rank = np.searchsorted(self.lats, lat, "right")
        out = np.zeros(len(lon), np.int64)
        everything = at == 0
        for level, (keys, sums) in enumerate(self.levels):
            block = at >> level
            take = (block & 1 == 1) & (at < self.size) if level + 1 < len(self.levels) else everything
            if take.any():
                b = block[take]
                out[take] += sums[np.searchsorted(keys, b * self.rows + rank[take], "left")] - sums[b << level]
                at[take] += 1 << level
        return out

    def _cut(self, k: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Whether segments k cross the rays of as many points, and which way; those wholly east are left out."""
        level = (self.y0[k] <= lat) & (lat < self.y1[k]) & (self.west[k] <= lon + _EDGE)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = self.x0[k] + (lat - self.y0[k]) / (self.y1[k] - self.y0[k]) * (self.x1[k] - self.x0[k])
        return np.where(level & (at > lon), self.way[k], 0)

    def count(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Crossings going north less those going south, of each point."""
        out = self._wholly_east(lon, lat)
        for k in self.long:
            out += self._cut(np.full(len(lon), k), lon, lat)
        west = self.west[self.short]
        first, last = np.searchsorted(west, lon - self.reach - 2 * _EDGE), np.searchsorted(west, lon + _EDGE, "right")
        # a few points at a time, so that what they are tested against stays small
        ends = np.cumsum(last - first)
        for a, b in _slices(ends, 1_000_000):
            n = last[a:b] - first[a:b]
            p = np.repeat(np.arange(a, b), n)
            k = self.short[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)]
            out += np.bincount(p, self._cut(k, lon[p], lat[p]), len(out)).astype(np.int64)
        return out


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of positions whose sizes, given by their running sum, come to about `most`."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by band and part, shore before points: id and is_land of the points."""
    names = ("band", "part", "kind", "id", "ax", "ay", "bx", "by")
    here, shore, strip = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        new = np.flatnonzero((c["band"][1:] != c["band"][:-1]) | (c["part"][1:] != c["part"][:-1]) | (c["kind"][1:] != c["kind"][:-1])) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            at = (c["band"][a], c["part"][a])
            if at != here:
                here, shore, strip = at, [], None
            run = [c[n][a:b] for n in ("ax", "ay", "bx", "by")]
            if c["kind"][a] == 0:
                shore.append(run)
                continue
            if strip is None and shore:
                strip = Strip(*(np.concatenate(x) for x in zip(*shore)))
            land = strip.count(run[0], run[1]) > 0 if strip else np.zeros(b - a, bool)
            yield pa.RecordBatch.from_arrays([pa.array(c["id"][a:b], pa.int64()), pa.array(land)], ["id", "is_land"])


def classify_points(points: DataFrame, segments: DataFrame, band: float = 0.01) -> DataFrame:
    """id, is_land of each point (id, lon, lat in degrees): whether more shore crosses its ray to the east going north than south.

    Without crossings it is water, as is a point with a null or NaN place; every
    row is judged by itself. A segment (ax, ay, bx, by) is in every strip of
    `band` degrees that it spans. Strips with more points than STRIP_MOST are
    counted first and dealt to parts.
    """
    ship(points.sparkSession)
    ok = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
    none = F.lit(0.0)
    p = points.where(ok).select(F.floor(F.col("lat") / band).alias("band"), "id", F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    full, n = saved(p.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / STRIP_MOST).alias("parts")).where("parts > 1"), "full-strips")
    full = F.broadcast(full) if n["n"] * 40 <= BROADCAST_LIMIT else full
    zero = F.lit(0).cast("bigint")
    p = p.join(full, "band", "left").select("band", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), zero).alias("part"), F.lit(1).alias("kind"), "id", "ax", "ay", none.alias("bx"), none.alias("by"))
    s = segments.where("ay <> by").select("ax", "ay", "bx", "by", F.explode(F.sequence(F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band))).alias("band"))
    part = F.explode(F.sequence(zero, F.coalesce("parts", F.lit(1).cast("bigint")) - 1)).alias("part")
    s = s.join(full, "band", "left").select("band", part, F.lit(0).alias("kind"), zero.alias("id"), "ax", "ay", "bx", "by")
    rows = s.unionByName(p).repartition("band", "part").sortWithinPartitions("band", "part", "kind")
    return rows.mapInArrow(_classify, "id bigint, is_land boolean").unionByName(points.where(~ok).select("id", F.lit(False).alias("is_land")))
