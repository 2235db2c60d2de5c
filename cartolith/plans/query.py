"""The combined query: tags, keys and places, all of which must hold."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..functions.geom import Box, Polygon, Radius
from ..model import Dataset
from ..operators.setops import intersect
from ..operators.spatial import Spatial
from ..operators.taginfo import Taginfo


class QueryError(Exception):
    """A query that cannot be answered."""


class Unconstrained(QueryError):
    """No constraint was given."""


class InvalidSpatial(QueryError):
    """A place that is not finite, inverted, negative or has too few vertices."""


class NoTags(QueryError):
    """Tags are asked for but the dataset was opened without them."""


@dataclass(frozen=True)
class Query:
    """Immutable builder; each step gives a new query, which can be run for every element type.

    info and space answer its parts; without them it looks at the dataset's tables.
    """

    data: Dataset
    tags: tuple = ()
    keys: tuple = ()
    places: tuple = ()
    has_tags: bool = True
    info: Taginfo | None = None
    space: Spatial | None = None

    def with_tag(self, key: str, value: str) -> Query:
        return replace(self, tags=(*self.tags, (key, value)))

    def with_key(self, key: str) -> Query:
        return replace(self, keys=(*self.keys, key))

    def in_bbox(self, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Query:
        return replace(self, places=(*self.places, Box(min_lon, min_lat, max_lon, max_lat)))

    def within_radius(self, lon: float, lat: float, radius: float) -> Query:
        return replace(self, places=(*self.places, Radius(lon, lat, radius)))

    def in_polygon(self, vertices: list[tuple[float, float]]) -> Query:
        return replace(self, places=(*self.places, Polygon(vertices)))

    def nodes(self) -> DataFrame:
        return self._run("node")

    def ways(self) -> DataFrame:
        return self._run("way")

    def relations(self) -> DataFrame:
        return self._run("relation")

    def _run(self, etype: str) -> DataFrame:
        """id of the elements of a type that meet every constraint, for orderBy("id").

        Checked in this order: no constraint, any bad place, tags without tags
        in the dataset. An unknown key or tag gives no rows.
        """
        if not (self.tags or self.keys or self.places):
            raise Unconstrained("a query needs at least one constraint")
        for p in self.places:
            if not (p.valid() if isinstance(p, Box) else p.valid):
                raise InvalidSpatial(f"bad {type(p).__name__.lower()}")
        if (self.tags or self.keys) and not self.has_tags:
            raise NoTags("the dataset was opened without tags")
        info, sp = self.info or Taginfo(self.data), self.space or Spatial(self.data)
        sets = [info.postings(etype, k, v) for k, v in self.tags] + [info.postings(etype, k) for k in self.keys]
        sets += [sp.in_bbox(etype, p) if isinstance(p, Box) else sp.touching(etype, p) for p in self.places]
        return intersect(sets)


class Selection:
    """Terms over one element type: tags or keys, and at most one box. Without terms it is empty, box or not."""

    def __init__(self, data: Dataset, etype: str):
        self.data, self.etype, self.terms, self.box = data, etype, [], None

    def and_(self, key: str, value: str | None = None) -> Selection:
        self.terms.append((key, value))
        return self

    def in_bbox(self, box: Box) -> Selection:
        self.box = box
        return self

    def resolve(self) -> DataFrame:
        if not self.terms:
            return self.data.spark.createDataFrame([], "id bigint")
        info = Taginfo(self.data)
        sets = [info.postings(self.etype, k, v) for k, v in self.terms]
        return intersect(sets + ([Spatial(self.data).in_bbox(self.etype, self.box)] if self.box else []))
