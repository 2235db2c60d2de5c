"""Tag inventory: keys, values, counts, postings, search and co-occurrence."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.geom import Box
from ..model import KINDS, Dataset
from ..session import materialize
from .setops import numbered


def _counts() -> list:
    names = ("nodes", "ways", "relations")
    return [F.count_if(F.col("etype") == k).alias(n) for k, n in zip(KINDS, names)]


class Taginfo:
    """Lookups over a dataset's tags; every method returns a lazy DataFrame."""

    def __init__(self, data: Dataset, space=None):
        self.data, self.tags, self._space = data, data.tags, space

    def space(self):
        """The spatial searches that lookups in a box use."""
        from .spatial import Spatial

        return self._space or Spatial(self.data)

    # lookups

    def keys(self) -> DataFrame:
        """All keys of the dictionary, also those that no element carries."""
        return self.data.dictionary.select("key").distinct()

    def key(self, key: str) -> DataFrame:
        return self.keys().where(F.col("key") == key)

    def keys_with_prefix(self, prefix: str) -> DataFrame:
        """Keys that begin with the bytes of prefix; an empty one gives all."""
        return self.keys().where(F.col("key").startswith(prefix))

    def kv(self, key: str, value: str) -> DataFrame:
        """key, value if the dictionary has the pair."""
        d = self.data.dictionary
        return d.where((F.col("key") == key) & (F.col("value") == value)).select("key", "value").distinct()

    def values(self, key: str) -> DataFrame:
        d = self.data.dictionary
        return d.where(F.col("key") == key).select("value").distinct()

    # counts

    @cached_property
    def value_stats(self) -> DataFrame:
        """key, value, nodes, ways, relations, total of every pair of the dictionary."""
        used = self.tags.groupBy("key", "value").agg(*_counts())
        every = self.data.dictionary.select("key", "value").distinct()
        c = every.join(used, ["key", "value"], "left").na.fill(0, ["nodes", "ways", "relations"])
        return c.withColumn("total", F.col("nodes") + F.col("ways") + F.col("relations"))

    def value_index(self) -> DataFrame:
        """key, value, value_index: the place of every pair of the dictionary in order of key and value, from 0."""
        return numbered(self.data.dictionary.select("key", "value").distinct(), ["key", "value"], "value_index")

    @cached_property
    def key_stats(self) -> DataFrame:
        """key, nodes, ways, relations, distinct_values, total of every key; summed over its values."""
        s = self.value_stats.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("nodes", "ways", "relations")), F.count("value").alias("distinct_values"))
        return s.withColumn("total", F.col("nodes") + F.col("ways") + F.col("relations"))

    def values_by_count(self, key: str | None = None, first: int | None = None) -> DataFrame:
        """key, value, total, rank of values, most common first, then by value; of one key or each."""
        v = self.value_stats if key is None else self.value_stats.where(F.col("key") == key)
        w = Window.partitionBy("key").orderBy(F.desc("total"), "value")
        r = v.select("key", "value", "total", F.row_number().over(w).alias("rank"))
        return r if first is None else r.where(F.col("rank") <= first)

    def top_keys(self, n: int) -> DataFrame:
        return self.key_stats.orderBy(F.desc("total"), "key").limit(n)

    # postings

    def postings(self, etype: str, key: str, value: str | None = None) -> DataFrame:
        """Distinct ids of elements of a type with key=value, or with the key."""
        t = self.tags.where((F.col("etype") == etype) & (F.col("key") == key))
        return (t if value is None else t.where(F.col("value") == value)).select("id").distinct()

    def postings_within(self, etype: str, key: str, ids: DataFrame, value: str | None = None) -> DataFrame:
        """Postings among ids, such as those of a box that several lookups share."""
        return self.postings(etype, key, value).join(ids.select("id"), "id", "left_semi")

    def postings_in_bbox(self, etype: str, key: str, box: Box, value: str | None = None) -> DataFrame:
        return self.postings_within(etype, key, self.space().in_bbox(etype, box), value)

    def _inside(self, box: Box) -> DataFrame:
        sp, ids = self.space(), None
        for k in KINDS:
            part = sp.in_bbox(k, box).select(F.lit(k).alias("etype"), "id")
            ids = part if ids is None else ids.unionByName(part)
        return self.tags.join(ids, ["etype", "id"], "left_semi")

    def counts_within(self, box: Box) -> DataFrame:
        """key, nodes, ways, relations of tags on elements in a box; keys without any are left out."""
        return self._inside(box).groupBy("key").agg(*_counts())

    def value_tallies_within(self, box: Box) -> DataFrame:
        """key and the number of distinct values in a box: on any element, and on each type."""
        of = [F.count_distinct(F.when(F.col("etype") == k, F.col("value"))).alias(n) for k, n in zip(KINDS, ("nodes", "ways", "relations"))]
        return self._inside(box).groupBy("key").agg(F.count_distinct("value").alias("any"), *of)

    # co-occurrence

    def _together(self, cols: list[str]) -> DataFrame:
        """Counts of ordered pairs of distinct items of one element; equal sets of items are counted once, with their number."""
        item = F.struct(*cols)
        sets = self.tags.groupBy("etype", "id").agg(F.array_sort(F.collect_set(item)).alias("items"))
        sets = sets.where(F.size("items") > 1).groupBy("items").agg(F.count(F.lit(1)).alias("n"))
        one = sets.select("n", "items", F.explode("items").alias("a"))
        two = one.select("n", "a", F.explode("items").alias("b")).where("a <> b")
        return two.groupBy("a", "b").agg(F.sum("n").alias("together_count"))

    def key_combinations(self) -> DataFrame:
        """key, other_key, together_count over elements of all types."""
        return self._together(["key"]).select(F.col("a.key").alias("key"), F.col("b.key").alias("other_key"), "together_count")

    def tag_combinations(self) -> DataFrame:
        """key, value, other_key, other_value, together_count over elements of all types."""
        p = self._together(["key", "value"])
        return p.select("a.key", "a.value", F.col("b.key").alias("other_key"), F.col("b.value").alias("other_value"), "together_count")

    # text search

    def values_containing(self, pattern: str, key: str | None = None) -> DataFrame:
        """key, value of the dictionary whose value holds pattern, ASCII case aside; of one key or all."""
        d = self.data.dictionary.select("key", "value").distinct()
        d = d if key is None else d.where(F.col("key") == key)
        return d.where(X.ascii_icontains(F.col("value"), pattern))

    def value_trigrams(self) -> DataFrame:
        """gram, key, value: the trigram index. Stored sorted by gram it prunes row groups."""
        d = self.data.dictionary.select("key", "value").distinct()
        return d.select(F.explode(X.trigrams(F.col("value"))).alias("gram"), "key", "value")

    def trigram_search(self, pattern: str, index: DataFrame | None = None, key: str | None = None) -> DataFrame:
        """As values_containing, with candidates from the index; without one, and for patterns below three bytes, values are scanned."""
        grams = X.text_trigrams(pattern)
        if not grams or index is None:
            return Taginfo.values_containing(self, pattern, key)
        i = index.where(F.col("gram").isin(grams))
        i = i if key is None else i.where(F.col("key") == key)
        c = i.groupBy("key", "value").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
        return c.where(X.ascii_icontains(F.col("value"), pattern)).select("key", "value")

    def search_ranked(self, pattern: str, n: int) -> DataFrame:
        """The n most common values that hold pattern: key, value, total."""
        hit = self.values_containing(pattern).join(self.value_stats.select("key", "value", "total"), ["key", "value"])
        return hit.orderBy(F.desc("total"), "key", "value").limit(n)

    # pages

    def key_page(self, key: str, n: int) -> DataFrame:
        """rank, value, total of a key's n most common values, after the key's own total (rank 0, null value)."""
        own = self.value_stats.where(F.col("key") == key).agg(F.sum("total").alias("total"))
        own = own.select(F.lit(0).alias("rank"), F.lit(None).cast("string").alias("value"), "total")
        return own.unionByName(self.values_by_count(key, n).select("rank", "value", "total"))

    def combination_page(self, key: str, n: int, value: str | None = None) -> DataFrame:
        """The n keys (with a value, tags) that most often go with a key (a tag); ties by key and value."""
        if value is None:
            return self.key_combinations().where(F.col("key") == key).orderBy(F.desc("together_count"), "other_key").limit(n)
        c = self.tag_combinations().where((F.col("key") == key) & (F.col("value") == value))
        return c.orderBy(F.desc("together_count"), "other_key", "other_value").limit(n)

    def examples(self, key: str, value: str, n: int) -> DataFrame:
        """etype, id, more: the first n ids of each type with key=value, and how many there are beyond."""
        t = self.tags.where((F.col("key") == key) & (F.col("value") == value)).select("etype", "id").distinct()
        counts = t.groupBy("etype").agg(F.count(F.lit(1)).alias("all"))
        r = t.withColumn("r", F.row_number().over(Window.partitionBy("etype").orderBy("id"))).where(F.col("r") <= n)
        return r.join(F.broadcast(counts), "etype").select("etype", "id", F.greatest(F.col("all") - n, F.lit(0)).alias("more"))

    def labels(self, etype: str, keys: tuple[str, ...] = ("highway", "building", "type", "amenity")) -> DataFrame:
        """id, label of the elements of a type that have tags."""
        t = self.tags.where(F.col("etype") == etype)
        name = {k: F.min(F.when(F.col("key") == k, F.col("value"))) for k in ("name", *keys)}
        return t.groupBy("id").agg(X.label(name, keys).alias("label"))

    def as_maps(self) -> DataFrame:
        """etype, id, tags as a map; of two values of one key the smaller."""
        one = self.tags.groupBy("etype", "id", "key").agg(F.min("value").alias("value"))
        return one.groupBy("etype", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("tags"))


def from_maps(maps: DataFrame) -> DataFrame:
    """etype, id, key, value of elements with a map of tags."""
    return maps.select("etype", "id", F.explode("tags").alias("key", "value"))


def shared_index(info: Taginfo) -> DataFrame:
    """The trigram index, written sorted by gram for several searches."""
    return materialize(info.value_trigrams().repartitionByRange("gram").sortWithinPartitions("gram"), "trigrams")
