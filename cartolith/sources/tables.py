"""Reading the tables and reducing histories to current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_WHEN = ", edited_at timestamp_ntz, loaded_at timestamp_ntz"
#: Columns and types of the tables of a dataset.
SCHEMAS = {
    "nodes": "id bigint, lon double, lat double, visible boolean" + _WHEN,
    "ways": "id bigint, visible boolean" + _WHEN,
    "way_refs": "way_id bigint, pos int, node_id bigint" + _WHEN,
    "relations": "id bigint, min_lon double, min_lat double, max_lon double, max_lat double, visible boolean" + _WHEN,
    "members": "rel_id bigint, pos int, mtype string, ref_id bigint, role string" + _WHEN,
    "ring_vertices": "rel_id bigint, ring_no int, vertex_no int, node_idx bigint, lon double, lat double" + _WHEN,
    "tags": "etype string, id bigint, key string, value string, key_idx bigint, slot bigint" + _WHEN,
    "tag_slots": "slot bigint, key_idx bigint, key string, value string",
    "probe_points": "point_id bigint, lon double, lat double, radius_deg double",
    "zones": "zone_id bigint, ring_no int, vertex_no int, lon double, lat double",
}


_ALIKE = [{"bigint", "int", "smallint", "tinyint"}, {"double", "float"}, {"timestamp_ntz", "timestamp"}, {"string"}, {"boolean"}]


class SchemaError(Exception):
    """A table that lacks a column or has another type in it."""


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a dataset folder, checked against SCHEMAS.

    A table may have more columns, numbers of another width, and times with or
    without a zone; anything else that differs is refused at once, by name,
    instead of deep in a query.
    """
    df = spark.read.parquet(f"{root}/{name}.parquet")
    found = dict(df.dtypes)
    for column in SCHEMAS.get(name, "").split(", "):
        if column:
            want, kind = column.split()
            got = found.get(want)
            if not any({kind, got} <= alike for alike in _ALIKE):
                raise SchemaError(f"{name}.{want} should be {kind}, is {got or 'absent'}")
    return df


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp column, whatever the session's time zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
    sec = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return day + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000 + sec


def current(df: DataFrame, keys: list[str], payload: list[str], loaded: bool = False) -> DataFrame:
    """The current row of each key: greatest edited_at, then smallest loaded_at.

    Copies with equal edited_at differ at most in loaded_at, so the payload is
    taken by edited_at alone; with loaded=True loaded_at comes as well. All
    buffers have fixed width if the payload has: a hash aggregation with
    map-side combine, which no repeated key can skew. A null edited_at is older
    than any other, a null loaded_at later; rows with a null key are dropped.
    """
    df = df.dropna(subset=keys)
    kind = dict(df.dtypes)["edited_at"]
    if loaded:
        far = F.lit(10**18).cast("decimal(19,0)")
        order = F.coalesce(micros(df, "edited_at"), F.lit(-(10**17))).cast("decimal(19,0)") * far
        order = order - F.coalesce(micros(df, "loaded_at"), F.lit(10**17)).cast("decimal(19,0)")
    else:
        order = F.coalesce(F.col("edited_at"), F.lit("0001-01-01 00:00:00").cast(kind))
    cols = [*payload, *(["loaded_at"] if loaded else [])]
    src = df.select(*keys, *cols, order.alias("_ord"))
    return src.groupBy(*keys).agg(*(F.max_by(F.col(c), F.col("_ord")).alias(c) for c in cols))


def located(nodes: DataFrame) -> DataFrame:
    """id, lon, lat of the nodes whose current row is visible and has a possible place."""
    n = current(nodes, ["id"], ["lon", "lat", "visible"])
    ok = F.col("visible") & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    ok = ok & ~((F.col("lon") == 0) & (F.col("lat") == 0))
    return n.where(ok).select("id", "lon", "lat")


def tag_rows(tags: DataFrame) -> DataFrame:
    """etype, id, key_idx, slot of the current tag rows that have a slot.

    Rows with a null slot, id, etype or key_idx are ignored and replace nothing.
    """
    t = tags.dropna(subset=["slot"])
    return current(t, ["etype", "id", "key_idx"], ["slot"])


def member_kind(mtype: Column) -> Column:
    """0 node, 1 way, 2 relation, null anything else; case and outer blanks do not count."""
    m = F.lower(F.trim(mtype))
    return F.when(m == "node", 0).when(m == "way", 1).when(m == "relation", 2)
