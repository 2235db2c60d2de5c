import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from cartolith.session import build_session

    return build_session("local[4]", 4, **{"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def data_dir():
    if not DATA.is_dir():
        pytest.skip("no test data")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(data_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(data_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(df):
    """Rows as a sorted list of tuples of reprs, by name of column."""
    cols = sorted(df.columns)
    return sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())


@pytest.fixture(scope="session")
def same_as_sql(spark, data_dir, duck):
    def check(query, sql):
        df = query(spark, data_dir)
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        expected = sorted(tuple(repr(r[i]) for i in order) for r in res.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df) == expected

    return check


T0 = "2023-01-01 00:00:00"


@pytest.fixture(scope="session")
def make_dataset(spark, tmp_path_factory):
    """Writes a small dataset; tables are lists of rows, with defaults for what is not given."""
    schemas = {
        "nodes": "id bigint, lon double, lat double, visible boolean, edited_at timestamp_ntz, loaded_at timestamp_ntz",
        "ways": "id bigint, visible boolean, edited_at timestamp_ntz, loaded_at timestamp_ntz",
        "way_refs": "way_id bigint, pos int, node_id bigint, edited_at timestamp_ntz, loaded_at timestamp_ntz",
        "relations": "id bigint, min_lon double, min_lat double, max_lon double, max_lat double, visible boolean, edited_at timestamp_ntz, loaded_at timestamp_ntz",
        "members": "rel_id bigint, pos int, mtype string, ref_id bigint, role string, edited_at timestamp_ntz, loaded_at timestamp_ntz",
        "ring_vertices": "rel_id bigint, ring_no int, vertex_no int, node_idx bigint, lon double, lat double, edited_at timestamp_ntz, loaded_at timestamp_ntz",
        "tags": "etype string, id bigint, key string, value string, key_idx bigint, slot bigint, edited_at timestamp_ntz, loaded_at timestamp_ntz",
        "tag_slots": "slot bigint, key_idx bigint, key string, value string",
    }

    def make(**tables):
        root = tmp_path_factory.mktemp("data")
        for name, schema in schemas.items():
            rows = tables.get(name, [])
            spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return make


@pytest.fixture(scope="session")
def small_map(make_dataset):
    """A hillside: seven nodes, three ways, three relations, with tags."""
    from datetime import datetime

    t = (datetime(2022, 5, 1), datetime(2022, 5, 3))
    nodes = [
        (10, 11.390, 47.260, {"natural": "peak", "name": "Gipfel"}), (11, 11.401, 47.266, {"amenity": "bench"}),
        (12, 11.404, 47.269, {"amenity": "bench", "backrest": "yes", "name": "Rast"}), (13, 11.409, 47.262, {"highway": "stop"}),
        (14, 11.430, 47.280, {"amenity": "fountain", "name": "Brunn"}), (15, 11.406, 47.271, {"amenity": "bench", "shop": "bakery"}), (16, 11.398, 47.2655, {})]
    ways = [(20, [11, 12, 16], {"highway": "path", "surface": "gravel"}), (21, [10, 14], {"highway": "track", "name": "Weg"}), (22, [12, 15, 13, 12], {"landuse": "meadow", "amenity": "bench"})]
    relations = [
        (30, (11.400, 47.265, 11.405, 47.270), [("node", 11), ("way", 20), ("way", 20)], {"type": "route", "route": "hiking"}),
        (31, (None,) * 4, [("way", 21), ("relation", 30), ("relation", 30)], {"type": "collection", "name": "Alles"}),
        (32, (11.403, 47.268, 11.410, 47.272), [("node", 15), ("Way ", 22), ("relation", 30)], {"type": "site", "amenity": "bench"})]
    carried = [(e, x[0], k, v) for e, xs in (("node", nodes), ("way", ways), ("relation", relations)) for x in xs for k, v in x[-1].items()]
    slots = sorted({(k, v) for *_, k, v in carried} | {("amenity", "unused")})
    numbers = {k: n for n, k in enumerate(sorted({k for k, _ in slots}))}
    return make_dataset(
        nodes=[(i, x, y, True, *t) for i, x, y, _ in nodes], ways=[(i, True, *t) for i, *_ in ways],
        way_refs=[(i, p, n, *t) for i, refs, _ in ways for p, n in enumerate(refs)],
        relations=[(i, *box, True, *t) for i, box, *_ in relations],
        members=[(i, p, kind, ref, "", *t) for i, _, ms, _ in relations for p, (kind, ref) in enumerate(ms)],
        tags=[(e, i, k, v, numbers[k], slots.index((k, v)), *t) for e, i, k, v in carried],
        tag_slots=[(n, numbers[k], k, v) for n, (k, v) in enumerate(slots)])
