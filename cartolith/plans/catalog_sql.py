"""SQL with the rows of the queries of catalog.py, written for an independent engine."""

from __future__ import annotations

import math

from ..functions.geom import units
from ..model import SCALE
from . import rings_sql as RS
from .catalog import BEYOND, BOX, CENTER, KEY, KEY2, NEAREST, PREFIX, RADIUS, SHORE, TRIANGLE, VALUE
from .problems_sql import LOCATED, TAG_ROWS, current

_CTE = {
    "located": LOCATED,
    "n": f"n AS (SELECT id, cast(trunc(lon * {SCALE}.0::DOUBLE) AS BIGINT) AS lon, cast(trunc(lat * {SCALE}.0::DOUBLE) AS BIGINT) AS lat FROM located)",
    "w": f"w AS (SELECT id FROM {current('ways', 'id', 'id IS NOT NULL')} WHERE visible)",
    "r": f"r AS (SELECT id, " + ", ".join(f"cast(trunc({c} * {SCALE}.0::DOUBLE) AS BIGINT) AS {c}" for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
         + f" FROM {current('relations', 'id', 'id IS NOT NULL')} WHERE visible)",
    "wr": f"wr AS (SELECT way_id, pos, node_id FROM {current('way_refs', 'way_id, pos', 'way_id IS NOT NULL AND pos IS NOT NULL')} WHERE way_id IN (SELECT id FROM w))",
    "m": f"m AS (SELECT rel_id, pos, lower(trim(mtype)) AS kind, ref_id, role FROM {current('members', 'rel_id, pos', 'rel_id IS NOT NULL AND pos IS NOT NULL')} WHERE rel_id IN (SELECT id FROM r))",
    "tr": TAG_ROWS,
    "d": "d AS (SELECT slot, key, value FROM tag_slots WHERE slot IS NOT NULL AND key IS NOT NULL AND value IS NOT NULL)",
    "t": "t AS (SELECT tr.etype, tr.id, d.key, d.value FROM tr JOIN d ON tr.slot = d.slot)",
    "v": "v AS (SELECT way_id, pos, lon, lat FROM wr JOIN n ON wr.node_id = n.id)",
    "seg": """seg AS (SELECT way_id, ax, ay, coalesce(bx, ax) AS bx, coalesce(by_, ay) AS by_ FROM (SELECT way_id, lon::HUGEINT AS ax, lat::HUGEINT AS ay,
  lead(lon) OVER q::HUGEINT AS bx, lead(lat) OVER q::HUGEINT AS by_, lag(pos) OVER q IS NULL AS first FROM v WINDOW q AS (PARTITION BY way_id ORDER BY pos)) WHERE bx IS NOT NULL OR first)""",
    "wb": "wb AS (SELECT way_id AS id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM v GROUP BY way_id)",
    "vs": """vs AS (SELECT p.key, p.value, count(*) FILTER (WHERE etype = 'node') AS nodes, count(*) FILTER (WHERE etype = 'way') AS ways,
  count(*) FILTER (WHERE etype = 'relation') AS relations, count(t.id) AS total FROM (SELECT DISTINCT key, value FROM d) p LEFT JOIN t ON p.key = t.key AND p.value = t.value GROUP BY ALL)""",
}
_NEEDS = {"n": ["located"], "wr": ["w"], "m": ["r"], "t": ["tr", "d"], "v": ["wr", "n"], "seg": ["v"], "wb": ["v"], "vs": ["t"]}


def _with(*names: str, more: str = "", recursive: bool = False) -> str:
    order: list[str] = []

    def add(x: str) -> None:
        for y in _NEEDS.get(x, []):
            add(y)
        if x not in order:
            order.append(x)

    for x in names:
        add(x)
    parts = [_CTE[x] for x in order] + ([more] if more else [])
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n"


def _in_box(box, lon: str = "lon", lat: str = "lat") -> str:
    x0, y0, x1, y1 = box
    return f"({lon} / {SCALE}.0::DOUBLE BETWEEN {x0}::DOUBLE AND {x1}::DOUBLE AND {lat} / {SCALE}.0::DOUBLE BETWEEN {y0}::DOUBLE AND {y1}::DOUBLE)"


def _over_box(box) -> str:
    x0, y0, x1, y1 = box
    u = f"{SCALE}.0::DOUBLE"
    return f"(max_lon / {u} >= {x0}::DOUBLE AND min_lon / {u} <= {x1}::DOUBLE AND max_lat / {u} >= {y0}::DOUBLE AND min_lat / {u} <= {y1}::DOUBLE)"


_AROUND = (CENTER[0] - RADIUS, CENTER[1] - RADIUS, CENTER[0] + RADIUS, CENTER[1] + RADIUS)
_CX, _CY = (f"({units(c)}::HUGEINT)" for c in CENTER)
_R2 = f"({math.ceil(RADIUS * SCALE) ** 2}::HUGEINT)"
_XS, _YS = zip(*TRIANGLE)
_TBOX = (min(_XS), min(_YS), max(_XS), max(_YS))


def _d2(x: str, y: str) -> str:
    return f"(({_CX} - {x}) * ({_CX} - {x}) + ({_CY} - {y}) * ({_CY} - {y}))"


_LEN = "((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))"
_DOT = f"(({_CX} - ax) * (bx - ax) + ({_CY} - ay) * (by_ - ay))"
_CROSS = f"(({_CX} - ax) * (by_ - ay) - ({_CY} - ay) * (bx - ax))"
_SEG_D2 = f"CASE WHEN {_LEN} = 0 OR {_DOT} <= 0 THEN {_d2('ax', 'ay')}::DOUBLE WHEN {_DOT} >= {_LEN} THEN {_d2('bx', 'by_')}::DOUBLE ELSE {_CROSS}::DOUBLE * {_CROSS}::DOUBLE / {_LEN}::DOUBLE END"
_NEARBY = f"greatest(ax, bx) >= {units(_AROUND[0]) - 10} AND least(ax, bx) <= {units(_AROUND[2]) + 10} AND greatest(ay, by_) >= {units(_AROUND[1]) - 10} AND least(ay, by_) <= {units(_AROUND[3]) + 10}"
# squares of crosses near the disc stay far below 2**127
_SEG_IN = f"({_NEARBY} AND CASE WHEN {_LEN} = 0 OR {_DOT} <= 0 THEN {_d2('ax', 'ay')} <= {_R2} WHEN {_DOT} >= {_LEN} THEN {_d2('bx', 'by_')} <= {_R2} ELSE {_CROSS} * {_CROSS} <= {_R2} * {_LEN} END)"

_V = [(units(x), units(y)) for x, y in TRIANGLE]
_E = list(zip([_V[-1], *_V[:-1]], _V))


def _orient(a, b, c) -> str:
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    return f"sign((({bx})::HUGEINT - ({ax})) * (({cy})::HUGEINT - ({ay})) - (({by})::HUGEINT - ({ay})) * (({cx})::HUGEINT - ({ax})))"


def _on(p, a, b) -> str:
    (px, py), (ax, ay), (bx, by) = p, a, b
    return f"({_orient(a, p, b)} = 0 AND {px} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) AND {py} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))"


def _inside(x: str, y: str) -> str:
    border = " OR ".join(_on((x, y), a, b) for a, b in _E)
    odd = " + ".join(
        f"CASE WHEN ({c[1]}::DOUBLE > {y}::DOUBLE) <> ({p[1]}::DOUBLE > {y}::DOUBLE) AND {x}::DOUBLE < ({p[0]}::DOUBLE - {c[0]}::DOUBLE) * ({y}::DOUBLE - {c[1]}::DOUBLE) / nullif({p[1]}::DOUBLE - {c[1]}::DOUBLE, 0) + {c[0]}::DOUBLE THEN 1 ELSE 0 END"
        for p, c in _E)
    return f"({border} OR ({odd}) % 2 = 1)"


def _meets() -> str:
    a, b, out = ("ax", "ay"), ("bx", "by_"), []
    for c, d in _E:
        s1, s2, s3, s4 = _orient(c, d, a), _orient(c, d, b), _orient(a, b, c), _orient(a, b, d)
        out.append(f"({s1} * {s2} < 0 AND {s3} * {s4} < 0) OR {_on(a, c, d)} OR {_on(b, c, d)} OR {_on(c, a, b)} OR {_on(d, a, b)}")
    return " OR ".join(out)


_SEG_IN_T = (f"(greatest(ax, bx) >= {min(x for x, _ in _V)} AND least(ax, bx) <= {max(x for x, _ in _V)} AND greatest(ay, by_) >= {min(y for _, y in _V)} AND least(ay, by_) <= {max(y for _, y in _V)} "
             f"AND ({_inside('ax', 'ay')} OR {_inside('bx', 'by_')} OR {_meets()}))")

_REL_LINKS = "rl AS (SELECT DISTINCT rel_id, ref_id FROM m WHERE kind = 'relation' AND ref_id IN (SELECT id FROM r))"
_CLOSE = f"{_REL_LINKS}, cl AS (SELECT id AS root, id AS rel FROM r UNION SELECT c.root, l.ref_id FROM cl c JOIN rl l ON c.rel = l.rel_id)"
_PARTS = _CLOSE + ", parts AS (SELECT DISTINCT c.root, m.kind, m.ref_id FROM cl c JOIN m ON c.rel = m.rel_id WHERE m.kind IN ('node', 'way') AND m.ref_id IS NOT NULL)"


def _rels(box, node: str, seg: str) -> str:
    return _with("n", "m", "seg", recursive=True, more=_PARTS) + f"""SELECT id FROM r WHERE {_over_box(box)} AND id IN (
  SELECT root FROM parts JOIN n ON parts.kind = 'node' AND parts.ref_id = n.id WHERE {node}
  UNION SELECT root FROM parts JOIN (SELECT DISTINCT way_id FROM seg WHERE {seg}) s ON parts.kind = 'way' AND parts.ref_id = s.way_id)"""


def _ways(box, seg: str) -> str:
    return _with("seg", "wb") + f"SELECT DISTINCT way_id AS id FROM seg WHERE {seg} AND way_id IN (SELECT id FROM wb WHERE {_over_box(box)})"


_DISTANCE = "round(sqrt(min(d)))::BIGINT AS distance"


def _ways_by_distance() -> str:
    return _with("seg", "wb") + f"""SELECT id, {_DISTANCE} FROM (SELECT way_id AS id, {_SEG_D2} AS d FROM seg WHERE {_SEG_IN} AND way_id IN (SELECT id FROM wb WHERE {_over_box(_AROUND)})) GROUP BY id"""


def _rels_by_distance() -> str:
    node, seg = f"{_d2('lon', 'lat')} <= {_R2}", _SEG_IN
    return _with("n", "m", "seg", recursive=True, more=_PARTS) + f"""SELECT root AS id, {_DISTANCE} FROM (
  SELECT root, {_d2('lon', 'lat')}::DOUBLE AS d FROM parts JOIN n ON parts.kind = 'node' AND parts.ref_id = n.id WHERE {node}
  UNION ALL SELECT root, d FROM parts JOIN (SELECT way_id, min({_SEG_D2}) AS d FROM seg WHERE {seg} GROUP BY way_id) s ON parts.kind = 'way' AND parts.ref_id = s.way_id)
  WHERE root IN (SELECT id FROM r WHERE {_over_box(_AROUND)}) GROUP BY root"""


def _fold(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_ALL_IN = f"""inbox AS (SELECT 'node' AS etype, id FROM n WHERE {_in_box(BOX)} UNION ALL SELECT 'way', id FROM wb WHERE {_over_box(BOX)}
  UNION ALL SELECT 'relation', id FROM r WHERE {_over_box(BOX)})"""
_BYTYPE = "count(*) FILTER (WHERE etype = 'node') AS nodes, count(*) FILTER (WHERE etype = 'way') AS ways, count(*) FILTER (WHERE etype = 'relation') AS relations"


def _combos(cols: list[str]) -> str:
    a, b = ", ".join(f"a.{c}" for c in cols), ", ".join(f"b.{c} AS other_{c}" for c in cols)
    differ = " OR ".join(f"a.{c} <> b.{c}" for c in cols)
    return _with("t", more=f"i AS (SELECT DISTINCT etype, id, {', '.join(cols)} FROM t)") + f"SELECT {a}, {b}, count(*) AS together_count FROM i a JOIN i b ON a.etype = b.etype AND a.id = b.id WHERE {differ} GROUP BY ALL"


def _parents(kind: str, tab: str) -> str:
    return _with(*{"m", tab}) + f"SELECT DISTINCT ref_id AS child, rel_id AS parent FROM m WHERE kind = '{kind}' AND ref_id IN (SELECT id FROM {tab})"


_TRI = _with("d", more=f"b AS (SELECT DISTINCT key, value, hex(encode({_fold('value')})) AS h FROM d)") + """
SELECT DISTINCT ('0x' || substr(h, 2 * i + 1, 6))::INTEGER AS gram, key, value FROM (SELECT key, value, h, unnest(range(0, length(h) // 2 - 2)) AS i FROM b)"""
_SHORE = f"""sh AS (SELECT way_id, ax / {SCALE}.0::DOUBLE AS ax, ay / {SCALE}.0::DOUBLE AS ay, bx / {SCALE}.0::DOUBLE AS bx, by_ / {SCALE}.0::DOUBLE AS by_ FROM seg
  WHERE way_id IN (SELECT id FROM t WHERE etype = 'way' AND key = '{SHORE[0]}' AND value = '{SHORE[1]}')),
cr AS (SELECT p.id, CASE WHEN s.ay < s.by_ THEN 1 ELSE -1 END AS direction, s.ax + (p.lat - s.ay) / (s.by_ - s.ay) * (s.bx - s.ax) AS crossing_lon FROM (SELECT id, lon / {SCALE}.0::DOUBLE AS lon, lat / {SCALE}.0::DOUBLE AS lat FROM n) p JOIN sh s
  ON p.lat >= least(s.ay, s.by_) AND p.lat < greatest(s.ay, s.by_)
  WHERE s.ay <> s.by_ AND (CASE WHEN s.ay < s.by_ THEN s.ax + (p.lat - s.ay) / (s.by_ - s.ay) * (s.bx - s.ax) ELSE s.bx + (p.lat - s.by_) / (s.ay - s.by_) * (s.ax - s.bx) END) > p.lon)"""



def _none_bad(*checks: str) -> str:
    """Checks of right tables find nothing; tests/test_verify.py plants a violation for each."""
    return f"SELECT unnest({list(checks)}) AS \"check\", 0::BIGINT AS bad"


SQL = {
    "keys": _with("d") + "SELECT DISTINCT key FROM d",
    "key_lookup": _with("d") + f"SELECT DISTINCT key FROM d WHERE key = '{KEY}'",
    "keys_with_prefix": _with("d") + f"SELECT DISTINCT key FROM d WHERE starts_with(key, '{PREFIX}')",
    "kv_lookup": _with("d") + f"SELECT DISTINCT key, value FROM d WHERE key = '{KEY}' AND value = '{VALUE}'",
    "values_of_key": _with("d") + f"SELECT DISTINCT value FROM d WHERE key = '{KEY}'",
    "key_stats": _with("vs") + "SELECT key, sum(nodes)::BIGINT AS nodes, sum(ways)::BIGINT AS ways, sum(relations)::BIGINT AS relations, count(*) AS distinct_values, sum(total)::BIGINT AS total FROM vs GROUP BY key",
    "value_stats": _with("vs") + "SELECT key, value, nodes, ways, relations, total FROM vs",
    "value_index": _with("d") + "SELECT key, value, row_number() OVER (ORDER BY key, value) - 1 AS value_index FROM (SELECT DISTINCT key, value FROM d)",
    "values_by_count": _with("vs") + "SELECT key, value, total, row_number() OVER (PARTITION BY key ORDER BY total DESC, value) AS rank FROM vs",
    "values_by_count_of_key": _with("vs") + f"SELECT key, value, total, row_number() OVER (PARTITION BY key ORDER BY total DESC, value) AS rank FROM vs WHERE key = '{KEY}' QUALIFY rank <= 10",
    "top_keys": _with("vs") + "SELECT key, sum(nodes)::BIGINT AS nodes, sum(ways)::BIGINT AS ways, sum(relations)::BIGINT AS relations, count(*) AS distinct_values, sum(total)::BIGINT AS total FROM vs GROUP BY key ORDER BY total DESC, key LIMIT 15",
    "kv_postings": _with("t") + f"SELECT DISTINCT etype, id FROM t WHERE key = '{KEY}' AND value = '{VALUE}'",
    "key_any_postings": _with("t") + f"SELECT DISTINCT etype, id FROM t WHERE key = '{KEY}'",
    "kv_in_bbox": _with("t", "n", "wb", "r", more=_ALL_IN) + f"SELECT DISTINCT etype, id FROM t SEMI JOIN inbox USING (etype, id) WHERE key = '{KEY}' AND value = '{VALUE}'",
    "key_in_bbox": _with("t", "n", "wb", "r", more=_ALL_IN) + f"SELECT DISTINCT etype, id FROM t SEMI JOIN inbox USING (etype, id) WHERE key = '{KEY}'",
    "counts_within": _with("t", "n", "wb", "r", more=_ALL_IN) + f"SELECT key, {_BYTYPE} FROM t SEMI JOIN inbox USING (etype, id) GROUP BY key",
    "value_tallies_within": _with("t", "n", "wb", "r", more=_ALL_IN) + """SELECT key, count(DISTINCT value) AS "any", count(DISTINCT value) FILTER (WHERE etype = 'node') AS nodes,
  count(DISTINCT value) FILTER (WHERE etype = 'way') AS ways, count(DISTINCT value) FILTER (WHERE etype = 'relation') AS relations FROM t SEMI JOIN inbox USING (etype, id) GROUP BY key""",
    "key_combos": _combos(["key"]),
    "tag_combos": _combos(["key", "value"]),
    "kv_examples": _with("t") + f"""SELECT etype, id, greatest(c - 5, 0) AS more FROM (SELECT etype, id, row_number() OVER (PARTITION BY etype ORDER BY id) AS k, count(*) OVER (PARTITION BY etype) AS c
  FROM (SELECT DISTINCT etype, id FROM t WHERE key = '{KEY}' AND value = '{VALUE}')) WHERE k <= 5""",
    "key_page": _with("vs") + f"""SELECT 0 AS rank, NULL::VARCHAR AS value, sum(total)::BIGINT AS total FROM vs WHERE key = '{KEY}'
  UNION ALL SELECT rank, value, total FROM (SELECT value, total, row_number() OVER (ORDER BY total DESC, value)::INTEGER AS rank FROM vs WHERE key = '{KEY}') WHERE rank <= 5""",
    "key_combo_page": "SELECT * FROM (" + _combos(["key"]) + f") WHERE key = '{KEY}' ORDER BY together_count DESC, other_key LIMIT 8",
    "tag_combo_page": "SELECT * FROM (" + _combos(["key", "value"]) + f") WHERE key = '{KEY}' AND value = '{VALUE}' ORDER BY together_count DESC, other_key, other_value LIMIT 8",
    "way_labels": _with("t") + """SELECT id, coalesce(min(value) FILTER (WHERE key = 'name'), 'highway=' || min(value) FILTER (WHERE key = 'highway'), 'building=' || min(value) FILTER (WHERE key = 'building'),
  'type=' || min(value) FILTER (WHERE key = 'type'), 'amenity=' || min(value) FILTER (WHERE key = 'amenity'), '(no descriptive tags)') AS label FROM t WHERE etype = 'way' GROUP BY id""",
    "substring_all": _with("d") + f"SELECT DISTINCT key, value FROM d WHERE contains({_fold('value')}, 'place')",
    "substring_in_key": _with("d") + f"SELECT DISTINCT key, value FROM d WHERE key = 'name' AND contains({_fold('value')}, 'hof')",
    "substring_non_ascii": _with("d") + f"SELECT DISTINCT key, value FROM d WHERE contains({_fold('value')}, 'Ñe')",
    "value_trigrams": _TRI,
    "trigram_search": _with("d") + f"SELECT DISTINCT key, value FROM d WHERE contains({_fold('value')}, 'place')",
    "search_ranked": _with("vs") + f"SELECT key, value, total FROM vs WHERE contains({_fold('value')}, 'place') ORDER BY total DESC, key, value LIMIT 20",
    "postings_intersect": _with("t") + f"SELECT id FROM t WHERE etype = 'way' AND key = '{KEY}' INTERSECT SELECT id FROM t WHERE etype = 'way' AND key = '{KEY2}'",
    "postings_union": _with("t") + f"SELECT DISTINCT id FROM t WHERE etype = 'way' AND key IN ('{KEY}', '{KEY2}')",
    "id_ranges": _with("w") + "SELECT min(id) AS start, max(id) + 1 AS stop FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM w) GROUP BY g",
    "ids_within_ranges": _with("t", "wb") + f"SELECT DISTINCT id FROM t WHERE etype = 'way' AND key = '{KEY}' AND id IN (SELECT id FROM wb WHERE {_over_box(BOX)})",
    "selection": _with("t", "wb") + f"""SELECT DISTINCT id FROM t WHERE etype = 'way' AND key = '{KEY}' AND value = '{VALUE}' AND id IN (SELECT id FROM t WHERE etype = 'way' AND key = '{KEY2}')
  AND id IN (SELECT id FROM wb WHERE {_over_box(BOX)})""",
    "ways_using_node": _with("wr", "n") + "SELECT DISTINCT node_id AS child, way_id AS parent FROM wr WHERE node_id IN (SELECT id FROM n)",
    "rels_with_node": _parents("node", "n"),
    "rels_with_way": _parents("way", "w"),
    "rels_with_relation": _parents("relation", "r"),
    "backrefs_page": _with("wr", "n", "m", "t", more="x AS (SELECT min(node_id) AS node FROM wr WHERE node_id IN (SELECT id FROM n))") + """SELECT what, p.id, coalesce(min(value) FILTER (WHERE key = 'name'),
  'highway=' || min(value) FILTER (WHERE key = 'highway'), 'building=' || min(value) FILTER (WHERE key = 'building'), 'type=' || min(value) FILTER (WHERE key = 'type'),
  'amenity=' || min(value) FILTER (WHERE key = 'amenity'), '(no descriptive tags)') AS label, greatest(max(c) - 3, 0)::INTEGER AS more
FROM (SELECT *, row_number() OVER (PARTITION BY what ORDER BY id) AS k, count(*) OVER (PARTITION BY what) AS c FROM (
  SELECT DISTINCT 'way' AS what, way_id AS id FROM wr, x WHERE node_id = x.node UNION SELECT 'relation', rel_id FROM m, x WHERE kind = 'node' AND ref_id = x.node)) p
LEFT JOIN t ON t.etype = p.what AND t.id = p.id WHERE k <= 3 GROUP BY what, p.id""",
    "nodes_bbox": _with("n") + f"SELECT id FROM n WHERE {_in_box(BOX)}",
    "nodes_bbox_beyond": _with("n") + f"SELECT id FROM n WHERE {_in_box((*BEYOND[:2], 180.0, 90.0))}",
    "rels_bbox_beyond": _with("r") + f"SELECT id FROM r WHERE {_over_box((*BEYOND[:2], 180.0, 90.0))}",
    "ways_bbox": _with("wb") + f"SELECT id FROM wb WHERE {_over_box(BOX)}",
    "rels_bbox": _with("r") + f"SELECT id FROM r WHERE {_over_box(BOX)}",
    "nodes_radius": _with("n") + f"SELECT id, {_d2('lon', 'lat')}::DOUBLE AS d2 FROM n WHERE {_in_box(_AROUND)} AND {_d2('lon', 'lat')} <= {_R2}",
    "ways_radius": _ways_by_distance(),
    "rels_radius": _rels_by_distance(),
    "nodes_knn": _with("n") + f"SELECT id, {_d2('lon', 'lat')}::DOUBLE AS d2 FROM n ORDER BY {_d2('lon', 'lat')}, id LIMIT {NEAREST}",
    "ways_knn": _with("seg") + f"SELECT way_id AS id, {_DISTANCE} FROM (SELECT way_id, {_SEG_D2} AS d FROM seg) GROUP BY way_id ORDER BY min(d), way_id LIMIT {NEAREST}",
    "rels_knn": _with("n", "m", "seg", recursive=True, more=_PARTS) + f"""SELECT root AS id, {_DISTANCE} FROM (
  SELECT root, {_d2('lon', 'lat')}::DOUBLE AS d FROM parts JOIN n ON parts.kind = 'node' AND parts.ref_id = n.id
  UNION ALL SELECT root, d FROM parts JOIN (SELECT way_id, min({_SEG_D2}) AS d FROM seg GROUP BY way_id) s ON parts.kind = 'way' AND parts.ref_id = s.way_id)
  WHERE root IN (SELECT id FROM r WHERE min_lon IS NOT NULL) GROUP BY root ORDER BY min(d), root LIMIT {NEAREST}""",
    "nodes_polygon": _with("n") + f"SELECT id FROM n WHERE {_in_box(_TBOX)} AND {_inside('lon', 'lat')}",
    "ways_polygon": _ways(_TBOX, _SEG_IN_T),
    "rels_polygon": _rels(_TBOX, _inside("lon", "lat"), _SEG_IN_T),
    "relation_closure": _with("m", recursive=True, more=_CLOSE) + "SELECT root AS rel_id, rel AS reach FROM cl",
    "query_tag_key_radius": _ways(_AROUND, _SEG_IN).replace("WITH ", "WITH " + TAG_ROWS + ", " + _CTE["d"] + ", " + _CTE["t"] + ", ", 1)
        + f" AND way_id IN (SELECT id FROM t WHERE etype = 'way' AND key = '{KEY}' AND value = '{VALUE}') AND way_id IN (SELECT id FROM t WHERE etype = 'way' AND key = '{KEY2}')",
    "query_tag_polygon": _with("n", "t") + f"SELECT id FROM n WHERE {_in_box(_TBOX)} AND {_inside('lon', 'lat')} AND id IN (SELECT id FROM t WHERE etype = 'node' AND key = '{KEY2}')",
    "query_multi_bbox": _with("r", "t") + f"SELECT id FROM r WHERE {_over_box(BOX)} AND {_over_box((-36.35, 10.7, -36.2, 10.9))} AND id IN (SELECT id FROM t WHERE etype = 'relation' AND key = 'type')",
    "land_water_points": _with("n", "seg", "t", more=_SHORE) + "SELECT n.id, coalesce(sum(cr.direction), 0) > 0 AS is_land FROM n LEFT JOIN cr ON n.id = cr.id GROUP BY n.id",
    "shore_ray_crossings": _with("n", "seg", "t", more=_SHORE) + "SELECT id, round(crossing_lon, 7) AS crossing_lon, direction FROM cr",
    "ring_signed_area": f"""WITH v AS (SELECT rel_id, ring_no, vertex_no, lon, lat FROM {current('ring_vertices', 'rel_id, ring_no, vertex_no', 'rel_id IS NOT NULL AND ring_no IS NOT NULL AND vertex_no IS NOT NULL')}
  WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)),
a AS (SELECT *, avg(lat) OVER (PARTITION BY rel_id, ring_no) AS mid, count(*) OVER (PARTITION BY rel_id, ring_no) AS c,
  first_value(lon) OVER q AS lon0, first_value(lat) OVER q AS lat0 FROM v WINDOW q AS (PARTITION BY rel_id, ring_no ORDER BY vertex_no)),
x AS (SELECT rel_id, ring_no, c, row_number() OVER q AS k, radians(lon - lon0) * cos(radians(mid)) * 6378137.0::DOUBLE AS x, radians(lat - lat0) * 6378137.0::DOUBLE AS y FROM a WINDOW q AS (PARTITION BY rel_id, ring_no ORDER BY vertex_no))
SELECT p.rel_id, p.ring_no, p.c::INTEGER AS vertices, round(CASE WHEN p.c < 3 THEN 0.0::DOUBLE ELSE sum(p.x * q.y - q.x * p.y) / 2 END, 1) + 0.0::DOUBLE AS area_m2
FROM x p JOIN x q ON p.rel_id = q.rel_id AND p.ring_no = q.ring_no AND q.k = p.k % p.c + 1 GROUP BY p.rel_id, p.ring_no, p.c""",
    "mercator_to_wgs84": _with("n") + "SELECT id, round(degrees(lon / 100.0::DOUBLE / 6378137.0::DOUBLE), 6) AS lon, round(degrees(2 * atan(exp(lat / 100.0::DOUBLE / 6378137.0::DOUBLE)) - pi() / 2), 6) AS lat FROM n",
    "fingerprint": _with("n", "w", "r", "d") + """SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM w) AS ways, (SELECT count(*) FROM r) AS relations,
  (SELECT count(*) FROM (SELECT DISTINCT key, value FROM d)) AS tags, (SELECT sum(strlen(s))::BIGINT FROM (SELECT key AS s FROM d UNION SELECT value FROM d)) AS strings""",
    "verify_taginfo": _none_bad("totals equal tag rows", "keys sum their values", "ranks ordered", "combinations symmetric", "combinations fit", "tag combinations symmetric", "tag combinations fit"),
    "verify_search": _none_bad("grams occur", "values indexed"),
    "verify_rings": _none_bad("vertices numbered", "rings closed", "vertices at their nodes", "polygons begin with their outer ring"),
    "verify_backrefs": _none_bad(*(f"{kind}{check}" for kind in ("", "node members: ", "way members: ", "relation members: ") for check in ("pairs from references", "references have pairs", "pairs distinct"))),
}
SQL |= {
    "stored_query": SQL["query_tag_key_radius"], "stored_substring": SQL["substring_all"], "stored_ways_radius": SQL["ways_radius"],
    "stored_rels_radius": SQL["rels_radius"], "stored_ways_bbox": SQL["ways_bbox"]}
SQL |= {
    "multipolygon_rings": _with("m", "t", "r", "wr", "n", recursive=True, more=RS.MULTIPOLYGONS) + RS.MULTIPOLYGON_RINGS,
    "coastline_rings": _with("t", "w", "wr", "n", recursive=True, more=RS.COAST) + RS.COASTLINE_RINGS,
    "coastline_window": _with("t", "w", "wr", "n", recursive=True, more=RS.COAST) + RS.WINDOW,
    "coastline_land_water": _with("t", "w", "wr", "n", recursive=True, more=RS.COAST).rstrip() + RS.LAND_WATER}
