"""SQL that assembles rings step by step, for an independent engine.

A row holds what a group of lines has left, the chain in hand, and what is done;
each step of the recursion takes up, prolongs or puts down one chain.
"""

from __future__ import annotations

from ..operators.rings import AREA_TYPES, SAME_M, SNAP_M
from .catalog import BOX, SHORE

_NODE = "STRUCT(id BIGINT, lon DOUBLE, lat DOUBLE)"


def _metres(p: str, q: str) -> str:
    x, y = f"(radians({q}.lon - {p}.lon) * cos(radians(({p}.lat + {q}.lat) / 2.0)))", f"radians({q}.lat - {p}.lat)"
    return f"(sqrt({x} * {x} + {y} * {y}) * 6378137.0::DOUBLE)"


#: g, rings, loose of lines (g, k, v): v the nodes of line k of group g.
STITCH = f"""
st AS (SELECT g, list({{'k': k, 'v': v}} ORDER BY k) AS lft, NULL::{_NODE}[] AS cur, 0 AS seams, []::{_NODE}[][] AS rings, []::{_NODE}[][] AS loose FROM lines GROUP BY g
  UNION ALL SELECT g, CASE act WHEN 'take' THEN lft[:len(lft) - 1] WHEN 'join' THEN lft[:b - 1] || lft[b + 1:] ELSE lft END,
    CASE act WHEN 'take' THEN lft[len(lft)].v WHEN 'join' THEN cur || (CASE WHEN {_metres('lft[b].v[-1]', 'cur[-1]')} < {_metres('lft[b].v[1]', 'cur[-1]')} THEN list_reverse(lft[b].v) ELSE lft[b].v END)[2:] END,
    CASE act WHEN 'join' THEN seams + 1 ELSE 0 END, CASE act WHEN 'ring' THEN list_append(rings, cur) ELSE rings END, CASE act WHEN 'open' THEN list_append(loose, cur) ELSE loose END
  FROM (SELECT *, CASE WHEN cur IS NULL THEN 'take' WHEN len(cur) > 1 AND (gap < {SAME_M} OR (seams > 0 AND gap < {SNAP_M} AND (coalesce(d, {SNAP_M}) >= {SNAP_M} OR gap <= d))) THEN 'ring'
      WHEN coalesce(d, {SNAP_M}) >= {SNAP_M} THEN 'open' ELSE 'join' END AS act
    FROM (SELECT *, {_metres('cur[1]', 'cur[-1]')} AS gap, list_min(ds) AS d, list_position(ds, list_min(ds)) AS b
      FROM (SELECT *, list_transform(lft, lambda x: least({_metres('x.v[1]', 'cur[-1]')}, {_metres('x.v[-1]', 'cur[-1]')})) AS ds FROM st WHERE NOT (cur IS NULL AND len(lft) = 0))))),
sewn AS (SELECT g, rings, loose FROM st WHERE cur IS NULL AND len(lft) = 0),
whole AS (SELECT g, unnest(rings) AS ring, unnest(range(len(rings))) AS r FROM sewn),
un AS (SELECT g, r, ring[1].id = ring[-1].id AND len(ring) > 1 AS closed, CASE WHEN ring[1].id = ring[-1].id AND len(ring) > 1 THEN ring[:len(ring) - 1] ELSE ring END AS body, []::{_NODE}[][] AS pieces, false AS cut FROM whole
  UNION ALL SELECT g, r, closed, body[:i - 1] || body[j:], CASE WHEN j - i > 2 THEN list_append(pieces, list_append(body[i:j - 1], body[i])) ELSE pieces END, true
  FROM (SELECT *, list_position(list_transform(body, lambda x: x.id), body[j].id) AS i FROM (SELECT *, list_filter(range(1, len(body) + 1), lambda n: list_position(list_transform(body, lambda x: x.id), body[n].id) < n)[1] AS j FROM un)) WHERE j IS NOT NULL),
simple AS (SELECT g, r, CASE WHEN cut AND len(body) < 3 THEN pieces ELSE list_append(pieces, CASE WHEN closed THEN list_append(body, body[1]) ELSE body END) END AS pieces
  FROM un WHERE len(list_distinct(list_transform(body, lambda x: x.id))) = len(body)),
piece AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY r, p) - 1 AS no, v FROM (SELECT g, r, unnest(pieces) AS v, unnest(range(len(pieces))) AS p FROM simple))"""

#: Nodes of ways in order, with places in degrees; needs wr and n.
_WAYS = """vw AS (SELECT way_id, list({'id': node_id, 'lon': n.lon / 10000000.0::DOUBLE, 'lat': n.lat / 10000000.0::DOUBLE} ORDER BY pos) AS v FROM wr JOIN n ON wr.node_id = n.id GROUP BY way_id HAVING count(*) > 1)"""

#: rel_id, polygon_no, ring_no, vertex_no, node_id; needs m, t, r, wr, n.
MULTIPOLYGONS = f"""{_WAYS},
lines AS (SELECT {{'rel': m.rel_id, 'hole': coalesce(m.role = 'inner', false)}} AS g, m.pos AS k, vw.v FROM m JOIN vw ON m.kind = 'way' AND m.ref_id = vw.way_id
  WHERE m.rel_id IN (SELECT id FROM t WHERE etype = 'relation' AND key = 'type' AND value IN {AREA_TYPES})),
{STITCH},
outside AS (SELECT g.rel AS rel_id, no, v FROM piece WHERE NOT g.hole), hole AS (SELECT g.rel AS rel_id, no, v FROM piece WHERE g.hole),
within AS (SELECT h.rel_id, h.no, min(o.no) AS polygon FROM hole h JOIN outside o ON h.rel_id = o.rel_id
  WHERE len(list_filter(range(1, len(o.v) + 1), lambda i: (o.v[i].lat > h.v[1].lat) <> (o.v[CASE WHEN i = 1 THEN len(o.v) ELSE i - 1 END].lat > h.v[1].lat) AND h.v[1].lon <
    (o.v[CASE WHEN i = 1 THEN len(o.v) ELSE i - 1 END].lon - o.v[i].lon) * (h.v[1].lat - o.v[i].lat) / (o.v[CASE WHEN i = 1 THEN len(o.v) ELSE i - 1 END].lat - o.v[i].lat) + o.v[i].lon)) % 2 = 1 GROUP BY h.rel_id, h.no),
ring AS (SELECT rel_id, no AS polygon_no, 0 AS ring_no, v FROM outside
  UNION ALL SELECT h.rel_id, w.polygon, row_number() OVER (PARTITION BY h.rel_id, w.polygon ORDER BY h.no), h.v FROM hole h JOIN within w ON h.rel_id = w.rel_id AND h.no = w.no)"""

#: part, ring_no, closed, v; needs t, wr, n.
COAST = f"""{_WAYS},
sw AS (SELECT way_id, v FROM vw WHERE way_id IN (SELECT id FROM w) AND way_id IN (SELECT id FROM t WHERE etype = 'way' AND key = '{SHORE[0]}' AND value = '{SHORE[1]}')),
en AS (SELECT way_id, v[1] AS e FROM sw UNION ALL SELECT way_id, v[-1] FROM sw),
ln AS (SELECT DISTINCT a.way_id AS a, b.way_id AS b FROM en a JOIN en b ON abs(a.e.lat - b.e.lat) < 0.0025 AND {_metres('a.e', 'b.e')} < {SNAP_M}),
cc AS (SELECT a, b FROM ln UNION SELECT cc.a, ln.b FROM cc JOIN ln ON cc.b = ln.a),
lines AS (SELECT c.part AS g, sw.way_id AS k, sw.v FROM sw JOIN (SELECT a, min(b) AS part FROM cc GROUP BY a) c ON sw.way_id = c.a),
{STITCH},
coast AS (SELECT g AS part, no AS ring_no, true AS closed, v FROM piece UNION ALL SELECT g, unnest(range(len(loose))), false, unnest(loose) FROM sewn)"""

MULTIPOLYGON_RINGS = "SELECT rel_id, polygon_no, ring_no, unnest(range(len(v))) AS vertex_no, unnest(list_transform(v, lambda x: x.id)) AS node_id FROM ring"
COASTLINE_RINGS = "SELECT part, ring_no, closed, unnest(range(len(v))) AS vertex_no, unnest(list_transform(v, lambda x: x.id)) AS node_id FROM coast"
WINDOW = f"""SELECT part, ring_no, closed, len(v) AS vertices FROM coast WHERE list_max(list_transform(v, lambda x: x.lon)) >= {BOX[0]} AND list_min(list_transform(v, lambda x: x.lon)) <= {BOX[2]}
  AND list_max(list_transform(v, lambda x: x.lat)) >= {BOX[1]} AND list_min(list_transform(v, lambda x: x.lat)) <= {BOX[3]} ORDER BY vertices DESC, part, ring_no, closed LIMIT 10"""
#: Areas to a tenth of a square metre.
LAND_WATER = """, ar AS (SELECT part, ring_no, v, cos(radians(list_avg(list_transform(v, lambda x: x.lat)))) AS c FROM coast WHERE closed),
sg AS (SELECT part, ring_no, v, CASE WHEN len(v) < 3 THEN 0.0 ELSE list_sum(list_transform(range(1, len(v) + 1), lambda i:
  radians(v[i].lon - v[1].lon) * radians(v[i % len(v) + 1].lat - v[1].lat) - radians(v[i % len(v) + 1].lon - v[1].lon) * radians(v[i].lat - v[1].lat))) * c * 6378137.0::DOUBLE * 6378137.0::DOUBLE / 2 END AS a FROM ar)
SELECT a > 0 AS is_land, round(abs(a), 1) AS area_m2, array_to_string(list_transform(v, lambda x: x.id), '/') AS nodes FROM sg"""
