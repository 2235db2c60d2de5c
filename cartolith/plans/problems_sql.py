"""SQL that gives the same rows as the queries of problems.py."""


def current(tab: str, keys: str, where: str = "true", loaded: bool = True) -> str:
    """Current rows: greatest edited_at, then smallest loaded_at."""
    return (f"(SELECT * FROM {tab} WHERE {where} QUALIFY row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY edited_at DESC NULLS LAST, loaded_at ASC NULLS LAST) = 1)")


LOCATED = (f"located AS MATERIALIZED (SELECT id, lon, lat FROM {current('nodes', 'id', 'id IS NOT NULL')} WHERE visible AND NOT isnan(lon) AND NOT isnan(lat) "
           "AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0))")
TAG_ROWS = f"tr AS (SELECT etype, id, key_idx, slot FROM {current('tags', 'etype, id, key_idx', 'slot IS NOT NULL AND etype IS NOT NULL AND id IS NOT NULL AND key_idx IS NOT NULL')})"

P1 = f"""
WITH {LOCATED},
cells AS (SELECT *, cast(floor(lon / 0.001) AS BIGINT) AS cx, cast(floor(lat / 0.001) AS BIGINT) AS cy FROM located),
near AS (SELECT a.id AS id_a, b.id AS id_b FROM cells a, (SELECT * FROM cells, range(-1, 2) dx(dx), range(-1, 2) dy(dy)) b
  WHERE a.cx = b.cx + b.dx AND a.cy = b.cy + b.dy AND a.id < b.id AND sqrt((a.lon-b.lon)*(a.lon-b.lon) + (a.lat-b.lat)*(a.lat-b.lat)) <= 0.0004),
point AS (SELECT DISTINCT p.point_id AS id_a, n.id AS id_b FROM probe_points p JOIN located n
  ON n.lon BETWEEN p.lon - p.radius_deg - 1e-9 AND p.lon + p.radius_deg + 1e-9
  WHERE NOT isnan(p.lon) AND NOT isnan(p.lat) AND NOT isnan(p.radius_deg) AND p.radius_deg >= 0
  AND sqrt((n.lon-p.lon)*(n.lon-p.lon) + (n.lat-p.lat)*(n.lat-p.lat)) <= p.radius_deg),
v AS (SELECT zone_id, ring_no, vertex_no, lon, lat, row_number() OVER w AS k, count(*) OVER (PARTITION BY zone_id, ring_no) AS c
  FROM (SELECT DISTINCT zone_id, ring_no, vertex_no, lon, lat FROM zones WHERE lon IS NOT NULL AND lat IS NOT NULL) WINDOW w AS (PARTITION BY zone_id, ring_no ORDER BY vertex_no)),
e AS (SELECT a.zone_id, a.ring_no, a.lon AS xa, a.lat AS ya, b.lon AS xb, b.lat AS yb FROM v a JOIN v b ON a.zone_id = b.zone_id AND a.ring_no = b.ring_no AND b.k = a.k % a.c + 1 WHERE a.c >= 3),
box AS (SELECT zone_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM v WHERE ring_no = 0 AND c >= 3 GROUP BY zone_id),
cand AS (SELECT b.zone_id, n.id, n.lon, n.lat FROM box b JOIN located n ON n.lon BETWEEN b.x0 AND b.x1 AND n.lat BETWEEN b.y0 AND b.y1),
par AS (SELECT c.zone_id, c.id, e.ring_no, count(*) FILTER (WHERE (e.ya > c.lat) <> (e.yb > c.lat) AND c.lon < (e.xb - e.xa) * (c.lat - e.ya) / nullif(e.yb - e.ya, 0) + e.xa) % 2 AS odd
  FROM cand c JOIN e ON c.zone_id = e.zone_id GROUP BY ALL),
zone AS (SELECT zone_id AS id_a, id AS id_b FROM par GROUP BY ALL HAVING max(CASE WHEN ring_no = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring_no <> 0 THEN odd ELSE 0 END) = 0)
SELECT 'near' AS kind, id_a, id_b FROM near UNION ALL SELECT 'point', id_a, id_b FROM point UNION ALL SELECT 'zone', id_a, id_b FROM zone"""

P4_TOTALS = f"WITH {TAG_ROWS} SELECT key_idx, count(*) AS n_rows, count(DISTINCT slot) AS n_items FROM tr GROUP BY key_idx"
P4 = f"""
WITH {TAG_ROWS}, t AS (SELECT key_idx, count(*) AS n, count(DISTINCT slot) AS s FROM tr GROUP BY key_idx)
SELECT 'rows' AS what, key_idx FROM t WHERE n * 20 >= (SELECT sum(n) FROM t)
UNION ALL SELECT 'slots', key_idx FROM t WHERE s * 20 >= (SELECT sum(s) FROM t)"""

_P5 = f"""
WITH targets AS (
  SELECT 'node' AS kind, id, arg_max(coalesce(visible, false), coalesce(edited_at, TIMESTAMP '0001-01-01')) AS visible, min(loaded_at) AS arrived FROM nodes GROUP BY id
  UNION ALL SELECT 'way', id, arg_max(coalesce(visible, false), coalesce(edited_at, TIMESTAMP '0001-01-01')), min(loaded_at) FROM ways GROUP BY id
  UNION ALL SELECT 'relation', id, arg_max(coalesce(visible, false), coalesce(edited_at, TIMESTAMP '0001-01-01')), min(loaded_at) FROM relations GROUP BY id),
refs AS (
  SELECT 'way_refs' AS tab, way_id AS owner_id, 0::BIGINT AS ring_no, pos::BIGINT AS pos, 'node' AS kind, node_id AS ref, edited_at, loaded_at FROM {current('way_refs', 'way_id, pos')}
  UNION ALL SELECT 'members', rel_id, 0, pos, lower(trim(mtype)), ref_id, edited_at, loaded_at FROM {current('members', 'rel_id, pos')}
  UNION ALL SELECT 'ring_vertices', rel_id, ring_no, vertex_no, 'node', node_idx, edited_at, loaded_at FROM {current('ring_vertices', 'rel_id, ring_no, vertex_no')}),
found AS (SELECT r.tab, r.owner_id, r.ring_no, r.pos, strftime(r.edited_at, '%Y-%m') AS period,
  CASE WHEN t.id IS NULL THEN 'missing' WHEN NOT t.visible THEN 'deleted' WHEN t.arrived > r.loaded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN targets t ON r.kind = t.kind AND r.ref = t.id WHERE r.ref IS NOT NULL AND r.kind IN ('node', 'way', 'relation'))
"""
P5 = _P5 + "SELECT tab, owner_id, ring_no, pos, period, reason FROM found WHERE reason IS NOT NULL"
P5_REPORT = _P5 + "SELECT tab, period, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY ALL"

_LINKS = f"""
live AS (SELECT id FROM {current('relations', 'id')} WHERE visible),
links AS MATERIALIZED (SELECT DISTINCT rel_id AS parent, ref_id AS child FROM {current('members', 'rel_id, pos')}
  WHERE lower(trim(mtype)) = 'relation' AND ref_id IN (SELECT id FROM live) AND rel_id IN (SELECT id FROM live))"""
_REACH = f"""
WITH RECURSIVE {_LINKS},
reach AS (SELECT parent AS a, child AS b FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON r.b = l.parent)"""
P6_BELOW = _REACH + " SELECT a AS rel_id, b AS below FROM reach"
P6 = _REACH.rstrip() + """,
cyc AS (SELECT a AS n FROM reach WHERE a = b),
under AS (SELECT DISTINCT b AS n FROM reach WHERE a IN (SELECT n FROM cyc) AND b NOT IN (SELECT n FROM cyc)),
part AS (SELECT r.a AS n, r.b AS m FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a WHERE r.a IN (SELECT n FROM cyc)),
tops AS (SELECT DISTINCT parent AS n FROM links WHERE parent NOT IN (SELECT child FROM links)),
free AS (SELECT * FROM links WHERE child NOT IN (SELECT n FROM cyc) AND child NOT IN (SELECT n FROM under) AND parent NOT IN (SELECT n FROM cyc) AND parent NOT IN (SELECT n FROM under)),
chain AS (SELECT n, cast(n AS VARCHAR) AS path FROM tops UNION ALL SELECT l.child, c.path || '/' || l.child FROM chain c JOIN free l ON c.n = l.parent)
SELECT n AS rel_id, 'tree' AS state, path FROM chain
UNION ALL SELECT n, 'cycle', string_agg(cast(m AS VARCHAR), '/' ORDER BY m) FROM part GROUP BY n
UNION ALL SELECT n, 'below', '' FROM under"""

SQL = {"p1_found": P1, "p4_found": P4, "p4_key_totals": P4_TOTALS, "p5_found": P5, "p5_report": P5_REPORT, "p6_found": P6, "p6_descendants": P6_BELOW}
