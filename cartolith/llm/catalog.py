"""Queries of the training-data problems and SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.problems_sql import TAG_ROWS
from ..session import materialize
from ..sources.tables import table, tag_rows
from . import cooccur, packing, residue, tokenizer, topn

_KINDS = ("key", "tag")


def _kind():
    return F.get(F.array(*(F.lit(k) for k in _KINDS)), F.col("kind")).alias("kind")


def _tag_pairs(spark: SparkSession, d: str, **least: int) -> DataFrame:
    rows = materialize(tag_rows(table(spark, d, "tags")), "tag-rows")
    return cooccur.item_pairs(rows, ["etype", "id"], ["key_idx", "slot"], **least)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tag_pairs(spark, d, min_together=10, min_times=4).select(_kind(), "id_a", "id_b")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.with_odds(_tag_pairs(spark, d)).select(_kind(), "id_a", "id_b", "together_count", "times", "odds_ratio")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_slots(tag_rows(table(spark, d, "tags")), table(spark, d, "tag_slots")).select("key_idx", "top_no", "slot")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p3_found, p7_ids, p8_containers, p9_found)}

_PAIRS = f"""
WITH {TAG_ROWS},
items AS (SELECT DISTINCT etype, id, 'key' AS kind, key_idx AS item FROM tr UNION SELECT etype, id, 'tag', slot FROM tr),
cnt AS (SELECT kind, item, count(*) AS n FROM items GROUP BY ALL),
tot AS (SELECT count(*) AS n FROM (SELECT DISTINCT etype, id FROM tr)),
pairs AS (SELECT a.kind, a.item AS id_a, b.item AS id_b, count(*) AS c FROM items a JOIN items b
  ON a.etype = b.etype AND a.id = b.id AND a.kind = b.kind AND a.item < b.item GROUP BY ALL),
full_pairs AS (SELECT p.kind, p.id_a, p.id_b, p.c, x.n AS a, y.n AS b, (SELECT n FROM tot) AS n
  FROM pairs p JOIN cnt x ON x.kind = p.kind AND x.item = p.id_a JOIN cnt y ON y.kind = p.kind AND y.item = p.id_b)
"""
SQL = {
    "p2_found": _PAIRS + "SELECT kind, id_a, id_b FROM full_pairs WHERE c >= 10 AND c::HUGEINT * n >= 4 * a::HUGEINT * b",
    "p2_pairs": _PAIRS + """SELECT kind, id_a, id_b, c AS together_count, (c::DOUBLE * n::DOUBLE) / (a::DOUBLE * b::DOUBLE) AS times,
  ((c::DOUBLE + 0.5::DOUBLE) * (n::DOUBLE - a::DOUBLE - b::DOUBLE + c::DOUBLE + 0.5::DOUBLE)) / ((a::DOUBLE - c::DOUBLE + 0.5::DOUBLE) * (b::DOUBLE - c::DOUBLE + 0.5::DOUBLE)) AS odds_ratio FROM full_pairs""",
    "p3_found": f"""
WITH {TAG_ROWS}, t AS (SELECT key_idx, slot, count(*) AS n FROM tr GROUP BY ALL),
v AS (SELECT slot, min(value) AS value FROM tag_slots GROUP BY slot)
SELECT key_idx, row_number() OVER (PARTITION BY key_idx ORDER BY n DESC, value ASC NULLS LAST, t.slot ASC) AS top_no, t.slot
FROM t LEFT JOIN v ON t.slot = v.slot QUALIFY top_no <= 3""",
}
