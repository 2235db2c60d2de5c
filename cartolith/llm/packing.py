"""Filling containers of fixed capacity with texts of varying length.

The plan is made over the histogram of lengths, which has at most `capacity`
entries however many documents there are; documents then take the planned
places by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .tokenizer import VOCABULARY, vocabulary_of, worker_encoder

CAPACITY = 2048


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over counts: segments and the number of containers.

    A segment (length, first, n, base, per) says that the items of that length
    with ranks first..first+n-1 lie in containers base + (rank - first) // per.
    Containers that are filled alike are kept as one range, so the work depends
    on the number of lengths, not of items.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []  # free spaces in use, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges (base, count) of containers
    used = 0

    def put(space: int, base: int, count: int) -> None:
        if space and count:
            if space not in ranges:
                ranges[space] = []
                insort(spaces, space)
            ranges[space].append((base, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        if length > capacity:
            raise ValueError("an item is longer than a container")
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                base, count = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space]
                    spaces.pop(k)
            else:
                space = capacity
                per = capacity // length
                base, count = used, -(-left // per)
                used += count
            per = space // length
            full = min(count, left // per)
            if full:
                segments.append((length, rank, full * per, base, per))
                rank, left = rank + full * per, left - full * per
                put(space - per * length, base, full)
                base, count = base + full, count - full
            if count and left and left < per:
                segments.append((length, rank, left, base, left))
                put(space - left * length, base, 1)
                rank, left, base, count = rank + left, 0, base + 1, count - 1
            put(space, base, count)
    return segments, used


def pieces(docs: DataFrame, capacity: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """id, piece_no, n_tokens of each piece, with part and local (rank among the part's pieces of that length).

    A text of up to `capacity` tokens is one piece, a longer one several, all
    but the last full; a text without tokens gives none.
    """
    ship(docs.sparkSession)
    voc, kind = vocabulary_of(docs, path), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = worker_encoder(path, voc), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            n = np.array([len(enc.encode(t)) for t in b.column(1).to_pylist()], np.int64)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(capacity, n[row] - no * capacity)
            # rank among equal sizes, in the order of rows
            order = np.argsort(size, kind="stable")
            s = size[order]
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.array([], int)
            runs = np.diff(np.r_[start, len(s)])
            local = np.empty(len(s), np.int64)
            local[order] = np.arange(len(s)) - np.repeat(start, runs)
            local += seen[size]
            seen[s[start]] += runs
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(no, pa.int32()), pa.array(size, pa.int32()), pa.array(np.full(len(row), part, np.int64)), pa.array(local)],
                ["id", "piece_no", "n_tokens", "part", "local"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {kind}, piece_no int, n_tokens int, part bigint, local bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece_no, n_tokens, container of every piece of every text with tokens.

    Texts are never split but those longer than a container. Rows with null or
    empty text give none; repeated or null ids are documents of their own. Only
    the histogram (at most `capacity` rows) goes to the driver and only the plan
    (bounded by it) is broadcast; a length that very many texts share is ranked
    by counts of its parts, not in one task.
    """
    spark = docs.sparkSession
    p = materialize(pieces(docs, capacity, path, id_col, text_col), "pieces")
    by_part = p.groupBy("part", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    hist = {r["n_tokens"]: r["n"] for r in by_part.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(hist, capacity)
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = by_part.select("part", "n_tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = p.join(offset, ["part", "n_tokens"]).withColumn("rank", F.col("before") + F.col("local"))
    seg = spark.createDataFrame(segments, "n_tokens int, first bigint, count bigint, base bigint, per bigint")
    placed = ranked.join(F.broadcast(seg), "n_tokens").where("rank >= first and rank < first + count")
    box = F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))
    return placed.select(F.col("id").alias(id_col), "piece_no", "n_tokens", box.cast("bigint").alias("container"))
