"""Passes over sorted partitions, vectorized on Arrow batches.

Spark sorts (spilling sorted runs and merging them); these functions only look
at neighbours, carrying one group from batch to batch, so their memory is one
batch whatever the size of a partition or a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def run_lengths(keys: list[str], count: str) -> Callable:
    """For mapInArrow: one row per run of equal int64 keys (without nulls) with its counts added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            n = b.column(count).to_numpy(zero_copy_only=False)
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            sums, firsts = np.add.reduceat(n, at), [c[at] for c in cols]
            if held is not None:
                if all(h == f[0] for h, f in zip(held, firsts)):
                    sums[0] += held_n
                else:
                    firsts = [np.concatenate([[h], f]) for h, f in zip(held, firsts)]
                    sums = np.concatenate([[held_n], sums])
            held, held_n = [f[-1] for f in firsts], sums[-1]
            if len(sums) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(f[:-1]) for f in firsts] + [pa.array(sums[:-1])], [*keys, count])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([h]) for h in held] + [pa.array([held_n])], [*keys, count])

    return run


def first_of_runs(group: str, n: int | None, keep: list[str]) -> Callable:
    """For mapInArrow: rows among the first n of their run of one int64 group (all if n is None).

    Adds part, the number of the partition, and local, the row's place in its run from 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).to_numpy(zero_copy_only=False)
            idx = np.arange(len(g), dtype=np.int64)
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            start = np.maximum.accumulate(np.where(new, idx, 0))
            local = idx - start + 1
            if last is not None and g[0] == last:
                local[start == 0] += seen
            last, seen = g[-1], int(local[-1])
            take = np.ones(len(g), bool) if n is None else local <= n
            if take.any():
                mask = pa.array(take)
                cols = [b.column(k).filter(mask) for k in keep]
                k = int(take.sum())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(k, part, np.int64)), pa.array(local[take])], [*keep, "part", "local"])

    return run
