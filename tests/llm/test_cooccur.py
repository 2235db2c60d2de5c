import random
from collections import Counter
from itertools import combinations

import pytest

from cartolith.llm import cooccur


def brute(rows, least=1, times=0):
    recs = {(e, i) for e, i, k, s in rows if e is not None and i is not None and (k is not None or s is not None)}
    out = set()
    for kind in (0, 1):
        sets = {r: set() for r in recs}
        for row in rows:
            if (row[0], row[1]) in recs and row[2 + kind] is not None:
                sets[row[0], row[1]].add(row[2 + kind])
        one = Counter(x for s in sets.values() for x in s)
        two = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
        out |= {(kind, a, b, c, one[a], one[b], len(recs)) for (a, b), c in two.items() if c >= least and c * len(recs) >= times * one[a] * one[b]}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "etype string, id bigint, key_idx bigint, slot bigint, n string")
    return df, {tuple(r) for r in cooccur.item_pairs(df, ["etype", "id"], ["key_idx", "slot"], **kw).collect()}


def messy(seed, top=40, base=0):
    rnd = random.Random(seed)
    rows = [(rnd.choice("nwr"), rnd.randrange(60), base + rnd.randrange(top), base + rnd.randrange(top)) for _ in range(500)]
    rows += rows[:30] + [(None, 1, 1, 1), ("n", None, 1, 1), ("n", 1, None, base + 3), ("n", 1, base + 2, None), ("w", 999, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("kw", [{}, {"min_together": 3}, {"min_together": 2, "min_times": 2}])
def test_pairs(spark, kw):
    rows = messy(1)
    assert run(spark, rows, **kw)[1] == brute(rows, kw.get("min_together", 1), kw.get("min_times", 0))


def test_large_records_are_split(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK", 4)
    rows = messy(2) + [("n", 5, k, k + 1) for k in range(60)]
    assert run(spark, rows)[1] == brute(rows)


def test_ids_beyond_32_bits(spark):
    rows = messy(3, base=1 << 40)
    assert run(spark, rows)[1] == brute(rows)
    rows = messy(4, base=-20)
    assert run(spark, rows, min_together=2)[1] == brute(rows, 2)


def test_empty_and_odds(spark):
    df, got = run(spark, [])
    assert got == set()
    pairs = spark.createDataFrame([(0, 1, 2, 5, 5, 5, 10)], "kind int, id_a bigint, id_b bigint, together_count bigint, n_a bigint, n_b bigint, n bigint")
    r = cooccur.with_odds(pairs).first()
    assert r["times"] == 2.0 and r["odds_ratio"] == (5.5 * 5.5) / (0.5 * 0.5)
