import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from cartolith.llm import packing as P
from cartolith.llm.tokenizer import VOCABULARY, Encoder


def fill(hist, capacity):
    seg, used = P.plan(hist, capacity)
    load, placed = Counter(), Counter()
    for length, first, n, base, per in seg:
        assert first == placed[length]
        placed[length] += n
        for k in range(n):
            load[base + k // per] += length
    assert placed == Counter({k: v for k, v in hist.items() if k > 0 and v}) and set(load) == set(range(used))
    assert max(load.values(), default=0) <= capacity
    return seg, used


def best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= s
        else:
            free.append(capacity - s)
    return len(free)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rnd = random.Random(seed)
    sizes = [min(64, int(rnd.expovariate(0.08)) + 1) for _ in range(rnd.randrange(1, 400))] + [7] * (200 * (seed % 2))
    _, used = fill(Counter(sizes), 64)
    assert used == best_fit(sizes, 64)


def test_plan_edges():
    assert P.plan({}, 10) == ([], 0)
    assert fill({10: 5}, 10)[1] == 5 and fill({3: 10**6}, 10)[1] == -(-(10**6) // 3)
    seg, _ = fill({k: 10**4 + k for k in range(1, 101)}, 100)
    assert len(seg) < 1000
    with pytest.raises(ValueError):
        P.plan({11: 1}, 10)


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
def test_pack(spark):
    enc = Encoder(Path(VOCABULARY).read_bytes())
    rnd = random.Random(2)
    rows = [(i, " word" * rnd.randrange(1, 30)) for i in range(400)] + [(i, " hot hot") for i in range(1000, 1300)]
    rows += [(500, " long" * 100), (501, ""), (502, None), (503, " long" * 96), (7, " twice"), (None, " no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, container int").repartition(5)
    out = P.pack(df, capacity=32).collect()
    load, parts = Counter(), defaultdict(list)
    for r in out:
        load[r["container"]] += r["n_tokens"]
        parts[r["doc_id"]].append(r["n_tokens"])
    assert max(load.values()) <= 32
    want = defaultdict(list)
    for i, t in rows:
        n = len(enc.encode(t))
        want[i] += [32] * (n // 32) + ([n % 32] if n % 32 else [])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert len(load) <= 1.05 * -(-sum(load.values()) // 32) + 1
    assert P.pack(df.limit(0), capacity=32).count() == 0
