import random
import uuid

import pytest

from cartolith.operators import hierarchy as H
from cartolith.session import rounds


def brute(links):
    links = {(a, b) for a, b in links if a is not None and b is not None}
    nodes = {x for e in links for x in e}
    kids = {n: [b for a, b in links if a == n] for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(kids[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids[x]
        reach[n] = seen
    cyc = {n for n in nodes if n in reach[n]}
    below = {m for n in cyc for m in reach[n]} - cyc
    out = {(n, "cycle", tuple(sorted(m for m in cyc if m in reach[n] and n in reach[m]))) for n in cyc} | {(n, "below", ()) for n in below}

    def walk(path):
        out.add((path[-1], "tree", path))
        for k in kids[path[-1]]:
            if k not in cyc and k not in below:
                walk((*path, k))

    for n in nodes - {b for _, b in links}:
        walk((n,))
    lists = {(n, m) for n in nodes for m in reach[n]}
    return out, lists


def run(spark, links):
    df = spark.createDataFrame(links, "parent bigint, child bigint")
    rows = H.hierarchy(df).collect()
    below = brute(links)[1]
    for r in rows:
        assert r["n_below"] == sum(a == r["rel_id"] for a, _ in below)
        if r["state"] == "tree":
            assert r["top"] == r["path"][0] and r["depth"] == len(r["path"]) - 1
    return {(r["rel_id"], r["state"], tuple(r["path"])) for r in rows}, {tuple(r) for r in H.descendants(df).collect()}, len(rows)


CASES = {
    "empty": [],
    "nulls": [(1, None), (None, 2), (1, 2), (1, 2)],
    "self": [(1, 1), (1, 2), (0, 1)],
    "diamond": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)],
    "two loops": [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 7), (9, 1)],
    "top above a loop only": [(1, 2), (2, 3), (3, 2)],
    "long": [(i, i + 1) for i in range(12)],
}


RANDOM = [(random.Random(s).randrange(25), random.Random(s + 500).randrange(25)) for s in range(30)]


@pytest.mark.parametrize("name,most", [*((n, 4096) for n in [*CASES, "random"]), ("nulls", 0), ("self", 0), ("two loops", 0), ("random", 0)])
def test_cases(spark, name, most, monkeypatch):
    monkeypatch.setattr(H, "GROUP_MOST", most)  # 0: everything as tables
    links = CASES.get(name, RANDOM)
    got, lists, n = run(spark, links)
    want, want_lists = brute(links)
    assert got == want and lists == want_lists and n == len(want)


def test_random(spark):
    rnd = random.Random(12)
    links = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(24)] + [(100 + rnd.randrange(9), 100 + rnd.randrange(9)) for _ in range(8)]
    got, lists, n = run(spark, links)
    want, want_lists = brute(links)
    assert got == want and lists == want_lists and n == len(want)


@pytest.mark.parametrize("seed", range(60))
def test_group(seed):
    rnd = random.Random(seed)
    size, n = rnd.randrange(2, 14), rnd.randrange(1, 22)
    links = sorted({(rnd.randrange(size), rnd.randrange(size)) for _ in range(n)})
    g = H.Group.of(links)
    want, lists = brute(links)
    rows = list(g.rows())
    assert {(a, s, tuple(p)) for a, s, p, _ in rows} == want and len(rows) == len(want)
    assert {(a, b) for a, bs in g.lists() for b in bs} == lists
    # reverse order of peeling: parents outside loops come before their children
    at = {a: k for k, (a, *_) in enumerate(rows)}
    assert all(at[a] < at[b] for a, b in links if a in at and not any({(a, b), (b, a)} <= lists for _ in [0]))


def jobs(spark, do):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    do()
    sc.setJobGroup("", "")
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_long_loop_as_tables(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_MOST", 0)
    n, tail = 40, 12
    links = [(i, (i + 1) % n) for i in range(n)] + [(7, 1000)] + [(1000 + i, 1001 + i) for i in range(tail)] + [(2000, 3)]
    rows = {r["rel_id"]: (r["state"], len(r["path"]), r["n_below"]) for r in H.hierarchy(spark.createDataFrame(links, "parent bigint, child bigint")).collect()}
    assert all(rows[i] == ("cycle", n, n + tail + 1) for i in range(n)) and rows[2000] == ("tree", 1, n + tail + 1)
    assert all(rows[1000 + i] == ("below", 0, tail - i) for i in range(tail + 1)) and len(rows) == n + tail + 2


def test_loops_of_any_length_take_few_rounds(spark):
    n = 200
    df = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "parent bigint, child bigint")
    with rounds(spark, n):
        found = []
        assert jobs(spark, lambda: found.append(H.loops(df))) < n / 2 and found[0].count() == n


def test_few_jobs(spark):
    chain, loop = [(i, i + 1) for i in range(32)], [(i, (i + 1) % 32) for i in range(32)]
    for links in (chain, loop):
        df = spark.createDataFrame(links, "parent bigint, child bigint")
        assert 0 < jobs(spark, lambda: H.hierarchy(df).collect()) < 40  # noqa: B023


def test_components(spark):
    from cartolith.operators.graph import components

    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u bigint, v bigint"), len(links)).collect()))
    want = {}
    for _ in links:
        for a, b in links:
            want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    assert got == want
