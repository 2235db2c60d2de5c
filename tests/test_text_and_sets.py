import random

from pyspark.sql import functions as F

from cartolith.functions import text as X
from cartolith.operators import setops

VALUES = ["Nordhafen", "NORDSTERN 9", "am nordufer", "Vieux Moulin", "Čapkova Žďár", "čapkova ŽĎÁR", "ooo", "oooooo", "oo", "7", "Quay Rd", "quay road", "9a Quay", "99th Lane", "Ыйс", "", "tab\there", "100%_off"]
PATTERNS = ["", "o", "ooo", "oooo", "ooooooo", "nord", "NORD", "Nordu", "rdst", "QUAY R", "9", "9a", "99", "čap", "ČAP", "Žď", "ŽĎ", "ж", "Ый", "%_", "\t", "absent", "Vieux Moulin", "vieux moulin "]


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def test_search(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "value string")
    for p in PATTERNS:
        got = sorted(r[0] for r in df.where(X.ascii_icontains(F.col("value"), p)).collect())
        assert got == sorted(v for v in VALUES if fold(p) in fold(v)), p


def test_trigrams(spark):
    df = spark.createDataFrame([(v,) for v in [*VALUES, None]], "value string")
    for v, grams in df.select("value", X.trigrams(F.col("value"))).collect():
        assert (grams or []) == (X.text_trigrams(v) if v is not None else [])


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id bigint")


def test_ranges(spark):
    xs = [5, 6, 7, 7, 9, 0, 1, 63, 64, 65, 127, 128, 300, None]
    got = sorted(map(tuple, setops.id_ranges(ids(spark, xs), width=64).collect()))
    assert got == [(0, 2), (5, 8), (9, 10), (63, 66), (127, 129), (300, 301)]
    whole = range(0, 700)
    assert list(map(tuple, setops.id_ranges(ids(spark, whole), width=64).collect())) == [(0, 700)]
    assert setops.id_ranges(ids(spark, [])).count() == 0
    inside = setops.within_ranges(ids(spark, [0, 2, 64, 200, 300]), setops.id_ranges(ids(spark, xs), width=64), width=16)
    assert sorted(r[0] for r in inside.collect()) == [0, 64, 300]


def brute_ranges(xs):
    out = []
    for x in sorted({x for x in xs if x is not None}):
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


def test_ranges_across_every_border(spark):
    rnd = random.Random(3)
    far = [2**32 - 1, 2**32, 2**62 - 1, 2**62, -(2**40) - 1, -(2**40), -1, 0, 1]
    assert sorted(map(tuple, setops.id_ranges(ids(spark, far)).collect())) == brute_ranges(far)
    cases = [list(range(-30, 75)), list(range(4, 64)), [*range(0, 16), *range(17, 40), *range(60, 64)], [3, 4, 7, 8, 15, 16, 31, 32], [rnd.randrange(-90, 90) for _ in range(140)], list(range(4096 * 4 - 9, 4096 * 4 + 9))]
    for xs in cases:
        assert sorted(map(tuple, setops.id_ranges(ids(spark, xs), width=4).collect())) == brute_ranges(xs)


def test_sets(spark):
    a, b = ids(spark, [1, 2, 2, 3]), ids(spark, [2, 3, 3, 4])
    assert sorted(r[0] for r in setops.intersect([a, b]).collect()) == [2, 3]
    assert sorted(r[0] for r in setops.union([a, b]).collect()) == [1, 2, 3, 4]
