"""Range joins over bins against every pair compared."""

import math
import random

import pytest

from carelake.operators.labs import critical_labs, critical_labs_ranged
from carelake.operators.ranges import range_join

POINTS = "key string, pid long, value double"
RANGES = "key string, rid long, s double, e double"


def _data(seed, n=400, m=120):
    """Few distinct values (ties with ends), a hot key, nulls, infinities, NaN, crossing and open ranges."""
    r = random.Random(seed)

    def number():
        return r.choice([None, math.inf, -math.inf, math.nan]) if r.random() < .05 else r.choice([r.randint(-9, 9) * 1.0, r.uniform(-9, 9)])

    def key():
        return r.choice(["hot", "hot", "hot", "a", "b", None])
    points = [(key(), i % (n - 9), number()) for i in range(n)] + [("none", -1, 1.0)]
    ranges = [(key(), i, number(), number()) for i in range(m)] + [("open", 900, None, None), ("alone", 901, 1.0, 2.0)]
    return [*points, ("open", -2, 3.0), ("open", -3, None)], ranges


def _sorted(df):
    return sorted(map(repr, map(tuple, df.select("key", "pid", "value", "rid", "s", "e").collect())))


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("bins", [2, 16, 256])
def test_equals_every_pair(spark, closed, bins):
    points, ranges = _data(bins)
    p, q = spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES)
    op = "<=" if closed else "<"
    p.createOrReplaceTempView("rj_points")
    q.createOrReplaceTempView("rj_ranges")
    want = spark.sql(f"""SELECT p.*, r.rid, r.s, r.e FROM rj_points p JOIN rj_ranges r ON p.key = r.key
        AND p.value IS NOT NULL AND (s IS NULL OR s {op} value) AND (e IS NULL OR value {op} e)""")
    got = range_join(p, q, "key", "value", "s", "e", closed=closed, bins=bins)
    assert got.columns == ["key", "pid", "value", "rid", "s", "e"]
    assert _sorted(got) == _sorted(want) != []


def test_bounds_that_cross_or_are_missing(spark):
    points, ranges = _data(5)
    labs = spark.createDataFrame(points, "test string, pid long, value double")
    bounds = spark.createDataFrame(ranges, "test string, rid long, low double, high double")
    want = sorted(map(repr, map(tuple, critical_labs(labs, bounds).collect())))
    assert sorted(map(repr, map(tuple, critical_labs_ranged(labs, bounds, bins=8).collect()))) == want != []


def test_empty_sides(spark):
    points, ranges = _data(7, 20, 5)
    p, q = spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES)
    assert range_join(p.limit(0), q, "key", "value", "s", "e").count() == 0
    assert range_join(p, q.limit(0), "key", "value", "s", "e").count() == 0


def test_readings_within_bounds_meet_none(spark):
    """Points that no range can hold are dropped before the join, however many ranges their key has."""
    p = spark.range(5000).selectExpr("'t' AS key", "id AS pid", "CAST(id % 100 AS DOUBLE) AS value")
    q = spark.range(3000).selectExpr("'t' AS key", "id AS rid", "200.0D + id AS s", "CAST(NULL AS DOUBLE) AS e")
    out = range_join(p, q, "key", "value", "s", "e")
    assert out.count() == 0
    near = range_join(p.selectExpr("key", "pid", "value + 150 AS value"), q, "key", "value", "s", "e")
    assert near.count() == sum(max(0, x + 150 - 200) for x in range(100)) * 50
