"""As-of joins, interval joins and running numbers against brute force, with large groups cut into parts."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.intervals import interval_join
from tidemark.operators.numbering import running

LEFT = "k string, t int, v int, _l int, n string"
RIGHT = "k string, t int, w int, v string"


def sides(seed=1, n=400):
    """One key holds over a third of all rows; NULL keys and times, repeated rows and ties on both sides."""
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c", None, "left only", "right only"]
    left, right = [], []
    for i in range(n):
        k = rng.choice(keys)
        t = None if rng.random() < 0.03 else rng.randint(0, 300)
        if rng.random() < 0.5 and k != "right only":
            left.append((k, t, i, None, "x"))
        elif k != "left only":
            right.append((k, t, i, None if i % 5 == 0 else f"r{i}"))
    left += left[:5]
    right += [(k, t, w + 1000, "tie") for k, t, w, _ in right[:20]] + right[30:35]
    return left, right


def partner(row, right, direction, strict, tolerance):
    k, t = row[0], row[1]
    if k is None or t is None:
        return None

    def key(r):  # among equal times the greatest row, NULL lowest
        return (r[1], r[2], r[3] is not None, r[3] or "")

    mine = [r for r in right if r[0] == k and r[1] is not None]
    back = [r for r in mine if (r[1] < t if strict else r[1] <= t)]
    ahead = [r for r in mine if (r[1] > t if strict else r[1] >= t)]
    b = max(back, key=key, default=None)
    f = max([r for r in ahead if r[1] == min(x[1] for x in ahead)], key=key, default=None) if ahead else None
    best = {"backward": b, "forward": f}.get(direction)
    if direction == "nearest":
        best = f if b is None or (f is not None and f[1] - t < t - b[1]) else b
    if best is not None and tolerance is not None and abs(best[1] - t) > tolerance:
        return None
    return best


@pytest.mark.parametrize("group_rows", [1 << 20, 20])
@pytest.mark.parametrize("direction, strict, tolerance", [("backward", False, None), ("backward", True, 9), ("forward", False, 3), ("forward", True, None), ("nearest", False, None)])
def test_asof_join(spark, group_rows, direction, strict, tolerance):
    left, right = sides()
    got = asof_join(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "t", ["k"], direction, tolerance, strict, group_rows=group_rows
    )
    assert got.columns == ["k", "t", "v", "_l", "n", "t_right", "w", "v_right"]
    want = [(*row, *((p[1], p[2], p[3]) if (p := partner(row, right, direction, strict, tolerance)) else (None,) * 3)) for row in left]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("group_rows", [1 << 20, 10])
def test_asof_join_of_one_group(spark, group_rows):
    left = [(date(2024, 1, 1) + timedelta(days=i), i) for i in range(0, 60, 2)]
    right = [(date(2024, 1, 1) + timedelta(days=i), f"r{i}") for i in range(5, 60, 7)]
    got = asof_join(spark.createDataFrame(left, "d date, i int"), spark.createDataFrame(right, "d date, r string"), "d", how="inner", group_rows=group_rows)
    want = [(d, i, right[(i - 5) // 7][0], right[(i - 5) // 7][1]) for d, i in left if i >= 5]
    assert sorted(map(tuple, got.collect())) == want


def test_asof_join_of_empty_sides_and_wrong_arguments(spark):
    left, right = spark.createDataFrame(sides()[0], LEFT), spark.createDataFrame(sides()[1], RIGHT)
    assert asof_join(left.limit(0), right, "t", ["k"]).count() == 0
    alone = asof_join(left, right.limit(0), "t", ["k"])
    assert alone.count() == left.count() and alone.filter("w IS NOT NULL").isEmpty()
    assert asof_join(left, right.limit(0), "t", ["k"], how="inner").count() == 0
    for wrong in ({"direction": "up"}, {"how": "outer"}):
        with pytest.raises(ValueError):
            asof_join(left, right, "t", ["k"], **wrong)
    with pytest.raises(TypeError):
        asof_join(left.withColumn("t", F.col("t").cast("double")), right, "t", ["k"])


def test_no_task_sorts_a_hot_key(spark):
    """One key holds most rows: cut, no part of it has more than some times the wanted rows."""
    from tidemark.operators import spread

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 7919).alias("t"))
    cuts = spread.large_groups(rows, ["k"], "t", 1000)
    parts = spread.with_part(rows, cuts, ["k"], "t", "p").groupBy("k", "p").count()
    assert [r["k"] for r in cuts.collect()] == [1]
    assert parts.agg(F.max("count")).first()[0] <= 2000 and parts.filter("k = 1").count() >= 15


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_interval_join(spark, closed, by):
    rng = random.Random(7)
    points = [(rng.choice("ab") if rng.random() < 0.9 else None, None if rng.random() < 0.05 else rng.randint(-50, 400), i) for i in range(150)]
    spans = [(rng.choice("ab"), s := rng.randint(-60, 400), s + rng.choice([0, 0, 1, 3, 17, 90, 500, -1]), i) for i in range(80)]
    spans += [("a", None, 5, 90), ("a", 5, None, 91), (None, 0, 100, 92), spans[0]]
    got = interval_join(spark.createDataFrame(points, "k string, t long, v int"), spark.createDataFrame(spans, "k string, s long, e long, v int"), "t", "s", "e", by, closed)
    want = []
    for k, t, v in points:
        for k2, s, e, v2 in spans:
            if None in (t, s, e) or s > e or (by and (k is None or k != k2)):
                continue
            if (t >= s if closed in ("both", "left") else t > s) and (t <= e if closed in ("both", "right") else t < e):
                want.append((k, t, v, s, e, v2) if by else (k, t, v, k2, s, e, v2))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_interval_join_of_many_intervals(spark, plan_of):
    """100 000 overlapping intervals of very different length; no nested loop, and the longest touch two buckets."""
    n = 100_000
    spans = spark.range(n).select("id", (F.col("id") * 37 % 100_003).alias("s")).withColumn("e", F.col("s") + F.pow(F.lit(2.0), F.col("id") % 12).cast("long"))
    points = spark.range(0, 100_003, 50).select(F.col("id").alias("t"))
    met = interval_join(points, spans, "t", "s", "e")
    plan = plan_of(met)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sum(len(range(-(-s // 50) * 50, s + 2 ** (i % 12) + 1, 50)) - (1 if s + 2 ** (i % 12) > 100_002 else 0) * max(0, (s + 2 ** (i % 12)) // 50 - 100_002 // 50) for i in range(n) for s in [i * 37 % 100_003])
    assert met.count() == want


def test_running_equals_global_window(spark, plan_of):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9) if rng.random() < 0.9 else None, rng.choice([None, "a", "b"]), "x") for i in range(500)]
    table = spark.createDataFrame(rows, "i long, v int, s string, _id string").repartition(7)
    got = running(table, [F.asc_nulls_last("v"), F.desc("i")], totals={"so_far": "v"}, previous={"before": "s"}, following={"after": "s"}, partitions=6)
    plan = plan_of(got)
    assert "SinglePartition" not in plan
    table.createOrReplaceTempView("running_rows")
    want = spark.sql(
        """SELECT *, row_number() OVER w AS number, sum(v) OVER w AS so_far, lag(s) OVER w AS before, lead(s) OVER w AS after
        FROM running_rows WINDOW w AS (ORDER BY v NULLS LAST, i DESC)"""
    )
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert running(table.limit(0), [F.asc("i")], totals={"so_far": "v"}).count() == 0
    with pytest.raises(ValueError):
        running(table, [F.asc("i")], number="v")
