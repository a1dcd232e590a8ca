"""Rate limits along keys of any length, against a loop."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators import scans


def loop(x, most, start=None):
    out = []
    for v, m in zip(x, most, strict=True):
        last = out[-1] if out else start
        out.append(v if last is None else max(last - m, min(last + m, v)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 64), st.integers(0, 9)), min_size=1, max_size=60), st.integers(0, 64))
def test_a_run_is_a_function_of_the_value_before(steps, start):
    x, most = np.array([s[0] / 64 for s in steps]), np.array([s[1] / 64 for s in steps])
    assert scans.limited(x, most, start / 64).tolist() == loop(x, most, start / 64)
    whole = scans.Run(0.0, 1.0)
    whole.steps(x, most)
    for k in range(65):
        assert whole.value(k / 64) == loop(x, most, k / 64)[-1]
    least = min(m for m in most) if len(most) else 0
    assert least == 0 or len(whole.given) <= 2 / (2 * least) + 4


@pytest.mark.parametrize("by_time", [False, True])
@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_keys_across_partitions(spark, by_time, partitions):
    rng = random.Random(partitions)
    rows = []
    for key in ("a", "b", None, "long"):
        t = 0.0
        for _ in range(1500 if key == "long" else rng.randint(1, 40)):
            t += rng.choice([0, 1, 1, 3]) / 8
            rows.append((key, t, len(rows), rng.randint(0, 64) / 64, 1 / 64 if key == "long" else 3 / 64))
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "k string, t double, i int, v double, rate double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): r.out for r in scans.slew(df, ["k"], ["t", "i"], "v", "rate", by_time).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        most = [r[4] * (r[1] - (own[n - 1][1] if n else 0)) if by_time else r[4] for n, r in enumerate(own)]
        assert [got[key, r[2]] for r in own] == pytest.approx(loop([r[3] for r in own], most), abs=1e-12)
    assert len(got) == len(rows)


def test_ten_million_steps_of_one_session(spark):
    n = 10_000_000
    x = (F.pmod(F.col("id") * 7919, F.lit(1024)) / 1024).alias("v")
    rows = spark.range(0, n, 1, 16).select(F.lit("s").alias("k"), F.col("id").alias("w"), x, F.lit(0.001).alias("rate"))
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        out = scans.slew(rows, ["k"], ["w"], "v", "rate")
        got = out.agg(F.count(F.lit(1)).alias("n"), F.sum("out").alias("s")).first()
        at = {r.w: r.out for r in out.filter("w % 999983 = 0").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    own = scans.limited(np.arange(n, dtype=np.int64) * 7919 % 1024 / 1024, np.full(n, 0.001), None)
    assert got.n == n and got.s == pytest.approx(own.sum(), rel=1e-9)
    assert all(v == pytest.approx(own[w], abs=1e-9) for w, v in at.items())
