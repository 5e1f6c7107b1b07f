"""Chi-square and Mann-Whitney against plain computations."""

import math
import random

import pytest

from adgauge.operators import significance

KEYS = ["k"]


def made(spark, rows):
    return spark.createDataFrame(rows, "k string, cohort_type string, metric_value double").repartition(3)


def normal_p(z):
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def test_chi_square(spark):
    rows = [("a", "exposed", 1.0)] * 30 + [("a", "exposed", 0.0)] * 10 + [("a", "control", 1.0)] * 20 + [("a", "control", 0.0)] * 20
    rows += [("empty", "exposed", 1.0), ("empty", "control", 1.0), ("one arm", "exposed", 1.0), ("one arm", "exposed", 0.0)]
    rows += [("scale", "exposed", 3.0), ("scale", "control", 0.0), ("a", None, 1.0), ("a", "exposed", None)]
    got = {r.k: r for r in significance.chi_square(made(spark, rows), KEYS).collect()}
    assert set(got) == {"a", "empty", "one arm"}
    want = 80 * (30 * 20 - 10 * 20) ** 2 / (40 * 40 * 50 * 30)
    assert got["a"].chi_square == pytest.approx(want) and got["a"].p_value == pytest.approx(normal_p(math.sqrt(want)))
    assert got["a"].is_significant and got["a"].statistical_test == "chi-square"
    assert (got["empty"].p_value, got["one arm"].chi_square, got["empty"].is_significant) == (None, None, False)


def brute_u(e, c):
    both = sorted(e + c)
    ranks = {x: (both.index(x) + 1 + both.index(x) + both.count(x)) / 2 for x in set(both)}
    n1, n2, n = len(e), len(c), len(both)
    u = sum(ranks[x] for x in e) - n1 * (n1 + 1) / 2
    ties = sum(both.count(x) ** 3 - both.count(x) for x in set(both))
    v = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))) if n > 1 else 0
    return u, (u - n1 * n2 / 2) / math.sqrt(v) if v > 0 else None


def test_mann_whitney(spark):
    rng = random.Random(5)
    arms = {
        "ties": ([rng.randint(0, 5) for _ in range(80)], [rng.randint(1, 6) for _ in range(50)]),
        "apart": ([rng.random() for _ in range(400)], [rng.random() + 0.2 for _ in range(300)]),
        "same": ([2, 2, 2], [2, 2]), "one": ([1], [2]), "no control": ([1, 2, 3], []), "alone": ([4], []),
    }
    rows = [(k, arm, float(x)) for k, pair in arms.items() for arm, xs in zip(("exposed", "control"), pair, strict=True) for x in xs]
    rows += [("ties", "exposed", None), ("ties", None, 1.0)]
    got = {r.k: r for r in significance.mann_whitney(made(spark, rows), KEYS).collect()}
    assert set(got) == set(arms)
    for k, (e, c) in arms.items():
        u, z = brute_u(e, c)
        assert got[k].u_statistic == pytest.approx(u) and (got[k].exposed_sample_size, got[k].control_sample_size) == (len(e), len(c))
        assert got[k].z_statistic == (None if z is None else pytest.approx(z)) and got[k].p_value == (None if z is None else pytest.approx(normal_p(z)))


def test_midranks_of_one_key_over_several_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", "exposed" if i % 3 else "control", float(i * 7 % 501)) for i in range(2000)]
        ranks = significance.midranks(made(spark, rows), KEYS).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    values = sorted(v for _, _, v in rows)
    assert len(ranks) == 501
    for r in ranks:
        assert r.before == values.index(r.value) and r.midrank == r.before + (values.count(r.value) + 1) / 2


def test_empty_table(spark):
    assert significance.chi_square(made(spark, []), KEYS).collect() == significance.mann_whitney(made(spark, []), KEYS).collect() == []
