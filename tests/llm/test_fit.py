import random

import numpy as np
import pytest

from palaver.llm.mixing import fit

SCHEMA = "doc_id long, n_tokens long, p array<double>"


def mixed(seed, rows=400, scarce=100):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        own = rng.uniform(0.6, 0.95) if i % scarce == 0 else rng.uniform(0.0, 0.05)
        u = rng.uniform(0.2, 0.9)
        out.append((i, rng.randint(5, 200), [(1 - own) * u, (1 - own) * (1 - u), own]))
    return out


def brute(rows, want, least, steps=200_000):
    """Projected gradient on every rate, one by one, to the least squares of the domain totals."""
    n = np.array([r[1] for r in rows], dtype=float)
    p = np.array([r[2] for r in rows])
    total = n.sum()
    r, y, t = np.ones(len(n)), np.ones(len(n)), 1.0
    step = total / np.linalg.eigvalsh(p.T @ (p * n[:, None])).max()
    for _ in range(steps):
        gap = (n * y) @ p / total - want
        if np.abs((n * r) @ p / total - want).max() < 1e-9:
            break
        new = np.maximum(least, y - step * (p @ gap))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / later * (new - r), new, later
    return r, (n * r) @ p / total


@pytest.mark.parametrize("want", [[0.5, 0.25, 0.25], [0.6, 0.37, 0.03], [0.2, 0.7, 0.1]])
def test_fit_meets_the_targets_as_brute_force_does(spark, want):
    rows = mixed(4)
    members = spark.createDataFrame(rows, SCHEMA)
    fitted, report = fit(members, 3, want)
    rates = np.array([r.rate for r in members.withColumn("rate", fitted.rate()).orderBy("doc_id").collect()])
    n, p = np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows])
    got = (n * rates) @ p / n.sum()
    assert (rates >= 0).all() and np.abs(got - want).max() < 2e-4 and report["gap"] < 2e-4
    _, other = brute(rows, np.array(want), 0.0)
    assert np.abs(got - other).max() < 3e-4


def test_no_rate_below_one_where_all_are_kept(spark):
    rows = mixed(7, scarce=3)
    members = spark.createDataFrame(rows, SCHEMA)
    fitted, report = fit(members, 3, [0.45, 0.2, 0.35], keep_all=True)
    rates = [r.rate for r in members.withColumn("rate", fitted.rate()).collect()]
    assert min(rates) >= 1 and report["gap"] < 2e-4


def test_fit_tells_targets_that_cannot_be_met(spark):
    members = spark.createDataFrame([(i, 10, [0.5, 0.5]) for i in range(20)], SCHEMA)
    with pytest.warns(UserWarning, match="not reached"):
        _, report = fit(members, 2, [0.8, 0.2])
    assert abs(report["gap"] - 0.3) < 0.01


def test_fit_of_nothing(spark):
    fitted, report = fit(spark.createDataFrame([], SCHEMA), 2, [0.5, 0.5])
    assert fitted.slopes == [0.0, 0.0] and report["gap"] == 0
