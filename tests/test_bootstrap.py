"""The bias-corrected accelerated interval against a plain one on skewed data."""

import statistics as plain

import numpy as np

from glossmill.operators import statistics


def plain_bca(x, rng, replicates):
    """Both ends by resampling with replacement, and the ends without any correction."""
    normal = plain.NormalDist()
    means = rng.choice(x, (replicates, len(x))).mean(1)
    left_out = np.array([np.delete(x, i).mean() for i in range(len(x))])
    d = left_out.mean() - left_out
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    z0 = normal.inv_cdf((means < x.mean()).mean())
    at = []
    for p in (0.025, 0.975):
        z = z0 + normal.inv_cdf(p)
        at.append(normal.cdf(z0 + z / (1 - a * z)))
    return np.quantile(means, at), np.quantile(means, (0.025, 0.975))


def test_skewed(spark):
    rng = np.random.default_rng(11)
    values = {"up": rng.lognormal(0, 1, 40), "down": -rng.lognormal(0, 1, 60)}
    rows = [(m, float(v), i) for m, x in values.items() for i, v in enumerate(x)]
    got = {r.metric: r for r in statistics.bootstrap_bca(spark.createDataFrame(rows, "metric string, value double, id long"), 8000).collect()}
    for m, x in values.items():
        se = x.std() / np.sqrt(len(x))
        ends = np.array([got[m].ci_low, got[m].ci_high])
        corrected, percentile = plain_bca(x, rng, 40_000)
        assert np.abs(ends - corrected).max() < 0.15 * se
        assert np.abs(percentile - corrected).max() > 0.25 * se  # the correction shows
