"""Refitted replicates against a plain version."""

import inspect

import numpy as np
import pytest

from cohortloom.operators import adjustment as ad
from cohortloom.queries import adjustment as aq

SF = "/root/testdata/sf0.001"


def test_refits_are_the_plain_ones(spark):
    d, fit = aq._fitted(spark, SF)
    rows = d.rows.select("judge_id", "person_id", "outcome", d.vector().alias("x")).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.outcome for r in rows], dtype=float)
    got = {}
    for r in ad.refitted_sums(d, fit, 7, "bootstrap:x:none", 3).collect():
        got[r.replicate, r.judge_id] = (r.observed, r.expected)
    free = np.array([0.0] + [1.0] * (x.shape[1] - 1))
    want = {}
    for i, drawn in enumerate(ad.replicate_weights([r.person_id for r in rows], 7, "bootstrap:x:none", 3)):
        w = np.array([drawn.get(r.person_id, 0) for r in rows], dtype=float)
        beta = np.array(fit.coefficients)
        for _ in range(40):
            p = ad.expit(x @ beta)
            beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(free), x.T @ (w * (y - p)) - free * beta)
        p = ad.expit(x @ beta)
        for j in {r.judge_id for r in rows}:
            at = np.array([r.judge_id == j for r in rows])
            if w[at].sum():
                want[i, j] = (w[at] @ y[at], w[at] @ p[at])
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6)


def test_published_intervals_are_of_500_refitted_replicates(spark):
    assert inspect.signature(ad.observed_expected).parameters["replicates"].default == 500
    found = aq.ag10b(spark, SF).collect()
    assert found and {r.replicates for r in found} == {500}
