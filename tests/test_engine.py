"""Adjustment, members, resolution, snapshots and streams against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import text as tx
from cohortloom.operators import adjustment as ad
from cohortloom.operators import graph, members
from cohortloom.operators import validation as va
from cohortloom.sources import files


def test_logistic_fit_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    x = np.hstack([np.ones((300, 1)), (rng.random((300, 3)) > 0.5).astype(float)])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [0.3, 1.0, -0.5, 0.0])))).astype(float)
    rows = spark.createDataFrame([(r.tolist(), 1.0, float(o)) for r, o in zip(x, y)], "x array<double>, n double, y double").repartition(3)
    fit = ad.fit_logistic(rows, 4, lam=2.0)
    beta, mask = np.zeros(4), np.array([0, 1, 1, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(2 * mask), x.T @ (y - p) - 2 * mask * beta)
    assert fit.converged and np.allclose(fit.coefficients, beta, atol=1e-8)
    assert ad.fit_status(10, 300, 4, fit) == "insufficient_events" and ad.fit_status(100, 300, 4, fit) == "fitted"


def test_shape_is_the_best_of_a_fine_grid():
    rng = np.random.default_rng(0)
    e = rng.uniform(2, 60, 80)
    o = rng.poisson(e * rng.gamma(5, 1 / 5, 80)).astype(float)
    best = ad.fit_shape(o, e)
    fine = max(np.exp(np.linspace(math.log(0.5), math.log(1000), 4000)), key=lambda a: ad.marginal_log_likelihood(a, o, e))
    assert abs(math.log(best / fine)) < 0.01
    assert ad.fit_shape(e.round(), e) > 100


def test_replicates_draw_every_time_the_same():
    a, b = (list(ad.replicate_weights(list("edcba"), 7, "bootstrap:x:none", 3)) for _ in range(2))
    assert a == b and all(sum(d.values()) == 5 for d in a) and a[0] != a[1]


def test_auc_and_bins(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(12) / 12, rng.randrange(2)) for i in range(203)]
    df = spark.createDataFrame(rows, "member_id int, predicted double, outcome int")
    pairs = [(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in rows for b in rows if a[2] and not b[2]]
    assert va.roc_auc(df).first().auc == pytest.approx(sum(pairs) / len(pairs))
    sizes = [r.n for r in va.calibration_bins(df).orderBy("bin").collect()]
    assert sizes == [21, 21, 21] + [20] * 7
    assert va.roc_auc(df.where("outcome = 1")).first().auc is None


def test_canonical_members_do_not_depend_on_order(spark):
    rows = [("a", 2020, 1, 3), ("a", 2020, 2, 2), ("b", 2021, 0, 1), ("a", 2020, 2, 2)]
    make = lambda r: spark.createDataFrame([("judge", "j", "s", "m", i, y, None, c, f) for i, y, c, f in r], "subject_type string, subject_id string, source_id string, slug string, member_id string, anchor_year int, dimension_value string, counted_mask int, followed_mask int")
    # The same flags in each slot, dealt to the rows of a member in another way.
    other = [("a", 2020, 2, 2), ("b", 2021, 0, 1), ("a", 2020, 3, 3), ("a", 2020, 0, 2)]
    digest = lambda r: members.family_digest(members.canonical(make(r), 2), "k").first().digest
    assert digest(rows) == digest(other) != digest(rows[:3])
    assert members.canonical(make(rows), 2).agg(F.sum("multiplicity")).first()[0] == 4


def test_publishing_leaves_equal_subjects_alone(spark):
    keys, schema = ["subject_type", "subject_id", "year"], "subject_type string, subject_id string, year int, n int"
    old = spark.createDataFrame([("j", "a", 1, 5), ("j", "a", None, 5), ("j", "b", 1, 1), ("j", "b", 2, 2)], schema)
    new = spark.createDataFrame([("j", "a", 1, 5), ("j", "a", None, 5), ("j", "b", 1, 1), ("j", "b", 3, 2)], schema)
    got = {(r.subject_id, r.year): r.action for r in members.publish_plan(old, new, keys, ["n"]).collect()}
    assert got == {("a", "1"): "keep", ("a", None): "keep", ("b", "1"): "revive", ("b", "2"): "supersede", ("b", "3"): "insert"}


def test_chains_and_cycles_of_merges(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (5, 12), (20, 21), (30, None)], "id int, merged_into int")
    got = {r.id: r.survivor for r in graph.survivors(m).collect()}
    assert {i: got[i] for i in (1, 2, 3, 20)} == {1: 4, 2: 4, 3: 4, 20: 21} and 30 not in got
    assert {got[i] for i in (10, 11, 12, 5)} == {10}


def test_snapshots_are_verified(spark, tmp_path):
    t = spark.createDataFrame([("s", "a"), ("s", "b")], "source_id string, id string")
    path = files.export_snapshot(spark, {"persons": t}, str(tmp_path))
    assert files.export_snapshot(spark, {"persons": t.orderBy(F.desc("id"))}, str(tmp_path)) == path
    assert files.open_snapshot(spark, path)["persons"].count() == 2
    t.limit(1).write.mode("overwrite").parquet(f"{path}/persons")
    with pytest.raises(files.FrameError):
        files.open_snapshot(spark, path)
    with pytest.raises(files.FrameError):
        files.export_snapshot(spark, {"secrets": t}, str(tmp_path))


def test_artifacts(spark, tmp_path):
    path = files.write_artifact(spark, str(tmp_path), {"b": [1, 2], "a": {"x": 1}})
    assert files.read_artifact(spark, path) == {"a": {"x": 1}, "b": [1, 2]}
    assert files.first_difference({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}) == "$.a[1].b"
    assert files.significant(1.23456789012345) == 1.23456789012


def test_headers_are_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day\n 1 ,01/02/2020\n,x\n")
    rows = files.scan_csv(spark, str(tmp_path / "a.csv"), ["id", "day"])
    assert [r.id for r in files.read_export(rows, ["id"], ["id"], ["day"], "2019-01-01", "2021-01-01").collect()] == ["1"]
    with pytest.raises(files.FrameError):
        files.scan_csv(spark, str(tmp_path / "a.csv"), ["id"])


def test_names(spark):
    raw = ["José  Núñez-Ortíz, Jr.", "  O'BRIEN ", None, "Straße", "ﬁne"]
    df = spark.createDataFrame([(x,) for x in raw], "n string")
    assert [r[0] for r in df.select(tx.person_name(F.col("n"))).collect()] == ["jose nunez ortiz jr", "o brien", None, "strasse", "fine"]
    assert df.limit(1).select(tx.case_number(F.lit(" 19-cr/ 0042 ! "))).first()[0] == "19-CR-0042"
