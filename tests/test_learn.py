"""Grouped fits against one numpy fit per model; sketch-based buckets; curves by key."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscope.functions import running
from pairscope.operators import learn, thresholds

SOURCES = ("a", "b", "c")


def plain_fit(x, y, w, ridge):
    beta = np.zeros(x.shape[1])
    penalty = np.diag(np.r_[0.0, np.full(x.shape[1] - 1, ridge)])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        g = x.T @ (w * (p - y)) / w.sum() + penalty @ beta
        h = (x.T * (w * p * (1 - p))) @ x / w.sum() + penalty
        beta = beta - np.linalg.lstsq(h, g, rcond=None)[0]
    return beta


def scored_rows(seed=3, n=900):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s, u, v = rng.choice(SOURCES), rng.gauss(0, 2), rng.gauss(5, 1)
        z = 0.8 * u - 0.5 * (v - 5) + {"a": -1.0, "b": 0.0, "c": 0.7}[s] - 0.6
        out.append((k, s, rng.randrange(5), int(rng.random() < 1 / (1 + math.exp(-z))), u, v))
    return out


def test_every_variant_and_rotation_is_fitted_on_its_own_rows(spark):
    rows = scored_rows()
    frame = spark.createDataFrame(rows, "rna_id long, source string, fold int, label_delete int, u double, v double")
    found = learn.fit_delete_risk(frame, ["u", "v"], SOURCES).collect()
    got = {(r["variant"], r["rotation"], r["rna_id"]): r["p_delete"] for r in found}
    plans = {learn.POOLED_AWARE: (SOURCES, SOURCES), learn.POOLED_AGNOSTIC: (SOURCES, SOURCES)}
    plans |= {learn.SPECIFIC + s.upper(): ((s,), (s,)) for s in SOURCES}
    plans |= {learn.HELD_OUT + s.upper(): (tuple(x for x in SOURCES if x != s), (s,)) for s in SOURCES}
    expected = {}
    for variant, (use, scores) in plans.items():
        for k in range(5):
            train = [r for r in rows if r[2] not in (k, (k + 1) % 5) and r[1] in use]
            raw = np.array([r[4:] for r in train])
            mean, std = raw.mean(axis=0), raw.std(axis=0)

            def design(part):
                x = (np.array([r[4:] for r in part]) - mean) / std
                known = [[float(variant == learn.POOLED_AWARE and r[1] == s) for s in SOURCES[1:]] for r in part]
                return np.hstack([np.ones((len(part), 1)), x, np.array(known)])

            y = np.array([r[3] for r in train], dtype=float)
            w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
            beta = plain_fit(design(train), y, w, learn.RIDGE)
            test = [r for r in rows if r[2] == k and r[1] in scores]
            for r, z in zip(test, design(test) @ beta):
                expected[(variant, k, r[0])] = 1 / (1 + math.exp(-z))
    assert got.keys() == expected.keys() and len(found) == len(got)
    assert max(abs(got[k] - v) for k, v in expected.items()) < 1e-7


def test_platt_per_key_and_its_bound(spark):
    rng = random.Random(1)
    rows = [(g, z, int(rng.random() < 1 / (1 + math.exp(-(s * z - 0.4))))) for g, s in ((0, 1.3), (1, -0.9)) for z in [rng.gauss(0, 2) for _ in range(800)]]
    fitted = {r["g"]: (r["a"], r["b"]) for r in learn.platt_fit(spark.createDataFrame(rows, "g int, z double, y int"), "z", "y", ["g"]).collect()}
    mine = [(z, y) for g, z, y in rows if g == 0]
    x, y = np.array([[1.0, z] for z, _ in mine]), np.array([y for _, y in mine], dtype=float)
    b, a = plain_fit(x, y, np.ones(len(y)), 0.0)
    assert fitted[0] == pytest.approx((a, b), abs=1e-8)
    share = np.mean([y for g, _, y in rows if g == 1])
    assert fitted[1] == pytest.approx((0.0, math.log(share / (1 - share))))


def test_fits_refuse_one_class_and_separable_rows(spark):
    with pytest.raises(ValueError, match="one class"):
        learn.platt_fit(spark.createDataFrame([(0, 1.0, 1), (0, 2.0, 1)], "g int, z double, y int"), "z", "y", ["g"])
    with pytest.raises(RuntimeError, match="settle"):
        learn.platt_fit(spark.createDataFrame([(0, -1.0, 0), (0, 1.0, 1)], "g int, z double, y int"), "z", "y", ["g"])


def test_buckets_follow_each_group(spark, monkeypatch):
    monkeypatch.setattr(running, "BUCKET_ROWS", 50)
    rng = random.Random(2)
    rows = [("big", rng.gauss(0, 1)) for _ in range(2_000)] + [("far", 1e6 + rng.random()) for _ in range(400)] + [("small", float(k)) for k in range(20)] + [(None, 3.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    placed = running.value_buckets(frame, "v", ["g"]).collect()
    assert len(placed) == len(rows)
    for g, few, most in (("big", 20, 200), ("far", 4, 200), ("small", 1, 20), (None, 1, 1)):
        mine = sorted((r["v"], r["_bucket"]) for r in placed if r["g"] == g)
        assert [b for _, b in mine] == sorted(b for _, b in mine)
        sizes = [sum(b == k for _, b in mine) for k in {b for _, b in mine}]
        assert len(sizes) >= few and max(sizes) <= most
    found = {r["g"]: r["quantile"] for r in running.grouped_quantiles(frame, ["g"], "v", [0.5]).collect()}
    assert all(found[g] == pytest.approx(np.median([v for x, v in rows if x == g])) for g in ("big", "far", "small"))


def test_curves_by_key_equal_curves_apart(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k % 3, f"r{rng.randrange(9)}", rng.randrange(2), rng.randrange(40) / 40, bool(rng.randrange(5) == 0)) for k in range(600)]
    frame = spark.createDataFrame(rows, "key int, rna_id string, label_delete int, risk double, held boolean")
    apart = {k: thresholds.threshold_curve(frame.where(F.col("key") == k), "risk", fixed=F.col("held")).collect() for k in range(3)}
    monkeypatch.setattr(running, "BUCKET_ROWS", 10)
    whole = thresholds.threshold_curve(frame, "risk", fixed=F.col("held"), keys=["key"]).collect()
    assert len(whole) == sum(map(len, apart.values()))
    expected = {(k, r["threshold"]): r.asDict() for k, points in apart.items() for r in points}
    for r in whole:
        want = expected[(r["key"], r["threshold"])]
        assert {c: v for c, v in r.asDict().items() if c != "key"} == {c: pytest.approx(v) if isinstance(v, float) else v for c, v in want.items()}
    chosen = thresholds.threshold_select(thresholds.threshold_curve(frame, "risk", keys=["key"]), ["key"])
    assert chosen.count() <= 3


def test_fit_reads_each_distinct_feature_row_once(spark, monkeypatch):
    rows = [(k, s, f, d, float(u), float(v)) for k, s, f, d, u, v in scored_rows(n=300)]
    frame = spark.createDataFrame(rows, "rna_id long, source string, fold int, label_delete int, u double, v double")
    sizes, fit = [], learn.grouped_logistic

    def counted(part, *args):
        sizes.append(part.count())
        return fit(part, *args)

    monkeypatch.setattr(learn, "grouped_logistic", counted)
    once = {(r["variant"], r["rotation"], r["rna_id"]): r["p_delete"] for r in learn.fit_delete_risk(frame, ["u", "v"], SOURCES).collect()}
    many = learn.fit_delete_risk(frame.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))), ["u", "v"], SOURCES).collect()
    assert sizes[0] == sizes[1]
    assert len(many) == 20 * len(once) and max(abs(r["p_delete"] - once[r["variant"], r["rotation"], r["rna_id"]]) for r in many) < 1e-8
