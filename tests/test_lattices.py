"""Invariants of the lattices, the code, the recall and the folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import consolidate, e8, golay, hadamard, leech, recall


def brute_nearest(v):
    """All codewords, both cases, parity mended by every single move."""
    y, best = np.asarray(v) * np.sqrt(8), (np.inf, None)
    for case in (0, 1):
        for g in leech.codebook():
            c = 2 * g + case
            p = 4 * np.round((y - c) / 4) + c
            options = [p]
            for i in range(24):
                q = p.copy()
                q[i] += 4 if y[i] >= p[i] else -4
                options.append(q)
            for q in options:
                if q.sum() % 8 == 4 * case and ((y - q) ** 2).sum() < best[0]:
                    best = (((y - q) ** 2).sum(), q)
    return best


def test_nearest_is_exact():
    for v in np.random.default_rng(1).normal(0, 1, (3, 24)):
        y, d2 = leech.nearest(v)
        d, point = brute_nearest(v)
        assert abs(d2[0] * 8 - d) < 1e-9
        assert (y[0] == point).all()


def test_index_is_a_bijection_and_points_are_fixed():
    y, _ = leech.nearest(np.random.default_rng(2).normal(0, 1.5, (64, 24)))
    g, c, z = leech.decompose(y)
    points = leech.reconstruct(g, c, z)
    assert np.allclose(points * np.sqrt(8), y)
    again, d2 = leech.nearest(points)
    assert (again == y).all() and d2.max() < 1e-18
    with pytest.raises(ValueError):
        leech.decompose(y + np.eye(24, dtype=int)[0])


def test_origin():
    y, d2 = leech.nearest(np.zeros((1, 24)))
    assert not y.any() and d2[0] == 0


def test_theta_series():
    assert leech.theta(6) == [1, 0, 196560, 16773120, 398034000, 4629381120]
    assert abs(sum(leech.shell_prior(30, 4.0)) - 1) < 1e-12


def test_code_corrects_three_errors_and_detects_four(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(200):
        m = int(rng.integers(4096))
        word = m | golay._parity(m) << 12
        n = k % 5
        for b in rng.choice(24, n, replace=False):
            word ^= 1 << int(b)
        rows.append((m, n, word))
    out = golay.decode(spark.createDataFrame(rows, "m long, n int, word long")).collect()
    for r in out:
        assert (r.message, r.errors) == ((r.m, r.n) if r.n < 4 else (None, None))


def test_weights(spark):
    found = {r.weight: r["count"] for r in golay.codebook(spark).groupBy("weight").count().collect()}
    assert found == {0: 1, 8: 759, 12: 2576, 16: 759, 24: 1}


def test_roots():
    table = np.asarray(e8.roots())
    assert table.shape == (240, 8) and np.allclose((table**2).sum(axis=1), 2)


def clustered(n=600, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1.5, (16, 24))
    rows = centres[rng.integers(16, size=n)] + rng.normal(0, 0.15, (n, 24))
    asked = rows[rng.choice(n, 16, replace=False)] + rng.normal(0, 0.1, (16, 24))
    return rows, asked


def test_recall_against_brute_force(spark):
    rows, asked = clustered()
    frame = lambda x: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    r, q = frame(rows), frame(asked)
    truth = recall.exact(r, q, 10)
    d2 = ((asked[:, None] - rows[None]) ** 2).sum(axis=2)
    want = {(k, int(i)) for k in range(16) for i in d2[k].argsort(kind="stable")[:10]}
    assert {(x.qid, x.rid) for x in truth.collect()} == want
    # however the rows lie over partitions
    assert {(x.qid, x.rid) for x in recall.exact(r.repartition(7), q.repartition(3), 10).collect()} == want
    assert recall.recall_at(recall.by_projection(r, q, 10, radius=1.5), truth).first().recall > 0.9
    assert recall.recall_at(recall.by_cell(r, q, 10), truth).first().recall > 0.3


def test_projection_probes_27_cells(spark):
    rows, asked = clustered()
    frame = lambda x: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {(x.qid, x.rid) for x in recall.by_projection(frame(rows), frame(asked), 1000).collect()}
    votes = np.zeros((16, len(rows)), int)
    for m in recall.projections():
        votes += (((asked @ m)[:, None] - (rows @ m)[None]) ** 2).sum(axis=2) <= 1.0
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(votes >= 2))}


def test_consolidation_keeps_mass_and_bits(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1.5, (12, 24))
    rows = (centres[rng.integers(12, size=120)] + rng.normal(0, 0.05, (120, 24))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id long, v array<double>")
    assigned = consolidate.assign(df, 1.0)
    sites = consolidate.alpha(consolidate.sites(assigned), 1.0)
    report = consolidate.audit(assigned, sites).first()
    assert report.drift < 1e-9 and report.sites < 120
    back = consolidate.reconstruct(assigned, sites)
    restored = consolidate.restore(back, consolidate.residuals(back)).orderBy("id").collect()
    assert (np.asarray([r.v for r in restored], dtype=np.float32) == rows.astype(np.float32)).all()


def test_wrong_width_raises(spark):
    df = spark.createDataFrame([(1, [1.0] * 23)], "id long, v array<double>")
    with pytest.raises(Exception, match="24 entries"):
        consolidate.assign(df).collect()


def test_hadamard_inverse():
    a = np.random.default_rng(4).normal(size=(5, 32))
    assert np.allclose(hadamard.rht(hadamard.rht(a, 9), 9, True), a)
    with pytest.raises(ValueError):
        hadamard.fwht(np.ones((1, 12)))


def test_snap_is_idempotent(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(0, 2, (50, 8)))], "id long, v array<double>")
    once = df.select("id", e8.nearest_point(F.col("v"))["point"].alias("v"))
    assert once.select(e8.nearest_point(F.col("v"))["d2"].alias("d")).agg(F.max("d")).first()[0] == 0
    # the coset of half integers has an odd sum of y - 1/2 by the default rule, an even one by the other
    p = {x: df.select(e8.nearest_point(F.col("v"), x)["point"].alias("p")).collect() for x in ("odd", "even")}
    for rule, rest in (("odd", 1), ("even", 0)):
        for r in p[rule]:
            y = np.asarray(r.p)
            assert y.sum() % 2 == 0 if (y == np.rint(y)).all() else (y - 0.5).sum() % 2 == rest
