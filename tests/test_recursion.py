"""M13 by recursion: against plain NumPy, and its distance from the full solve."""
import numpy as np
import pandas as pd
import pytest

from trainlens.operators import vectors as V


def frame(spark, m, parts=3):
    return spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(m)), "grad": list(m)})).repartition(parts)


def plain(q, g, cfg):
    h = q / cfg.scale
    for _ in range(cfg.recursion_depth):
        h = h + (q - (h @ g.T) @ g / len(g) - cfg.damping * h) / cfg.scale
    return h


def result(spark, q, g, cfg, **kw):
    rows = V.ihvp_vectors(frame(spark, q), frame(spark, g), q.shape[1], cfg, **kw).collect()
    return np.array([r.vec for r in sorted(rows, key=lambda r: r.probe_id)])


@pytest.mark.parametrize("group_bytes", [1 << 20, 400])
def test_steps_against_numpy(spark, group_bytes):
    rng = np.random.default_rng(1)
    q, g = rng.normal(size=(17, 5)), rng.normal(size=(60, 5))
    for cfg in (V.InfluenceConfig(scale=12.0, recursion_depth=3), V.InfluenceConfig(recursion_depth=0)):
        assert np.allclose(result(spark, q, g, cfg, group_bytes=group_bytes), plain(q, g, cfg))


def test_error_bound_against_the_full_solve(spark):
    rng = np.random.default_rng(2)
    q, g = rng.normal(size=(6, 4)), rng.normal(size=(50, 4))
    f = g.T @ g / len(g)
    cfg = V.InfluenceConfig(damping=0.1, scale=4.0, recursion_depth=12)
    low, high = np.linalg.eigvalsh(f)[[0, -1]]
    assert high + cfg.damping <= cfg.scale
    full = np.linalg.solve(f + cfg.damping * np.eye(4), q.T).T
    shrink = (1 - (low + cfg.damping) / cfg.scale) ** cfg.recursion_depth
    gap = np.linalg.norm(result(spark, q, g, cfg) - full, axis=1)
    assert (gap <= shrink * np.linalg.norm(q / cfg.scale - full, axis=1) + 1e-9).all()
    # and the ranking it leads to
    got = V.ihvp_recursive_topk(frame(spark, q), frame(spark, g), 3, 4, cfg).collect()
    score = plain(q, g, cfg) @ g.T
    for i in range(6):
        assert [r.bank_id for r in sorted((r for r in got if r.probe_id == i), key=lambda r: r["rank"])] == np.argsort(-score[i], kind="stable")[:3].tolist()


def test_samples_are_averaged(spark):
    rng = np.random.default_rng(3)
    q, g = rng.normal(size=(3, 4)), rng.normal(size=(400, 4))
    one = result(spark, q, g, V.InfluenceConfig(scale=5.0, recursion_depth=6))
    four = result(spark, q, g, V.InfluenceConfig(scale=5.0, recursion_depth=6, num_samples=4))
    assert not np.allclose(one, four) and np.allclose(one, four, atol=0.1)
    # equal parts give the result of the whole
    same = result(spark, q, np.repeat(g[:1], 40, 0), V.InfluenceConfig(scale=50.0, recursion_depth=4))
    assert np.allclose(same, plain(q, g[:1], V.InfluenceConfig(scale=50.0, recursion_depth=4)))


def test_odd_input(spark):
    nan = float("nan")
    probes = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0])], "idx long, grad array<double>")
    bank = spark.createDataFrame([(7, [1.0, 0.0]), (8, [None, 1.0]), (9, None)], "idx long, grad array<double>")
    cfg = V.InfluenceConfig(scale=2.0, recursion_depth=2)
    rows = V.ihvp_vectors(probes, bank, 2, cfg).collect()
    assert [r.probe_id for r in rows] == [1] and np.allclose(rows[0].vec, plain(np.array([[1.0, 2.0]]), np.array([[1.0, 0.0]]), cfg)[0])
    assert V.ihvp_vectors(probes.limit(0), bank, 2, cfg).count() == 0
    # without a bank only the damping is left
    alone = V.ihvp_vectors(probes, bank.limit(0), 2, cfg).collect()
    assert np.allclose(alone[0].vec, plain(np.array([[1.0, 2.0]]), np.zeros((1, 2)), cfg)[0])
    with pytest.raises(ValueError, match="scale"):
        V.InfluenceConfig(scale=0).validate()


def test_few_products_are_held_at_once():
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(4)
    h, g = rng.normal(size=(6000, 4)), rng.normal(size=(9000, 4))
    scalar = [pa.scalar(x, pa.int32()) for x in (0, 0, 3)]
    block = pa.table({"n": [len(g)], "cells": pa.array([g.tobytes()], pa.binary())})
    tile = pa.table({"tile": pa.array([3], pa.int32()), "h": pa.array([h.tobytes()], pa.binary())})
    tracemalloc.start()
    out = V._curvature(4)(tuple(scalar), block, tile)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak  # all products would be 432 MB
    assert out.column("n").to_pylist() == [9000] and out.column("tile").to_pylist() == [3]
    assert np.allclose(V._matrix(out.column("cells")[0].as_py(), 4), (h @ g.T) @ g)


@pytest.mark.parametrize("samples", [1, 3])
def test_a_cell_has_one_tile_and_blocks_are_kept_small(spark, monkeypatch, samples):
    rng = np.random.default_rng(5)
    q, g = rng.normal(size=(40, 3)), rng.normal(size=(300, 3))
    g[7] = g[8]
    real, acc = V._curvature, spark.sparkContext.accumulator(0)

    def counted(dim):
        run = real(dim)

        def body(key, block, tile):
            if len(tile) > 1 or any(len(x.as_py()) > 3 * 3 * 8 for x in block.column("cells")):
                acc.add(1)
            return run(key, block, tile)
        return body
    monkeypatch.setattr(V, "_curvature", counted)
    got = result(spark, q, g, V.InfluenceConfig(scale=9.0, recursion_depth=2, num_samples=samples), group_bytes=1200)
    assert acc.value == 0  # more than a tile, or a block that is no smaller than its vectors
    if samples == 1:
        assert np.allclose(got, plain(q, g, V.InfluenceConfig(scale=9.0, recursion_depth=2)))
    r = V._factor(g)
    assert r.shape == (3, 3) and np.allclose(r.T @ r, g.T @ g) and len(V._factor(g[:2])) == 2
