"""Whitening against a plain decomposition of all vectors at once."""

import math

import numpy as np
import pytest

from sentinelle.llm import whitening
from sentinelle.llm.q_whitening import op12_whitening

SF = "/root/testdata/sf0.001"


def brute(ids, vectors, most=32):
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array(x) - np.array(total) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, total, strict=True)) for r in x]
    return n, dict(zip(ids, deviation, strict=True)), dict(zip(ids, (centred @ v[:, :most] / np.sqrt(e[:most])).tolist(), strict=True)), e[:most] / e.sum()


def check(got, ids, vectors, k):
    n, deviation, white, explained = brute(ids, vectors, k)
    sign = {}
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in ids for c in range(1, k + 1))
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-8)
        assert r.identity_error < 1e-9
        want = white[r.vec_id][r.component - 1]
        if abs(want) > 0.1:
            assert sign.setdefault(r.component, r.whitened * want > 0) == (r.whitened * want > 0)
        assert abs(abs(r.whitened) - abs(want)) < 1e-6


@pytest.mark.parametrize("tasks", [1, 70])
def test_all_embeddings(spark, tasks, tmp_path):
    whole = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole.repartition(tasks).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = whole.collect()
    check(op12_whitening(spark, str(tmp_path)).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(0, i % 3 + 1, 5)], "x") for i in range(40)] + [(3, [9.0, 9.0, 0.0, 1.0, -7.0], "x")]
    bad = [(90, None, "x"), (91, [1.0, None, 1.0, 1.0, 1.0], "x"), (92, [1.0, float("nan"), 1.0, 1.0, 1.0], "x"), (93, [float("inf")] * 5, None), (94, [], "x"), (95, [1.0, 2.0], "x")]
    # The further column bears the name of one of the result's.
    df = spark.createDataFrame(good[:40] + bad, "vec_id long, embedding array<float>, vector string")
    check(whitening.whitened(df).collect(), [i for i, *_ in good[:40]], [np.float32(v).tolist() for _, v, _ in good[:40]], 5)
    again = whitening.whitened(spark.createDataFrame(good, "vec_id long, embedding array<double>, component string").repartition(9)).collect()
    assert len(again) == 41 * 5 and {r.n for r in again} == {41}
    assert whitening.whitened(df.where("false")).collect() == []
    assert whitening.whitened(df.where("vec_id = 90")).collect() == []
    assert whitening.whitened(df.where("vec_id = 94")).collect() == []
    assert whitening.whitened(df.where("vec_id = 0")).collect() == []


def test_flat_dimensions_have_no_component(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_null_ids_and_long_vectors(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(None if i == 4 else i, rng.normal(0, 1, 700).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    got = whitening.whitened(df.repartition(11)).collect()
    assert len(got) == 50 * 32 and sum(r.vec_id is None for r in got) == 32 and got[0].identity_error < 1e-8


def test_deviation_stays_exact_and_is_refused_beyond_64_bits(spark):
    big = spark.createDataFrame([(0, [2.0**20]), (1, [-(2.0**20)]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whitened(big).collect()}[0] == (3 * 2**26 - 64) ** 2
    w = whitening.Whitening(3, [0], np.eye(1), np.ones(1), np.ones(1))
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[2**40]]), w)
