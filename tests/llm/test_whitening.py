"""Whitening against numpy's own eigendecomposition of the whole table."""

import math

import numpy as np
import pytest

from cloakroom.llm import whitening as w


def plain(rows):
    """x, distinct x, eigenvalues (falling) and eigenvectors of (id, vector) rows."""
    valid = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in valid], dtype=np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.sum(axis=0) / len(fit)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return [i for i, _ in valid], x, fit, values[::-1], axes[:, ::-1]


def check(df, components=16, id_col="vec_id", vec_col="embedding"):
    got = [r.asDict() for r in w.whiten(df, components, id_col, vec_col).collect()]
    ids, x, fit, values, axes = plain([(r[0], r[1]) for r in df.select(id_col, vec_col).collect()])
    k, n, s = min(components, x.shape[1]), len(fit), fit.sum(axis=0)
    assert len(got) == len(ids) * k
    assert {(g["n"], g["identity_error"]) for g in got} == {(n, got[0]["identity_error"])} and got[0]["identity_error"] < 1e-9
    assert sorted((str(g["vec_id"]), g["component"]) for g in got) == sorted((str(i), c + 1) for i in ids for c in range(k))
    if None not in ids and len(set(ids)) == len(ids):
        place = {i: p for p, i in enumerate(ids)}
        white = np.zeros((len(ids), k))
        for g in got:
            white[place[g["vec_id"]], g["component"] - 1] = g["whitened"]
            assert g["deviation"] == sum(int(n * a - b) ** 2 for a, b in zip(x[place[g["vec_id"]]], s)) or g["component"] > 1
            assert g["explained"] == pytest.approx(values[g["component"] - 1] / values.sum(), rel=1e-10)
        want = (x - s / n) @ axes[:, :k] / np.sqrt(values[:k])
        for c in range(k):
            assert min(np.abs(want[:, c] - white[:, c]).max(), np.abs(want[:, c] + white[:, c]).max()) < 1e-7
    return got


def test_embeddings(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))


@pytest.mark.parametrize("rows_each, fan_in", [(8, 3), (50, 2), (1000, 16)])
def test_many_spectra(spark, monkeypatch, rows_each, fan_in):
    monkeypatch.setattr(w, "ROWS_EACH", rows_each)
    monkeypatch.setattr(w, "FAN_IN", fan_in)
    rng = np.random.default_rng(rows_each)
    x = rng.standard_normal((120, 12)) @ np.diag(np.linspace(0.2, 4, 12)) + 3
    check(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 5)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5)]
    kind = "vec_id long, embedding array<double>"
    base = spark.createDataFrame(good + odd, kind)
    first = check(base)
    assert {g["vec_id"] for g in first} == set(range(40))
    # other lengths, repeated rows, null ids and columns of clashing names change nothing for the rest
    more = spark.createDataFrame(good + odd + good[:3] * 20 + [(None, good[0][1]), (7, [1.0, 2.0])], kind)
    for c in ("id", "v", "y", "n", "deviation", "whitened"):
        more = more.selectExpr("*", f"'x' AS {c}")
    again = w.whiten(more).collect()
    by = {(g["vec_id"], g["component"]): g for g in first}
    assert len(again) == 6 * (40 + 60 + 1)
    for g in again:
        if g["vec_id"] is not None:
            want = by[g["vec_id"], g["component"]]
            assert (g["deviation"], g["n"]) == (want["deviation"], 40) and abs(abs(g["whitened"]) - abs(want["whitened"])) < 1e-9


def test_little_or_no_variance(spark):
    kind = "vec_id long, embedding array<double>"
    assert w.whiten(spark.createDataFrame([], kind)).collect() == []
    assert w.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], kind)).collect() == []
    rows = w.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [4.0, 1.0])], kind)).collect()
    assert [r["component"] for r in rows] == [1, 1, 1] and all(r["explained"] == 1.0 for r in rows)
    with pytest.raises(Exception, match="beyond the range"):
        w.whiten(spark.createDataFrame([(1, [0.0, 1e9]), (2, [2.0, -1e9]), (3, [4.0, 1e9])], kind)).collect()


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_rank_one_updates(d):
    rng = np.random.default_rng(d)
    values, vectors, whole = np.zeros(d), np.eye(d), np.zeros((d, d))
    for i in range(150):
        v = rng.integers(-9, 9, d).astype(float)
        if i % 5 == 0:
            v[: d // 2] = 0
        rho = 0.5 if i % 3 else 1e-9
        whole += rho * np.outer(v, v)
        values, vectors = w.rank_one(values, vectors, v, rho)
    assert np.abs(values - np.linalg.eigvalsh(whole)).max() < 1e-12 * max(1, values[-1])
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    assert np.abs(whole @ vectors - vectors * values).max() < 1e-12 * max(1, values[-1])


def test_merged_spectra_before_refinement():
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (300, 10))
    parts = []
    for rows in (x[:4], x[4:150], x[150:]):
        s = w.Spectrum.empty(10)
        for r in rows:
            s.add(r)
        parts.append(s)
    s = parts[0].merge(parts[2]).merge(w.Spectrum.empty(10)).merge(parts[1])
    c = x - x.mean(axis=0)
    assert s.n == 300 and (s.sums == x.sum(axis=0)).all()
    assert np.abs(s.values - np.linalg.eigvalsh(c.T @ c)).max() < 1e-9
