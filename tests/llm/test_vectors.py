import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import vectors


@pytest.mark.parametrize("cell", [32, 100_000])
def test_near_vectors_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL_VECTORS", cell)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "FEW", 2 * cell)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    for i in range(200, 400):  # near and exact copies
        x[i] = x[rng.integers(0, 150)] + (0 if i % 5 == 0 else rng.normal(size=16) * 0.15)
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, float("inf")] * 8), (None, [float(v) for v in x[0]])]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + bad
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    y = np.vstack([x, x[:1]]).astype(float)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(400))
    assert len(got) == len(rows) and all(got[i].n_links <= near[i].sum() for i in range(400)) and found >= 0.95 * near[:400].sum()
    for i in range(1000, 1005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [8, 16, 64, 384])
def test_recall_at_the_threshold(width):
    """Pairs of cosine exactly 0.9, the hardest ones, mostly meet in a cell, whatever the length."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    x = unit(rng.normal(size=(3000, width)))
    u = rng.normal(size=(3000, width))
    u = unit(u - (u * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * u
    centres = vectors.spherical_kmeans(unit(rng.normal(size=(3000, width))), 64)
    cells = []
    for z in (x, y):
        rows = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([1] * 3000), pa.array([width] * 3000, pa.int32()), pa.array([r.tobytes() for r in z])], ["cid", "n", "width", "vector"])
        out = pa.Table.from_batches(vectors._assign([rows], {width: (0, centres)}, vectors.REACH, "<f8"))
        cells.append((out.column("home").to_pylist(), out.column("cells").to_pylist()))
    (hx, cx), (hy, cy) = cells
    assert sum(a in d or b in c for a, b, c, d in zip(hx, hy, cx, cy)) >= 0.97 * 3000


def test_vectors_of_other_lengths_doubles_and_repeated_keys(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1e300, 1e300]), (4, [1.0, 1.0]), (5, [1e-310, 1e-310]), (4, [1.0, 1.0]), (6, []), (7, [-0.0, 1.0]), (8, [0.0, 1.0]), (None, [0.0, 5.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<double>, cid string, home int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [(-1, 2, 7, False), (1, 1, 1, True), (2, 1, 1, False), (3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False), (5, 3, 3, False), (6, 0, 6, True), (7, 2, 7, True), (8, 2, 7, False)]
