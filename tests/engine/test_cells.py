"""Voronoi cells of many sites at once against the single-site kernel, with planes that only touch a cell."""

import numpy as np
import pyarrow as pa

from lattisphere.operators import batch, neighbors, voronoi

HALF = 0.5
SHAPES = {
    "simple cubic": (np.eye(3) * 10, [(0, 0, 0)]),
    "body centred": (np.eye(3) * 4, [(0, 0, 0), (HALF, HALF, HALF)]),
    "face centred": (np.eye(3) * 5, [(0, 0, 0), (HALF, HALF, 0), (HALF, 0, HALF), (0, HALF, HALF)]),
    "flat": (np.diag([3.0, 3.0, 20.0]), [(0, 0, 0), (0.1, 0.2, 0.05)]),
    "skew": (np.array([[6, 0, 0], [2, 5, 0], [-1, 2, 7.0]]), np.random.default_rng(3).random((9, 3)).tolist()),
    "two in one place": (np.eye(3) * 8, [(0, 0, 0), (0.4, 0.1, 0.2), (0.4, 0.1, 0.2), (0.7, 0.6, 0.9)]),
}


def table():
    rows = []
    for name, (cell, places) in SHAPES.items():
        for i, xyz in enumerate(np.array(places) @ cell):
            rows.append({"structure_id": name, "site_i": i, **dict(zip("xyz", xyz.tolist())), **{f"l{a}{b}": float(cell[a, b]) for a in range(3) for b in range(3)}, "p0": True, "p1": True, "p2": True})
    return pa.Table.from_pylist(rows)


def test_cells_equal_single_sites():
    chunk = batch.Chunk(table())
    found = {}
    for f in voronoi.cells(chunk, 6.0):
        for j, u in enumerate(f["u"].tolist()):
            base = int(chunk.start[chunk.of[u]])
            key = chunk.ids[u].as_py(), u - base, int(f["v"][j]) - base, int(f["ia"][j]), int(f["ib"][j]), int(f["ic"][j])
            found[key] = tuple(f[n][j] for n in ("dist", "solid_angle", "area", "volume"))
    expected = {}
    for name, (cell, places) in SHAPES.items():
        xyz = (np.array(places) @ cell).tolist()
        for u in range(len(xyz)):
            for f in voronoi.facets(cell, xyz, u, 6.0):
                expected[name, u, f["v"], *f["image"]] = tuple(f[n] for n in ("dist", "solid_angle", "area", "volume"))
    assert found.keys() == expected.keys()
    assert all(np.allclose(found[k], expected[k], atol=1e-9) for k in expected)
    for name, (cell, places) in SHAPES.items():
        if name != "two in one place":
            assert np.isclose(sum(x[3] for k, x in found.items() if k[0] == name), np.linalg.det(cell))


def test_strategies_work_on_chunks(spark):
    """No function runs for one structure at a time."""
    from lattisphere.plans import queries

    for name in ("nn_voronoi", "nn_crystal", "voronoi_volumes"):
        text = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in text and "ArrowEvalPython" not in text
    assert neighbors.STRATEGIES["voronoi"][1:] == (True, False)
