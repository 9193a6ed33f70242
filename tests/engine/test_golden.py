"""Published identifiers of known crystals."""

import math

import pytest

from lattisphere.operators import graph, ids, kernel, labels, neighbors, sequences
from lattisphere.options import IdOptions
from lattisphere.sources import cif

A = 5.692
NA = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]
CL = [(0.5, 0.5, 0.5), (0.5, 0, 0), (0, 0.5, 0), (0, 0, 0.5)]
FCC = [[0, A / 2, A / 2], [A / 2, 0, A / 2], [A / 2, A / 2, 0]]
CUBE = [[A, 0.0, 0.0], [0.0, A, 0.0], [0.0, 0.0, A]]


def crystal(spark, named):
    """(structures, sites) from {id: (lattice, [(species, fractional)])}."""
    structures, sites = [], []
    for key, (cell, atoms) in named.items():
        structures.append((key, [[float(x) for x in row] for row in cell], [True] * 3, len(atoms)))
        for i, (s, f) in enumerate(atoms):
            sites.append((key, i, s, *(float(sum(f[r] * cell[r][c] for r in range(3))) for c in range(3)), None))
    return (
        spark.createDataFrame(structures, "structure_id string, lattice array<array<double>>, pbc array<boolean>, n_sites int"),
        spark.createDataFrame(sites, "structure_id string, site_i int, species string, x double, y double, z double, oxi double"),
    )


@pytest.fixture(scope="module")
def salts(spark):
    nacl = [("Na", f) for f in NA] + [("Cl", f) for f in CL]
    return crystal(spark, {"NaCl": (CUBE, nacl), "Cs": (CUBE, [("Cs", NA[0]), *nacl[1:]]), "primitive": (FCC, [("Na", (0, 0, 0)), ("Cl", (0.5, 0.5, 0.5))])})


def by_key(df, value="graph_id"):
    return {r.structure_id: r[value] for r in df.collect()}


def test_default_ids(salts):
    found = by_key(ids.graph_ids(*salts))
    assert found["NaCl"] == "NaCl-3D-88c8e156db1b0fd9"
    assert found["Cs"] == "CsNa3Cl4-3D-1a85e9c5247fb74a"


def test_topology_ids(salts):
    found = by_key(ids.graph_ids(*salts, IdOptions(topology_only=True)))
    assert found["NaCl"] == found["Cs"] == "3D-c144aa1ceffbd9af"


def test_maker_depth_and_site_ids(salts):
    assert by_key(ids.maker_ids(*salts))["NaCl"] == "NaCl-88c8e156db1b0fd9"
    assert by_key(ids.maker_ids(*salts, IdOptions(depth=2)))["NaCl"] == "NaCl-b54d6c6b1662ccdb"
    edges = graph.symmetric(neighbors.minimum_distance(*salts))
    rows = ids.site_ids(salts[1], edges).where("structure_id = 'NaCl'").collect()
    assert {r.site_id[:16] for r in rows if r.site_i < 4} == {"Na_Na-8ac4127fe1"} and {r.site_id[:16] for r in rows if r.site_i >= 4} == {"Cl_Cl-0d9c88475b"}


def test_reduce_makes_cells_agree(salts):
    options = IdOptions(depth=4, reduce=True)
    found = by_key(ids.maker_ids(*salts, options))
    assert found["NaCl"] == found["primitive"]
    plain = by_key(ids.maker_ids(*salts))
    assert plain["NaCl"] != plain["primitive"]
    edges = graph.symmetric(neighbors.minimum_distance(*salts))
    near = {r.site_i: r.site_id for r in ids.site_ids(salts[1], edges, options).where("structure_id = 'primitive'").collect()}
    assert "Na-ee0d78f1" in near[0] and "Cl-77752e7a" in near[1]


QUARTZ = {
    "298": (["x,y,z", "-y,x-y,2/3+z", "-x+y,-x,1/3+z", "y,x,-z", "x-y,-y,1/3-z", "-x,-x+y,2/3-z"], 4.9137, 5.4047, [("O", 0.413300007582, 0.267199993134, -0.214533343911), ("Si", 0.469700008631, 0.0, -0.333333343267)]),
}


def quartz(spark):
    ops, a, c, atoms = QUARTZ["298"]
    cell = cif.cell_matrix(a, a, c, 90, 90, 120)
    sites = cif.from_spacegroup(ops, cell, [s for s, *_ in atoms], [f for _, *f in atoms])
    assert len(sites) == 9
    structures = spark.createDataFrame([("q", cell, [True] * 3, 9)], "structure_id string, lattice array<array<double>>, pbc array<boolean>, n_sites int")
    rows = spark.createDataFrame([("q", i, s["species"], s["x"], s["y"], s["z"], None) for i, s in enumerate(sites)], "structure_id string, site_i int, species string, x double, y double, z double, oxi double")
    return structures, rows


def test_quartz(spark):
    q = quartz(spark)
    assert by_key(ids.graph_ids(*q))["q"] in ("SiO2-3D-aab30488e82694e7", "SiO2-aab30488e82694e7")
    assert by_key(ids.clustering_ids(*q))["q"] == "3f8e7842377ffa36"


def test_clustering_of_small_cells(spark):
    sc = (cif.cell_matrix(3.26609228, 3.26609228, 3.26609228, 60, 60, 60), [("Sc", (0, 0, 0))])
    layer = [(0, 0, 0.25), (0, 0, 0.75), (0.33333333, 0.66666667, 0.25), (0.66666667, 0.33333333, 0.75)]
    graphite = (cif.cell_matrix(2.46729126, 2.46729126, 7.80307300, 90, 90, 120), [("C", f) for f in layer])
    found = by_key(ids.clustering_ids(*crystal(spark, {"Sc": sc, "graphite": graphite})))
    assert found == {"Sc": "3b2bcf29df1ce648", "graphite": "06f29c886936a611"}


def test_joins_and_kernel_agree(salts):
    structures, sites = salts
    edges = graph.symmetric(neighbors.minimum_distance(structures, sites))
    names = labels.elements(sites)
    levels = sequences.level_strings(sites, edges, names, 3)
    joined = {(r.structure_id, r.site_i): r.cs for r in sequences.environments(levels).collect()}
    near = {(r.structure_id, r.site_i): r.cs for r in ids.kernel_rows(sites, edges, IdOptions(depth=3)).selectExpr("structure_id", "posexplode(cs) as (site_i, cs)").collect()}
    assert joined == near
    comps = {(r.structure_id, r.site_i): r.comp for r in graph.components(sites, edges).collect()}
    assert comps == {(r.structure_id, r.site_i): r.comp for r in graph.components_by_joins(sites, edges).collect()}
    wide = graph.components(sites, edges).groupBy("structure_id").agg({"diameter": "max"}).collect()
    reach = graph.diameter_by_joins(sites, edges).groupBy("structure_id").agg({"reach": "max"}).collect()
    assert sorted(map(tuple, wide)) == sorted(map(tuple, reach))


def test_option_errors():
    with pytest.raises(ValueError):
        IdOptions(wyckoff=True, loop=True)
    with pytest.raises(ValueError):
        IdOptions(loop=True, topology_only=True)


def test_rings_of_a_square():
    edges = [(u, v, 0, 0, 0) for u in range(4) for v in ((u + 1) % 4, (u - 1) % 4)]
    found = kernel.rings(0, 5, kernel.adjacency(4, edges))
    assert [len(r) for r in found] == [5]
    assert kernel.rings(0, 5, kernel.adjacency(2, [(0, 1, 0, 0, 0), (1, 0, 0, 0, 0)])) == []
    assert math.isclose(cif.cell_matrix(1, 2, 3, 90, 90, 90)[1][1], 2)
