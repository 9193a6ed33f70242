"""Further sources, errors that users meet, and options of the coordination rules."""

import json
import math

import pytest

from lattisphere.operators import graph, ids, neighbors, radii, voronoi
from lattisphere.options import IdOptions
from lattisphere.sources import poscar, records

from .test_golden import CL, CUBE, NA, by_key, crystal
from .test_parts import SALT

POSCAR = """salt
5.692
1 0 0
0 1 0
0 0 1
Na Cl
4 4
Direct
0 0 0
0 0.5 0.5
0.5 0 0.5
0.5 0.5 0 Na
0.5 0.5 0.5
0.5 0 0
0 0.5 0
0 0 0.5
"""


def test_poscar():
    direct = poscar.parse(POSCAR)
    assert [s["species"] for s in direct["sites"]] == ["Na"] * 4 + ["Cl"] * 4 and direct["lattice"][1] == [0.0, 5.692, 0.0]
    volume = poscar.parse(POSCAR.replace("5.692", f"-{5.692**3}", 1))
    assert all(math.isclose(a["x"], b["x"]) and math.isclose(a["z"], b["z"]) for a, b in zip(direct["sites"], volume["sites"]))
    old = POSCAR.replace("Na Cl\n", "", 1).replace("salt", "Na Cl", 1).replace("Direct", "Selective dynamics\nCartesian")
    assert poscar.parse(old) == direct
    with pytest.raises(ValueError):
        poscar.parse(POSCAR.replace("0 0 0.5\n", ""))


def test_files_of_all_kinds(spark, tmp_path):
    from lattisphere.cli import identify

    (tmp_path / "POSCAR").write_text(POSCAR)
    (tmp_path / "b.vasp").write_text("broken")
    (tmp_path / "c.cif").write_text(SALT)
    found = {r.path.rsplit("/", 1)[1]: r.graph_id for r in identify(spark, [str(tmp_path)]).collect()}
    assert found == {"POSCAR": "NaCl-3D-88c8e156db1b0fd9", "b.vasp": "", "c.cif": "NaCl-3D-88c8e156db1b0fd9"}


def test_json_records(spark, tmp_path):
    data = [{"structure": SALT, "formation_energy_per_atom": -2.0}, {"structure": SALT, "formation_energy_per_atom": -1.0}, {"structure": "no", "formation_energy_per_atom": 0.5}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    structures, sites, fields = records.read(spark, f"{tmp_path}/d.json")
    found = ids.graph_ids(structures, sites).join(fields, "structure_id")
    assert sorted((r.graph_id, r.formation_energy_per_atom) for r in found.collect()) == [("NaCl-3D-88c8e156db1b0fd9", -2.0), ("NaCl-3D-88c8e156db1b0fd9", -1.0)]
    assert fields.count() == 3


def test_graph_errors(spark):
    structures, sites = crystal(spark, {"a": (CUBE, [("Na", f) for f in NA] + [("Cl", f) for f in CL])})
    edges = graph.symmetric(neighbors.minimum_distance(structures, sites))
    one = spark.createDataFrame(edges.limit(1).collect(), edges.schema)
    there, not_there = one, one.selectExpr("structure_id", "u", "v", "ia + 7 AS ia", "ib", "ic")
    assert graph.without_edges(edges, there, strict=True).count() == edges.count() - 2
    assert graph.without_edges(edges, not_there).count() == edges.count()
    with pytest.raises(Exception, match="no such bond in structure a"):
        graph.without_edges(edges, not_there, strict=True).collect()
    assert graph.empty(structures, sites).collect() == [] and ids.ids_of_graph(sites, graph.empty(structures, sites), IdOptions()).count() == 1
    with pytest.raises(Exception, match="no sites in structure a"):
        graph.empty(structures, sites.where("false")).collect()
    listed = [tuple(r) for r in graph.connectivity(edges).collect()]
    assert listed == sorted(listed) and len(listed) == edges.count()


def test_shapes_are_checked(spark):
    structures, sites = crystal(spark, {"a": (CUBE, [("Na", (0, 0, 0))])})
    with pytest.raises(ValueError, match="sites lacks x"):
        neighbors.bonds("minimum_distance", structures, sites.drop("x"))
    with pytest.raises(TypeError):
        neighbors.bonds("minimum_distance", structures, sites.withColumn("y", sites.y.cast("string")))
    with pytest.raises(Exception, match="3 x 3"):
        neighbors.bonds("minimum_distance", structures.selectExpr("structure_id", "slice(lattice, 1, 2) AS lattice", "pbc"), sites).collect()
    with pytest.raises(Exception, match="without coordinates"):
        neighbors.bonds("minimum_distance", structures, sites.selectExpr("structure_id", "site_i", "species", "x", "y", "IF(site_i = 0, NULL, z) AS z", "oxi")).collect()


def test_vanadium_antimonate(spark):
    """Molecules far apart: only the most likely coordination finds their bonds."""
    atoms = [("V", (0, 0, 0)), ("Sb", (0.5, 0.5, 0.5)), ("O", (0, 0.36862268, 0.36862268)), ("O", (0.5, 0.55918021, 0.44081979)), ("O", (0.5, 0.44081979, 0.55918021)), ("O", (0, 0.63137732, 0.63137732))]
    angle = math.radians(93.93754878)
    cell = [[17.05509494, 0, 0], [0, 21.76624210, 0], [0, 21.76624210 * math.cos(angle), 21.76624210 * math.sin(angle)]]
    structures, sites = crystal(spark, {"a": (cell, atoms)})
    found = by_key(ids.graph_ids(structures, sites, IdOptions(diameter_factor=1), strategy="crystal"))
    assert found["a"] == "VSbO4-0D-e50201525efe4cd5"


def pair(oxi, **options):
    """Likelihoods of the first site of two in a cube of 10."""
    coords, cube = [(0.0, 0.0, 0.0), (5.0, 0.0, 0.0)], [[10.0, 0, 0], [0, 10.0, 0], [0, 0, 10.0]]
    return voronoi.coordination(voronoi.facets(cube, coords, 0, 7.0), 0, ["Na", "Cl"], oxi, ids.ELECTRONEGATIVITY, **options)


def test_opposite_charges():
    assert {f["v"] for f in pair([1, -1], cation_anion=True, distance_cutoffs=None)[1]} == {1}
    assert {f["v"] for f in pair([1, -1], distance_cutoffs=None)[1]} == {0, 1}
    assert {f["v"] for f in pair([0, None], cation_anion=True, distance_cutoffs=None)[1]} == {0}  # a state of 0 goes with every known one
    for states in ([1, None], [1, 1]):
        with pytest.raises(ValueError, match="opposite charge"):
            pair(states, cation_anion=True)
    with pytest.raises(ValueError, match="oxidation state"):
        pair([None, -1], cation_anion=True)


def test_radii_of_states():
    table = {"Na": {1: 1.16}, "Cl": {-1: 1.67, 1: 0.5, 3: 0.7}}
    assert [radii.radius_of(*x, table) for x in (("Na", 1), ("Cl", 2), ("Cl", 1), ("Cl", 5), ("Na", -1), ("Na", None), ("Qq", 1))] == [1.16, pytest.approx(0.6), 0.5, pytest.approx(0.6), 1.66, 1.66, 0.0]
    assert pair([1, -1], radii=[1.16, 1.67])[0] == {0: 1.0} and len(pair([1, -1], radii=[2.0, 2.5])[1]) > 0
    with pytest.warns(UserWarning, match="no radius"):
        pair([1, -1], radii=[1.16, 0.0])
    assert pair([1, -1], fingerprint_length=6)[0] == {0: 1.0, **dict.fromkeys(range(1, 6), 0.0)}


def test_named_cutoffs():
    assert radii.preset_cutoffs("covalent", ["Na", "Cl"]) == radii.covalent_cutoffs(["Na", "Cl"])
    with pytest.raises(ValueError):
        radii.preset_cutoffs("none", ["Na"])


def test_cell_lists_find_the_same_bonds(spark):
    from lattisphere.plans.queries import crystals

    structures, sites = crystals(spark, "/root/testdata/sf0.001")
    structures, sites = structures.where("structure_id < 400"), sites.where("structure_id < 400")
    table = {("AF", "NO"): 4.0, ("RF", "RF"): 5.0}
    for name, options in (("minimum_distance", {"cutoff": 8.4}), ("cutoff_dict", {"cutoffs": table}), ("brunner_real", {}), ("econ", {"cutoff": 5.0})):
        key = lambda r: (r.structure_id, r.u, r.v, r.ia, r.ib, r.ic)
        plain, mixed = ({key(r): r.weight for r in neighbors.bonds(name, structures, sites, **options, **more).collect()} for more in ({}, {"binned_above": 3}))
        assert mixed == pytest.approx(plain) and len(plain) > 50
