"""Kernels over whole structures: against the joins and the one-structure kernels, and what their plans no longer hold."""

import math
from pathlib import Path

import pytest

from lattisphere.operators import geometry, graph, ids, kernel, labels, neighbors, sequences
from lattisphere.options import IdOptions
from lattisphere.plans import queries, session

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def some(spark):
    structures, sites = queries.crystals(spark, SF)
    return structures.where("structure_id < 60"), sites.where("structure_id < 60")


def rows(df, *rounded):
    return sorted(tuple(round(r[c], 9) if c in rounded else str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["nn_min_distance", "nn_all_sites", "nn_okeeffe", "nn_brunner_real", "nn_brunner_relative", "nn_brunner_reciprocal", "nn_econ", "distance_clusters", "nn_distance_cluster"])
def test_pairs_are_never_sorted(spark, name):
    """The one window numbers the sites; none runs over pairs, and one shuffle deals sites and structures alike."""
    text = plan(queries.queries()[name](spark, SF))
    assert text.count("Window [") == 1 and "Generate" not in text and "raise_error" not in text


@pytest.mark.parametrize("name", ["graph_ids_md5_depth3", "component_ids_blake2b", "level_strings_depth3", "shell_counts_depth3", "merged_ids_kernel_md5", "graph_ids_rings", "reduced_ids"])
def test_ids_need_no_second_grouping_of_edges(spark, name):
    text = plan(queries.queries()[name](spark, SF))
    assert "MapInArrow" in text and "collect_list(struct(u" not in text and "lattisphere-shell" not in text


def test_strategies_equal_windows_over_pairs(some):
    table = {("AF", "NO"): 4.0, ("RF", "RF"): 5.0}
    for name, options in (("minimum_distance", {"cutoff": 8.4}), ("cutoff_dict", {"cutoffs": table}), ("brunner_real", {}), ("brunner_relative", {}), ("brunner_reciprocal", {}), ("econ", {"cutoff": 6.0})):
        made = neighbors.bonds(name, *some, **options)
        with geometry.by_bins():
            other = neighbors.bonds(name, *some, **options)
        assert rows(made, "weight") == rows(other, "weight"), name


def test_levels_equal_joins(some):
    structures, sites = some
    made = neighbors.bond_rows(structures, sites, cutoff=8.4)
    edges = graph.edges_of(made)
    by_joins = sequences.level_strings(sites, edges, labels.elements(sites), 3)
    assert rows(sequences.level_strings_of(made, 3)) == rows(by_joins)
    counts = sequences.shell_counts(sites, edges, labels.elements(sites), 3)
    assert rows(sequences.shell_counts_of(made, 3)) == rows(counts)
    assert rows(sequences.shell_counts_of(made, 3, cumulated=True)) == rows(sequences.cumulative(counts))


def test_ids_equal_single_structures(some):
    made = neighbors.bond_rows(*some, cutoff=8.4)
    options = IdOptions()
    found = {r.structure_id: r for r in ids.kernel_rows_of(made, options).collect()}
    assert len(found) > 40
    for r in made.collect():
        edges = [tuple(e) for e in r.edges]
        n, own = len(r.species), found[r.structure_id]
        comp, cs = kernel.sequences(n, edges, r.species, options.diameter_factor, options.additional_depth)
        assert (own.comp, own.cs, own.dim) == (comp, cs, kernel.dimension(n, edges))
        assert own.graph_id == kernel.structure_digest(kernel.component_digests(comp, cs))


def test_tied_distances_stay_in_one_cluster(spark):
    """Two atoms at the same distance beyond a gap belong to one run, whichever of them is sorted first."""
    side = 40.0
    cell = [[side if i == j else 0.0 for j in range(3)] for i in range(3)]
    xyz = [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.3, 0.0, 0.0), (0.0, 4.0, 0.0), (0.0, -4.0, 0.0), (0.0, 0.0, 5.5)]
    structures = spark.createDataFrame([(1, cell, [True] * 3)], "structure_id long, lattice array<array<double>>, pbc array<boolean>")
    sites = spark.createDataFrame([(1, i, "X", *p, None) for i, p in enumerate(xyz)], "structure_id long, site_i int, species string, x double, y double, z double, oxi double")
    d = sorted([0.0, *[math.dist(xyz[0], p) for p in xyz[1:]]])
    runs = [[d[0]]]
    for a, b in zip(d, d[1:]):
        runs.append([b]) if b - a > 0.5 else runs[-1].append(b)
    expected = [(k, run[-1]) for k, run in enumerate(x for x in runs if len(x) > 1)]
    assert expected == [(0, 2.3), (1, 4.0)]
    found = neighbors.distance_clusters(structures, sites).where("u = 0").orderBy("k").collect()
    assert [(r.k, r.bound) for r in found] == expected
    bonds = neighbors.cluster_bonds(structures, sites).where("u = 0").collect()
    assert sorted((r.k, r.v) for r in bonds) == [(0, 1), (0, 2), (1, 3), (1, 4)]


def test_components_of_parts_of_structures(spark, some):
    """Edges are contracted before they are joined; with few at a time, stars of parts have to be joined."""
    structures, sites = some
    edges = graph.edges_of(neighbors.bond_rows(structures, sites, cutoff=8.4))
    expected = rows(graph.components(sites, edges).drop("diameter"))
    assert rows(graph.components_by_joins(sites, edges)) == expected == rows(graph.components_by_joins(sites, edges, rows=3))
    chain = spark.range(199).selectExpr("'long' AS structure_id", "INT((id * 7) % 199) AS u", "INT((id * 7) % 199 + 1) AS v", "0 AS ia", "0 AS ib", "0 AS ic")
    atoms = spark.range(201).selectExpr("'long' AS structure_id", "INT(id) AS site_i")
    for at_once in (2, 50, 1000):
        found = graph.components_by_joins(atoms, graph.symmetric(chain), rows=at_once).collect()
        assert {r.site_i: r.comp for r in found} == {i: 200 if i == 200 else 0 for i in range(201)}
    written = len(session._written)
    graph.components_by_joins(sites, edges)
    assert len(session._written) == written + 1


def test_clustering_needs_no_stored_pairs(some):
    """One pass over structures; equal to the kernel for one structure at a time, which rings still take."""
    written = len(session._written)
    made = ids.clustering_ids(*some, IdOptions(), base_cutoff=8.4)
    assert len(session._written) == written and "ArrowEvalPython" not in plan(made)
    with geometry.by_bins():
        other = ids.clustering_ids(*some, IdOptions(), base_cutoff=8.4)
    assert rows(made) == rows(other)
