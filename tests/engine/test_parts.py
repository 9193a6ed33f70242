"""Sources, sinks, geometry kernels, streaming, splits."""

import math

import numpy as np
import pytest

from lattisphere import sinks
from lattisphere.operators import graph, ids, kernel, neighbors, relational, voronoi
from lattisphere.options import IdOptions
from lattisphere.sources import cif, xyz

SALT = """# made for this test
data_salt
_cell_length_a 5.692(1)
_cell_length_b 5.692
_cell_length_c 5.692
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
loop_
_symmetry_equiv_pos_as_xyz
'x,y,z'
'x,y+1/2,z+1/2'
X+1/2,Y,Z+1/2
'1/2+x, 1/2+y, z'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na1 Na 0 0 0
Cl1 Cl 0.5 0.5 0.5
"""


def test_cif_column_and_ids(spark):
    rows = spark.createDataFrame([("a", SALT), ("bad", "no cif"), ("none", None)], "k string, t string")
    structures, sites = cif.tables(rows, "k", "t")
    assert structures.count() == 1 and sites.count() == 8
    assert ids.graph_ids(structures, sites).collect()[0].graph_id == "NaCl-3D-88c8e156db1b0fd9"


def test_cif_files_and_source(spark, tmp_path):
    (tmp_path / "salt.cif").write_text(SALT)
    structures, sites = cif.read(spark, str(tmp_path))
    assert sites.groupBy("species").count().count() == 2 and structures.first().n_sites == 8
    spark.dataSource.register(cif.CifSource)
    row = spark.read.format("cif").load(str(tmp_path)).first()
    assert len(row.sites) == 8 and row.error is None


def test_operators():
    assert [(f, float(s)) for f, s in cif.operator("-y,x-y,2/3+z")] == [([0, -1, 0], 0.0), ([1, -1, 0], 0.0), ([0, 0, 1], 2 / 3)]


def test_molecules(spark):
    water = "3\n# H2O\nH 0.95 -0.55 0\nH -0.95 -0.55 0\nO 0 0 0\n"
    atoms = xyz.molecules(spark.createDataFrame([("w", water), ("bad", "x")], "k string, t string").where("k = 'w'"), "k", "t")
    free = xyz.unboxed(atoms)
    edges = graph.symmetric(neighbors.minimum_distance(free, atoms))
    assert sorted((r.u, r.v) for r in edges.collect()) == [(0, 2), (1, 2), (2, 0), (2, 1)]
    with pytest.raises(Exception, match="does not allow"):
        neighbors.bonds("brunner_real", free, atoms).collect()


def test_voronoi_fills_space():
    rng = np.random.default_rng(1)
    cell = [[6, 0.3, 0], [1, 7, 0], [0.2, 0.5, 5]]
    sites = (rng.random((7, 3)) @ np.array(cell)).tolist()
    found = [voronoi.facets(cell, sites, i, adjacent=True) for i in range(7)]
    assert all(math.isclose(sum(f["solid_angle"] for f in own), 4 * math.pi, rel_tol=1e-6) for own in found)
    assert math.isclose(sum(f["volume"] for own in found for f in own), abs(np.linalg.det(cell)), rel_tol=1e-6)
    assert all(len(f["adjacent"]) >= 3 for own in found for f in own)


def test_ions_bond_by_charge():
    cell = [[10.0, 0, 0], [0, 10.0, 0], [0, 0, 10.0]]
    xyz_ = [[0.0, 0, 0], [5.0, 0, 0]]
    chance, near = voronoi.coordination(voronoi.facets(cell, xyz_, 0), 0, ["Na", "Cl"], [1.0, -1.0], {}, distance_cutoffs=None, cation_anion=True)
    assert all(f["v"] == 1 for f in near) and math.isclose(sum(chance.values()), 1)
    with pytest.raises(ValueError):
        voronoi.coordination(voronoi.facets(cell, xyz_, 0), 0, ["Na", "K"], [1.0, 1.0], {}, cation_anion=True)


def test_dimensions():
    chain = [(0, 0, 0, 0, 1), (0, 0, 0, 0, -1)]
    sheet = chain + [(0, 0, 1, 0, 0), (0, 0, -1, 0, 0)]
    bulk = sheet + [(0, 0, 1, 1, 1), (0, 0, -1, -1, -1)]
    assert [kernel.dimension(1, e) for e in ([], chain, sheet, bulk)] == [0, 1, 2, 3]


def test_errors_are_caught_row_by_row(spark):
    sites = spark.createDataFrame([("a", 0, "Na"), ("b", 0, None)], "structure_id string, site_i int, species string")
    edges = spark.createDataFrame([("b", 0, 7, 0, 0, 0)], "structure_id string, u int, v int, ia int, ib int, ic int")
    found = {r.structure_id: (r.graph_id, r.error) for r in ids.kernel_rows(sites, edges, catch=True).collect()}
    assert found["a"][1] is None and found["b"][0] == "" and found["b"][1]


def test_merged_id_is_the_id_of_both(spark):
    sites = spark.createDataFrame([("a", 0, "H"), ("a", 1, "H"), ("b", 0, "C"), ("ab", 0, "H"), ("ab", 1, "H"), ("ab", 2, "C")], "structure_id string, site_i int, species string")
    edges = spark.createDataFrame([(k, *e, 0, 0, 0) for k in ("a", "ab") for e in ((0, 1), (1, 0))], "structure_id string, u int, v int, ia int, ib int, ic int")
    keys = spark.createDataFrame([("a", 1), ("b", 1)], "structure_id string, merge_key int")
    merged = ids.merged_ids(keys, sites, edges).first().graph_id
    alone = {r.structure_id: r.graph_id for r in ids.ids_of_graph(sites, edges, IdOptions(prepend_composition=False, prepend_dimensionality=False)).collect()}
    assert merged == alone["ab"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "structure_id long, graph_id string")
    rows.where("structure_id = 3").write.parquet(f"{tmp_path}/t")
    sinks.insert_if_absent(rows, f"{tmp_path}/t")
    sinks.insert_if_absent(rows, f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(1, "a"), (3, "b")]
    sinks.write_csv(rows, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 3
    assert sinks.cached(rows, f"{tmp_path}/p").count() == sinks.cached(rows.limit(0), f"{tmp_path}/p").count() == 3


def test_splits_share_no_key(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select("id", (F.col("id") % 37).alias("graph_id"))
    parts = relational.hash_split(rows, F.col("graph_id"), 3)
    assert parts.groupBy("graph_id").agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()


def test_forest(spark):
    rows = spark.range(200).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS a", "IF(id % 7 = 0, NULL, CAST(id % 3 AS DOUBLE)) AS b", "CAST(2 * (id % 10) AS DOUBLE) AS y")
    found = relational.forest(rows, rows, ["a", "b"], "y", trees=5)
    assert relational.mean_absolute_error(found, "y", "prediction").first().mae < 2


def test_stream_keeps_the_first(spark, tmp_path):
    from lattisphere.streaming.dedup import first_seen, into_table

    schema = "structure_id long, graph_id string, ts timestamp"
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], schema).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).lit("2024-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = first_seen(stream(), "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("firsts").select("graph_id").distinct().count() == spark.table("firsts").count() == 2
    rows.limit(0).write.parquet(f"{tmp_path}/out")
    query = into_table(stream(), f"{tmp_path}/out", f"{tmp_path}/c2")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_command_line_identifies_files(spark, tmp_path):
    from lattisphere.cli import identify

    (tmp_path / "a.cif").write_text(SALT)
    (tmp_path / "b.cif").write_text("nothing")
    (tmp_path / "c.xyz").write_text("2\nH2\nH 0 0 0\nH 0.74 0 0\n")
    found = {r.path[-5:]: r.graph_id for r in identify(spark, [str(tmp_path)]).collect()}
    assert found["a.cif"] == "NaCl-3D-88c8e156db1b0fd9" and found["b.cif"] == "" and found["c.xyz"].startswith("H2-0D-")


def test_covalent_cutoffs_bond_salt(spark):
    from lattisphere.operators.radii import covalent_cutoffs

    structures, sites = cif.tables(spark.createDataFrame([("a", SALT)], "k string, t string"), "k", "t")
    edges = graph.symmetric(neighbors.cutoff_dict(structures, sites, covalent_cutoffs(["Na", "Cl"])))
    assert {r.degree for r in graph.degree(sites, edges).collect()} == {6}
