"""Identifiers of structure files: `spark-submit -m lattisphere.cli FILES... [--output ids.csv]`, or `python -m lattisphere.cli`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import geometry, ids
from .options import IdOptions
from .sources import cif, poscar, xyz


def identify(spark: SparkSession, paths: list[str], options: IdOptions = IdOptions()) -> DataFrame:
    """(path, graph_id) of CIF, POSCAR and XYZ files; a file that can't be read has the id ""."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    is_xyz, is_poscar = name.endswith(".xyz"), name.rlike("poscar|contcar|[.]vasp$")
    structures, sites = cif.tables(files.where(~is_xyz & ~is_poscar), "path", "value")
    more, of_more = poscar.tables(files.where(is_poscar), "path", "value")
    structures, sites = structures.unionByName(more), sites.unionByName(of_more)
    boxes, atoms = geometry.boxed(xyz.molecules(files.where(is_xyz), "path", "value"))
    structures = structures.select("structure_id", "lattice", "pbc", "n_sites").unionByName(boxes)
    sites = geometry.without_coincident(structures, sites.unionByName(atoms))
    found = ids.graph_ids(structures, sites, options, catch=True).withColumnRenamed("structure_id", "path")
    return files.select("path").join(found, "path", "left").fillna("", ["graph_id"])


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("files", nargs="+")
    parser.add_argument("--output", help="a folder for the ids as CSV")
    parser.add_argument("--topology-only", action="store_true")
    given = parser.parse_args()
    found = identify(SparkSession.builder.getOrCreate(), given.files, IdOptions(topology_only=given.topology_only)).persist()
    sinks.show(found, 1000)
    if given.output:
        sinks.write_csv(found, given.output)


if __name__ == "__main__":
    main()
