"""Crystals from POSCAR text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import cif


def parse(text: str) -> dict:
    """{lattice, sites} of one POSCAR: a comment, a scale, three cell vectors, elements, counts, and coordinates.

    A negative scale is the cell's volume. Where the line of elements is missing, the comment names them. Lines of
    selective dynamics, velocities and labels behind the coordinates are skipped.
    """
    lines = text.splitlines()
    cell = [[float(x) for x in line.split()[:3]] for line in lines[2:5]]
    (a, b, c), scale = cell, float(lines[1].split()[0])
    volume = abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
    if scale < 0:
        scale = (-scale / volume) ** (1 / 3)
    lattice = [[scale * x for x in row] for row in cell]
    at = 5
    names = lines[at].split()
    if names[0].isdigit():
        names = lines[0].split()
    else:
        at += 1
    counts = [int(n) for n in lines[at].split()]
    if len(names) < len(counts):
        raise ValueError("fewer elements than counts")
    at += 1
    if lines[at].strip()[:1] in "sS":
        at += 1
    cartesian = lines[at].strip()[:1] in "cCkK"
    species = [name.split("_")[0] for name, n in zip(names, counts) for _ in range(n)]
    sites = []
    for name, line in zip(species, lines[at + 1 : at + 1 + len(species)], strict=True):
        f = [float(x) for x in line.split()[:3]]
        xyz = [scale * x for x in f] if cartesian else [sum(f[r] * lattice[r][k] for r in range(3)) for k in range(3)]
        sites.append({"species": name, "x": xyz[0], "y": xyz[1], "z": xyz[2], "oxi": None})
    return {"lattice": lattice, "sites": sites}


def tables(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(structures, sites) from a column of POSCAR text; rows that can't be read are left out."""
    return cif.tables(rows, key, text, parse)
