"""Periodic neighbour search as joins: within a structure, over the images that can be near.

Everything is keyed by structure_id, so one shuffle by it serves the join and all windows and aggregates after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SELF = 1e-8


def _cell(i: int, j: int) -> Column:
    return F.col("lattice")[i][j]


def inverse_columns() -> list[list[Column]]:
    """Columns of the inverse lattice (adjugate over determinant): fractional = cartesian . inverse."""
    m = [[_cell(i, j) for j in range(3)] for i in range(3)]
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    det = sum((m[0][c] * minor(0, c) for c in range(1, 3)), m[0][0] * minor(0, 0))
    return [[minor(c, r) / det for c in range(3)] for r in range(3)]


def fractional(structures: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites with fractional coordinates fa, fb, fc and the reach of one Angstrom along each axis (wa, wb, wc)."""
    inv = inverse_columns()
    xyz = [F.col(c) for c in "xyz"]
    frac = {f"f{n}": sum((xyz[r] * inv[r][c] for r in range(1, 3)), xyz[0] * inv[0][c]) for c, n in enumerate("abc")}
    reach = {f"w{n}": F.when(F.col("pbc")[c], F.sqrt(inv[0][c] ** 2 + inv[1][c] ** 2 + inv[2][c] ** 2)) for c, n in enumerate("abc")}
    return sites.join(structures.select("structure_id", "lattice", "pbc"), "structure_id").withColumns(frac | reach)


def periodic_pairs(structures: DataFrame, sites: DataFrame, r: float, min_r: float = 1.0) -> DataFrame:
    """(structure_id, u, v, ia, ib, ic, dist) with 1e-8 <= dist < r; for r below min_r the bound is dist <= r.

    An axis that is not periodic has the image 0 alone. Image bounds are those of each pair, so nearly all generated rows
    are kept.
    """
    own = fractional(structures, sites)
    a = own.select("structure_id", F.col("site_i").alias("u"), *[F.col(c).alias(f"{c}u") for c in ("x", "y", "z", "fa", "fb", "fc")])
    b = own.select("structure_id", F.col("site_i").alias("v"), "lattice", "wa", "wb", "wc", *[F.col(c).alias(f"{c}v") for c in ("x", "y", "z", "fa", "fb", "fc")])
    pairs = a.join(b, "structure_id")
    for n in "abc":
        gap, width = F.col(f"f{n}u") - F.col(f"f{n}v"), F.col(f"w{n}") * r + 1e-8
        images = F.when(F.col(f"w{n}").isNull(), F.array(F.lit(0))).when(F.ceil(gap - width) <= F.floor(gap + width), F.sequence(F.ceil(gap - width).cast("int"), F.floor(gap + width).cast("int")))
        pairs = pairs.withColumn(f"i{n}", F.explode(images))
    shift = [sum((F.col(f"i{n}") * _cell(k, c) for k, n in [(1, "b"), (2, "c")]), F.col("ia") * _cell(0, c)) for c in range(3)]
    d = [F.col(f"{c}v") + s - F.col(f"{c}u") for c, s in zip("xyz", shift)]
    dist = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    near = F.col("dist") <= r if r < min_r else F.col("dist") < r
    return pairs.select("structure_id", "u", "v", "ia", "ib", "ic", dist.alias("dist")).where((F.col("dist") >= SELF) & near)


def binned_pairs(structures: DataFrame, sites: DataFrame, r: float, min_r: float = 1.0) -> DataFrame:
    """The same pairs by a cell list: images fall into cubes of edge max(0.1, r), and only the 27 cubes about a site are
    joined. For large structures, where the pairs within a structure are far more than those that are near. Joined by
    structure and cube, so one structure is dealt over many tasks."""
    edge = max(0.1, r)
    own = fractional(structures, sites)
    ends = own.groupBy("structure_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("fa", "fb", "fc", "x", "y", "z") for f in (F.min, F.max)])
    b = own.join(ends, "structure_id")
    for n in "abc":
        low = F.ceil(F.col(f"min_f{n}") - F.col(f"f{n}") - F.col(f"w{n}") * r - 1e-8).cast("int")
        high = F.floor(F.col(f"max_f{n}") - F.col(f"f{n}") + F.col(f"w{n}") * r + 1e-8).cast("int")
        b = b.withColumn(f"i{n}", F.explode(F.when(F.col(f"w{n}").isNull(), F.array(F.lit(0))).otherwise(F.sequence(low, high))))
    moved = [F.col(c) + sum((F.col(f"i{n}") * _cell(k, i) for k, n in [(1, "b"), (2, "c")]), F.col("ia") * _cell(0, i)) for i, c in enumerate("xyz")]
    b = b.withColumns({f"{c}v": m for c, m in zip("xyz", moved)})
    for c in "xyz":
        b = b.where((F.col(f"{c}v") > F.col(f"min_{c}") - r - SELF) & (F.col(f"{c}v") < F.col(f"max_{c}") + r + SELF))
    b = b.select("structure_id", F.col("site_i").alias("v"), "ia", "ib", "ic", "xv", "yv", "zv", *[F.floor(F.col(f"{c}v") / edge).alias(f"b{c}") for c in "xyz"])
    near = F.sequence(F.lit(-1), F.lit(1))
    a = sites.select("structure_id", F.col("site_i").alias("u"), *[F.col(c).alias(f"{c}u") for c in "xyz"])
    for c in "xyz":
        a = a.withColumn(f"d{c}", F.explode(near)).withColumn(f"b{c}", F.floor(F.col(f"{c}u") / edge) + F.col(f"d{c}")).drop(f"d{c}")
    d = [F.col(f"{c}v") - F.col(f"{c}u") for c in "xyz"]
    joined = a.join(b, ["structure_id", "bx", "by", "bz"]).withColumn("dist", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    near = F.col("dist") <= r if r < min_r else F.col("dist") < r
    return joined.where((F.col("dist") >= SELF) & near).select("structure_id", "u", "v", "ia", "ib", "ic", "dist")


_search: ContextVar = ContextVar("search", default=periodic_pairs)


def near_pairs(structures: DataFrame, sites: DataFrame, r: float) -> DataFrame:
    """Pairs by the search that holds while a plan is made: `periodic_pairs`, or `binned_pairs` inside `by_bins`."""
    return _search.get()(structures, sites, r)


def searches_whole() -> bool:
    """Whether structures are searched pair by pair, so that kernels over whole structures can do it."""
    return _search.get() is periodic_pairs


@contextmanager
def by_bins() -> Iterator[None]:
    token = _search.set(binned_pairs)
    try:
        yield
    finally:
        _search.reset(token)


def boxed(atoms: DataFrame, vacuum: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Molecules in a periodic box with `vacuum` on each side: (structures, sites) of (structure_id, site_i, species, x, y, z)."""
    ends = atoms.groupBy("structure_id").agg(F.count("*").cast("int").alias("n_sites"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])
    side = [F.col(f"max_{c}") - F.col(f"min_{c}") + 2 * vacuum for c in "xyz"]
    lattice = F.array(*[F.array(*[side[i] if i == j else F.lit(0.0) for j in range(3)]) for i in range(3)])
    structures = ends.select("structure_id", lattice.alias("lattice"), F.array(*[F.lit(True)] * 3).alias("pbc"), "n_sites")
    low = ends.select("structure_id", *[f"min_{c}" for c in "xyz"])
    moved = atoms.join(low, "structure_id").withColumns({c: F.col(c) - F.col(f"min_{c}") + vacuum for c in "xyz"})
    return structures, moved.drop(*[f"min_{c}" for c in "xyz"])


def without_coincident(structures: DataFrame, sites: DataFrame, tol: float = 0.01) -> DataFrame:
    """Sites without those closer than tol to a site of the same structure with a smaller index."""
    own = periodic_zero(structures, sites, tol)
    return sites.join(own.where("v < u").select("structure_id", F.col("u").alias("site_i")).distinct(), ["structure_id", "site_i"], "left_anti")


def periodic_zero(structures: DataFrame, sites: DataFrame, tol: float) -> DataFrame:
    """Pairs of different sites at most tol apart, coincident ones included."""
    own = fractional(structures, sites)
    a = own.select("structure_id", "lattice", "pbc", F.col("site_i").alias("u"), *[F.col(f"f{n}").alias(f"{n}u") for n in "abc"])
    b = own.select("structure_id", F.col("site_i").alias("v"), *[F.col(f"f{n}").alias(f"{n}v") for n in "abc"])
    gap = [F.col(f"{n}v") - F.col(f"{n}u") for n in "abc"]
    gap = [F.when(F.col("pbc")[i], g - F.round(g)).otherwise(g) for i, g in enumerate(gap)]
    d = [sum((gap[k] * _cell(k, c) for k in (1, 2)), gap[0] * _cell(0, c)) for c in range(3)]
    return a.join(b, "structure_id").where("u <> v").withColumn("dist", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("dist") <= tol).select("structure_id", "u", "v", "dist")
