"""Radii of sites as joins with small tables of elements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .voronoi import COVALENT


def _of(table: dict[str, float], species: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), species)


def default_radii(sites: DataFrame, covalent: dict[str, float] = COVALENT, atomic: dict[str, float] | None = None) -> DataFrame:
    """(structure_id, site_i, radius): covalent, else atomic, else null."""
    radius = _of(covalent, F.col("species"))
    if atomic:
        radius = F.coalesce(radius, _of(atomic, F.col("species")))
    return sites.select("structure_id", "site_i", radius.alias("radius"))


def ionic_radii(sites: DataFrame, ionic: DataFrame) -> DataFrame:
    """(structure_id, site_i, radius) from the site's oxidation state and a table ionic (species, state int, radius).

    Between two whole states the radius is interpolated. A state that the table lacks takes the mean radius of the
    element's cations or anions, by its sign; without a state the default radius holds; 0 where nothing is known.
    """
    table = ionic.groupBy("species").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "radius"))).alias("states"),
        F.avg(F.when(F.col("state") > 0, F.col("radius"))).alias("cation"),
        F.avg(F.when(F.col("state") < 0, F.col("radius"))).alias("anion"),
    )
    own = sites.join(table, "species", "left").withColumn("__default", _of(COVALENT, F.col("species")))
    low, high = (F.try_element_at("states", f("oxi").cast("int")) for f in (F.floor, F.ceil))
    between = low + (high - low) * (F.col("oxi") - F.floor("oxi"))
    mean = F.when(F.col("oxi") > 0, F.col("cation")).when(F.col("oxi") < 0, F.col("anion"))
    radius = F.when(F.col("oxi").isNull(), F.col("__default")).otherwise(F.coalesce(between, mean, F.col("__default")))
    return own.select("structure_id", "site_i", F.coalesce(radius, F.lit(0.0)).alias("radius"))


def radius_of(species: str, oxi: float | None, ionic: dict[str, dict[int, float]]) -> float:
    """As `ionic_radii`, for one site: 0 where nothing is known of the element."""
    states, default = ionic.get(species, {}), COVALENT.get(species, 0.0)
    if oxi is None:
        return default
    low, high = math.floor(oxi), math.ceil(oxi)
    if low in states and high in states:
        return states[low] + (states[high] - states[low]) * (oxi - low)
    alike = [r for s, r in states.items() if s * oxi > 0]
    return sum(alike) / len(alike) if alike else default


#: Named tables of cut-offs: name -> scale of the sum of covalent radii.
PRESETS = {"covalent": 1.2, "covalent_tight": 1.1, "covalent_wide": 1.3}


def preset_cutoffs(name: str, species: list[str]) -> dict[tuple[str, str], float]:
    """A cut-off table by its name."""
    if name not in PRESETS:
        raise ValueError(f"no table {name}; there are {', '.join(sorted(PRESETS))}")
    return covalent_cutoffs(species, PRESETS[name])


def covalent_cutoffs(species: list[str], scale: float = 1.2) -> dict[tuple[str, str], float]:
    """A cut-off table for neighbors.cutoff_dict: scaled sums of covalent radii for all pairs of the given elements."""
    known = sorted({s for s in species if s in COVALENT})
    return {(a, b): scale * (COVALENT[a] + COVALENT[b]) for i, a in enumerate(known) for b in known[i:]}
