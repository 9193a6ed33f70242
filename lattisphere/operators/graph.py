"""Bond graphs as tables: closure, edits, components, diameter, dimensionality.

Edges are stored in both directions. Joins and aggregates are keyed by structure_id first, so they share its partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import stored
from ..schemas import EDGE
from . import batch, kernel


def symmetric(bonds: DataFrame) -> DataFrame:
    """Distinct edges in both directions, without zero-image self edges; no shuffle beyond the one by structure_id."""
    one = F.struct("u", "v", "ia", "ib", "ic")
    other = F.struct(F.col("v").alias("u"), F.col("u").alias("v"), *[(-F.col(c)).alias(c) for c in ("ia", "ib", "ic")])
    both = bonds.select("structure_id", F.explode(F.array(one, other)).alias("e")).select("structure_id", "e.*")
    return both.where("u <> v OR ia <> 0 OR ib <> 0 OR ic <> 0").dropDuplicates(list(EDGE))


def _failing(rows: DataFrame, there: DataFrame, by: list[str], text: str, like: DataFrame) -> DataFrame:
    """No rows, in the columns of `like`; an error as soon as `rows` has one that is not `there`."""
    marked = rows.join(there.select(*by).distinct().withColumn("__there", F.lit(True)), by, "left")
    error = F.raise_error(F.concat(F.lit(text), F.col("structure_id").cast("string"))).cast("boolean")
    return marked.where(F.when(F.col("__there").isNull(), error).otherwise(F.lit(False))).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def without_edges(edges: DataFrame, gone: DataFrame, strict: bool = False) -> DataFrame:
    """edges without those of `gone`, in either direction; with strict, a bond to break that is not there is an error."""
    both = symmetric(gone)
    left = edges.join(both, list(EDGE), "left_anti")
    return left.unionByName(_failing(both, edges, list(EDGE), "no such bond in structure ", left)) if strict else left


def empty(structures: DataFrame, sites: DataFrame) -> DataFrame:
    """The edge table of graphs without bonds: no rows. A structure without sites is an error."""
    none = sites.select("structure_id", *[F.lit(0).alias(c) for c in EDGE if c != "structure_id"]).where("false")
    return none.unionByName(_failing(structures.select("structure_id"), sites, ["structure_id"], "no sites in structure ", none))


def connectivity(edges: DataFrame) -> DataFrame:
    """(structure_id, u, v) of all bonds, sorted: what two graphs are compared by."""
    return edges.select("structure_id", "u", "v").orderBy("structure_id", "u", "v")


def without_site(edges: DataFrame, site: int) -> DataFrame:
    """edges that do not touch a site."""
    return edges.where((F.col("u") != site) & (F.col("v") != site))


def with_cluster_edges(edges: DataFrame, bonds: DataFrame, site: int, k: int) -> DataFrame:
    """edges with the bonds of one site replaced by those of its distance cluster k (see neighbors.cluster_bonds)."""
    own = symmetric(bonds.where((F.col("u") == site) & (F.col("k") == k)))
    return without_site(edges, site).select(*EDGE).unionByName(own.select(*EDGE)).distinct()


def one_direction(edges: DataFrame) -> DataFrame:
    """The export form: each bond once, from the smaller site."""
    return edges.where("u <= v")


def neighbours_of(edges: DataFrame, at: DataFrame) -> DataFrame:
    """Neighbours of (structure_id, site, ia, ib, ic) rows: the bond's image is added to the row's."""
    moved = at.select("structure_id", F.col("site").alias("u"), *[F.col(c).alias(f"at_{c}") for c in ("ia", "ib", "ic")])
    return moved.join(edges, ["structure_id", "u"]).select("structure_id", "u", "v", *[(F.col(c) + F.col(f"at_{c}")).alias(c) for c in ("ia", "ib", "ic")]).distinct()


def degree(sites: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("structure_id", "u").agg(F.count("*").alias("degree")).withColumnRenamed("u", "site_i")
    return sites.select("structure_id", "site_i").join(counts, ["structure_id", "site_i"], "left").fillna(0, ["degree"])


def assembled(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """(structure_id, species array by site_i, edges array of structs): one row for each structure, for the kernels."""
    own = sites.groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("site_i", "species"))), lambda s: s["species"]).alias("species"))
    bonds = edges.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "ia", "ib", "ic"))).alias("edges"))
    empty = F.array().cast("array<struct<u:int,v:int,ia:int,ib:int,ic:int>>")
    return own.join(bonds, "structure_id", "left").withColumn("edges", F.coalesce("edges", empty))


def edges_of(rows: DataFrame) -> DataFrame:
    """The edge table of assembled structures whose sites are numbered from 0."""
    return rows.select("structure_id", F.explode("edges").alias("e")).select("structure_id", "e.*")


def edge_rows(edges: pa.Array) -> list[list[kernel.Edge]]:
    return [[(e["u"], e["v"], e["ia"], e["ib"], e["ic"]) for e in row or ()] for row in edges.to_pylist()]


_SUMMARY = T.StructType([T.StructField("comp", T.ArrayType(T.IntegerType())), T.StructField("diameter", T.ArrayType(T.IntegerType())), T.StructField("dim", T.IntegerType())])


def summary(species: Column, edges: Column) -> Column:
    """struct<comp, diameter (by site), dim> of an assembled structure."""

    @F.arrow_udf(_SUMMARY)
    def run(names: pa.Array, bonds: pa.Array) -> pa.Array:
        comps, wides, dims = [], [], []
        for _, _, g, _ in batch.graphs(names, bonds):
            comp, wide = g.components()
            comps.append(comp)
            wides.append(wide)
            dims.append(g.dimension(comp))
        start = pa.array(batch.lists(names)[0].astype(np.int32))
        comp, wide, dim = (pa.array(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32)) for x in (comps, wides, dims))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(start, comp), pa.ListArray.from_arrays(start, wide), dim], names=["comp", "diameter", "dim"])

    return run(species, edges)


def components(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """(structure_id, site_i, comp, diameter) through the kernel."""
    return components_of(assembled(sites, edges))


def components_of(rows: DataFrame) -> DataFrame:
    """The same, of assembled structures."""
    rows = rows.withColumn("s", summary(F.col("species"), F.col("edges")))
    each = rows.select("structure_id", F.posexplode(F.arrays_zip("s.comp", "s.diameter")).alias("site_i", "e"))
    return each.select("structure_id", "site_i", F.col("e.comp").alias("comp"), F.col("e.diameter").alias("diameter"))


def dimensionality(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """(structure_id, dim) through the kernel."""
    return dimensionality_of(assembled(sites, edges))


def dimensionality_of(rows: DataFrame) -> DataFrame:
    """The same, of assembled structures."""
    return rows.select("structure_id", summary(F.col("species"), F.col("edges"))["dim"].alias("dim"))


#: Edges that `components_by_joins` contracts at a time.
CONTRACTED = 1_000_000


def _star(t: pa.Table, first_cut: bool, last_cut: bool) -> pa.RecordBatch:
    """The components of these edges as stars about their smallest sites; whether the first or last structure is cut is known."""
    begin = batch.starts(t["structure_id"])
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, t.num_rows)))
    ends = [t[c].to_numpy().astype(np.int64) for c in "uv"]
    low = min(x.min() for x in ends)
    wide = max(x.max() for x in ends) - low + 1
    keys, number = np.unique(np.concatenate([of * wide + x - low for x in ends]), return_inverse=True)
    u, v, root = number[: len(of)], number[len(of) :], np.arange(len(keys))
    while True:  # the smaller root wins at both ends of an edge, then roots of roots are taken
        least = np.arange(len(keys))
        np.minimum.at(least, root[u], root[v])
        np.minimum.at(least, root[v], root[u])
        while (least[least] != least).any():
            least = least[least]
        new = least[root]
        if (new == root).all():
            break
        root = new
    own = keys // wide
    cut = ((own == 0) & first_cut) | ((own == len(begin) - 1) & last_cut)
    site = lambda key: (key % wide + low).astype(np.int32)
    ids = t["structure_id"].combine_chunks().take(pa.array(begin[own]))
    return pa.RecordBatch.from_pydict({"structure_id": ids, "v": site(keys), "root": site(keys[root]), "cut": cut})


def _stars(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Edges (structure_id, u, v), those of a structure one after another -> (structure_id, v, root, cut), at most some
    `rows` edges held. cut: the structure has more edges, so its stars are of a part each."""
    held, n, cut = [], 0, False
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n > rows:
            t = pa.Table.from_batches(held)
            begin = batch.starts(t["structure_id"])
            last = int(begin[begin <= rows][-1])
            to = last or rows
            yield _star(t.slice(0, to), cut, not last)
            cut = not last
            t = t.slice(to)
            held, n = t.to_batches(), t.num_rows
    if n:
        yield _star(pa.Table.from_batches(held), cut, False)


def components_by_joins(sites: DataFrame, edges: DataFrame, rows: int = CONTRACTED) -> DataFrame:
    """(structure_id, site_i, comp) for structures of any size.

    The edges of a structure are contracted to stars, `rows` of them at a time, which settles all structures of fewer
    edges. The stars of larger ones are joined by label propagation with pointer jumping.
    """
    kind = edges.schema["structure_id"].dataType.simpleString()
    ordered = edges.select("structure_id", "u", "v").where("u <> v").repartition("structure_id").sortWithinPartitions("structure_id")
    stars = stored(ordered.mapInArrow(lambda batches: _stars(batches, rows), f"structure_id {kind}, v int, root int, cut boolean"), "stars")
    found = stars.where("NOT cut").select("structure_id", F.col("v").alias("site_i"), "root")
    cut = stars.where("cut")
    if not cut.isEmpty():
        found = found.unionByName(_joined(cut))
    own = sites.select("structure_id", "site_i").join(found, ["structure_id", "site_i"], "left")
    return own.select("structure_id", "site_i", F.coalesce("root", "site_i").alias("comp"))


def _joined(stars: DataFrame) -> DataFrame:
    """(structure_id, site_i, root) of structures whose stars lie in several parts."""
    one, other = (stars.select("structure_id", F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("v", "root"), ("root", "v")))
    near = stored(one.unionByName(other).where("u <> v").distinct(), "near")
    labels = stored(stars.select("structure_id", "v", F.col("v").alias("comp")).distinct(), "labels")
    while True:
        least = near.join(labels, ["structure_id", "v"]).groupBy("structure_id", "u").agg(F.min("comp").alias("least")).withColumnRenamed("u", "v")
        now = labels.join(least, ["structure_id", "v"], "left").withColumn("now", F.least("comp", F.coalesce("least", "comp")))
        jump = labels.select("structure_id", F.col("v").alias("now"), F.col("comp").alias("further"))
        moved = stored(now.join(jump, ["structure_id", "now"]).select("structure_id", "v", F.least("now", "further").alias("comp"), (F.least("now", "further") < F.col("comp")).alias("moved")), "labels")
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels.select("structure_id", F.col("v").alias("site_i"), F.col("comp").alias("root"))


def diameter_by_joins(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """(structure_id, site_i, reach): the largest hop count from each site, by a frontier join for each level."""
    near = stored(edges.select("structure_id", "u", "v").where("u <> v").distinct(), "near")
    front = stored(sites.select("structure_id", F.col("site_i").alias("start"), F.col("site_i").alias("at"), F.lit(0).alias("level")), "front")
    seen, level = front, 0
    while not front.isEmpty():
        level += 1
        step = front.select("structure_id", "start", F.col("at").alias("u")).join(near, ["structure_id", "u"]).select("structure_id", "start", F.col("v").alias("at")).distinct()
        front = stored(step.join(seen, ["structure_id", "start", "at"], "left_anti").withColumn("level", F.lit(level)), "front")
        seen = seen.unionByName(front)
    return seen.groupBy("structure_id", F.col("start").alias("site_i")).agg(F.max("level").alias("reach"))

