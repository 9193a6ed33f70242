"""Identifiers of sites, components, structures and merged sets, and what is done with equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.digest import HASHES, TEXT_HASHES, gcd_of, joined_sorted
from ..options import IdOptions
from ..plans.session import spread, stored
from . import batch, geometry, graph, kernel, labels, neighbors, sequences

# Pauling electronegativities of the elements (public tables); X is unknown and sorts last.
ELECTRONEGATIVITY = {
    "H": 2.20, "Li": 0.98, "Be": 1.57, "B": 2.04, "C": 2.55, "N": 3.04, "O": 3.44, "F": 3.98, "Na": 0.93, "Mg": 1.31, "Al": 1.61, "Si": 1.90, "P": 2.19,
    "S": 2.58, "Cl": 3.16, "K": 0.82, "Ca": 1.00, "Sc": 1.36, "Ti": 1.54, "V": 1.63, "Cr": 1.66, "Mn": 1.55, "Fe": 1.83, "Co": 1.88, "Ni": 1.91, "Cu": 1.90,
    "Zn": 1.65, "Ga": 1.81, "Ge": 2.01, "As": 2.18, "Se": 2.55, "Br": 2.96, "Kr": 3.00, "Rb": 0.82, "Sr": 0.95, "Y": 1.22, "Zr": 1.33, "Nb": 1.6, "Mo": 2.16,
    "Tc": 1.9, "Ru": 2.2, "Rh": 2.28, "Pd": 2.20, "Ag": 1.93, "Cd": 1.69, "In": 1.78, "Sn": 1.96, "Sb": 2.05, "Te": 2.1, "I": 2.66, "Xe": 2.6, "Cs": 0.79,
    "Ba": 0.89, "La": 1.10, "Ce": 1.12, "Pr": 1.13, "Nd": 1.14, "Sm": 1.17, "Gd": 1.2, "Dy": 1.22, "Ho": 1.23, "Er": 1.24, "Tm": 1.25, "Lu": 1.27, "Hf": 1.3,
    "Ta": 1.5, "W": 2.36, "Re": 1.9, "Os": 2.2, "Ir": 2.20, "Pt": 2.28, "Au": 2.54, "Hg": 2.00, "Tl": 1.62, "Pb": 2.33, "Bi": 2.02, "Th": 1.3, "Pa": 1.5, "U": 1.38,
}
#: Elements whose pure formula names a molecule of two atoms.
DIATOMIC = ("O", "N", "F", "Cl", "H")


def with_formula(rows: DataFrame, species: str = "species", name: str = "formula") -> DataFrame:
    """rows with the formula of an array of species: counts over their gcd, by electronegativity, then name.

    A count of 1 is not written; an element of DIATOMIC alone is written with 2 atoms.
    """
    table = F.create_map(*[F.lit(x) for pair in ELECTRONEGATIVITY.items() for x in pair])
    count = lambda s: F.size(F.filter(species, lambda x: x == s)).cast("bigint")
    part = lambda s: F.struct(F.coalesce(F.try_element_at(table, s), F.lit(1e9)).alias("x"), s.alias("species"), count(s).alias("n"))
    rows = rows.withColumn("__parts", F.array_sort(F.transform(F.array_distinct(species), part)))
    rows = rows.withColumn("__g", gcd_of(F.transform("__parts", lambda p: p["n"])))
    alone = (F.size("__parts") == 1) & F.col("__parts")[0]["species"].isin(*DIATOMIC)
    number = lambda p: F.when(alone, F.lit(2).cast("bigint")).otherwise((p["n"] / F.col("__g")).cast("bigint"))
    text = F.transform("__parts", lambda p: F.concat(p["species"], F.when(number(p) == 1, F.lit("")).otherwise(number(p).cast("string"))))
    return rows.withColumn(name, F.array_join(text, "")).drop("__parts", "__g")


def formulas(sites: DataFrame) -> DataFrame:
    """(structure_id, formula)."""
    rows = sites.groupBy("structure_id").agg(F.collect_list("species").alias("species"))
    return with_formula(rows).select("structure_id", "formula")


def component_digests(environments: DataFrame, components: DataFrame, digest: str = "blake2b", reduce: bool = False) -> DataFrame:
    """(structure_id, comp, sites array, digest) from (structure_id, site_i, cs) and (structure_id, site_i, comp)."""
    hash_ = HASHES[digest][0]
    rows = environments.join(components.select("structure_id", "site_i", "comp"), ["structure_id", "site_i"])
    grouped = rows.groupBy("structure_id", "comp").agg(F.array_sort(F.collect_list("site_i")).alias("sites"), F.array_sort(F.collect_list("cs")).alias("all"))
    if reduce:
        n_of = lambda cs: F.size(F.filter("all", lambda x: x == cs))
        grouped = grouped.withColumn("g", gcd_of(F.transform(F.array_distinct("all"), n_of)))
        grouped = grouped.withColumn("q", F.min("g").over(Window.partitionBy("structure_id")))
        grouped = grouped.withColumn("all", F.flatten(F.transform(F.array_distinct("all"), lambda cs: F.array_repeat(cs, (n_of(cs) / F.col("q")).cast("int")))))
    return grouped.select("structure_id", "comp", "sites", hash_(joined_sorted(F.col("all"), "-")).alias("digest"))


def structure_ids(components: DataFrame, key: str = "structure_id", digest: str = "blake2b", size: int = 8) -> DataFrame:
    """(key, graph_id) over all component digests of a key; with a merge key this is the id of several materials at once."""
    text = joined_sorted(F.collect_list("digest"), ":")
    rows = components.groupBy(key).agg(text.alias("text"))
    return rows.select(key, HASHES[digest][0](F.col("text"), size).alias("graph_id"))


def component_ids(components: DataFrame, digest: str = "blake2b") -> DataFrame:
    """(structure_id, sites, component_id): 16-byte digests of the component digests."""
    return components.select("structure_id", "sites", HASHES[digest][0](F.col("digest"), 16).alias("component_id"))


def prefixed(ids: DataFrame, sites: DataFrame, edges: DataFrame, options: IdOptions = IdOptions()) -> DataFrame:
    """formula-dimD-id as the options ask; topology-only ids have no formula."""
    parts = [F.col("graph_id")]
    if options.prepend_dimensionality:
        ids = ids.join(graph.dimensionality(sites, edges), "structure_id")
        parts = [F.concat(F.col("dim").cast("string"), F.lit("D")), *parts]
    if options.prepend_composition and not options.topology_only:
        ids = ids.join(formulas(sites), "structure_id")
        parts = [F.col("formula"), *parts]
    return ids.select("structure_id", F.concat_ws("-", *parts).alias("graph_id"))


_IDS = T.StructType([T.StructField("graph_id", T.StringType()), T.StructField("comp", T.ArrayType(T.IntegerType())), T.StructField("cs", T.ArrayType(T.StringType())), T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("dim", T.IntegerType()), T.StructField("error", T.StringType())])


def _whole_ids(options: IdOptions, species: pa.Array, edges: pa.Array, named: pa.Array) -> dict[str, pa.Array]:
    """Columns of _IDS but for the error, of all structures at once."""
    of = TEXT_HASHES[options.digest]
    start = batch.lists(species)[0]
    given = named.to_pylist() if named.null_count < len(named) else None
    comps, environments, found, wholes, dims = [], [], [], [], []
    for lo, hi, g, own in batch.graphs(species, edges):
        base = ["H"] * len(own) if options.topology_only else own
        if given is not None:
            base = [x for k in range(lo, hi) for x in given[k] or base[g.start[k - lo] : g.start[k - lo + 1]]]
        if options.loop:
            base = [x for k in range(hi - lo) for x in kernel.ring_labels(int(g.n[k]), g.edges_of(k), own[g.start[k] : g.start[k + 1]], options.diameter_factor, options.additional_depth)]
        comp, wide = g.components()
        cs = batch.sequences(g, batch.Labels(g, base), np.arange(g.sites), options.diameter_factor * wide + options.additional_depth, True, options.digest)
        comps.append(comp)
        dims.append(g.dimension(comp))
        environments += cs
        every = comp.tolist()
        for a, b in zip(g.start[:-1].tolist(), g.start[1:].tolist()):
            digests = kernel.component_digests(every[a:b], cs[a:b], options.reduce, of)
            found.append(digests)
            wholes.append(kernel.structure_digest(digests, options.digest_size, of))
    offsets = pa.array(start.astype(np.int32))
    flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32))
    return {
        "graph_id": pa.array(wholes, pa.string()), "comp": pa.ListArray.from_arrays(offsets, flat(comps)), "cs": pa.ListArray.from_arrays(offsets, pa.array(environments, pa.string())),
        "digests": pa.array(found, pa.list_(pa.string())), "dim": flat(dims),
    }


def _kernel_ids(options: IdOptions, catch: bool) -> Column:
    @F.arrow_udf(_IDS)
    def run(species: pa.Array, edges: pa.Array, named: pa.Array) -> pa.Array:
        try:
            out = _whole_ids(options, species, edges, named)
            return pa.StructArray.from_arrays([*out.values(), pa.nulls(len(species), pa.string())], names=[*out, "error"])
        except Exception:
            if not catch:
                raise
        kinds = pa.struct([("graph_id", pa.string()), ("comp", pa.list_(pa.int32())), ("cs", pa.list_(pa.string())), ("digests", pa.list_(pa.string())), ("dim", pa.int32()), ("error", pa.string())])
        out = []
        for k in range(len(species)):  # one by one, to find those that fail
            try:
                row = {name: x[0].as_py() for name, x in _whole_ids(options, species.slice(k, 1), edges.slice(k, 1), named.slice(k, 1)).items()}
                out.append({**row, "error": None})
            except Exception as e:
                out.append({"graph_id": "", "comp": None, "cs": None, "digests": None, "dim": None, "error": str(e)})
        return pa.array(out, kinds)

    return run("species", "edges", "labels")


def kernel_rows(sites: DataFrame, edges: DataFrame, options: IdOptions = IdOptions(), given: DataFrame | None = None, catch: bool = False) -> DataFrame:
    """(structure_id, species, graph_id, comp, cs, digests, dim, error) in one pass over assembled structures.

    given: own start labels (structure_id, site_i, label), such as Wyckoff labels. With catch, a structure that fails has
    the id "" and its error.
    """
    return kernel_rows_of(graph.assembled(sites, edges), options, given, catch)


def kernel_rows_of(rows: DataFrame, options: IdOptions = IdOptions(), given: DataFrame | None = None, catch: bool = False) -> DataFrame:
    """The same, from structures that are assembled already (neighbors.bond_rows)."""
    if given is not None:
        own = given.groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("site_i", "label"))), lambda s: s["label"]).alias("labels"))
        rows = rows.join(own, "structure_id", "left")
    else:
        rows = rows.withColumn("labels", F.lit(None).cast("array<string>"))
    return rows.withColumn("r", _kernel_ids(options, catch)).select("structure_id", "species", "r.*")


def component_digests_of(rows: DataFrame) -> DataFrame:
    """(structure_id, comp, digest) of kernel rows: their digests are in the order of the components' smallest sites."""
    each = rows.select("structure_id", F.explode(F.arrays_zip(F.array_distinct("comp").alias("comp"), F.col("digests").alias("digest"))).alias("e"))
    return each.select("structure_id", "e.comp", "e.digest")


def graph_ids(structures: DataFrame, sites: DataFrame, options: IdOptions = IdOptions(), strategy: str = "minimum_distance", letters: DataFrame | None = None, catch: bool = False, **of_strategy) -> DataFrame:
    """(structure_id, graph_id) from structures alone: bonds, graph, environments, digests, prefixes."""
    given = labels.wyckoff(sites, letters, options.topology_only) if options.wyckoff and letters is not None else None
    return prefixed_rows(kernel_rows_of(neighbors.bond_rows(structures, sites, strategy, **of_strategy), options, given, catch), options)


def ids_of_graph(sites: DataFrame, edges: DataFrame, options: IdOptions = IdOptions(), letters: DataFrame | None = None, catch: bool = False) -> DataFrame:
    """(structure_id, graph_id) of a given bond graph."""
    given = labels.wyckoff(sites, letters, options.topology_only) if options.wyckoff and letters is not None else None
    return prefixed_rows(kernel_rows(sites, edges, options, given, catch), options)


def prefixed_rows(rows: DataFrame, options: IdOptions = IdOptions()) -> DataFrame:
    """(structure_id, graph_id) of kernel rows, with the prefixes that the options ask for."""
    parts = [F.col("graph_id")]
    if options.prepend_dimensionality:
        parts = [F.concat(F.col("dim").cast("string"), F.lit("D")), *parts]
    if options.prepend_composition and not options.topology_only:
        rows = with_formula(rows)
        parts = [F.col("formula"), *parts]
    whole = F.concat_ws("-", *parts)
    return rows.select("structure_id", F.when(F.col("error").isNull(), whole).otherwise("").alias("graph_id"))


def maker_ids(structures: DataFrame, sites: DataFrame, options: IdOptions = IdOptions(), **of_strategy) -> DataFrame:
    """formula-id, with `depth` and `reduce` of the options."""
    from dataclasses import replace

    return graph_ids(structures, sites, replace(options, prepend_dimensionality=False, prepend_composition=True), **of_strategy)


def site_ids(sites: DataFrame, edges: DataFrame, options: IdOptions = IdOptions()) -> DataFrame:
    """(structure_id, site_i, site_id): label_sequence."""
    return site_ids_of(kernel_rows(sites, edges, options), options)


def site_ids_of(rows: DataFrame, options: IdOptions = IdOptions()) -> DataFrame:
    """The same, of kernel rows."""
    rows = rows.select("structure_id", F.posexplode(F.arrays_zip("species", "cs")).alias("site_i", "e"))
    label = F.lit("H") if options.topology_only else F.col("e.species")
    return rows.select("structure_id", "site_i", F.concat_ws("_", label, "e.cs").alias("site_id"))


def merged_ids(groups: DataFrame, sites: DataFrame, edges: DataFrame, options: IdOptions = IdOptions()) -> DataFrame:
    """(merge_key, graph_id) for rows (structure_id, merge_key): the id of all materials of a key taken together."""
    return merged_ids_of(groups, kernel_rows(sites, edges, options), options)


def merged_ids_of(groups: DataFrame, rows: DataFrame, options: IdOptions = IdOptions()) -> DataFrame:
    """The same, of kernel rows."""
    digests = rows.select("structure_id", F.explode("digests").alias("digest"))
    return structure_ids(digests.join(groups, "structure_id"), "merge_key", options.digest, options.digest_size)


def clustering_ids(structures: DataFrame, sites: DataFrame, options: IdOptions = IdOptions(), base_tol: float = 0.1, base_cutoff: float = 10.0) -> DataFrame:
    """(structure_id, graph_id) by distance clusters: bare digests without prefixes."""
    wide = max(base_cutoff, options.cutoff)
    if not options.loop and geometry.searches_whole():
        within_r = lambda dist, r: dist <= r if r < 1.0 else dist < r

        def work(chunk: batch.Chunk) -> Iterator[dict]:
            pick, bonds, found = batch.shortest(base_tol), [], []
            for centers, (u, v, ia, ib, ic, dist) in chunk.cut_blocks(wide):
                near = np.flatnonzero(within_r(dist, base_cutoff))
                if len(near):
                    near = near[pick(chunk, u[near], v[near], dist[near])[0]]
                    bonds.append([x[near] for x in (u, v, ia, ib, ic)])
                near = np.flatnonzero(within_r(dist, options.cutoff))
                i, k, _ = batch.cluster_pairs(u[near], dist[near], centers, 0.5)
                i, k = near[i[k < options.rank_k]], k[k < options.rank_k]
                found.append([u[i], k, v[i], ia[i], ib[i], ic[i]])
            columns = lambda rows, n: [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * n
            base = batch.Graph(chunk.start, *columns(bonds, 5), both=True)
            codes, known = chunk.species
            names = ["H" if options.topology_only else known[c] for c in codes.tolist()]
            digests = batch.clustering_digests(chunk, base, columns(found, 6), names, options.rank_k, options.diameter_factor, options.additional_depth, options.digest_size, options.digest)
            yield {"structure_id": chunk.id_of, "graph_id": pa.array(digests, pa.string())}

        return neighbors.in_chunks(structures, sites, "graph_id string", work, "species")
    pairs = stored(geometry.near_pairs(structures, sites, wide), "pairs")  # one search for both kinds of bonds
    within = lambda r: pairs if r == wide else pairs.where(F.col("dist") <= r if r < 1.0 else F.col("dist") < r)
    base = graph.symmetric(neighbors.minimum_distance(structures, sites, base_tol, base_cutoff, pairs=within(base_cutoff)))
    bonds = neighbors.cluster_bonds(structures, sites, options.cutoff, within(options.cutoff)).where(F.col("k") < options.rank_k)
    own = bonds.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("u", "k", "v", "ia", "ib", "ic"))).alias("clusters"))
    rows = graph.assembled(sites, base).join(own, "structure_id", "left")

    @F.arrow_udf(T.StringType())
    def run(species: pa.Array, edges: pa.Array, clusters: pa.Array) -> pa.Array:
        out = []
        for names, rows, found in zip(species.to_pylist(), graph.edge_rows(edges), clusters.to_pylist()):
            each: list[list] = [[] for _ in names]
            for c in found or ():
                each[c["u"]].append((c["k"], c["v"], c["ia"], c["ib"], c["ic"]))
            start = ["H"] * len(names) if options.topology_only else names
            relabel = (lambda e, n=names: kernel.ring_labels(len(n), e, n, options.diameter_factor, options.additional_depth)) if options.loop else None
            out.append(kernel.clustering_digest(len(names), rows, each, start, options.rank_k, options.diameter_factor, options.additional_depth, options.digest_size, relabel, TEXT_HASHES[options.digest]))
        return pa.array(out, pa.string())

    return spread(rows).select("structure_id", run("species", "edges", "clusters").alias("graph_id"))


def unique_structures(ids: DataFrame, order: str) -> DataFrame:
    """The first row of each graph_id by `order`."""
    return ids.withColumn("__r", F.row_number().over(Window.partitionBy("graph_id").orderBy(order))).where("__r = 1").drop("__r")


def same_structures(ids: DataFrame) -> DataFrame:
    """(a, b): each structure with the first one of its id, so a group of n costs n rows, not n^2."""
    first = ids.withColumn("a", F.min("structure_id").over(Window.partitionBy("graph_id")))
    return first.where(F.col("a") != F.col("structure_id")).select("a", F.col("structure_id").alias("b"))


def are_same(a: DataFrame, b: DataFrame) -> DataFrame:
    """(structure_id, same) for two id tables by structure."""
    joined = a.join(b.withColumnRenamed("graph_id", "other"), "structure_id")
    return joined.select("structure_id", (F.col("graph_id") == F.col("other")).alias("same"))


