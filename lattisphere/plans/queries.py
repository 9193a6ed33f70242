"""One query for each operator, over crystals derived from the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import sinks
from ..operators import geometry, graph, ids, labels, neighbors, radii, relational, sequences
from ..options import IdOptions
from ..sources import orders
from .session import stored, tuned

Query = Callable[[SparkSession, str], DataFrame]
#: At 8.4 no pair of the derived crystals lies within 1e-6 of the radius or of the bond threshold.
REACH = 8.4


def crystals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sites = orders.sites(tuned(spark), sf_dir)
    return orders.structures(sites), sites


def bond_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.bond_rows(*crystals(spark, sf_dir), tol=0.1, cutoff=REACH)


def bond_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    structures, sites = crystals(spark, sf_dir)
    return sites, graph.edges_of(neighbors.bond_rows(structures, sites, tol=0.1, cutoff=REACH))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def ids_md5(spark: SparkSession, sf_dir: str, depth: int, **options) -> DataFrame:
    return kernel_md5(spark, sf_dir, depth, **options).select("structure_id", "graph_id")


def kernel_md5(spark: SparkSession, sf_dir: str, depth: int, given: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    structures, sites = crystals(spark, sf_dir)
    rows = neighbors.bond_rows(structures, sites, tol=0.1, cutoff=REACH)
    return ids.kernel_rows_of(rows, IdOptions(depth=depth, digest="md5", **options), given(sites) if given else None)


def letters(sites: DataFrame) -> DataFrame:
    """Wyckoff letters made up for the derived crystals: none for every third site."""
    letter = F.chr(F.lit(97) + F.col("site_i") % 4)
    return sites.where("site_i % 3 <> 2").select("structure_id", "site_i", letter.alias("wyckoff"), F.lit("225").alias("sg"))


def with_letters(sites: DataFrame) -> DataFrame:
    return labels.wyckoff(sites, letters(sites))


def strategy(name: str, *columns: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(neighbors.bonds(name, *crystals(spark, sf_dir), **options), "weight")

    return run


def okeeffe(spark: SparkSession, sf_dir: str) -> DataFrame:
    structures, sites = crystals(spark, sf_dir)
    kinds = sites.select("species").distinct()
    both = kinds.select(F.col("species").alias("su")).crossJoin(kinds.select(F.col("species").alias("sv")))  # of species, not rows
    length = F.lit(2.0) + 0.1 * F.length(F.concat("su", "sv")) + F.when(F.col("su") == F.col("sv"), 0.5).otherwise(0.0)
    return rounded(neighbors.minimum_okeeffe(structures, sites, both.withColumn("d0", length), cutoff=REACH), "weight")


def pairs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = geometry.periodic_pairs(*crystals(spark, sf_dir), REACH)
    image = F.sum(F.col("ia") + 3 * F.col("ib") + 9 * F.col("ic")).cast("long")
    return pairs.groupBy("structure_id", "u").agg(F.count("*").alias("n"), F.round(F.min("dist"), 6).alias("nearest"), image.alias("image_sum"))


def on_graph(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(*bond_graph(spark, sf_dir))


def cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    structures, sites = crystals(spark, sf_dir)
    base = graph.edges_of(neighbors.bond_rows(structures, sites, tol=0.1, cutoff=REACH))
    return graph.with_cluster_edges(base, neighbors.cluster_bonds(structures, sites, 6.0), 0, 0)


def split_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_ = stored(ids_md5(spark, sf_dir, 1), "ids")  # both halves read it
    return all_.where("structure_id % 2 = 1"), all_.where("structure_id % 2 = 0")


def are_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd, even = split_ids(spark, sf_dir)
    return ids.are_same(even, odd.withColumn("structure_id", F.col("structure_id") - 1))


def merged_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("structure_id"), F.col("o_custkey").alias("merge_key"))
    return ids.merged_ids_of(keys, kernel_md5(spark, sf_dir, 1), IdOptions(digest="md5"))


def prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.prefixed_rows(kernel_md5(spark, sf_dir, 1))


def mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_quantity") * 1000).alias("predicted"), F.col("l_extendedprice").alias("actual"))
    parts = {"train": rows.where("l_orderkey % 2 = 0"), "test": rows.where("l_orderkey % 2 = 1")}
    all_ = relational.tagged(parts).unionByName(rows.withColumn("kind", F.lit("all")))
    return relational.mean_absolute_error(all_, "actual", "predicted", "kind").withColumn("mae", F.round("mae", 4))


def ionic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii by oxidation states made up for the derived crystals: halves from -1 to 1.5."""
    _, sites = crystals(spark, sf_dir)
    table = spark.createDataFrame([("AF", -1, 1.5), ("AF", 0, 1.0), ("AF", 1, 0.5), ("AF", 2, 0.25), ("NO", 1, 0.75), ("NO", -1, 2.0)], "species string, state int, radius double")
    return radii.ionic_radii(sites.withColumn("oxi", (F.col("site_i") % 6) / 2.0 - 1.0), table)


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    structures, sites = geometry.boxed(orders.sites(tuned(spark), sf_dir))
    out = sites.join(structures.select("structure_id", F.col("lattice")[0][0].alias("edge")), "structure_id")
    return rounded(out, "x", "y", "z", "edge").select("structure_id", "site_i", "x", "y", "z", "edge")


def ring_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = bond_graph(spark, sf_dir)
    walks = labels.ring_walks(edges, 4)
    return walks.groupBy("structure_id", "start", (F.size("path") - 1).alias("size")).agg(F.count("*").alias("n"))


def diameter(rows: DataFrame) -> DataFrame:
    return graph.components_of(rows).groupBy("structure_id", "comp").agg(F.max("diameter").alias("diameter"))


def kernel_components(rows: DataFrame, options: IdOptions = IdOptions()) -> DataFrame:
    """Sites and id of each component, in one pass over assembled structures."""
    found = ids.kernel_rows_of(rows, options)
    sites_of = lambda comp: F.array_join(F.filter(F.transform("comp", lambda c, i: F.when(c == comp, i)), lambda i: i.isNotNull()), ",")
    each = F.arrays_zip(F.transform(F.array_distinct("comp"), sites_of).alias("sites"), F.col("digests").alias("digest"))
    rows = found.select("structure_id", F.explode(each).alias("e")).select("structure_id", "e.*")
    return ids.component_ids(rows, options.digest)


def hundred(sites: DataFrame) -> DataFrame:
    """A hundred merge keys over all structures."""
    return sites.select("structure_id", (F.col("structure_id") % 100).alias("merge_key")).distinct()


def cell_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Voronoi cells of a structure add up to, and the solid angles of its facets: both are known beforehand."""
    structures, sites = crystals(spark, sf_dir)
    apart = geometry.without_coincident(structures, sites, 0.01)
    again = apart.withColumn("site_i", (F.row_number().over(Window.partitionBy("structure_id").orderBy("site_i")) - 1).cast("int"))
    facets = neighbors.voronoi_facets(structures, again, 6.0)
    total = facets.groupBy("structure_id").agg(F.sum("volume").alias("volume"), (F.sum("solid_angle") / F.count_distinct("u")).alias("angle"), F.count_distinct("u").alias("n_sites"))
    return total.select("structure_id", F.round("volume", 3).alias("volume"), F.round("angle", 6).alias("angle"), "n_sites")


def queries() -> dict[str, Query]:
    """name -> (spark, sf_dir) -> DataFrame."""
    from ..operators.ids import clustering_ids, graph_ids, maker_ids

    depth3 = lambda rows: sequences.level_strings_of(rows, 3)
    shared = lambda rows: rows.withColumn("same", F.transform("species", lambda _: F.lit("H")))
    plain = lambda rows: sequences.environments(rows, None).select("structure_id", "site_i", "cs")
    on_rows = lambda make: lambda s, d: make(bond_rows(s, d))
    named = lambda rows: sequences.environments(rows, "md5").select("structure_id", "site_i", F.concat_ws("_", "label", "cs").alias("site_id"))
    on_sites = lambda make: lambda s, d: make(crystals(s, d)[1])
    on_ids = lambda make: lambda s, d: make(ids_md5(s, d, 1))
    on_split = lambda make: lambda s, d: make(*split_ids(s, d))
    cutoffs = {("AF", "NO"): 4.0, ("RF", "RF"): 5.0}
    pairs = lambda r, make=geometry.periodic_pairs: lambda s, d: rounded(make(*crystals(s, d), r), "dist")
    return {
        "crystal_sites": on_sites(lambda t: rounded(t.drop("oxi"), "x", "y", "z")),
        "periodic_pairs": pairs(4.0),
        "periodic_pairs_r84": pairs_summary,
        "periodic_pairs_binned": pairs(3.0, geometry.binned_pairs),
        "nn_min_distance": strategy("minimum_distance", cutoff=REACH),
        "nn_all_sites": strategy("minimum_distance", get_all_sites=True),
        "nn_okeeffe": okeeffe,
        "nn_cutoff_dict": strategy("cutoff_dict", cutoffs=cutoffs),
        "nn_brunner_reciprocal": strategy("brunner_reciprocal"),
        "nn_brunner_relative": strategy("brunner_relative"),
        "nn_brunner_real": strategy("brunner_real"),
        "nn_econ": strategy("econ"),
        "nn_voronoi": strategy("voronoi", cutoff=6.0),
        "voronoi_volumes": cell_volumes,
        "nn_crystal": strategy("crystal"),
        "distance_clusters": lambda s, d: rounded(neighbors.distance_clusters(*crystals(s, d)), "bound"),
        "nn_distance_cluster": lambda s, d: neighbors.cluster_bonds(*crystals(s, d)),
        "graph_edges_symmetric": on_graph(lambda sites, edges: edges),
        "graph_one_direction": on_graph(lambda sites, edges: graph.one_direction(edges)),
        "graph_break_site": on_graph(lambda sites, edges: graph.without_site(edges, 0)),
        "graph_break_edges": on_graph(lambda sites, edges: graph.without_edges(edges, edges.where("ia <> 0"))),
        "graph_cluster_edges": cluster_edges,
        "graph_neighbours_of": on_graph(lambda sites, edges: graph.neighbours_of(edges, sites.where("site_i = 0").select("structure_id", F.col("site_i").alias("site"), F.lit(1).alias("ia"), F.lit(0).alias("ib"), F.lit(-1).alias("ic")))),
        "graph_degree": on_graph(graph.degree),
        "graph_components": on_rows(lambda rows: graph.components_of(rows).drop("diameter")),
        "graph_components_by_joins": on_graph(graph.components_by_joins),
        "graph_diameter": on_rows(diameter),
        "graph_dimensionality": on_rows(graph.dimensionality_of),
        "labels_element": on_sites(labels.elements),
        "labels_topology": on_sites(labels.topology),
        "labels_wyckoff_given": on_sites(with_letters),
        "labels_rings": on_graph(lambda sites, edges: labels.rings(sites, edges, 1, 1)),
        "ring_walks_depth4": ring_walks,
        "shell_counts_depth3": on_rows(lambda rows: sequences.shell_counts_of(rows, 3)),
        "shell_counts_cumulative": on_rows(lambda rows: sequences.shell_counts_of(rows, 3, cumulated=True)),
        "level_strings_depth3": on_rows(lambda rows: depth3(rows).withColumn("levels", F.array_join("levels", "|"))),
        "cs_plain_depth3": on_rows(lambda rows: plain(depth3(rows))),
        "cs_topology_depth2": on_rows(lambda rows: plain(sequences.level_strings_of(shared(rows), 2, "same"))),
        "site_ids_md5": on_rows(lambda rows: named(depth3(rows))),
        "site_ids_blake2b": on_rows(lambda rows: ids.site_ids_of(ids.kernel_rows_of(rows))),
        "site_ids_kernel_md5": on_rows(lambda rows: ids.site_ids_of(ids.kernel_rows_of(rows, IdOptions(depth=3, digest="md5")))),
        "component_ids_kernel_md5": on_rows(lambda rows: kernel_components(rows, IdOptions(depth=3, digest="md5"))),
        "graph_ids_kernel_md5": lambda s, d: graph_ids(*crystals(s, d), IdOptions(depth=3, digest="md5"), cutoff=REACH),
        "maker_ids_depth2_md5": lambda s, d: maker_ids(*crystals(s, d), IdOptions(depth=2, digest="md5"), cutoff=REACH),
        "maker_ids_reduced_md5": lambda s, d: maker_ids(*crystals(s, d), IdOptions(depth=2, reduce=True, digest="md5"), cutoff=REACH),
        "merged_ids_kernel_md5": lambda s, d: ids.merged_ids_of(hundred(crystals(s, d)[1]), kernel_md5(s, d, 1), IdOptions(digest="md5")),
        "clustering_ids_md5": lambda s, d: clustering_ids(*crystals(s, d), IdOptions(depth=1, digest="md5"), base_cutoff=REACH),
        "component_ids_md5": lambda s, d: ids.component_digests_of(kernel_md5(s, d, 3)),
        "component_ids_blake2b": on_rows(kernel_components),
        "graph_ids_md5_depth3": lambda s, d: ids_md5(s, d, 3),
        "graph_ids_topology": lambda s, d: ids_md5(s, d, 2, topology_only=True),
        "graph_ids_md5_wyckoff": lambda s, d: ids_md5(s, d, 2, given=with_letters),
        "graph_ids_blake2b": lambda s, d: graph_ids(*crystals(s, d), IdOptions(), cutoff=REACH),
        "graph_ids_rings": lambda s, d: graph_ids(*crystals(s, d), IdOptions(loop=True, diameter_factor=1), cutoff=REACH),
        "maker_ids_depth2": lambda s, d: maker_ids(*crystals(s, d), IdOptions(depth=2), cutoff=REACH),
        "maker_ids_reduced": lambda s, d: maker_ids(*crystals(s, d), IdOptions(depth=2, reduce=True), cutoff=REACH),
        "merged_ids_blake2b": lambda s, d: ids.merged_ids_of(hundred(crystals(s, d)[1]), ids.kernel_rows_of(bond_rows(s, d))),
        "clustering_ids": lambda s, d: clustering_ids(*crystals(s, d), IdOptions(), base_cutoff=REACH),
        "formulas": on_sites(ids.formulas),
        "ids_prefixed": prefixed,
        "merged_ids_by_customer": merged_by_customer,
        "reduced_ids": lambda s, d: ids_md5(s, d, 1, reduce=True),
        "unique_structures": on_ids(lambda t: ids.unique_structures(t, "structure_id")),
        "same_structure_pairs": on_ids(ids.same_structures),
        "are_same": are_same,
        "leakage_semi": on_split(relational.leaked),
        "leakage_anti": on_split(relational.novel),
        "leakage_counts": on_split(relational.leakage_counts),
        "group_by_id": on_ids(relational.members),
        "isostructural_groups": on_ids(lambda t: relational.members(t, least=2)),
        "dedup_with_first": on_ids(relational.with_first),
        "group_split": on_ids(lambda t: relational.hash_split(t, F.col("graph_id"), 5)),
        "site_histogram": on_rows(lambda rows: relational.histogram(named(sequences.level_strings_of(rows, 1)))),
        "id_lookup": lambda s, d: (lambda t: relational.look_up(t, t))(stored(ids_md5(s, d, 1), "ids")),  # both sides read it
        "formula_lookup": on_sites(lambda t: ids.formulas(t).where("formula = 'AFNO'")),
        "insert_if_absent": on_split(sinks.absent),
        "mae_by_split": mae,
        "site_radii": on_sites(lambda t: radii.default_radii(t, {"AF": 0.5, "NO": 1.25, "RF": 0.75}, {"AO": 2.0, "NF": 1.0, "RO": 1.75})),
        "ionic_radii": ionic,
        "composition": on_sites(lambda t: rounded(relational.composition(t), "share")),
        "boxed_molecules": boxed,
        "coincident_removed": lambda s, d: geometry.without_coincident(*crystals(s, d), 0.01).select("structure_id", "site_i", "species"),
    }
