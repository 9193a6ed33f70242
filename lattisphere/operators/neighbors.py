"""Neighbour strategies: each turns pairs into bonds (structure_id, u, v, ia, ib, ic, weight)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..plans.session import spread
from ..schemas import EDGE
from . import batch, graph
from . import voronoi as V
from .geometry import by_bins, near_pairs, searches_whole


def _site() -> WindowSpec:
    return Window.partitionBy("structure_id", "u")


def _near() -> WindowSpec:
    return _site().orderBy("dist", "v", "ia", "ib", "ic")


def _bonds(pairs: DataFrame, weight: Column) -> DataFrame:
    return pairs.select(*EDGE, weight.alias("weight"))


def in_chunks(structures: DataFrame, sites: DataFrame, fields: str, work: Callable[[batch.Chunk], Iterator[dict]], *columns: str, long: bool = False) -> DataFrame:
    """Rows of a kernel over whole structures: work(chunk) -> columns by name, structure_id first, of these fields.

    The sites of a structure follow one another: that takes the shuffle by structure_id that the tables mostly have had,
    and no sort of pairs. columns: those of sites that the kernel reads besides the places.
    long: the kernel works long on few bytes, so rows are dealt over all cores (see spread).
    """
    square = (F.size("lattice") == 3) & (F.size("pbc") == 3)
    for i in range(3):
        square = square & (F.size(F.get("lattice", F.lit(i))) == 3)
    cell = {f"l{i}{j}": F.when(square, F.get(F.get("lattice", F.lit(i)), F.lit(j))) for i in range(3) for j in range(3)}
    flags = {f"p{i}": F.when(square, F.get("pbc", F.lit(i))) for i in range(3)}
    cells = structures.select("structure_id", *[c.alias(n) for n, c in {**cell, **flags}.items()])
    own = sites.select("structure_id", "site_i", *dict.fromkeys(columns), "x", "y", "z")
    rows = own.join(cells, "structure_id")
    rows = (spread(rows) if long else rows.repartition("structure_id")).sortWithinPartitions("structure_id")
    kind = rows.schema["structure_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batch.whole(batches):
            for made in work(batch.Chunk(table)):
                out = pa.RecordBatch.from_pydict(made)
                for k in range(0, out.num_rows, 50_000):
                    yield out.slice(k, 50_000)

    return rows.mapInArrow(run, f"structure_id {kind}, {fields}")


BOND_FIELDS = "u int, v int, ia int, ib int, ic int, weight double"
#: name -> (cut-off, choice of bonds) of the strategies that look at distances alone, by their options.
CHOICES: dict[str, Callable[..., tuple[float, Callable]]] = {
    "minimum_distance": lambda tol=0.1, cutoff=10.0, get_all_sites=False: (cutoff, batch.everything if get_all_sites else batch.shortest(tol)),
    "minimum_okeeffe": lambda predicted, tol=0.1, cutoff=10.0: (cutoff, batch.scaled({(r.su, r.sv): r.d0 for r in predicted.select("su", "sv", "d0").collect()}, tol)),
    "cutoff_dict": lambda cutoffs: _listed(cutoffs),
    "brunner_reciprocal": lambda tol=1e-4, cutoff=8.0: (cutoff, batch.widest_gap(lambda d, after: 1 / d - 1 / after, tol)),
    "brunner_relative": lambda tol=1e-4, cutoff=8.0: (cutoff, batch.widest_gap(lambda d, after: after / d, tol)),
    "brunner_real": lambda tol=1e-4, cutoff=8.0: (cutoff, batch.widest_gap(lambda d, after: after - d, tol)),
    "econ": lambda tol=0.2, cutoff=10.0, cation_anion=False, radii=None, rounds=64: (cutoff, batch.effective(tol, rounds, cation_anion)),
}


def _listed(cutoffs: dict[tuple[str, str], float]) -> tuple[float, Callable]:
    both = {**{(b, a): r for (a, b), r in cutoffs.items()}, **cutoffs}
    return max(both.values(), default=1e-9), batch.below(both)


def _chosen(name: str, structures: DataFrame, sites: DataFrame, **options) -> DataFrame:
    """Bonds by a choice over the pairs of whole structures."""
    r, pick = CHOICES[name](**options)

    def work(chunk: batch.Chunk) -> Iterator[dict]:
        for u, v, ia, ib, ic, dist in chunk.blocks(r):
            if len(u):
                keep, weight = pick(chunk, u, v, dist)
                at = u[keep]
                yield {"structure_id": chunk.ids.take(pa.array(at)), "u": chunk.site[at], "v": chunk.site[v[keep]], "ia": ia[keep], "ib": ib[keep], "ic": ic[keep], "weight": weight}

    return in_chunks(structures, sites, BOND_FIELDS, work, "species", *(["oxi"] if options.get("cation_anion") else []))


def bond_rows(structures: DataFrame, sites: DataFrame, name: str = "minimum_distance", **options) -> DataFrame:
    """Assembled structures (see graph.assembled) with the bonds of a strategy in both directions.

    Strategies that look at distances alone make them in one pass; sites are numbered by their order.
    """
    if name not in CHOICES or options.get("radii") is not None or not searches_whole() or "binned_above" in options:
        return graph.assembled(sites, graph.symmetric(bonds(name, structures, sites, **options)))
    named(name, structures, sites)
    r, pick = CHOICES[name](**options)
    kinds = _kinds(name)

    def work(chunk: batch.Chunk) -> Iterator[dict]:
        _allowed(kinds, name, chunk)
        found = []
        for u, v, ia, ib, ic, dist in chunk.blocks(r):
            if len(u):
                keep, _ = pick(chunk, u, v, dist)
                found.append([x[keep] for x in (u, v, ia, ib, ic)])
        u, v, a, b, c = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        g = batch.Graph(chunk.start, u, v, a, b, c, both=True)
        base = g.start[g.of[g.u]]
        ends = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (g.u - base, g.v - base, g.a, g.b, g.c)], names=["u", "v", "ia", "ib", "ic"])
        yield {
            "structure_id": chunk.id_of, "species": pa.ListArray.from_arrays(pa.array(g.start.astype(np.int32)), chunk.table["species"].combine_chunks()),
            "edges": pa.ListArray.from_arrays(pa.array(g.ptr[g.start].astype(np.int32)), ends),
        }

    fields = "species array<string>, edges array<struct<u:int,v:int,ia:int,ib:int,ic:int>>"
    return in_chunks(structures, sites, fields, work, "species", *(["oxi"] if options.get("cation_anion") else []))


def minimum_distance(structures: DataFrame, sites: DataFrame, tol: float = 0.1, cutoff: float = 10.0, get_all_sites: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Bonds shorter than (1 + tol) times the site's shortest, weight shortest / dist; or all in reach, weight dist."""
    if pairs is None and searches_whole():
        return _chosen("minimum_distance", structures, sites, tol=tol, cutoff=cutoff, get_all_sites=get_all_sites)
    pairs = near_pairs(structures, sites, cutoff) if pairs is None else pairs
    if get_all_sites:
        return _bonds(pairs, F.col("dist"))
    near = pairs.withColumn("m", F.min("dist").over(_site())).where(F.col("dist") < (1 + tol) * F.col("m"))
    return _bonds(near, F.col("m") / F.col("dist"))


def _species(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    own = lambda name, col: sites.select("structure_id", F.col("site_i").alias(name), F.col("species").alias(col))
    return pairs.join(own("u", "su"), ["structure_id", "u"]).join(own("v", "sv"), ["structure_id", "v"])


def minimum_okeeffe(structures: DataFrame, sites: DataFrame, predicted: DataFrame, tol: float = 0.1, cutoff: float = 10.0) -> DataFrame:
    """Like minimum distance, on dist / predicted(su, sv). predicted: (su, sv, d0) for both orders, one row for each pair of species."""
    if searches_whole():
        return _chosen("minimum_okeeffe", structures, sites, predicted=predicted, tol=tol, cutoff=cutoff)
    pairs = _species(near_pairs(structures, sites, cutoff), sites).join(predicted, ["su", "sv"])
    rel = pairs.withColumn("rel", F.col("dist") / F.col("d0")).withColumn("m", F.min("rel").over(_site()))
    return _bonds(rel.where(F.col("rel") < (1 + tol) * F.col("m")), F.col("m") / F.col("rel"))


def cutoff_dict(structures: DataFrame, sites: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """Bonds of the listed pairs of species, in either order, below their length; weight dist."""
    if searches_whole():
        return _chosen("cutoff_dict", structures, sites, cutoffs=cutoffs)
    both = {**{(b, a): r for (a, b), r in cutoffs.items()}, **cutoffs}
    if not both:
        return _bonds(near_pairs(structures, sites, 1e-9), F.col("dist"))
    table = F.create_map(*[F.lit(x) for (a, b), r in sorted(both.items()) for x in (f"{a}\0{b}", r)])
    pairs = _species(near_pairs(structures, sites, max(both.values())), sites)
    return _bonds(pairs.where(F.col("dist") < F.try_element_at(table, F.concat_ws("\0", "su", "sv"))), F.col("dist"))


def _brunner(name: str, gap: Callable[[Column, Column], Column]):
    def strategy(structures: DataFrame, sites: DataFrame, tol: float = 1e-4, cutoff: float = 8.0) -> DataFrame:
        if searches_whole():
            return _chosen(name, structures, sites, tol=tol, cutoff=cutoff)
        pairs = near_pairs(structures, sites, cutoff)
        after = F.lead("dist").over(_near())
        gaps = pairs.withColumn("gap", gap(F.col("dist"), after)).withColumn("first", F.min("dist").over(_site()))
        widest = _site().orderBy(F.desc_nulls_last("gap"), "dist", "v", "ia", "ib", "ic")
        cut = gaps.withColumn("d_max", F.first("dist").over(widest)).withColumn("n", F.count("gap").over(_site()))
        return _bonds(cut.where((F.col("n") > 0) & (F.col("dist") < F.col("d_max") + tol)), F.col("first") / F.col("dist"))

    return strategy


brunner_reciprocal = _brunner("brunner_reciprocal", lambda d, after: 1 / d - 1 / after)
brunner_relative = _brunner("brunner_relative", lambda d, after: after / d)
brunner_real = _brunner("brunner_real", lambda d, after: after - d)


def econ(structures: DataFrame, sites: DataFrame, tol: float = 0.2, cutoff: float = 10.0, cation_anion: bool = False, radii: DataFrame | None = None, rounds: int = 64) -> DataFrame:
    """Effective coordination: weight exp(1 - (f / m)^6) above tol, with m the self-consistent mean of f.

    f is the distance, or with radii (structure_id, site_i, radius) the distance scaled by the site's share of the two
    radii. m starts at the smallest f and is averaged anew until it changes by at most 1e-4; that is a fold over the
    site's own distances, so it needs no further shuffle.
    """
    if radii is None and searches_whole():
        return _chosen("econ", structures, sites, tol=tol, cutoff=cutoff, cation_anion=cation_anion, rounds=rounds)
    pairs = near_pairs(structures, sites, cutoff)
    if cation_anion:
        oxi = lambda name, col: sites.select("structure_id", F.col("site_i").alias(name), F.col("oxi").alias(col))
        pairs = pairs.join(oxi("u", "ou"), ["structure_id", "u"]).join(oxi("v", "ov"), ["structure_id", "v"])
        pairs = pairs.where(F.when(F.col("ou") >= 0, ~(F.col("ov") > 0)).otherwise(F.col("ov") > 0))
    f = F.col("dist")
    if radii is not None:
        own = lambda name, col: radii.select("structure_id", F.col("site_i").alias(name), F.col("radius").alias(col))
        pairs = pairs.join(own("u", "ru"), ["structure_id", "u"]).join(own("v", "rv"), ["structure_id", "v"])
        f = F.when(F.col("ru") + F.col("rv") > 0, F.col("dist") * F.col("ru") / (F.col("ru") + F.col("rv"))).otherwise(F.col("dist"))
    pairs = pairs.withColumn("f", f)
    fs = pairs.groupBy("structure_id", "u").agg(F.array_sort(F.collect_list("f")).alias("fs"))

    def mean(m: Column) -> Column:
        e = lambda x: F.exp(1 - F.pow(x / m, F.lit(6.0)))
        sums = F.aggregate("fs", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["a"] + x * e(x)).alias("a"), (s["b"] + e(x)).alias("b")))
        return sums["a"] / sums["b"]

    start = F.struct(F.array_min("fs").alias("m"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        new = F.transform(F.array(s["m"]), mean)[0]
        return F.when(s["done"], s).otherwise(F.transform(F.array(new), lambda x: F.struct(x.alias("m"), (F.abs(x - s["m"]) <= 1e-4).alias("done")))[0])

    means = fs.select("structure_id", "u", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["m"].alias("m"))
    found = pairs.join(means, ["structure_id", "u"]).withColumn("w", F.exp(1 - F.pow(F.col("f") / F.col("m"), 6)))
    return _bonds(found.where((F.col("w") > tol) & (F.col("dist") < cutoff)), F.col("w"))


def distance_clusters(structures: DataFrame, sites: DataFrame, cutoff: float = 6.0, eps: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """(structure_id, u, k, bound): the largest distance of each cluster of a site, ascending from k = 0.

    In one dimension and with two members at least, density clusters are runs without a gap above eps; the site's own
    distance 0 takes part, runs of one member are noise. pairs: those within the cut-off, where they are known already.
    """
    if pairs is None and searches_whole():

        def work(chunk: batch.Chunk) -> Iterator[dict]:
            for centers, (u, *_, dist) in chunk.cut_blocks(cutoff):
                at, k, bound = batch.clusters(u, dist, centers, eps)
                yield {"structure_id": chunk.ids.take(pa.array(at)), "u": chunk.site[at], "k": k, "bound": bound}

        return in_chunks(structures, sites, "u int, k int, bound double", work)
    own = sites.select("structure_id", F.col("site_i").alias("u"), F.lit(0.0).alias("dist"))
    pairs = near_pairs(structures, sites, cutoff) if pairs is None else pairs
    all_ = pairs.select("structure_id", "u", "dist").unionByName(own)
    steps = _site().orderBy("dist")
    runs = all_.withColumn("new", (F.col("dist") - F.lag("dist").over(steps) > eps).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(steps.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = runs.groupBy("structure_id", "u", "run").agg(F.max("dist").alias("bound"), F.count("*").alias("n")).where("n >= 2")
    return bounds.select("structure_id", "u", (F.row_number().over(_site().orderBy("run")) - 1).alias("k"), "bound")


def cluster_bonds(structures: DataFrame, sites: DataFrame, cutoff: float = 6.0, pairs: DataFrame | None = None) -> DataFrame:
    """(structure_id, u, k, v, ia, ib, ic, weight): the bonds of each cluster, by distances rounded to three decimals."""
    if pairs is None and searches_whole():

        def work(chunk: batch.Chunk) -> Iterator[dict]:
            for centers, (u, v, ia, ib, ic, dist) in chunk.cut_blocks(cutoff):
                i, k, r = batch.cluster_pairs(u, dist, centers, 0.5)
                at = u[i]
                yield {"structure_id": chunk.ids.take(pa.array(at)), "u": chunk.site[at], "k": k, "v": chunk.site[v[i]], "ia": ia[i], "ib": ib[i], "ic": ic[i], "weight": r}

        return in_chunks(structures, sites, "u int, k int, v int, ia int, ib int, ic int, weight double", work)
    pairs = near_pairs(structures, sites, cutoff) if pairs is None else pairs
    bounds = distance_clusters(structures, sites, cutoff, pairs=pairs).withColumn("high", F.round("bound", 3))
    bounds = bounds.withColumn("low", F.lag("high").over(_site().orderBy("k")))
    pairs = pairs.withColumn("r", F.round("dist", 3))
    near = pairs.join(bounds.drop("bound"), ["structure_id", "u"]).where((F.col("r") <= F.col("high")) & (F.col("low").isNull() | (F.col("r") > F.col("low"))))
    return near.select("structure_id", "u", "k", "v", "ia", "ib", "ic", F.col("r").alias("weight"))


#: name -> (strategy, crystals allowed, molecules allowed)
STRATEGIES: dict[str, tuple[Callable[..., DataFrame], bool, bool]] = {
    "minimum_distance": (minimum_distance, True, True),
    "minimum_okeeffe": (minimum_okeeffe, True, True),
    "cutoff_dict": (cutoff_dict, True, True),
    "brunner_reciprocal": (brunner_reciprocal, True, False),
    "brunner_relative": (brunner_relative, True, False),
    "brunner_real": (brunner_real, True, False),
    "econ": (econ, True, True),
}


def register(name: str, strategy: Callable[..., DataFrame], structures: bool = True, molecules: bool = False) -> None:
    """Add an own strategy: a callable (structures, sites, **options) -> bonds."""
    STRATEGIES[name] = strategy, structures, molecules


def named(name: str, structures: DataFrame, sites: DataFrame) -> None:
    """An error for an unknown strategy, and for tables that lack columns or have the wrong kinds."""
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name}; there are {', '.join(sorted(STRATEGIES))}")
    need = {"structures": (structures, {"structure_id", "lattice", "pbc"}), "sites": (sites, {"structure_id", "site_i", "species", "x", "y", "z"})}
    for table, (df, columns) in need.items():
        if lacking := columns - set(df.columns):
            raise ValueError(f"{table} lacks {', '.join(sorted(lacking))}")
    kinds = dict(sites.dtypes)
    if wrong := [c for c in "xyz" if kinds[c] not in ("double", "float")]:
        raise TypeError(f"coordinates {', '.join(wrong)} are no numbers")


def _kinds(name: str) -> tuple[bool, bool]:
    return STRATEGIES[name][1:]


def _allowed(kinds: tuple[bool, bool], name: str, chunk: batch.Chunk) -> None:
    periodic = chunk.pbc.any(1)
    if (not kinds[0] and periodic.any()) or (not kinds[1] and not periodic.all()):
        raise ValueError(f"{name} does not allow this kind of structure")


def checked(structures: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables with shapes and coordinates checked as they are read, for strategies that don't check them themselves."""
    named = F.col("structure_id").cast("string")
    square = (F.size("lattice") == 3) & F.forall("lattice", lambda row: F.size(row) == 3) & (F.size("pbc") == 3)
    error = F.raise_error(F.concat(F.lit("a lattice is 3 x 3 numbers and pbc 3 flags: structure "), named))
    bad = F.raise_error(F.concat(F.lit("a site without coordinates: structure "), named))
    # values that can't be read without the check, so that no plan drops it
    lattice = F.when(square, F.col("lattice")).otherwise(error.cast(structures.schema["lattice"].dataType))
    place = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)).otherwise(bad.cast("double")) for c in "xyz"}
    return structures.withColumn("lattice", lattice), sites.withColumns(place)


def bonds(name: str, structures: DataFrame, sites: DataFrame, binned_above: int | None = None, **options) -> DataFrame:
    """Bonds by a registered strategy; structures of a kind that it does not allow raise an error when read.

    binned_above: structures of more sites than this search their pairs by cell lists; the bonds are the same.
    """
    named(name, structures, sites)
    strategy, crystals, molecules = STRATEGIES[name]
    if binned_above is not None or (name not in CHOICES and strategy not in (voronoi, crystal)) or options.get("radii") is not None or not searches_whole():
        structures, sites = checked(structures, sites)
    periodic = F.coalesce(F.get("pbc", F.lit(0)) | F.get("pbc", F.lit(1)) | F.get("pbc", F.lit(2)), F.lit(False))
    bad = F.lit(False) if crystals and molecules else ~periodic if crystals else periodic
    allowed = structures.withColumn("pbc", F.when(bad, F.raise_error(F.lit(f"{name} does not allow this kind of structure")).cast("array<boolean>")).otherwise(F.col("pbc"))) if not (crystals and molecules) else structures
    if binned_above is None:
        return strategy(allowed, sites, **options)
    small = strategy(allowed.where(F.col("n_sites") <= binned_above), sites, **options)
    with by_bins():
        large = strategy(allowed.where(F.col("n_sites") > binned_above), sites, **options)
    return small.unionByName(large)


def _by_kernel(structures: DataFrame, sites: DataFrame, make: Callable[[list, list, list, list], list[tuple]], fields: list | None = None) -> DataFrame:
    """Rows of a whole-structure kernel, (lattice, coords, species, oxi) -> rows of these fields; bonds by default."""
    own = sites.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("site_i", "species", "x", "y", "z", "oxi"))).alias("s"))
    fields = fields or [("u", pa.int32()), ("v", pa.int32()), ("ia", pa.int32()), ("ib", pa.int32()), ("ic", pa.int32()), ("weight", pa.float64())]
    kinds = [T.StructField(n, T.DoubleType() if a == pa.float64() else T.IntegerType()) for n, a in fields]

    @F.arrow_udf(T.ArrayType(T.StructType(kinds)))
    def run(lattices: pa.Array, atoms: pa.Array) -> pa.Array:
        out = []
        for cell, rows in zip(lattices.to_pylist(), atoms.to_pylist()):
            found = make(cell, [(a["x"], a["y"], a["z"]) for a in rows], [a["species"] for a in rows], [a["oxi"] for a in rows])
            out.append([dict(zip([n for n, _ in fields], f)) for f in found])
        return pa.array(out, pa.list_(pa.struct(fields)))

    rows = own.join(structures.select("structure_id", "lattice"), "structure_id")
    return spread(rows).select("structure_id", F.explode(run("lattice", "s")).alias("e")).select("structure_id", "e.*")


def voronoi_facets(structures: DataFrame, sites: DataFrame, cutoff: float = 13.0) -> DataFrame:
    """(structure_id, u, v, dist, solid_angle, area, volume): every facet of every Voronoi cell; volume is that of its pyramid."""
    names = ("dist", "solid_angle", "area", "volume")

    def work(chunk: batch.Chunk) -> Iterator[dict]:
        for f in V.cells(chunk, cutoff):
            yield {"structure_id": chunk.ids.take(pa.array(f["u"])), "u": chunk.site[f["u"]], "v": chunk.site[f["v"]], **{n: f[n] for n in names}}

    return in_chunks(structures, sites, f"u int, v int, {', '.join(f'{n} double' for n in names)}", work, long=True)


def voronoi(structures: DataFrame, sites: DataFrame, tol: float = 0.0, targets: list[str] | None = None, cutoff: float = 13.0, weight: str = "solid_angle") -> DataFrame:
    """Facets of the Voronoi cell above tol times the largest; weight relative to it, by any measure of a facet."""
    if weight not in ("dist", "solid_angle", "area", "volume", "face_dist"):
        return _by_kernel(structures, sites, lambda cell, xyz, species, oxi: V.voronoi_bonds(cell, xyz, species, tol, targets, cutoff, weight))

    def work(chunk: batch.Chunk) -> Iterator[dict]:
        codes, names = chunk.species
        wanted = np.array([targets is None or x in targets for x in names])
        for f in V.cells(chunk, cutoff):
            f = {n: x[wanted[codes[f["v"]]]] for n, x in f.items()}
            first, count = batch.segments(f["u"])
            if not len(first):
                continue
            most = np.repeat(np.maximum.reduceat(f[weight], first), count)
            keep = np.flatnonzero(f[weight] > tol * most)
            u = f["u"][keep]
            yield {"structure_id": chunk.ids.take(pa.array(u)), "u": chunk.site[u], "v": chunk.site[f["v"][keep]], **{n: f[n][keep] for n in ("ia", "ib", "ic")}, "weight": f[weight][keep] / most[keep]}

    return in_chunks(structures, sites, BOND_FIELDS, work, "species", long=True)


def crystal(structures: DataFrame, sites: DataFrame, ionic: dict[str, dict[int, float]] | None = None, search_cutoff: float = 7.0, **options) -> DataFrame:
    """The most likely coordination by weighted Voronoi facets; options as in voronoi.crystal_bonds.

    ionic: radii by element and oxidation state, for the cut-off by distance; without it covalent radii hold.
    """
    from .ids import ELECTRONEGATIVITY
    from .radii import radius_of

    if ionic is not None:
        options["radius_of"] = lambda s, o: radius_of(s, o, ionic)
    of = options.pop("radius_of", None)
    measures = ("v", "dist", "solid_angle", "area", "volume", "face_dist")

    def work(chunk: batch.Chunk) -> Iterator[dict]:
        species, oxi = chunk.table["species"].to_pylist(), chunk.table["oxi"].to_pylist()
        radii = [of(s, o) for s, o in zip(species, oxi)] if of else None
        for f in V.cells(chunk, search_cutoff):
            first, count = batch.segments(f["u"])
            columns = [f[n].tolist() for n in measures]
            images = list(zip(*[f[n].tolist() for n in ("ia", "ib", "ic")]))
            found = []
            for at, n in zip(first.tolist(), count.tolist()):
                u = int(f["u"][at])
                lo, hi = (int(x) for x in chunk.start[chunk.of[u] : chunk.of[u] + 2])
                mine = [dict(zip(measures, row), image=image) for *row, image in zip(*[x[at : at + n] for x in columns], images[at : at + n])]
                for facet in mine:
                    facet["v"] -= lo
                own = {"radii": radii[lo:hi]} if of else {}
                found += [(u, v + lo, *rest) for _, v, *rest in V.likely_bonds(mine, u - lo, species[lo:hi], oxi[lo:hi], ELECTRONEGATIVITY, **own, **options)]
            if found:
                u, v, ia, ib, ic, w = (np.array(x) for x in zip(*found))
                yield {"structure_id": chunk.ids.take(pa.array(u)), "u": chunk.site[u], "v": chunk.site[v], "ia": ia.astype(np.int32), "ib": ib.astype(np.int32), "ic": ic.astype(np.int32), "weight": w}

    return in_chunks(structures, sites, BOND_FIELDS, work, "species", "oxi", long=True)


register("voronoi", voronoi)
register("crystal", crystal)
