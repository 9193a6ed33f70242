"""Environment sequences as joins: shells, cumulative histograms, level strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digest import HASHES, blake
from ..plans.session import stored
from . import batch

PLACE = ["structure_id", "center", "site", "ia", "ib", "ic"]


def shells(sites: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(structure_id, center, level, site, ia, ib, ic): the places first reached at each level from 1 to depth.

    Each shell is a table of its own in the shared folder: it is read three times, and its lineage would double with every
    level. In an undirected graph a new place can only have been met in the last two shells, so only these are subtracted.
    """
    edges = stored(edges, "edges")
    step = edges.select("structure_id", F.col("u").alias("site"), "v", *[F.col(c).alias(f"d{c}") for c in ("ia", "ib", "ic")])
    zero = F.lit(0).cast("int")
    last = sites.select("structure_id", F.col("site_i").alias("center"), F.col("site_i").alias("site"), *[zero.alias(c) for c in ("ia", "ib", "ic")])
    before, out = None, None
    for level in range(1, depth + 1):
        moved = [(F.col(c) + F.col(f"d{c}")).alias(c) for c in ("ia", "ib", "ic")]
        new = last.join(step, ["structure_id", "site"]).select("structure_id", "center", F.col("v").alias("site"), *moved).dropDuplicates(PLACE)
        new = new.join(last, PLACE, "left_anti")
        new = new if before is None else new.join(before, PLACE, "left_anti")
        before, last = last, stored(new, "shell")
        rows = last.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else last.withColumn("level", zero).limit(0)


def shell_counts(sites: DataFrame, edges: DataFrame, labels: DataFrame, depth: int) -> DataFrame:
    """(structure_id, center, level, label, n bigint) for the labels met at each level."""
    named = labels.select("structure_id", F.col("site_i").alias("site"), "label")
    return shells(sites, edges, depth).join(named, ["structure_id", "site"]).groupBy("structure_id", "center", "level", "label").agg(F.count("*").alias("n"))


def level_strings(sites: DataFrame, edges: DataFrame, labels: DataFrame, depth: int) -> DataFrame:
    """(structure_id, site_i, label, levels array<string>): exactly `depth` strings for each site.

    Counts are cumulative and never start anew. A site's labels and counts by level are folded inside its own row, so the
    grid of levels and labels is never materialised.
    """
    counts = shell_counts(sites, edges, labels, depth)
    met = counts.groupBy("structure_id", "center").agg(F.array_sort(F.collect_list(F.struct("label", "level", "n"))).alias("met"))
    own = labels.join(met.withColumnRenamed("center", "site_i"), ["structure_id", "site_i"], "left")
    names = F.array_distinct(F.transform("met", lambda m: m["label"]))

    def level(k):
        upto = lambda name: F.aggregate(F.filter("met", lambda m: (m["label"] == name) & (m["level"] <= k)), F.lit(0).cast("bigint"), lambda a, m: a + m["n"])
        seen = F.filter(F.transform(names, lambda name: F.struct(name.alias("label"), upto(name).alias("n"))), lambda s: s["n"] > 0)
        return F.coalesce(F.array_join(F.transform(seen, lambda s: F.concat(s["label"], s["n"].cast("string"))), ""), F.lit(""))

    levels = F.array(*[level(F.lit(k)) for k in range(1, depth + 1)]).cast("array<string>")
    return own.select("structure_id", "site_i", "label", levels.alias("levels"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row in b["levels"].to_pylist():
            h = ""
            for level in row:
                h = blake(f"{h}-{level}")
            out.append(h)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], names=[*b.schema.names[:3], "text"])


def environments(levels: DataFrame, digest: str | None = "blake2b") -> DataFrame:
    """(structure_id, site_i, label, cs): hashed by a digest of HASHES, or plain with digest None."""
    if digest == "blake2b":  # a barrier keeps the optimizer from inlining the lambdas into the function's argument
        rows = levels.select("structure_id", "site_i", "label", "levels")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
        rows = rows.mapInArrow(_folded, f"{kinds}, text string")
    else:
        text = F.array_join("levels", "-") if digest is None else HASHES[digest][1](F.col("levels"))
        rows = levels.select("structure_id", "site_i", "label", text.alias("text"))
    return rows.select("structure_id", "site_i", "label", F.concat("label", F.lit("-"), "text").alias("cs"))


def cumulative(counts: DataFrame) -> DataFrame:
    """Running totals of shell counts by (structure_id, center, label), for the levels at which a label is met."""
    upto = Window.partitionBy("structure_id", "center", "label").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("n", F.sum("n").over(upto))


def _levels_of(rows: DataFrame, fields: str, work: Callable[[batch.Graph, batch.Labels], tuple[np.ndarray, dict]], label: str) -> DataFrame:
    """Rows of a kernel over assembled structures with start labels in a column; work's first column is the structure's place."""
    kind = rows.schema["structure_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, names = batch.lists(b["label"])
            names = names.to_pylist()
            for lo, hi, g, _ in batch.graphs(b["species"], b["edges"]):
                of, columns = work(g, batch.Labels(g, names[start[lo] : start[hi]]))
                out = pa.RecordBatch.from_pydict({"structure_id": b["structure_id"].take(pa.array(of + lo)), **columns})
                for k in range(0, out.num_rows, 50_000):
                    yield out.slice(k, 50_000)

    return rows.select("structure_id", "species", "edges", F.col(label).alias("label")).mapInArrow(run, f"structure_id {kind}, {fields}")


def shell_counts_of(rows: DataFrame, depth: int, label: str = "species", cumulated: bool = False) -> DataFrame:
    """shell_counts, or cumulative(shell_counts), of assembled structures with their start labels in an array column."""

    def work(g, labels):
        every = np.arange(g.sites)
        parts, whole = [], np.zeros(g.sites * labels.width, np.int64)
        for level, i, site in g.shells(every, np.full(g.sites, depth)):
            n = np.bincount(i * labels.width + labels.number[site], minlength=g.sites * labels.width)
            whole += n
            cell = np.flatnonzero(n)
            parts.append((cell, np.full(len(cell), level), (whole if cumulated else n)[cell]))
        cell, level, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
        site, number = np.divmod(cell, labels.width)
        of = g.of[site]
        names = [labels.sets[s][k] for s, k in zip(of.tolist(), number.tolist())]
        return of, {"center": g.local[site].astype(np.int32), "level": level.astype(np.int32), "label": pa.array(names, pa.string()), "n": n}

    return _levels_of(rows, "center int, level int, label string, n bigint", work, label)


def level_strings_of(rows: DataFrame, depth: int, label: str = "species") -> DataFrame:
    """level_strings of assembled structures with their start labels in an array column."""

    def work(g, labels):
        found: list[list[str]] = [[] for _ in range(g.sites)]
        for _, on, texts in batch.level_texts(g, labels, np.arange(g.sites), np.full(g.sites, depth)):
            for j, text in zip(on, texts):
                found[j].append(text)
        return g.of, {"site_i": g.local.astype(np.int32), "label": pa.array(labels.names, pa.string()), "levels": pa.array(found, pa.list_(pa.string()))}

    return _levels_of(rows, "site_i int, label string, levels array<string>", work, label)
