"""Sharding by a k-d tree over row metadata, in DataFrame operations only.

Each dimension becomes an order-preserving 62-bit key: 40 bits of value, numbers by their place between the column's
extremes, text by its first five bytes after the common prefix of all; and 22 bits of a hash below that, so that a value
which a third of all rows share can still be split. Rows of one group (equal texts, for documents) are kept together if the
group weighs at most `keep` of a shard: they get the group's smallest values and one hash, of the lower half, so that where
a cut meets a value it mostly falls among single rows. Heavier groups are split: each of their rows has keys of its own.

A node that is to become s shards is split at the weighted quantile floor(s/2) : ceil(s/2) of the dimension along which it is
widest (its key range against the root's). Weighted quantiles are found for all nodes of a level at once, by histograms
of BINS bins which are narrowed to the bin that holds the target until this bin weighs less than `tolerance` of a
shard, or is a single key. Each pass aggregates map-side first; the driver gets at most shards x BINS numbers. A node is a
function of a row's keys, so no pass moves rows; they are shuffled once, at the end, for the gapless slots.

Defined results: null numbers sort below all others and null text as empty text; a null or negative weight counts as 0; null
groups are no group. An empty table gives no rows. The hash is one of all columns of the row, so shards don't depend on how the
table is stored; only repeated rows of a group that is split differ by a row number, and may part. Columns other than the
dimensions and the weight are carried along; columns named `shard` or `slot` are replaced, and names may not start with `__`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ranked, shuffle_width

BINS = 1024
#: The share of a shard up to which a group is kept together.
KEEP = 0.25
_VALUE, _HASH = 40, 22


def _place(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a whole number from 0 below 2^40."""
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = [d for d in dims if isinstance(kinds[d], T.NumericType)]
    ends = df.agg(*[f(F.col(d).cast("double")).alias(f"{f.__name__}_{d}") for d in numbers for f in (F.min, F.max)]).first() if numbers else {}
    out = []
    for d in dims:
        if d in numbers:
            low, high = ends[f"min_{d}"] or 0.0, ends[f"max_{d}"] or 0.0
            share = (F.col(d).cast("double") - low) / (high - low) if high > low else F.lit(0.0)
            out.append(F.coalesce(F.least(F.greatest(share * (2**_VALUE - 2), F.lit(0.0)), F.lit(2.0**_VALUE - 2)).cast("long") + 1, F.lit(0)))
        else:
            text = F.coalesce(F.col(d).cast("string"), F.lit(""))
            first, last = df.agg(F.min(text), F.max(text)).first()
            same = next((i for i, (a, b) in enumerate(zip(first or "", last or "")) if a != b), min(len(first or ""), len(last or "")))
            tail = F.rpad(F.hex(F.encode(F.substring(text, same + 1, 5), "UTF-8")), 10, "0")
            out.append(F.conv(F.substring(tail, 1, 10), 16, 10).cast("long"))
    return out


def keyed_rows(rows: DataFrame, shards: int, weight: str, dims: list[str], group: str | None = None, keep: float = KEEP) -> tuple[DataFrame, float]:
    """The rows with their weight `__w`, a number `__row` and a key `__k0`, `__k1`, ... for each dimension; and a shard's weight."""
    values = [f"__p{i}" for i in range(len(dims))]
    rows = rows.drop("shard", "slot")
    hashed = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out = rows.withColumns(dict(zip(values, _place(rows, dims))) | {"__w": F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long")})
    out = out.withColumns({"__h": F.xxhash64(*hashed), "__row": F.monotonically_increasing_id(), "__g": F.xxhash64(group) if group else F.lit(None).cast("long")})
    if group:
        out = out.withColumn("__g", F.when(F.col(group).isNotNull(), F.col("__g")))
    total, n = out.agg(F.sum("__w"), F.count("*")).first()
    target = (total or 0) / shards
    tie = lambda number, half: F.lit(half << _HASH - 1) + F.shiftrightunsigned(number, 65 - _HASH)
    if not group:
        keys = {f"__k{i}": F.shiftleft(v, _HASH) + tie(F.xxhash64("__h", F.lit(i)), 1) for i, v in enumerate(values)}
        return out.withColumns(keys).drop(*values, "__h", "__g"), target
    groups = out.where("__g IS NOT NULL").groupBy("__g").agg(F.sum("__w").alias("__gw"), F.count("*").alias("__gn"), *[F.min(v).alias(f"__g{v}") for v in values]).where("__gn > 1")
    groups = materialize(groups, "groups")
    # groups of very many rows are dealt over salts: at most 1024 of them, so what is broadcast is bounded
    many = groups.where(F.col("__gn") > max(100, n // 1024)).select("__g", F.ceil(F.col("__gn") / max(100, n // 1024)).cast("int").alias("__salts"))
    salted = groups.join(F.broadcast(many), "__g", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    out = out.join(F.broadcast(many), "__g", "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    out = out.join(salted, ["__g", "__salt"], "left")
    whole = F.coalesce(F.col("__gw") <= keep * target, F.lit(False))
    own = F.when(F.col("__gn").isNotNull(), F.xxhash64("__h", "__row")).otherwise(F.col("__h"))
    out = out.withColumn("__whole", whole).withColumn("__h", F.when(F.col("__whole"), F.col("__g")).otherwise(own))
    half = lambda i: F.when(F.col("__whole"), tie(F.xxhash64("__h", F.lit(i)), 0)).otherwise(tie(F.xxhash64("__h", F.lit(i)), 1))
    keys = {f"__k{i}": F.shiftleft(F.when(F.col("__whole"), F.col(f"__g{v}")).otherwise(F.col(v)), _HASH) + half(i) for i, v in enumerate(values)}
    return out.withColumns(keys).drop(*values, *[f"__g{v}" for v in values], "__h", "__g", "__gw", "__gn", "__whole", "__salt"), target


def kd_shards(rows: DataFrame, shards: int, weight: str, dims: list[str], tolerance: float = 0.001, group: str | None = None, keep: float = KEEP) -> DataFrame:
    """rows with `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard); sizes are near equal by weight."""
    spark = rows.sparkSession
    keys = [f"__k{i}" for i in range(len(dims))]
    keyed, target = keyed_rows(rows, shards, weight, dims, group, keep)
    keyed = materialize(keyed, "keys")

    cuts: dict[int, tuple[int, int]] = {}  # of the nodes that are split: dimension, first key of the right side
    tree = {0: (0, shards)}  # of each node: its first shard and how many
    node, depth_nodes, number = F.lit(0), {0: (0, shards)}, 1
    root: list[int] | None = None
    while open_nodes := {n: span for n, span in depth_nodes.items() if span[1] > 1}:
        at = keyed.withColumn("__node", node).where(F.col("__node").isin(*open_nodes))
        wide = at.groupBy("__node").agg(F.sum("__w").alias("w"), *[f(k).alias(f"{f.__name__}{k}") for k in keys for f in (F.min, F.max)]).collect()
        if not wide:
            break
        if root is None:
            root = [max(1, wide[0][f"max{k}"] - wide[0][f"min{k}"]) for k in keys]
        todo = {}
        for r in wide:
            d = max(range(len(keys)), key=lambda i: ((r[f"max{keys[i]}"] - r[f"min{keys[i]}"]) / root[i], -i))
            span = open_nodes[r["__node"]][1]
            # dimension, lowest key, one above the highest key, weight below the lowest key, weight wanted on the left
            todo[r["__node"]] = [d, r[f"min{keys[d]}"], r[f"max{keys[d]}"] + 1, 0, r["w"] * (span // 2) / span]
        while todo:
            key = _of_node({n: F.col(keys[t[0]]) for n, t in todo.items()})
            width = {n: max(1, -(-(t[2] - t[1]) // BINS)) for n, t in todo.items()}
            low, high, step = (_of_node({n: F.lit(f(n, t)) for n, t in todo.items()}) for f in (lambda n, t: t[1], lambda n, t: t[2], lambda n, t: width[n]))
            inside = at.where(F.col("__node").isin(*todo)).withColumns({"__key": key, "__low": low, "__high": high, "__step": step}).where((F.col("__key") >= F.col("__low")) & (F.col("__key") < F.col("__high")))
            bins: dict[int, list[tuple[int, int]]] = {n: [] for n in todo}
            for r in inside.groupBy("__node", F.expr("(__key - __low) div __step").alias("b")).agg(F.sum("__w").alias("w")).collect():
                bins[r["__node"]].append((r["b"], r["w"]))
            for n in list(todo):
                d, lowest, _, below, wanted = todo[n]
                for b, w in sorted(bins[n]):
                    if below + w >= wanted:
                        break
                    below += w
                start = lowest + b * width[n]
                if width[n] == 1 or w <= tolerance * target:
                    cuts[n] = (d, start if wanted - below < below + w - wanted and below else start + width[n])
                    del todo[n]
                else:
                    todo[n] = [d, start, start + width[n], below, wanted]
        depth_nodes = {}
        for n in open_nodes:
            if n in cuts:
                first, span = open_nodes[n]
                depth_nodes |= {number: (first, span // 2), number + 1: (first + span // 2, span - span // 2)}
                tree |= {n: (number, number + 1), number: depth_nodes[number], number + 1: depth_nodes[number + 1]}
                number += 2
        node = _descend(0, cuts, tree, keys)
    leaves = {n: span[0] for n, span in tree.items() if n not in cuts}
    placed = keyed.withColumn("shard", _descend(0, cuts, tree, keys, leaves).cast("int"))
    counts = placed.groupBy("shard").agg(F.count("*").alias("n"))
    return ranked(placed, "shard", counts, "slot", ["__row"], 4 * shuffle_width(spark)).drop("__row", "__w", *keys)


def _of_node(values: dict[int, Column]) -> Column:
    return reduce(lambda out, kv: F.when(F.col("__node") == kv[0], kv[1]).otherwise(out), values.items(), F.lit(None))


def _descend(n: int, cuts: dict, tree: dict, keys: list[str], names: dict[int, int] | None = None) -> Column:
    """The leaf, so far, of a row: nested comparisons, one for each level. names: other numbers for the leaves."""
    if n not in cuts:
        return F.lit(names[n] if names else n)
    left, right = (_descend(child, cuts, tree, keys, names) for child in tree[n])
    return F.when(F.col(keys[cuts[n][0]]) < cuts[n][1], left).otherwise(right)
