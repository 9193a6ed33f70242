"""N-gram Jaccard join: adaptive multi-match prefixes over distinct 5-word shingles, down to exact components.

Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets. A document is known by a 64-bit
fingerprint of its set, so equal sets are one from the start. Then:

1. One pass counts shingles in a sketch, over all documents; its width follows the text (`sketch_bits`), up to 2^22. (sketch count, shingle) is the global order.
2. A second pass emits each set's prefix: its first n - ceil(t n) + l shingles in that order. l is chosen for each
   document from the estimated cost of its candidates: a longer prefix costs rows, but raises the number of shared
   prefix shingles that a pair needs, alpha(x, y) - max(|x| - prefix(x), |y| - prefix(y)), before it is verified. Only
   shingles that two sets have in their prefixes are kept; the others are dropped where they meet.
3. Stars: for each shingle the set that meets the most others is the centre. Documents that share enough with a centre are
   verified against it, at most TRIES each. Groups of copies collapse here without pairs between their members.
4. All pairs that still lie in different components, and share as many prefix shingles as they need, are verified. Two
   documents of one component need no test: it could not change the components. So no link between components is lost.

Verification intersects the whole sets. Components are found by label propagation with pointer jumping over tables.
Every stage is cut by a table in the shared folder; nothing of all documents reaches the driver but the sketch. Groups are as
many as their bytes take, whatever the session's number of partitions; owners of a frequent shingle meet block by block,
and a set that many are held against is sent to several groups. Joins by a frequent shingle, centre or component have one row
for each key on the other side; adaptive execution splits their partitions.

Defined results: null, empty and blank texts have no shingles and link with nothing; with fewer than `size` words the whole
sequence is one shingle. A row without doc_id has no component (null) and links with nothing. Rows with one doc_id
are known by their own texts: equal ones are in one component, others only if links join them. Repeated rows are returned as
often as they occur by `jaccard_components`, and once by `one_of_each`; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import Bounded, materialize, shuffle_width, sum_arrays

SIZE, PERCENT = 5, 75
TRIES = 2
#: Part of the shared shingles a pair needs that a document must share with a centre to be tried; not used after that.
SHARE = 0.3
#: Extra prefix shingles that a document may choose from; the choice travels in the three low bits of its tokens.
EXTRA = (1, 2, 4, 8, 16)
#: Bytes that a group of packed rows is to have about, and its owners of one shingle; groups are made as many as that takes.
GROUP_BYTES, OWNERS = 16_000_000, 2_000
#: Proposed pairs that a task holds before it passes them on, and the parts in which it does.
HELD, PARTS = 1_000_000, 4_096
#: Bytes of ids or pairs up to which they are broadcast to the texts; beyond it, both are dealt by key.
BROADCAST_BYTES = 32_000_000
#: Pairs of one set that are verified together with one copy of it.
TOGETHER = 200
_MIX, _SHIFT, _TOKEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), np.uint64(0xFFFFFFFFFFFFFFF8)


@lru_cache(1)
def _words() -> Bounded:
    import xxhash

    return Bounded(xxhash.xxh3_64_intdigest, 120_000, "shingles")


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    k = min(size, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> _SHIFT
    return np.unique(out)


def set_key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def alpha(nx, ny, percent: int = PERCENT):
    """Smallest intersection with which sets of these sizes link."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_length(estimates: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """(length, index into EXTRA) of the prefix of a set whose shingles have these estimated counts, in order."""
    n = len(estimates)
    base = n - (-(-percent * n // 100))
    cost = np.cumsum(estimates)
    best = (np.inf, 1, 0)
    for i, extra in enumerate(EXTRA):
        p = min(n, base + extra)
        needed = max(1, int(alpha(n, n, percent)) - (n - p))
        # a row for each token; and at most cost / needed documents share that many of them and are verified
        total = p + 4.0 * cost[p - 1] / needed
        if total < best[0]:
            best = (total, p, i)
        if p == n:
            break
    return best[1], best[2]


def sketch_bits(shingles_: int, tasks: int) -> int:
    """Counters of the sketch, as a power of 2: one for 256 shingles, but at most one for 8 that a task scans."""
    most = max(1, min(shingles_ // 256, shingles_ // max(1, tasks) // 8))
    return min(22, max(14, most.bit_length() - 1))


def _scan(docs: DataFrame, key: str, text: str, size: int, bits: int) -> DataFrame:
    """Rows (doc, set, n), and with each task's share of the sketch rows (chunk, counts)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, schema = np.zeros(1 << bits, np.int64), None
        for b in batches:
            sets = [shingles(t, size) for t in b["text"].to_pylist()]
            keys = [set_key(s) if len(s) else None for s in sets]
            new = list({k: s for k, s in zip(keys, sets) if k is not None}.values())
            if new:
                sketch += np.bincount((np.concatenate(new) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            nothing = pa.nulls(b.num_rows)
            out = pa.RecordBatch.from_arrays([b["doc"], pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names=["doc", "set", "n", "chunk", "counts"])
            schema = out.schema
            yield out
        if schema is not None:
            parts = np.split(np.minimum(sketch, 2**31 - 1).astype("<i4"), 32)
            yield pa.RecordBatch.from_arrays([pa.nulls(32).cast(schema.field("doc").type), pa.nulls(32, pa.int64()), pa.nulls(32, pa.int64()), pa.array(range(32), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=schema.names)

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, set bigint, n bigint, chunk int, counts binary")


def _shared_tokens(docs: DataFrame, text: str, sketch: np.ndarray, size: int, percent: int, buckets: int) -> DataFrame:
    """(token, set, extra): prefix shingles that at least two sets have in their prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # at most 2^22 numbers
    bits = len(sketch).bit_length() - 1
    ordinary = float(np.median(sketch)) * 1.5
    # a bucket holds about this many rows; a shingle that may have as many alone is dealt over all buckets by its owners
    hot = ordinary + max(1000.0, float(sketch.sum()) / (4 * buckets))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for b in batches:
            tokens, owners, common = [], [], []
            for t in b["text"].to_pylist():
                found = shingles(t, size)
                if not len(found):
                    continue
                k = set_key(found)
                if k in seen:
                    continue
                seen.add(k)
                f = counts[(found >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((found, f))
                p, extra = prefix_length(np.maximum(0.0, f[order] - ordinary), percent)
                tokens.append(found[order[:p]] & _TOKEN | np.uint64(extra))
                owners.append(np.full(p, k, np.int64))
                common.append(f[order[:p]] >= hot)
            if len(seen) > 500_000:
                seen.clear()
            if not tokens:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            bucket = ((token >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            bucket = np.where(np.concatenate(common), buckets + owner % buckets, bucket).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used, start = np.unique(bucket[order], return_index=True)
            ends = np.append(start, len(order))[1:]
            rows = [(order[s:e]) for s, e in zip(start, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([token[r].tobytes() for r in rows], pa.binary()), pa.array([owner[r].tobytes() for r in rows], pa.binary())], names=["bucket", "tokens", "owners"])

    def meet(table: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()])
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in table["owners"].to_pylist()])
        order = np.lexsort((owner, token & _TOKEN))
        token, owner = token[order], owner[order]
        same_token = (token[1:] & _TOKEN) == (token[:-1] & _TOKEN)
        new = np.append(True, ~(same_token & (owner[1:] == owner[:-1])))  # a set that several tasks met counts once
        token, owner = token[new], owner[new]
        same = (token[1:] & _TOKEN) == (token[:-1] & _TOKEN)
        several = np.append(False, same) | np.append(same, False) | (table["bucket"][0].as_py() >= buckets)  # a part of a hot shingle's owners
        token, owner = token[several], owner[several]
        return pa.table({"token": pa.array((token & _TOKEN).view(np.int64)), "set": pa.array(owner), "extra": pa.array((token & ~_TOKEN).astype(np.int32))})

    packed = docs.select(F.col(text).alias("text")).mapInArrow(emit, "bucket int, tokens binary, owners binary")
    return packed.groupBy("bucket").applyInArrow(meet, "token bigint, set bigint, extra int")


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) of sets that link.

    Of a pair, the set that has fewer pairs brings its shingles along; those of the other are sent once for every TOGETHER
    of its pairs. So a set that thousands are held against, as the centre of a family is, lands in as many groups as that takes.
    """
    needed = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct().join(sets, "set").select(F.col("doc").alias(key)).distinct()
    needed = materialize(needed, "needed")
    size_of_ids = needed.agg(F.sum(F.octet_length(F.col(key).cast("string")) + 16)).first()[0] or 0
    texts = docs.select(key, text).join(F.broadcast(needed) if size_of_ids <= BROADCAST_BYTES else needed, key, "left_semi")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s for t in b["text"].to_pylist() if len(s := shingles(t, size))]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["set", "shingles"])

    whole = texts.select(F.col(text).alias("text")).mapInArrow(rebuild, "set bigint, shingles binary")
    times = pairs.select(F.explode(F.array("x", "y")).alias("set")).groupBy("set").agg(F.count("*").alias("t"))
    count = lambda name: times.select(F.col("set").alias(name), F.col("t").alias(f"t{name}"))
    size_of = lambda name: sets.select(F.col("set").alias(name), F.col("n").alias(f"n{name}"))
    told = pairs.select("x", "y").join(count("x"), "x").join(count("y"), "y").join(size_of("x"), "x").join(size_of("y"), "y")
    by_x = F.col("tx") > F.col("ty")
    told = told.select(F.when(by_x, F.col("y")).otherwise(F.col("x")).alias("own"), F.when(by_x, F.col("x")).otherwise(F.col("y")).alias("with"), F.greatest("tx", "ty").alias("t"), F.when(by_x, F.col("ny")).otherwise(F.col("nx")).alias("n"))
    told = materialize(told.withColumn("part", F.pmod(F.xxhash64("own"), F.ceil(F.col("t") / TOGETHER)).cast("int")), "pairs")
    shingles_, n_pairs = told.agg(F.sum("n"), F.count("*")).first()
    groups = _groups(docs.sparkSession, 8 * (shingles_ or 0))
    group = F.pmod(F.xxhash64("with", "part"), F.lit(groups)).cast("int").alias("group")
    nobody = F.lit(None).cast("bigint")
    asked = told.select(F.col("own").alias("set"), group, "with").unionByName(told.select("with", "part").distinct().select(F.col("with").alias("set"), group, nobody.alias("with")))
    rows = whole.join(F.broadcast(asked) if 80 * n_pairs <= BROADCAST_BYTES else asked, "set").select("group", "set", "with", "shingles")

    def intersect(table: pa.Table) -> pa.Table:
        sets_, others, blobs = table["set"].to_pylist(), table["with"].to_pylist(), table["shingles"]
        of = {s: i for i, (s, other) in enumerate(zip(sets_, others)) if other is None}
        good = []
        for i, (own, other) in enumerate(zip(sets_, others)):
            if other is not None:
                a, b = (np.frombuffer(blobs[k].as_buffer(), np.uint64) for k in (i, of[other]))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    good.append((min(own, other), max(own, other)))
        return pa.table({"x": pa.array([g[0] for g in good], pa.int64()), "y": pa.array([g[1] for g in good], pa.int64())})

    return materialize(rows.groupBy("group").applyInArrow(intersect, "x bigint, y bigint").distinct(), "links")


def _groups(spark: SparkSession, size: int) -> int:
    """How many groups rows of this many bytes in all are dealt to."""
    return int(max(shuffle_width(spark), -(-size // GROUP_BYTES)))


def components(links: DataFrame) -> DataFrame:
    """(set, comp): the smallest set reachable from each set that has a link."""
    edges = materialize(links.select("x", "y").union(links.select("y", "x")).toDF("set", "other").distinct(), "edges")
    labels = materialize(edges.groupBy("set").agg(F.least(F.col("set"), F.min("other")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("set", "other"), "other").groupBy("set").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "set").select("set", "comp", F.least("comp", "near").alias("now"))
        jump = labels.select(F.col("set").alias("now"), F.col("comp").alias("further"))
        moved = hooked.join(jump, "now").select("set", F.least("now", "further").alias("comp"), (F.least("now", "further") < F.col("comp")).alias("moved"))
        moved = materialize(moved, "labels")
        labels = moved.select("set", "comp")
        if moved.where("moved").isEmpty():
            return labels


def _crossing(tokens: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different components that share as many prefix shingles as they need.

    The owners of a shingle are dealt in blocks of OWNERS, and every two blocks meet in a group of their own. A group passes the
    pairs it finds on whenever it holds HELD of them, with the number of shingles they share there; the numbers are added up.
    """
    spark = tokens.sparkSession
    rows = tokens.join(sets.select("set", "n"), "set").join(comps, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    rows = materialize(rows, "owned-tokens")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.ceil(F.count("*") / OWNERS).cast("int").alias("blocks"), F.count("*").alias("l"))
    mixed = materialize(mixed.where("a <> b").select("token", "blocks", "l"), "mixed-tokens")
    groups = _groups(spark, 50 * (mixed.agg(F.sum(F.col("l") * F.col("blocks"))).first()[0] or 0))
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = rows.join(mixed.drop("l"), "token").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.select(F.pmod(F.xxhash64("token", "i", "j"), F.lit(groups)).cast("int").alias("group"), "token", "i", "j", "block", "set", "n", "comp", "extra")
    pair = np.dtype([("x", "<i8"), ("y", "<i8"), ("need", "<i4"), ("c", "<i4")])
    extras = np.array(EXTRA)

    def merged(found: np.ndarray) -> np.ndarray:
        found = found[np.lexsort((found["y"], found["x"]))]
        first = np.flatnonzero(np.append(True, (found["x"][1:] != found["x"][:-1]) | (found["y"][1:] != found["y"][:-1])))
        out = found[first]
        out["c"] = np.add.reduceat(found["c"], first)
        return out

    def passed_on(made: list[np.ndarray]) -> pa.RecordBatch:
        found = merged(np.concatenate(made))
        part = (found["x"].view(np.uint64) % np.uint64(PARTS)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        used, start = np.unique(part[order], return_index=True)
        blobs = [found[order[s:e]].tobytes() for s, e in zip(start, np.append(start, len(order))[1:])]
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], names=["part", "pairs"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # about GROUP_BYTES, at least the owners of one block or two
        cols = {c: table[c].to_numpy() for c in ("token", "i", "j", "block", "set", "n", "comp", "extra")}
        order = np.lexsort((cols["set"], cols["comp"], cols["j"], cols["i"], cols["token"]))
        token, i, j, block, owner, n, comp, extra = (c[order] for c in cols.values())
        rest = n - np.minimum(n, n - (-(-percent * n // 100)) + extras[extra])
        new = np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        edges = np.append(np.flatnonzero(new), len(token))
        runs = np.append(np.flatnonzero(new | np.append(True, comp[1:] != comp[:-1])), len(token))
        ends = edges[np.searchsorted(edges, np.arange(len(token)), "right")]  # of each row's shingle
        nexts = runs[np.searchsorted(runs, np.arange(len(token)), "right")]  # and of its component there
        made: list[np.ndarray] = []
        held = 0
        for r in np.flatnonzero(nexts < ends):
            o = np.arange(nexts[r], ends[r])
            o = o[(100 * np.minimum(n[o], n[r]) >= percent * np.maximum(n[o], n[r])) & ((i[r] == j[r]) | (block[o] != block[r]))]
            if len(o):
                out = np.empty(len(o), pair)
                out["x"], out["y"], out["c"] = np.minimum(owner[r], owner[o]), np.maximum(owner[r], owner[o]), 1
                out["need"] = np.maximum(1, alpha(n[r], n[o], percent) - np.maximum(rest[r], rest[o]))
                made.append(out)
                held += len(o)
            if held > 2 * HELD:
                made = [merged(np.concatenate(made))]
                held = len(made[0])
                if held > HELD:
                    yield passed_on(made)
                    made, held = [], 0
        if made:
            yield passed_on(made)

    def enough(table: pa.Table) -> pa.Table:
        found = merged(np.concatenate([np.frombuffer(x, pair) for x in table["pairs"].to_pylist()]))
        found = found[found["c"] >= found["need"]]
        return pa.table({"x": pa.array(np.ascontiguousarray(found["x"])), "y": pa.array(np.ascontiguousarray(found["y"]))})

    proposed = materialize(dealt.groupBy("group").applyInArrow(propose, "part int, pairs binary"), "proposed")
    wide = min(PARTS, _groups(spark, proposed.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0))
    return proposed.withColumn("part", F.col("part") % wide).groupBy("part").applyInArrow(enough, "x bigint, y bigint")


def _components(docs: DataFrame, percent: int, size: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, set, n) of all texts, and (set, comp, component_id) of all sets: the component and its smallest key."""
    spark = docs.sparkSession
    length = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = sketch_bits(length // 6, docs.rdd.getNumPartitions())
    scan = materialize(_scan(docs, key, text, size, bits), "scan")
    sketch = sum_arrays(scan.where("chunk IS NOT NULL").select("chunk", "counts"), 1 << bits)
    buckets = _groups(spark, 16 * int(sketch.sum()) // 3)  # a third of the shingles are in prefixes, or little more
    rows = scan.where("chunk IS NULL").select("doc", "set", "n")
    sets = materialize(rows.where("set IS NOT NULL AND doc IS NOT NULL").groupBy("set").agg(F.min("doc").alias("doc"), F.max("n").alias("n")), "documents")
    tokens = materialize(_shared_tokens(docs.where(F.col(key).isNotNull()), text, sketch, size, percent, buckets), "tokens")

    # the centre of a shingle is the set whose prefix meets the most others: of a family of copies, that is the original
    lengths = tokens.groupBy("token").agg(F.count("*").alias("l"))
    met = tokens.join(lengths, "token").groupBy("set").agg(F.sum("l").alias("met"))
    centres = tokens.join(met, "set").groupBy("token").agg(F.max(F.struct("met", "set"))["set"].alias("y"))
    shared = tokens.join(centres, "token").where("set <> y").groupBy("set", "y").agg(F.count("*").alias("c"))
    size_of = lambda name: sets.select(F.col("set").alias(name), F.col("n").alias(f"n{name}"))
    stars = shared.withColumnRenamed("set", "x").join(size_of("x"), "x").join(size_of("y"), "y")
    # a heuristic choice, by the number of shared prefix shingles for which y is the centre: what it misses, step 4 finds
    wanted = F.greatest(F.lit(1), F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent)) - F.greatest(*[F.floor(F.col(c) * percent / 100) for c in ("nx", "ny")]))
    near = stars.where((100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (F.col("c") >= SHARE * wanted))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))).where(F.col("r") <= TRIES)
    links = _verify(materialize(best.select("x", "y"), "stars"), sets, docs, key, text, size, percent)
    first = components(links)
    crossing = materialize(_crossing(tokens, sets, first, percent), "crossing")
    between = _verify(crossing, sets, docs, key, text, size, percent)
    for name in ("x", "y"):  # what is left to join are components, not documents
        comp = first.select(F.col("set").alias(name), F.col("comp").alias("c"))
        between = between.join(comp, name, "left").withColumn(name, F.coalesce("c", name)).drop("c")
    second = components(between.where("x <> y").distinct()).select(F.col("set").alias("comp"), F.col("comp").alias("further"))
    # the smallest key of a component first of its parts, so that no component meets in one task
    named = sets.join(first, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    parts = materialize(named.groupBy("comp").agg(F.min("doc").alias("doc")).join(second, "comp", "left").withColumn("further", F.coalesce("further", "comp")), "parts")
    smallest = parts.groupBy("further").agg(F.min("doc").alias("component_id"))
    finals = parts.select("comp", "further").join(smallest, "further")
    return rows, named.select("set", "comp").join(finals, "comp").select("set", F.col("further").alias("comp"), "component_id")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles long, component_id): component_id is the smallest key reachable by links, itself included."""
    rows, named = _components(docs, percent, size, key, text)
    return rows.join(named.drop("comp"), "set", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, of its smallest key; all columns stay, rows without key or without words stay.

    A key that occurs once stands for its row. The rows of a key that occurs more often are judged one by one, by their
    own text; of several with the component's smallest key one stays.
    """
    rows, named = _components(docs, percent, size, key, text)
    named = materialize(named, "components")
    several = materialize(rows.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").select("doc"), "repeated-keys")
    copies = rows.join(named, "set").where(F.col("doc") != F.col("component_id")).select("doc")
    gone = materialize(copies.union(several).distinct().withColumnRenamed("doc", key), "copies")
    kept = docs.join(gone, key, "left_anti")
    if several.isEmpty():
        return kept

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], names=[*b.schema.names, "__set"])

    own = docs.join(several.withColumnRenamed("doc", key), key, "left_semi").withColumn("__row", F.monotonically_increasing_id())
    own = materialize(own.mapInArrow(keyed, StructType([*own.schema.fields, StructField("__set", LongType())])), "repeated-rows")
    judged = own.select("__row", F.col("__set").alias("set"), F.col(key).alias("doc"), F.xxhash64(text).alias("h")).join(named, "set").where(F.col("doc") == F.col("component_id"))
    first = judged.groupBy("comp").agg(F.min(F.struct("h", "__row"))["__row"].alias("__row")).select("__row")
    stay = own.where("__set IS NULL").select("__row").union(first)
    return kept.unionByName(own.join(stay, "__row", "left_semi").select(*docs.columns))
