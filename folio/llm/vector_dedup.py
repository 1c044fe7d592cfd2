"""Near-duplicate vectors by sorted projection passes.

In a pass, a label's vectors are ordered lexicographically by concatenated random hashes: the signs of projections of the vector minus its label's mean, since embeddings
share a direction that would say nothing. The order is cut into blocks of WINDOW vectors, and each block is compared with itself and the block before it as matrix products: a window of
at least WINDOW neighbours on one side. The number of passes follows from a label's size and from how alike its vectors are, so that a pair at the
threshold meets in some pass with a probability of RECALL or more; a label of at most two blocks needs one pass and misses nothing, and one so dense that passes would cost more than
all its pairs is compared tile by tile, which misses nothing either. Ranks decide blocks, so results don't depend on partitions.

No row is made for a pair: a block gives each of its linked vectors one link, that to the smallest vector it is connected with in there. The links of all passes are united to
components. How many vectors each one is linked with is counted within components, tile by tile, so it is exact for the pairs whose components were found.

Comparisons are by cosine in double precision, and only between equal labels that are not null. Vectors that are null, empty or zero,
or hold a null or a number that is not finite, are linked with nothing; so are vectors of different lengths. Equal vectors and repeated rows are linked
like any others; they are one class until the end, so thousands of copies cost one comparison. Null ids count as larger than all others. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, small
from .textbatch import small_batches, tidy

#: Vectors of a block, signs of a pass's key, the least probability with which a pair at the threshold meets in some pass, and passes that are made in one go.
WINDOW, BITS, RECALL, AT_ONCE = 1024, 48, 0.98, 4
#: Vectors compared at once within a tile, the least and the most in a tile. Tiles grow with the root of a group's size, so that tasks become both more and larger.
BLOCK, LEAST_IN_TILE, MOST_IN_TILE = 512, 128, 16384


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, each of norm 1, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes(vectors: DataFrame, vec_id: str, embedding: str, label: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows with their class, and a row for each class: (class, label, dim, v, n, first)."""
    v = F.col(embedding)
    sound = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # Floats stay floats where they are sent; arithmetic is in doubles.
    numbers = v if vectors.schema[embedding].dataType.simpleString() == "array<float>" else F.transform(v, lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.struct(F.col(label).cast("string").alias("label"), numbers.alias("v"))).alias("x"))
    # Copies are one class: 64 bits of a digest of the label and the numbers.
    digest = F.sha2(F.concat_ws("\0", F.col("x.label"), F.to_json(F.struct("x.v"))), 256)
    keyed = rows.withColumn("class", F.when(F.col("x").isNotNull(), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    named = scratch.table(keyed, "rows")
    each = named.where("class is not null").groupBy("class").agg(F.first("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return named, scratch.table(each.select("class", F.col("x.label").alias("label"), F.size("x.v").alias("dim"), F.col("x.v").alias("v"), "n", "first"), "classes")


def tile_links(x: np.ndarray, cls: np.ndarray, n: np.ndarray, split: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compares rows before ``split`` with those from it on; with a split of 0, all rows with each other.

    For each linked row its class, the smallest class that it is connected with here, and how many vectors of other classes it is linked with.
    """
    order = np.concatenate([np.argsort(cls[:split]), split + np.argsort(cls[split:])])
    x, cls, n = x[order], cls[order], n[order]
    linked, group = np.zeros(len(cls), np.int64), np.arange(len(cls))
    for at in range(0, split or len(cls), BLOCK):
        end = min(at + BLOCK, split or len(cls))
        base = split or at
        hit = x[at:end] @ x[base:].T >= least
        if not split:
            hit &= np.arange(base, len(cls))[None] > np.arange(at, end)[:, None]
        if not hit.any():
            continue
        linked[at:end] += hit @ n[base:]
        linked[base:] += n[at:end] @ hit
        for i in np.flatnonzero(hit.any(1)):
            mine = np.append(group[base:][hit[i]], group[at + i])
            if (mine != mine[0]).any():
                group[np.isin(group, mine)] = mine.min()
    some = np.flatnonzero(linked)
    low = np.full(len(cls), np.iinfo(np.int64).max)
    np.minimum.at(low, group, cls)
    return cls[some], low[group[some]], linked[some]


def links(each: DataFrame, key: list[str], least: float, scratch: Scratch) -> DataFrame:
    """(a, b, linked) from all pairs of each group with one key, compared in pairs of tiles, see tile_links. each: (class, *key, v, n)."""
    sizes = scratch.table(each.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    tiles = F.ceil(F.col("m") / F.least(F.lit(MOST_IN_TILE), F.greatest(F.lit(LEAST_IN_TILE), F.ceil(8 * F.sqrt("m"))))).cast("int")
    joined = each.select("class", *key, "v", "n").join(F.broadcast(sizes) if small(sizes) else sizes, key)
    dealt = joined.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    # Tile t meets every tile u: as the first of (t, u) for u >= t, as the second of (u, t) for u < t.
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*key, F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "class", "v", "n")

    def compare(table: pa.Table) -> pa.Table:
        tile, t, u = table.column("tile").to_numpy(), table.column("t")[0].as_py(), table.column("u")[0].as_py()
        order = np.argsort(tile, kind="stable")
        split = int((tile == t).sum()) if t != u else 0
        if t != u and split in (0, len(tile)):  # one of the tiles got no class
            out = [np.zeros(0, np.int64)] * 3
        else:
            out = tile_links(_matrix(table.column("v"))[order], table.column("class").to_numpy()[order], table.column("n").to_numpy()[order], split, least)
        return pa.table(dict(zip(("a", "b", "linked"), map(pa.array, out), strict=True)))

    return sent.groupBy(*key, "t", "u").applyInArrow(compare, "a long, b long, linked long")


def passes_for(n: int, spread: float, least: float) -> int:
    """How many passes a label of n vectors needs, whose unit vectors have a mean of squared length ``spread``; 0: all pairs are cheaper.

    Without the mean, a pair at the threshold is at this angle, and agrees in a sign with the probability that follows; it stands in one block or in two adjoining ones if
    it agrees in as many signs as there are halvings from n to a block.
    """
    if n <= 2 * WINDOW:
        return 1
    cosine = (least - spread) / max(1 - spread, 1e-12)
    if cosine <= 0:
        return 0
    agree = 1 - math.acos(min(cosine, 1.0)) / math.pi
    meet = agree ** math.log2(n / WINDOW)
    needed = 1 if meet >= RECALL else math.ceil(math.log(1 - RECALL) / math.log1p(-meet))
    return needed if needed * 2 * WINDOW < n else 0


def centres(each: DataFrame, least: float) -> DataFrame:
    """(label, dim, m, passes, centre): the mean of every label's unit vectors of one length."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(label, dim, n, x) for (label, dim), (n, x) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["label", "dim", "m", "x"])

        for b in batches:
            t = pa.Table.from_batches([b])
            for key in set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                mine = t.filter(pc.and_(pc.equal(t["label"], key[0]), pc.equal(t["dim"], key[1])))
                now = held.setdefault(key, [0, np.zeros(key[1])])
                now[0] += len(mine)
                now[1] += _matrix(mine["v"]).sum(0)
            if len(held) > 5000:
                yield out()
        if held:
            yield out()

    partial = each.select("label", "dim", "v").mapInArrow(add, "label string, dim int, m long, x array<double>")
    by_place = partial.select("label", "dim", "m", F.posexplode("x").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("m").alias("m"), F.sum("x").alias("x"))
    mean = by_place.groupBy("label", "dim").agg(F.first("m").alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("m")).alias("x")))), lambda s: s["x"]).alias("centre"))
    plan = F.udf(lambda n, spread: passes_for(n, spread, least), "int")  # a row a label
    return mean.select("label", "dim", "m", plan("m", F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x)).alias("passes"), "centre")


def keyed(each: DataFrame, first: int, last: int) -> DataFrame:
    """each (class, label, dim, v, n, passes, centre) -> (pass, key, class, label, dim, v, n) for the passes from first up to last."""
    schema = f"pass int, key long, class long, label string, dim int, v {each.schema['v'].dataType.simpleString()}, n long"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        bit = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims, passes = b.column("dim").to_numpy(), b.column("passes").to_numpy()
            for dim in np.unique(dims).tolist():
                for p in range(first, last):
                    mine = b.filter(pa.array((dims == dim) & (passes > p)))
                    if not len(mine):
                        continue
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([dim, p, 20240711]).normal(size=(dim, BITS))
                    off = _matrix(mine.column("v")) - mine.column("centre").flatten().to_numpy().reshape(len(mine), -1)
                    key = ((off @ planes[dim, p] > 0) * bit).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), p, np.int32)), pa.array(key), *(mine.column(c) for c in ("class", "label", "dim", "v", "n"))], ["pass", "key", "class", "label", "dim", "v", "n"])

    return each.mapInArrow(run, schema)


def pass_links(rows: DataFrame, n: int, least: float, scratch: Scratch) -> DataFrame:
    """rows (pass, key, class, label, dim, v, n) -> links (a, b) from blocks of WINDOW neighbours, each compared with itself and the block before."""
    group = ["pass", "label", "dim"]
    order = [*group, "key", "class"]
    parts = max(1, -(-n // (16 * WINDOW)))
    # Places in the order: those in a range, fixed once written, and how many of a group stand in the ranges before.
    placed = scratch.table(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("range", F.shiftright("at", 33))
    starts = placed.groupBy("range", *group).agg(F.min("at").alias("start"), F.count("*").alias("here"))
    earlier = F.coalesce(F.sum("here").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.table(starts.select("range", *group, (earlier - F.col("start")).alias("shift"), F.sum("here").over(Window.partitionBy(*group)).alias("all")), "starts")
    ranked = placed.join(F.broadcast(starts) if small(starts) else starts, ["range", *group])
    block, last = F.floor((F.col("at") + F.col("shift")) / WINDOW).cast("int"), F.floor((F.col("all") - 1) / WINDOW).cast("int")
    # A block's rows are also sent to the next one, to be compared as those before it. Blocks past the last don't exist.
    dealt = ranked.select(*group, block.alias("own"), F.explode(F.when(block < last, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"), "class", "v", "n")

    def compare(table: pa.Table) -> pa.Table:
        before = table.column("own").to_numpy() < table.column("block").to_numpy()
        order = np.argsort(~before, kind="stable")
        x, cls, n, split = _matrix(table.column("v"))[order], table.column("class").to_numpy()[order], table.column("n").to_numpy()[order], int(before.sum())
        found = [tile_links(x[split:], cls[split:], n[split:], 0, least)[:2]] + ([tile_links(x, cls, n, split, least)[:2]] if split else [])
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.table({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    return dealt.groupBy(*group, "block").applyInArrow(compare, "a long, b long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for every row."""
    scratch = scratch or Scratch(vectors.sparkSession, "vectors")
    small_batches(vectors.sparkSession)
    named, each = classes(vectors, vec_id, embedding, label, scratch)
    plan = scratch.table(centres(each, least).where("m > 1"), "centres")
    few = small(plan, 20_000)
    # How many rows each number of passes concerns: a row a number.
    needed = {r["passes"]: r["m"] for r in plan.groupBy("passes").agg(F.sum("m").alias("m")).collect()}
    meet = each.join(F.broadcast(plan) if few else plan, ["label", "dim"])
    found = []
    if needed.get(0):
        found.append(scratch.table(links(meet.where("passes = 0").select("class", "label", "dim", "v", "n"), ["label", "dim"], least, scratch).select("a", "b").where("a <> b").distinct(), "tile links"))
    for first in range(0, max(needed, default=0), AT_ONCE):
        last = first + AT_ONCE
        n = sum(m * (min(p, last) - first) for p, m in needed.items() if p > first)
        found.append(scratch.table(pass_links(keyed(meet.where(F.col("passes") > first), first, last), n, least, scratch).distinct(), "links"))
        scratch.forget()
    pairs = found[0] if found else scratch.spark.createDataFrame([], "a long, b long")
    for f in found[1:]:
        pairs = pairs.union(f)
    labels = scratch.table(connected_components(pairs, scratch), "components").withColumnsRenamed({"node": "class", "label": "component"})
    counts = links(each.join(F.broadcast(labels) if small(labels) else labels, "class").select("class", "component", "v", "n"), ["component"], least, scratch).groupBy(F.col("a").alias("class")).agg(F.sum("linked").alias("linked"))
    lowest = each.join(labels, "class").groupBy("component").agg(F.min("first").alias("low"))
    info = labels.join(lowest, "component").join(counts, "class").select("class", "low", "linked")
    info = scratch.table(each.select("class", "n", "first").join(info, "class", "left").select("class", F.coalesce("low", "first").alias("low"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "info")
    out = named.select("vec_id", "class").join(F.broadcast(info) if small(info) else info, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
