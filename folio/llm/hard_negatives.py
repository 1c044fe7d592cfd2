"""Hard negatives by inner product, found with a pivot table.

Every vector x gets one more component, sqrt(M^2 - |x|^2), where M is the greatest length, and an anchor a gets 0; then |a - x|^2 = |a|^2 + M^2 - 2 a.x, so the
greatest inner product is the least Euclidean distance. Each row's distances to a few pivots are stored. By the triangle inequality |d(a,p) - d(x,p)| <= d(a,x) <= d(a,p) + d(x,p),
which brackets the score; what the bracket leaves is checked exactly. Rows are range-sorted by label, nearest pivot and distance into blocks, so a block's
least and greatest pivot distances bracket all of its scores at once, before any vector is sent.

Anchors (the stated queries) meet rows in blocks: a task holds one block and streams blocks of anchors past it. Blocks come in waves, each 16 times the one before: what
a wave finds raises the score that later ones have to reach, so the rows handed on stay near 16 k a query and wave at any size. Labels are ranges of
blocks, so a label with a third of all rows is as many tasks as it has blocks.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part (nor those that scaling makes infinite). Vectors of different lengths are never compared; one set of pivots a
length is held on the driver. A repeated row is another row, but rows of an anchor's own id are never its positives. Ties go by smaller id. Fewer rows than asked for are all returned; a
negative positive score leaves no window. Scores are exact up to 2^53 / 100, as doubles beyond. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from .scratch import Scratch
from .textbatch import small_batches, tidy

#: Pivots of a length of vector; rows of a block and of a block of anchors, and their most bytes; growth from wave to wave.
PIVOTS, BLOCK_ROWS, ANCHOR_ROWS, BLOCK_BYTES, ANCHOR_BYTES, WAVE = 8, 4096, 512, 8 << 20, 1 << 20, 16
LOWEST = -1e300


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def items_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (id long, label, vec array<double> of whole numbers, anchor boolean) that take part, with a number of their own, their length and square: a written table."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = rows.where("id is not null and label is not null and vec is not null").where(fine)
    return scratch.table(held.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vec", F.coalesce("anchor", F.lit(False)).alias("anchor"), F.size("vec").alias("dim"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("square")), "items")


def pivots_of(items: DataFrame, count: int = PIVOTS) -> dict[int, tuple[float, np.ndarray]]:
    """For each length of vector: the greatest square, and pivots with their added component. Pivots are the rows of the least hashes of their ids, so any run takes the same."""
    most = {r["dim"]: r["most"] for r in items.groupBy("dim").agg(F.max("square").alias("most")).collect()}
    order = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "row")
    chosen = items.select("dim", "id", "row", "vec", "square").withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).orderBy("dim", "place").collect()
    out: dict[int, list[list[float]]] = {}
    for r in chosen:
        out.setdefault(r["dim"], []).append([*r["vec"], max(most[r["dim"]] - r["square"], 0.0) ** 0.5])
    return {d: (most[d], np.array(p, np.float64).reshape(len(p), d + 1)) for d, p in out.items()}


def distances(vecs: np.ndarray, squares: np.ndarray, most: float, pivots: np.ndarray, anchors: bool) -> np.ndarray:
    """Distances to the pivots, all in the space with one more component."""
    added = np.zeros(len(vecs)) if anchors else np.sqrt(np.maximum(most - squares, 0))
    point = np.column_stack([vecs, added])
    return np.sqrt(np.maximum((point * point).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (point @ pivots.T), 0))


def pivot_table(items: DataFrame, pivots: dict, anchors: bool, scratch: Scratch) -> DataFrame:
    """(row, id, label, dim, vec, square, near, dist): the stored distances; vectors as bytes of doubles."""
    given = items.where("anchor") if anchors else items
    schema = StructType([*[given.schema[c] for c in ("row", "id", "label", "dim", "square")], *_parse_datatype_string("vec binary, near int, dist array<double>").fields])
    arrow = _arrow(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                most, p = pivots[d]
                vecs = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                dist = distances(vecs, part.column(4).to_numpy(), most, p, anchors)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([v.tobytes() for v in np.ascontiguousarray(vecs)], pa.binary()), pa.array(dist.argmin(1).astype(np.int32)), pa.array(dist.tolist(), pa.list_(pa.float64()))], schema=arrow)

    return scratch.table(given.select("row", "id", "label", "dim", "square", "vec").mapInArrow(run, schema), "pivot_table")


def blocks_of(table: DataFrame, rows: int, size: int, scratch: Scratch) -> DataFrame:
    """Rows in blocks of near pivot distances: (block, dim, label, n, ids, vecs, dists, squares, numbers as bytes; low, high: least and greatest distance to each pivot; least, greatest square)."""
    order = ["dim", "label", "near", F.col("dist")[0], "row"]
    given = table.repartitionByRange(*order).sortWithinPartitions(*order).select("dim", "label", "row", "id", "vec", "dist", "square")
    schema = StructType([StructField("block", LongType()), *[table.schema[c] for c in ("dim", "label")], *_parse_datatype_string("n int, ids binary, vecs binary, dists binary, squares binary, numbers binary, low array<double>, high array<double>, least double, greatest double").fields])
    arrow = _arrow(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def told() -> pa.RecordBatch:
            nonlocal number
            dist, square = np.array([r["dist"] for r in held]), np.array([r["square"] for r in held])
            row = {"block": number, "dim": held[0]["dim"], "label": held[0]["label"], "n": len(held), "ids": np.array([r["id"] for r in held], np.int64).tobytes(), "vecs": b"".join(r["vec"] for r in held), "dists": dist.tobytes(), "squares": square.tobytes(), "numbers": np.array([r["row"] for r in held], np.int64).tobytes(), "low": dist.min(0).tolist(), "high": dist.max(0).tolist(), "least": square.min(), "greatest": square.max()}
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if held and ((row["dim"], row["label"]) != (held[0]["dim"], held[0]["label"]) or len(held) >= max(1, min(rows, size // (8 * max(1, row["dim"]))))):
                    yield told()
                held.append(row)
        if held:
            yield told()

    return scratch.table(given.mapInArrow(run, schema), "blocks")


def bracket(anchor_dist: np.ndarray, anchor_square: np.ndarray, row_dist: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner products of anchors and rows, (anchors, rows), from their distances to the pivots; a little wider for rounding."""
    near = np.zeros((len(anchor_dist), len(row_dist)))
    far = np.full_like(near, np.inf)
    for p in range(anchor_dist.shape[1]):
        a, x = anchor_dist[:, p, None], row_dist[None, :, p]
        np.maximum(near, np.abs(a - x), out=near)
        np.minimum(far, a + x, out=far)
    whole = (anchor_square + most)[:, None]
    slack = 1 + 1e-9 * whole
    return (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack


def best_in_block(anchor: dict, block: dict, most: float, k: int, low: int, high: int, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of the anchor, window, id, score) of what one block offers to one block of anchors: at most k a window. anchor's windows: (row, window, positive's score or None, score to reach)."""
    places = {int(n): i for i, n in enumerate(anchor["numbers"])}
    by_window: dict[int, list[dict]] = {}
    for w in anchor["windows"]:
        by_window.setdefault(w["window"], []).append(w)
    lowest, highest = bracket(anchor["dists"], anchor["squares"], block["dists"], most)
    wanted = []
    fits = np.zeros(lowest.shape, bool)
    for window, held in sorted(by_window.items()):
        at = np.array([places[w["row"]] for w in held])
        positive = np.array([np.nan if w["positive"] is None else w["positive"] for w in held], np.float64)
        reach = np.array([w["reach"] for w in held], np.float64)
        from_, to = (reach, np.full(len(at), np.inf)) if same else (np.maximum(reach, low * positive / 100 - 1), high * positive / 100 + 1)
        fits[at] |= (highest[at] >= from_[:, None]) & (lowest[at] <= to[:, None])
        wanted.append((window, at, positive, reach))
    if same:
        fits &= anchor["ids"][:, None] != block["ids"][None]
    rows, cols = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
    if not len(rows):
        return
    exact = np.full(fits.shape, LOWEST)
    exact[np.ix_(rows, cols)] = anchor["vecs"][rows] @ block["vecs"][cols].T
    exact[~fits] = LOWEST
    for window, at, positive, reach in wanted:
        score = exact[at]
        good = (score > LOWEST) & (score >= reach[:, None])
        if not same:
            good &= (low * positive[:, None] <= 100 * score) & (100 * score <= high * positive[:, None])
        score = np.where(good, score, LOWEST)
        if score.shape[1] > k:
            score[score < np.partition(score, score.shape[1] - k, axis=1)[:, -k, None]] = LOWEST
        i, j = np.nonzero(score > LOWEST)
        order = np.lexsort((block["ids"][j], -score[i, j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        i, j = i[rank < k], j[rank < k]
        yield anchor["numbers"][at[i]], np.full(len(i), window, np.int32), block["ids"][j], score[i, j]


def _read(row: dict) -> dict:
    n = row["n"]
    out = {"ids": np.frombuffer(row["ids"], np.int64), "numbers": np.frombuffer(row["numbers"], np.int64), "squares": np.frombuffer(row["squares"], np.float64)}
    return out | {"vecs": np.frombuffer(row["vecs"], np.float64).reshape(n, row["dim"]), "dists": np.frombuffer(row["dists"], np.float64).reshape(n, -1), "windows": row.get("windows")}


FOUND = "row bigint, window int, id bigint, score double"


def sweep(anchors: DataFrame, blocks: DataFrame, windows: DataFrame, pivots: dict, k: int, scratch: Scratch, *, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The first k rows of each (row, window) of windows (block, row, window, positive), by score, then id: (row, window, id, score).

    same: rows of the anchor's label; otherwise rows of other labels with low * positive <= 100 * score <= high * positive.
    """
    most = {d: m for d, (m, _) in pivots.items()}
    arrow = _arrow(_parse_datatype_string(FOUND))
    label = ["dim", "label"] if same else ["dim"]
    order = Window.partitionBy(*label).orderBy(F.xxhash64("block"), "block")
    # A row a block: its place decides its wave.
    light = scratch.table(blocks.select("block", "dim", "label", "low", "high").withColumn("place", F.row_number().over(order)), "places")
    waves = light.agg(F.max("place")).first()[0] or 0
    biggest = F.create_map(*[F.lit(x) for d, m in most.items() for x in (d, m)]) if most else F.create_map(F.lit(0), F.lit(0.0))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["anchors"] is None:
                    held = _read(row)
                    continue
                found = list(best_in_block(_read(row), held, most[row["dim"]], k, low, high, same))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    best, start, end = None, 0, WAVE
    while start < waves:
        reach = windows.withColumn("reach", F.lit(LOWEST))
        if best is not None:
            full = best.groupBy("row", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("row", "window", "kth")
            reach = windows.join(full, ["row", "window"], "left").select(*windows.columns, F.coalesce("kth", F.lit(LOWEST)).alias("reach"))
        least = F.col("reach") if same else F.greatest("reach", F.col("positive") * low / 100 - 1)
        greatest = F.lit(-LOWEST) if same else F.col("positive") * high / 100 + 1
        asked = scratch.table(reach.groupBy("block").agg(F.collect_list(F.struct("row", "window", "positive", "reach")).alias("windows"), F.min(least).alias("from"), F.max(greatest).alias("to")), "asked")
        asking = anchors.select(F.col("block").alias("anchors"), F.col("dim").alias("d"), F.col("label").alias("l"), F.col("low").alias("alow"), F.col("high").alias("ahigh"), "least", "greatest").join(asked.select(F.col("block").alias("anchors"), "from", "to"), "anchors")
        # Whole blocks are bracketed first; only pairs that can hold a result have their vectors sent.
        gap = F.array_max(F.zip_with(F.zip_with("low", "ahigh", lambda x, a: x - a), F.zip_with("alow", "high", lambda a, x: a - x), lambda p, q: F.greatest(p, q, F.lit(0.0))))
        reachable = F.array_min(F.zip_with("high", "ahigh", lambda x, a: x + a))
        whole = F.element_at(biggest, F.col("d"))
        possible = ((F.col("greatest") + whole) * (1 + 2e-9) - gap * gap) / 2 + 1 >= F.col("from")
        possible &= ((F.col("least") + whole) * (1 - 2e-9) - reachable * reachable) / 2 - 1 <= F.col("to")
        met = (F.col("dim") == F.col("d")) & ((F.col("label") == F.col("l")) if same else (F.col("label") != F.col("l")))
        pairs = light.where((F.col("place") > start) & (F.col("place") <= end)).join(asking, met).where(possible).select("block", "anchors")
        bulk = ["dim", "n", "ids", "vecs", "dists", "squares", "numbers"]
        payload = anchors.select(F.col("block").alias("anchors"), *bulk).join(asked.select(F.col("block").alias("anchors"), "windows"), "anchors")
        sent = pairs.join(payload, "anchors").select("block", "anchors", *bulk, "windows")
        kept = blocks.join(pairs.select("block").distinct(), "block", "left_semi").select("block", F.lit(None).cast("long").alias("anchors"), *bulk, F.lit(None).cast(sent.schema["windows"].dataType).alias("windows"))
        met_ = kept.unionByName(sent).repartition("block").sortWithinPartitions("block", F.col("anchors").asc_nulls_first())
        found = met_.mapInArrow(run, FOUND)
        first = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
        best = scratch.table((found if best is None else best.unionByName(found)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank"), "best")
        start, end = end, end * WAVE
    return best if best is not None else anchors.sparkSession.createDataFrame([], FOUND)


def hard_negatives(rows: DataFrame, scratch: Scratch, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """rows (id, label, vec, anchor) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first rows of the same label; each one's negatives are the first rows of other labels that score between low and high per cent of it.
    """
    small_batches(rows.sparkSession)
    items = items_of(rows, scratch)
    pivots = pivots_of(items)
    blocks = blocks_of(pivot_table(items, pivots, False, scratch), BLOCK_ROWS, BLOCK_BYTES, scratch)
    anchors = blocks_of(pivot_table(items, pivots, True, scratch), ANCHOR_ROWS, ANCHOR_BYTES, scratch)

    @tidy
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, numbers, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row, id_ = np.frombuffer(numbers, np.int64), np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block)), pa.array(row), pa.array(id_)], ["block", "row", "anchor_id"])

    who = scratch.table(anchors.select("block", "numbers", "ids").mapInArrow(members, "block bigint, row bigint, anchor_id bigint"), "anchors")
    first = sweep(anchors, blocks, who.select("block", "row", F.lit(0).alias("window"), F.lit(None).cast("double").alias("positive")), pivots, positives, scratch, same=True)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    pairs = scratch.table(first.select("row", rank.alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive")).join(who, "row"), "positives")
    second = sweep(anchors, blocks, pairs.where("positive >= 0").select("block", "row", "window", "positive"), pivots, negatives, scratch, same=False, low=low, high=high)
    place = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "id"))
    whole = lambda c: F.expr(f"try_cast({c} as bigint)")
    return second.withColumn("rank", place).join(pairs, ["row", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), whole("positive").alias("positive_score"), whole("score").alias("negative_score"))


def quantised(embeddings: DataFrame) -> DataFrame:
    """(id, label, vec, anchor) of the table: labels of ids divisible by 7 are moved on by one, components are 256ths, rounded down."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    # floor() gives longs, which the largest doubles don't fit: from 2^52 on a double is whole as it is.
    down = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform("embedding", lambda x: down(x.cast("double") * 256)).alias("vec"), (F.col("vec_id") % 100 == 0).alias("anchor"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), Scratch(spark, "negatives"))


#: Brute force over all rows for the anchors.
OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x : floor(256 * x::double)) as vec
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as alike, b.vec_id as id, list_inner_product(a.vec, b.vec)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id, score from s where alike qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.alike and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify rank <= 10
"""
