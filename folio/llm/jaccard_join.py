"""Exact Jaccard self-join of texts by n-gram sets, through parity sketches.

Every shingle is XORed into one symbol of a sketch, so the number of symbols in which two sketches differ is at most the
symmetric difference of the sets. Sizes are banded; a band's sketches have more symbols than the largest symmetric difference
that a linked pair of the band can have, so by the pigeonhole principle such a pair has a symbol in common: the join key. A set also
writes keys for the next band if a partner may be there. Candidates are verified on the whole sets.

Keys that very many classes share are told from a sample of the texts, and their classes are dealt to salts: each salt has a pivot of its own, and the salts' pivots
meet in turn. So no key's classes have to pass through one task.

Copies with one set are one class from the start, and only classes are joined. A key's classes are first compared by parity bits: every
shingle flips one of about two bits a shingle, so the Hamming distance of two classes' bits is at most their symmetric difference, and a pair
that differs in more bits than a linked pair's difference can have is no pair. All are compared with the key's smallest class; in keys whose
classes are then not all connected, the others too: by a join where a key has few classes, and tile by tile where it has many, of which only a spanning forest
comes out. What these bits connect is a family; every link lies within one. A family's whole sets are compared tile by tile as matrix products, and
again a spanning forest of the true links comes out. So no pair is left out, and no task or row count grows with the square of a group.

A null or blank text has an empty set and is linked with nothing. Repeated rows and equal texts are linked. Null ids
are kept and count as larger than all others. Extra columns are not read, and may have any name.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, small
from .shingles import U, mix, shingle_sets
from .textbatch import fresh, small_batches, steps, tidy


class Bands:
    """Size bands for a threshold num/den: where each begins, and its sketch's symbols and spare symbols."""

    def __init__(self, num: int, den: int, ratio: float = 1.25, most: int = 1 << 40):
        self.num, self.den = num, den
        # |A ^ B| <= (den - num) / (den + num) * (|A| + |B|); below the first band, only equal sets can be linked.
        first = max(1, (den + num + 2 * (den - num) - 1) // (2 * (den - num)) - 1)
        self.low = [first]
        while self.low[-1] < most:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * max(ratio, 1.01 * den / num))))

    def of(self, n: int) -> int:
        return bisect.bisect_right(self.low, n) - 1

    def symbols(self, band: int) -> tuple[int, int]:
        differ = 2 * (self.low[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        spare = 1 + differ // 50
        return differ + 1 + spare, spare

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The join keys of an ascending set of hashes: non-empty symbols of its own band and of the next if it can reach there."""
        n, own = len(s), self.of(len(s))
        out = [np.zeros(0, U)]
        for band in (own, own + 1):
            if band < 0 or self.den * n < self.num * self.low[band]:
                continue
            m, spare = self.symbols(band)
            slot = ((s >> U(32)) * U(m) >> U(32)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            value, slot = np.bitwise_xor.reduceat(s, at), slot[at]
            if m - len(slot) > spare:  # too many empty symbols to leave them out: a partner may have only those in common
                full = np.zeros(m, U)
                full[slot] = value
                value, slot = full, np.arange(m)
            out.append(mix(value + mix(slot.astype(U) + U(band << 40))))
        return np.concatenate(out)


def parity_bits(s: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits: a power of two of places, at least two a hash and 64 in all."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bits (rows of 64-bit words) of a smaller power of two of places: halves are XORed, as the hashes' low bits say."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _class(s: np.ndarray) -> int | None:
    """A set's class: 64 bits of a digest of all its hashes; none for an empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def sketches(docs: DataFrame, doc_id: str, text: str, words: int, bands: Bands | None = None, seen_most: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, class, bits), or with bands (class, keys) of the sets that have any.

    Bits and keys are left out where the same task has written them for an equal set before. Keys are far larger than the rest; they
    are worked out from the texts again rather than kept in a table.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in steps(batches, "text"):
            n, cls, said = [], [], []
            for s in shingle_sets(texts, words):
                c = _class(s)
                known = c is None or c in seen
                if c is not None and len(seen) < seen_most:
                    seen.add(c)
                if bands and (known or not len(keys := bands.keys(s))):
                    continue
                n.append(len(s))
                cls.append(c)
                said.append(keys.view(np.int64) if bands else None if known else parity_bits(s))
            if bands:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(said, pa.list_(pa.int64()))], ["class", "keys"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(said, pa.binary())], ["doc_id", "n_shingles", "class", "bits"])

    return given.mapInArrow(run, "class long, keys array<long>" if bands else "doc_id long, n_shingles long, class long, bits binary")


def class_sets(docs: DataFrame, doc_id: str, text: str, words: int, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, n, s): the whole sets of the wanted classes, (class, member) with one member's id each, from the texts anew."""
    ids = wanted.select(F.col("member").alias("_id"))
    ids = F.broadcast(ids) if small(ids) else ids
    lowest = F.lit(-(2**63))
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), lowest).alias("_id"), F.col(text).alias("text")).join(ids, "_id", "left_semi").select("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in steps(batches, "text"):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([pa.array(map(_class, sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "n", "s"])

    return scratch.table(given.mapInArrow(run, "class long, n long, s array<long>").join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")


#: Every so-manieth text, by its hash, is looked at for keys that many share: SAMPLED_KEY times in the sample or more. Such a key's classes are dealt to SALTS.
SAMPLE, SAMPLED_KEY, SALTS = 64, 64, 64


def shared_keys(docs: DataFrame, doc_id: str, text: str, words: int, bands: Bands, scratch: Scratch) -> DataFrame:
    """(key): those that many of the sampled texts' classes have; copies of a text count once. Fewer than a key for every SAMPLED_KEY sampled keys."""
    sampled = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(SAMPLE)) == 0)
    keys = sketches(sampled, doc_id, text, words, bands).select(F.explode("keys").alias("key"), "class").distinct()
    return scratch.table(keys.groupBy("key").count().where(F.col("count") >= SAMPLED_KEY).select("key"), "shared keys")


def met_in_keys(exploded: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, class) -> (key, class, pivot): each class that isn't its key's smallest, and, in shared keys, its salt's smallest or the salts' smallest."""
    few = small(shared)
    marked = exploded.join((F.broadcast(shared) if few else shared).withColumn("shared", F.lit(True)), "key", "left")
    salt = F.when(F.col("shared"), F.pmod(F.xxhash64("class"), F.lit(SALTS))).otherwise(0).cast("int")
    # One shuffle of (key, salt, class), sorted once: the first class of a key and salt is its pivot.
    by_key = Window.partitionBy("key", "salt").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    first = marked.select("key", salt.alias("salt"), "class").withColumn("pivot", F.first("class").over(by_key))
    return first.where("class <> pivot").select("key", "class", "pivot").distinct()


def met_across_salts(exploded: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, class, pivot) for the salts' pivots of shared keys: at most SALTS rows a key."""
    held = exploded.join(F.broadcast(shared) if small(shared) else shared, "key", "left_semi")
    pivots = held.groupBy("key", F.pmod(F.xxhash64("class"), F.lit(SALTS)).alias("salt")).agg(F.min("class").alias("class"))
    out = pivots.withColumn("pivot", F.min("class").over(Window.partitionBy("key")))
    return out.where("class <> pivot").select("key", "class", "pivot")


def unlikely_left_out(na: np.ndarray, nb: np.ndarray, ba: pa.Array, bb: pa.Array, num: int, den: int) -> np.ndarray:
    """Which pairs differ in no more parity bits than linked sets of these sizes can. Pairs whose bits are of the same lengths are compared at once: there are few lengths, powers of two."""
    most = (na + nb) * (den - num) // (den + num)
    la, lb = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ba, bb))
    keep = np.zeros(len(most), bool)
    for p, q in np.unique(np.stack([la, lb], 1), axis=0):
        at = np.flatnonzero((la == p) & (lb == q))
        x, y = (np.frombuffer(c.take(pa.array(at)).buffers()[2], U, len(at) * int(n) // 8).reshape(len(at), -1) for c, n in ((ba, p), (bb, q)))
        size = int(min(p, q)) // 8
        keep[at] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(1, dtype=np.int64) <= most[at]
    return keep


def likely(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b) classes, those that sizes and parity bits don't rule out. bits: (class, n, bits)."""
    x = bits.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    y = bits.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = pairs.join(y, "b").join(x, "a").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", "na", "nb", "ba", "bb")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = unlikely_left_out(*(batch.column(c).to_numpy() for c in ("na", "nb")), batch.column("ba"), batch.column("bb"), num, den)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def forest(cls: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest's edges; near(i) tells which classes the i-th is linked with."""
    free = np.ones(len(cls), bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while free.any():
        front = [int(free.argmax())]
        free[front] = False
        while front:
            i = front.pop()
            new = np.flatnonzero(near(i) & free)
            free[new] = False
            a.append(np.full(len(new), cls[i]))
            b.append(cls[new])
            front += new.tolist()
    return np.concatenate(a), np.concatenate(b)


def across_tiles(cls: np.ndarray, near, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (side tells which) that the tiles' own links don't imply: at most one fewer than the components that the two have by themselves.

    A tile's own links come from its own group, so a family of many tiles has about one link a pair of tiles, not one a class and pair.
    """
    at = np.arange(len(cls))
    label = at.copy()
    # A forest tells a component's classes one after the other, each linked from an earlier one.
    for i, j in zip(*forest(at, lambda i: near(i) & (side == side[i])), strict=True):
        label[j] = label[i]
    top = at.copy()

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    kept = []
    for i, j in zip(*forest(at, near), strict=True):
        x, y = root(label[i]), root(label[j])
        if x != y:
            top[y] = x
            kept.append((i, j))
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return cls[pairs[:, 0]], cls[pairs[:, 1]]


def likely_in_large_keys(members: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """members (key, class, m: the key's classes, n, bits) -> links (a, b) that connect what the bits don't rule out, within each key."""
    tiles = F.ceil(F.col("m") / (2 * TILE)).cast("int")
    dealt = scratch.table(members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")), "key tiles")
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "class", "n", "bits")

    def run(table: pa.Table) -> pa.Table:
        cls, n = table.column("class").to_numpy(), table.column("n").to_numpy()
        raw = [np.frombuffer(x, U) for x in table.column("bits").to_pylist()]
        size = min(map(len, raw))
        bits = np.stack([folded(x, size) for x in raw])
        fits = lambda i: (np.bitwise_count(bits ^ bits[i]).sum(1) <= (n + n[i]) * (den - num) // (den + num)) & (np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num)
        side = table.column("tile").to_numpy()
        a, b = forest(cls, fits) if (side == side[0]).all() else across_tiles(cls, fits, side)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("key", "t", "u").applyInArrow(run, "a long, b long")


#: Classes of a key whose pairs are joined one by one; classes and shingles of a tile.
FEW, TILE, TILE_SHINGLES, COLUMNS = 16, 512, 400_000, 4096


def linked_in_tiles(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether each two of the sets are linked: intersections by products of 0-1 matrices over a slice of the shingles at a time."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[i:j], column[i:j] - a] = 1
        common += x @ x.T
    return common * den >= (size[:, None] + size[None] - common) * num


def family_links(members: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """members (class, family) -> links (a, b) that connect what is linked within each family; each two tiles are a group of their own."""
    sizes = members.join(sets.select("class", "n"), "class").groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    tiles = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("all") / TILE_SHINGLES), F.lit(1)).cast("int")
    dealt = scratch.table(members.join(sizes, "family").select("class", "family", tiles.alias("tiles"), F.pmod(F.xxhash64("class"), tiles).cast("int").alias("tile")), "tiles")
    # Only the places of sets are joined before sets are dealt out, once for every pair of tiles.
    sent = sets.join(F.broadcast(dealt) if small(dealt) else dealt, "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.select("family", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "class", "s")

    def run(table: pa.Table) -> pa.Table:
        hit = linked_in_tiles([np.asarray(s.values) for s in table.column("s")], num, den)
        cls, side = table.column("class").to_numpy(), table.column("tile").to_numpy()
        a, b = forest(cls, hit.__getitem__) if (side == side[0]).all() else across_tiles(cls, hit.__getitem__, side)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("family", "t", "u").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, class, component_id), one row for every row; the component's id is its smallest doc_id.

    Documents are linked whose sets of ``words``-word shingles have den * |intersection| >= num * |union|.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    small_batches(docs.sparkSession)
    bands = Bands(num, den)
    all_docs = scratch.table(sketches(docs, doc_id, text, words), "sketches")
    exploded = sketches(docs, doc_id, text, words, bands).select(F.explode("keys").alias("key"), "class")
    shared = shared_keys(docs, doc_id, text, words, bands, scratch)
    met = scratch.table(met_in_keys(exploded, shared), "met")
    if shared.limit(1).count():
        met = met.union(scratch.table(met_across_salts(exploded, shared), "met across salts"))
    del exploded
    scratch.forget()
    pairs = scratch.table(met.select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    one_each = lambda ids: all_docs.where("class is not null").join(F.broadcast(ids) if small(ids) else ids, "class", "left_semi").groupBy("class")
    joined = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "joined")
    bits = scratch.table(one_each(joined).agg(F.first("n_shingles").alias("n"), F.first("bits", ignorenulls=True).alias("bits")), "bits")
    near = scratch.table(likely(pairs, bits, num, den), "near")
    labels = connected_components(near, scratch)
    # What is left: pairs without the pivot, in keys whose classes are not all connected.
    named = met.join(labels, met["class"] == labels.node, "left").select("key", "class", F.coalesce("label", "class").alias("label"))
    state = scratch.table(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", "m"), "open keys")
    left = scratch.table(named.join(state, "key"), "open")
    few = left.where(F.col("m") <= FEW)
    one, two = few.select("key", F.col("class").alias("a"), F.col("label").alias("la")), few.select("key", F.col("class").alias("b"), F.col("label").alias("lb"))
    more = scratch.table(one.join(two, "key").where("a < b and la <> lb").select("a", "b").distinct(), "more pairs")
    many = left.where(F.col("m") > FEW).select("key", "class", "m").join(bits, "class")
    near = scratch.table(near.union(likely(more, bits, num, den)).union(likely_in_large_keys(many, num, den, scratch)), "all near")
    families = connected_components(near, scratch).withColumnsRenamed({"node": "class", "label": "family"})
    members = scratch.table(one_each(families.select("class")).agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("member")), "members")
    sets = class_sets(docs, doc_id, text, words, members, scratch)
    labels = connected_components(scratch.table(family_links(families, sets, num, den, scratch), "links"), scratch)
    classes = all_docs.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    placed = scratch.table(classes.join(labels, classes["class"] == labels.node, "left").select("class", "first", F.coalesce("label", "class").alias("label")), "classes")
    lowest = placed.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Only classes in components of several need their component's smallest id; most classes are alone.
    named = placed.join(lowest, "label", "left").select("class", F.coalesce("component_id", "first").alias("component_id"))
    return all_docs.select("doc_id", "n_shingles", "class").join(named, "class", "left").select("doc_id", "n_shingles", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each_group(docs: DataFrame, doc_id: str = "doc_id", scratch: Scratch | None = None, **options) -> DataFrame:
    """docs without the linked documents of smaller ones: of each component the row with the smallest id stays.

    Where ids are null or repeated, rows are numbered first, in a table written once, and told apart by these numbers.
    """
    scratch = scratch or Scratch(docs.sparkSession, "copies")
    columns = docs.columns
    ids = docs.select(F.col(doc_id).alias("id"))
    odd = ids.where("id is null").limit(1).count() or ids.groupBy("id").count().where("count > 1").limit(1).count()
    key = fresh(columns, "row") if odd else doc_id
    given = scratch.table(docs.withColumn(key, F.monotonically_increasing_id()), "numbered") if odd else docs
    drop = scratch.table(jaccard_components(given, key, scratch=scratch, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(fresh(given.columns, "copy"))), "copies")
    return given.join(F.broadcast(drop) if small(drop) else drop, given[key] == drop[drop.columns[0]], "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
