"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

Words are summed by source and bucket of a document's hash. A source's target is met by whole copies of all its documents and,
for the rest, by the documents below a hash threshold. Running sums over the buckets give the bucket that the rest's
budget ends in; only that bucket is divided further, and at last its hashes one by one. The filter compares a document's hash with its
source's threshold: no document is sorted, and no pass but the two histograms reads more than the boundary buckets.

Nulls: a null text has size 0, a null source is a source of its own, the last. Documents with one hash (repeated rows of one id) are taken
together. Equal inputs give equal results in every run and partitioning. Sources without words have target 0. Empty tables
give empty results. Extra columns pass through; columns that the operator adds are named by ``added``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small
from .textbatch import fresh

#: Bits of the hash: 60, split into three levels of buckets.
LEVELS = (12, 12, 36)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORDS, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


#: Sources to a task where they are put in order.
SOURCES_IN_TASK = 1_000_000


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """df with the columns of ``sums``: running sums of other columns over all rows before a row in the order.

    Rows are range-partitioned; each range sums up on its own, and ranges add the totals of those before them (a row a range).
    """
    parts = max(1, -(-df.count() // SOURCES_IN_TASK))
    ranged = scratch.table(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    out = ranged.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(totals), "_range")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """(source, source_size) -> with target: the share of all words by weight, none above ``most`` times its source's size.

    Giving the excess to the others by weight, again and again, ends where every target is the smaller of its limit and weight x one
    common level. With sources ordered by limit / weight, the level is found from running sums of the limits and weights before each. The driver
    gets the totals and the common level: three numbers.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    counted = in_order(sizes.withColumn("one", F.lit(1)), by_name, {"place": "one"}, scratch, "sources").drop("one")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    limit = counted.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    by_ratio = [F.col("limit") / F.col("weight"), *by_name]
    before = in_order(limit, by_ratio, {"limits": "limit", "weights": "weight"}, scratch, "limits")
    words, weight = before.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(words or 0) * F.lit(float(share)) - F.col("limits")) / (F.lit(weight or 1) - F.col("weights"))
    fits = before.withColumn("level", level).withColumn("full", F.col("limit") < F.col("weight") * F.col("level"))
    # The first source in this order that isn't full has the level of all that aren't.
    common = fits.where(~F.col("full")).agg(F.min_by("level", F.struct(F.col("limit") / F.col("weight"), *by_name))).first()[0]
    target = F.col("limit") if common is None else F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.lit(common)))
    return fits.select("source", "source_size", target.alias("target"))


def _end(histogram: DataFrame, slot: str, exact: bool) -> DataFrame:
    """(source, rest, slot, words) -> for each source the slot in which its rest ends, and the rest left there.

    exact: the last slot that is still taken instead; a slot is taken if that brings the sum nearer to the rest.
    """
    running = F.sum("words").over(Window.partitionBy("source").orderBy(slot))
    h = histogram.withColumn("before", running - F.col("words"))
    if exact:
        return h.where(F.col("before") * 2 + F.col("words") <= F.col("rest") * 2).groupBy("source").agg(F.max(slot).alias(slot))
    return h.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))).select("source", slot, (F.col("rest") - F.col("before")).alias("rest"))


def plan(sized: DataFrame, scratch: Scratch, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """A row for each source: (source, source_size, target, copies, bound). sized: (source, h, size), written before.

    A document is taken ``copies`` times, and once more if its hash is at most ``bound``.
    """
    bits = sum(LEVELS)
    first = scratch.table(sized.groupBy("source", F.shiftright("h", bits - LEVELS[0]).alias("b1")).agg(F.sum("size").alias("words")), "level1")
    totals = first.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(totals, share, most, weights, scratch)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = scratch.table(goal.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "goals")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    rests = goal.select("source", "rest")
    one = first.join(rests, same(first, rests)).select(first["source"], "b1", "words", "rest")
    end1 = scratch.table(_end(one, "b1", exact=False), "end1")
    within = lambda ends, cols: sized.withColumn("b1", F.shiftright("h", bits - LEVELS[0])).withColumn("b2", F.shiftright("h", LEVELS[2])).join(F.broadcast(ends) if small(ends) else ends, cols(ends))
    two = within(end1.withColumnsRenamed({"source": "s", "b1": "c1"}), lambda e: F.col("source").eqNullSafe(e["s"]) & (F.col("b1") == e["c1"])).groupBy("source", "b2", "rest").agg(F.sum("size").alias("words"))
    end2 = scratch.table(_end(two, "b2", exact=False), "end2")
    three = within(end2.withColumnsRenamed({"source": "s", "b2": "c2"}), lambda e: F.col("source").eqNullSafe(e["s"]) & (F.col("b2") == e["c2"])).groupBy("source", "h", "rest").agg(F.sum("size").alias("words"))
    last = _end(three, "h", exact=True).withColumnsRenamed({"source": "s3", "h": "hash"})
    ends = end1.withColumnsRenamed({"source": "s1", "rest": "r1"}).join(end2.withColumnsRenamed({"source": "s2", "rest": "r2"}), F.col("s1").eqNullSafe(F.col("s2")), "left").join(last, F.col("s1").eqNullSafe(F.col("s3")), "left")
    bound = F.coalesce("hash", F.shiftleft("b2", LEVELS[2]) - 1, F.shiftleft("b1", bits - LEVELS[0]) - 1)
    ends = ends.select("s1", bound.alias("end"), F.lit(True).alias("known"))
    # A source without a boundary bucket has no words or a rest that takes them all: it has no document more to take or all of them.
    everything = F.when(F.col("rest") >= F.col("source_size"), F.lit(1 << bits)).otherwise(F.lit(-1))
    joined = goal.join(ends, F.col("source").eqNullSafe(F.col("s1")), "left")
    return joined.select("source", "source_size", "target", "copies", F.when(F.col("known"), F.col("end")).otherwise(everything).alias("bound"))


ADDED = ("_size", "_source_size", "_target", "_times")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), added: tuple[str, ...] = ADDED, scratch: Scratch | None = None) -> DataFrame:
    """docs with its size, its source's size and target, and how often the mix takes the document whole (0 to ``most``), under the names ``added``.

    A column of docs with such a name is replaced.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    sized = scratch.table(docs.select(F.col(source).alias("source"), id_hash(F.col(doc_id)).alias("h"), word_count(F.col(text)).alias("size")), "sizes")
    found = scratch.table(plan(sized, scratch, share, most, weights), "plan").select(F.struct("*").alias("found"))
    # The plan has a row a source; where it is small, documents are filtered where they lie. Rows travel as one column, so that no name can clash.
    taken = {n.lower() for n in added}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    given = docs.select(row.alias("row"), F.col(source).alias("source"), id_hash(F.col(doc_id)).alias("h"), word_count(F.col(text)).alias("size"))
    out = given.join(F.broadcast(found) if small(found) else found, F.col("source").eqNullSafe(F.col("found.source")))
    times = F.col("found.copies") + F.when(F.col("h") <= F.col("found.bound"), 1).otherwise(0)
    return out.select("row.*", F.col("size").alias(added[0]), F.col("found.source_size").alias(added[1]), F.col("found.target").alias(added[2]), times.alias(added[3]))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs. Ids repeat where a document is taken twice."""
    columns = docs.columns
    names = []
    for n in (*ADDED, "_copy"):
        names.append(fresh([*columns, *names], n))
    out = mix(docs, added=tuple(names[:4]), **options).where(F.col(names[3]) > 0)
    return out.withColumn(names[4], F.explode(F.sequence(F.lit(1), F.col(names[3]).cast("int")))).select(*[F.col(f"`{c}`") for c in columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    scratch = Scratch(spark, "mix7")
    sized = scratch.table(docs.select("doc_id", "source", id_hash(F.col("doc_id")).alias("h"), word_count(F.col("text")).alias("size")), "sizes")
    found = scratch.table(plan(sized, scratch), "plan").withColumnRenamed("source", "s")
    out = sized.join(F.broadcast(found) if small(found) else found, F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("size") * (F.col("copies") + F.when(F.col("h") <= F.col("bound"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same by sorting: the documents of a source in the order of their hashes, as long as each brings the sum nearer to the rest.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS lim FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, lim / weight) AS common FROM levels WHERE NOT lim < weight * level),
goals AS (
  SELECT source, source_size, CASE WHEN lim < weight * level OR common IS NULL THEN lim ELSE least(lim, weight * common) END AS target
  FROM levels, common),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goals),
hashes AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (
  SELECT a.source, h, words, sum(words) OVER (PARTITION BY a.source ORDER BY h) - words AS before, target - copies * source_size AS rest
  FROM hashes a JOIN rests b ON a.source IS NOT DISTINCT FROM b.source),
bounds AS (SELECT source, max(h) AS bound FROM running WHERE before * 2 + words <= rest * 2 GROUP BY source)
SELECT s.doc_id, s.size, r.source_size, r.target::DOUBLE AS target,
       (s.size * (r.copies + CASE WHEN s.h <= b.bound THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source
"""
