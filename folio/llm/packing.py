"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

A document's token ids are counted and cut into pieces no longer than a sequence. A piece longer than half a sequence shares with no other such piece, so each opens
a sequence. The others come in bands of lengths, longest first. In a round, the band's pieces and the open sequences' gaps are put in one range-sorted order by size, and
each piece gets the smallest gap that holds it and that no longer piece has taken: going down the order, gaps are laid on a stack and a piece takes the top one. A gap that
holds several pieces of the band stands there as several slots. This successor sweep is distributed: each range matches what it can, and what it leaves open (pieces first, then slots) is
matched across ranges from two numbers a range. Ranks in the order decide all conflicts. Then the gaps are updated, and the next round begins; pieces that find no gap
open new sequences. Pieces, gaps and matches are tables throughout; the driver holds counts only.

Nulls: a null text counts as empty and has one id, the end mark. Repeated rows and equal texts are packed each on its own;
rows with a null id too. Texts of any length are cut, never shortened. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textbatch import small_batches, steps, tidy

CAPACITY = 1024
END_ID = 2


class PieceTokenizer:
    """Token ids by the ``tokenizers`` library, remembered by stretch.

    The byte-level pre-tokenizer never lets a token cross a single space or a single line break between other
    characters (a space starts a token, a line break is one), nor the place where a full stop or comma that ends a word follows a letter or
    digit. So texts that have white space of only that kind are cut there, and each stretch is encoded once and kept as
    bytes of little-endian ids. Other texts, and those that say one of the vocabulary's special tokens, are encoded whole.
    """

    OTHER = [c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n"] + ["\u180e", "\x02"]
    LONGEST = 64
    DOUBLE = ("  ", "\n\n", " \n", "\n ")

    def __init__(self, path: str, keep: int = 800_000, room: int = 160 << 20):
        from tokenizers import Tokenizer

        # A task has one core; the library's threads would take others'.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # Remembered are so many stretches and bytes, and none of more than LONGEST characters, which seldom come again.
        self.keep, self.room = keep, room
        self.known: dict[str, bytes] = {}
        self.stops = {c: self.whole(c) for c in ".,"}
        vocab = self.tok.get_vocab()
        #: The tokens that begin with a space or a line break, as the byte-level alphabet writes them.
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[0] in "\u0120\u010a"]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def odd(self, text: str) -> bool:
        """Whether it has white space other than single spaces and line breaks between other characters."""
        return text[0] in " \n" or text[-1] in " \n" or any(d in text for d in self.DOUBLE) or any(c in text for c in self.OTHER) or any(t in text for t in self.special)

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Encodes stretches, many at once: those that begin with white space can stand one after the other, and a text's first one can stand after a line break, whose id is then left out."""
        got: dict[str, bytes] = {}
        known = self.known
        stopped = [s for s in new if s[-1] in ".," and s[-2:-1].isalnum()]
        ends = set(stopped)
        rest = list(dict.fromkeys(core for s in new if (core := s[:-1] if s in ends else s) not in known))
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            text = "".join([s if s[0] == "\n" else f"\n{s[1:]}" if s[0] == "\x02" else f" {s}" for s in some])
            # Without offsets, which cost as much as the encoding does: a token that begins with white space begins a stretch.
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.begins[ids]).tolist()
            if len(at) == len(some) and at[0] == 0:
                data = ids.tobytes()
                got.update((s, data[4 * x : 4 * y]) for s, x, y in zip(some, at, [*at[1:], len(ids)], strict=True))
            else:
                got.update((s, self.whole(s if s[0] == "\n" else f"\n{s[1:]}" if s[0] == "\x02" else f" {s}")) for s in some)
        for s in rest:
            if s[0] == "\x02":
                got[s] = got[s][4:]
        for s in stopped:
            core = s[:-1]
            got[s] = (known.get(core) or got[core]) + self.stops[s[-1]]
        return got

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. What is new in any of them is encoded together, and remembered while there is room: the first stretches a task meets hold the frequent ones."""
        known, out, gaps = self.known, [], []
        for t in texts:
            if not t or self.odd(t):
                out.append([self.whole(t)] if t else [])
                continue
            # A stretch stands here without its space; \x02 marks the text's first, which has none.
            parts = ("\x02" + t.replace("\n", " \n")).split(" ")
            found = list(map(known.get, parts))
            out.append(found)
            if None in found:
                gaps.append((found, [(i, s) for i, (s, b) in enumerate(zip(parts, found, strict=True)) if b is None]))
        if gaps:
            got = self.learn(list(dict.fromkeys(s for _, new in gaps for _, s in new)))
            for found, new in gaps:
                for i, s in new:
                    found[i] = got[s]
            if len(known) + len(got) <= self.keep and self.room > 0:
                short = {s: b for s, b in got.items() if len(s) <= self.LONGEST}
                self.room -= sum(map(sys.getsizeof, short)) + sum(map(sys.getsizeof, short.values())) + 100 * len(short)
                known.update(short)
        return [b"".join(found) for found in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(2)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids) of every row; a row's first piece is the shorter one."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch, texts in steps(batches, "text"):
            rows = []
            for d, ids in zip(batch.column(0).to_pylist(), tok.encode_all(texts), strict=True):
                ids += end
                n = len(ids) // 4
                at, cut = 0, n % capacity or capacity
                k = 0
                while at < n:
                    part = ids[4 * at : 4 * cut]
                    rows.append((d, k, at, cut - at, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
                    at, cut, k = cut, cut + capacity, k + 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    return given.mapInArrow(run, schema)


#: Rows of a range in a sweep. Ratio between the lengths of a band: of the longer pieces, which decide how many sequences there are, and of those under a sixteenth of a sequence.
RANGE_ROWS, BAND, SHORT_BAND = 500_000, 2, 8


def stack_match(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """opens tells slots (True) from pieces, in order. A piece takes the last slot before it that is free.

    Returns places of matched pieces and of their slots, of pieces left without, and of slots left open.
    """
    height = np.cumsum(np.where(opens, 1, -1))
    floor = np.minimum.accumulate(np.minimum(height, 0))
    lost = ~opens & (floor < np.concatenate([[0], floor[:-1]])) if len(opens) else np.zeros(0, bool)
    live = np.flatnonzero(~lost)
    # A slot's level is the height that it reaches, a piece's the height that it leaves: at each level slots and pieces take turns.
    level = (height - floor + ~opens)[live]
    order = live[np.argsort(level, kind="stable")]
    level = np.sort(level, kind="stable")
    piece = np.flatnonzero(~opens[order])
    open_ = opens[order] & np.concatenate([(level[1:] != level[:-1]) | opens[order][1:], [True]])[: len(order)]
    return order[piece], order[piece - 1], np.flatnonzero(lost), np.sort(order[open_])


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """left: (range, pieces without a slot, open slots), in order -> segments (slots' range, slot, pieces' range, piece, how many).

    ``piece``, ``piece + 1`` and so on of the one range get ``slot``, ``slot - 1`` and so on of the other.
    """
    stack: list[list[int]] = []
    out = []
    for part, pieces_, slots in left:
        at = 0
        while at < pieces_ and stack:
            n = min(pieces_ - at, stack[-1][1])
            out.append((stack[-1][0], stack[-1][1] - 1, part, at, n))
            at += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if slots:
            stack.append([part, slots])
    return out


def sweep(slots: DataFrame, band: DataFrame, rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int, int | None]:
    """slots (seq, slot, size, gap) and band (item, length) -> (item, length, seq, slot, gap) for every slot, item null where it stays open; the pieces left; how many got a slot; the ids of those left, if known."""
    spark = slots.sparkSession
    long = lambda name: F.lit(0).cast("long").alias(name)
    events = slots.select("size", F.lit(True).alias("opens"), F.col("seq").alias("id"), "slot", "gap").union(band.select(F.col("length").alias("size"), F.lit(False).alias("opens"), F.col("item").alias("id"), long("slot"), long("gap")))
    order = [F.col("size").desc(), F.col("opens").desc(), F.col("gap").desc(), F.col("id"), F.col("slot")]
    ranged = events.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    names = ["kind", "range", "k", "item", "length", "seq", "slot", "gap"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pa.Table.from_batches([b]) for b in batches]
        if not got:
            return
        t = pa.concat_tables(got).combine_chunks()
        col = {n: t.column(n).to_numpy() for n in ("size", "id", "slot", "gap")}
        item, slot, lost, open_ = stack_match(t.column("opens").to_numpy(zero_copy_only=False).astype(bool))
        here = TaskContext.get().partitionId()

        def say(kind: int, i: np.ndarray | None, s: np.ndarray | None) -> pa.RecordBatch:
            n = len(i) if i is not None else len(s)
            none = pa.nulls(n, pa.int64())
            cols = [np.full(n, kind), np.full(n, here), np.arange(n), *((col["id"][i], col["size"][i]) if i is not None else (none, none)), *((col["id"][s], col["slot"][s], col["gap"][s]) if s is not None else (none, none, none))]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names)

        yield say(0, item, slot)
        yield say(1, lost, None)
        yield say(2, None, open_)
        # A range's summary: how many pieces got a slot, how many are left and their ids, how many slots are open.
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (3, here, len(item), len(lost), int(col["size"][lost].sum()), len(open_), 0, 0)], names)

    swept = scratch.table(ranged.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "swept")
    ranges = sorted(swept.where("kind = 3").collect(), key=lambda r: r["range"])
    segments = across([(r["range"], r["item"], r["seq"]) for r in ranges])
    found = sum(r["k"] for r in ranges) + sum(s[4] for s in segments)
    columns = ["item", "length", "seq", "slot", "gap"]
    own, lost, open_ = swept.where("kind = 0"), swept.where("kind = 1").select("range", "k", "item", "length"), swept.where("kind = 2")
    if not segments:
        return own.union(open_).select(*columns), lost.select("item", "length"), found, sum(r["length"] for r in ranges)
    # A pair's key: its segment and its place there. There are fewer segments than twice the ranges.
    seg = F.broadcast(spark.createDataFrame([(i, *s) for i, s in enumerate(segments)], "seg long, from long, top long, to long, low long, n long"))
    inside = (F.col("range") == F.col("to")) & (F.col("k") >= F.col("low")) & (F.col("k") < F.col("low") + F.col("n"))
    taken = (F.col("range") == F.col("from")) & (F.col("k") <= F.col("top")) & (F.col("k") > F.col("top") - F.col("n"))
    got = lost.join(seg, inside).select("seg", (F.col("k") - F.col("low")).alias("nth"), "item", "length")
    held = open_.select("range", "k", "seq", "slot", "gap").join(seg, taken, "left").select("seg", (F.col("top") - F.col("k")).alias("nth"), "seq", "slot", "gap")
    return own.select(*columns).union(held.join(got, ["seg", "nth"], "left").select(*columns)), lost.join(seg, inside, "left_anti").select("item", "length"), found, None


def wanted(gaps: DataFrame, lo: int, hi: int, n: int, most: int) -> tuple[Column, int]:
    """(which gaps to offer to n pieces of lengths from lo + 1 to hi, about how many slots they have), at most about n slots of full length, from the smallest gaps up, and n of each smaller size.

    Among gaps of one size any will do; those taken are told by a hash of their sequence, a few more than needed. most: as many slots as there could be; where that is less than four for each piece, all gaps are offered.
    """
    room = F.col("gap") > lo
    if 4 * n >= most:
        return room, most
    # At most one row a size.
    sizes = {r["gap"]: r["count"] for r in gaps.where(room).groupBy("gap").count().collect()}
    all_, some, left, slots = [], [], n, 0
    for g in sorted(sizes):
        each = min(max(1, g // hi), n)
        need = n if g < hi else -(-left // each)
        if need <= 0:
            continue
        ask = need + 6 * math.isqrt(need) + 10
        took = min(sizes[g], ask)
        (all_ if took == sizes[g] else some).append((g, ask / sizes[g]))
        slots += took * each
        left -= min(sizes[g], need) * each if g >= hi else 0
    spread = F.pmod(F.xxhash64("seq"), F.lit(1 << 30))
    chosen = F.col("gap").isin([g for g, _ in all_]) if all_ else F.lit(False)
    for g, part in some:
        chosen = chosen | ((F.col("gap") == g) & (spread < int(part * (1 << 30)) + 1))
    return chosen, slots


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """items (doc_id, piece, length, ...), each length from 1 to capacity -> with sequence_id and offset, gapless from 0 in every sequence."""
    spark = items.sparkSession
    # Every row's number, fixed once written; a row that opens a sequence of its own gives it its number.
    rows = scratch.table(items.select(F.struct("*").alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("item")), "numbered")
    half = capacity // 2
    bands, hi = [], half
    while hi:
        bands.append((lo := hi // (BAND if hi > capacity // 16 else SHORT_BAND), hi))
        hi = lo
    band_of = functools.reduce(lambda c, b: F.when(F.col("length") > b[0], b[0]).otherwise(c), sorted([*bands, (half, capacity)]), F.lit(0))
    held = {r["lo"]: r["count"] for r in rows.groupBy(band_of.alias("lo")).count().collect()}
    n_alone = held.get(half, 0)
    gaps = rows.where((F.col("length") > half) & (F.col("length") < capacity)).select(F.col("item").alias("seq"), (F.lit(capacity) - F.col("length")).alias("gap"))
    opened, placed = 0, []
    for lo, hi in bands:
        if lo not in held:
            continue
        n = held[lo]
        band, short = rows.where((F.col("length") > lo) & (F.col("length") <= hi)).select("item", "length"), False
        while n:
            # Slots of the band's full length where a gap has room for them, else one of the gap's own size.
            many = F.least(F.greatest(F.lit(1), F.floor(F.col("gap") / hi)), F.lit(n)).cast("long")
            offered, about = wanted(gaps, lo, hi, n, (n_alone + opened) * (capacity // hi))
            slots = gaps.where(offered).select("seq", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("slot"), F.least("gap", F.lit(hi)).cast("long").alias("size"), "gap")
            found, left, got, left_words = sweep(slots, band, n + about, scratch)
            if got:
                # One shuffle by sequence: where its pieces begin, and the gap that they leave, which its first slot's row carries on.
                by_seq = Window.partitionBy("seq").orderBy("slot")
                used = F.coalesce("length", F.lit(0))
                start = F.lit(capacity) - F.col("gap") + F.coalesce(F.sum(used).over(by_seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                rest = F.col("gap") - F.sum(used).over(by_seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                laid = scratch.table(found.select("item", "length", "seq", "slot", start.alias("offset"), rest.alias("rest")), "round")
                placed.append(laid.where("item is not null").select("item", "seq", "offset"))
                gaps = laid.where("slot = 0 and rest > 0").select("seq", F.col("rest").alias("gap")).union(gaps.where(~offered))
                n, band = n - got, left
            if n:
                # Open as many sequences as the ids left fill; if that was not enough, or is about the same, as many as surely take the rest. Those that
                # nothing needs are the last to be taken, also by shorter bands, and are none if nothing is ever put there.
                words = left_words if left_words is not None else left.agg(F.sum("length")).first()[0]
                sure = -(-n // (capacity // hi))
                more = sure if short or 1000 * sure < n_alone + opened else max(1, -(-words // capacity))
                short = True
                gaps = gaps.union(spark.range(opened, opened + more, 1, 1 + more // RANGE_ROWS).select((-F.col("id") - 1).alias("seq"), F.lit(capacity).cast("long").alias("gap")))
                opened += more
    alone = rows.where(F.col("length") > half).select("row", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not placed:
        return alone.select("row.*", "sequence_id", "offset")
    laid = functools.reduce(DataFrame.union, placed)
    shared = rows.where(F.col("length") <= half).join(laid, "item").select("row", F.col("seq").alias("sequence_id"), "offset")
    return alone.union(shared).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, scratch: Scratch | None = None, **options) -> DataFrame:
    """Pieces of all rows with their sequences and offsets; ``with_ids=True`` keeps the token ids."""
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    # Written first: texts should be encoded once.
    return pack(scratch.table(pieces(docs, path, capacity=capacity, **options), "pieces"), scratch, capacity)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
