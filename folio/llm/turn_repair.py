"""Repair of conversations' turn structure by the cheapest edits.

A repaired conversation's role initials follow ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn, or nothing at all. Keeping a row costs 0,
giving it the role user or assistant 3, deleting it 4, a new empty row 3; a truncated row that stays costs 3 more, and blank or
duplicate rows have to go. Four states say what may follow, so the least cost to the end from each state is a backward recursion: it
runs over time-major arrays, (turn, conversation, state), of conversations of like length, and the edits are traced forward over the same arrays.

Rows are range-sorted by conversation and turn, so a task streams whole conversations, however long. One that ends its task's range, or is longer than
a segment, is cut into segments; a segment's costs between any two states are a 4 x 4 table, and tables are chained in order,
so the rows of one huge conversation are worked on by many tasks and only 4 numbers a segment pass along it.

Cases: rows go by turn (nulls first), then role, then the SHA-256 of the text; equal rows are counted before they are sent, and all but the first are duplicates. A null role or text is one space. A null
conversation id is a conversation of its own. Initials are a role's first character as it stands; an empty or unknown role can't be kept. A blank text has nothing but white space
(bytes 32 and 9 to 13), a truncated one doesn't end in ``.``, ``!`` or ``?`` before such. No rows give no segments. Texts of any length are whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .scratch import Scratch, small
from .textbatch import small_batches, tidy

#: Rows, and characters of text, that a segment holds at most (a longer row is a segment of its own), and rows that are solved at once.
SEGMENT_ROWS, SEGMENT_CHARS, SOLVE_ROWS, SOLVE_CHARS = 4096, 2_000_000, 16_384, 4_000_000
#: Rows of the largest table of repeated texts' first turns that is broadcast: about 100 bytes each.
FIRSTS_ROWS = 200_000
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system, a user, an assistant turn. Codes of roles: system, user, assistant, any other.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
CODE = {"s": 0, "u": 1, "a": 2}
#: The state after keeping a row of a code, or -1; and after a row that an edit gives its role.
KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
NEVER = 1 << 40
MUST_GO, TRUNCATED = 4, 8
#: The costs of ending in each state.
ENDS = np.array([0, NEVER, NEVER, 0], np.int64)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
EDITS = "array<struct<edit string, role string, text string>>"


# --- the recursion ---------------------------------------------------------------------------------------------------------------

def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs by state when rows may be put in first. Two in a row lead back to the same state, so one look is enough from user and assistant, and these serve the others."""
    out = cost.copy()
    out[..., USER] = np.minimum(cost[..., USER], INSERT_COST + cost[..., ASSISTANT])
    out[..., ASSISTANT] = np.minimum(cost[..., ASSISTANT], INSERT_COST + cost[..., USER])
    for s in (EMPTY, SYSTEM):
        out[..., s] = np.minimum(cost[..., s], INSERT_COST + out[..., USER])
    return out


def _choices(row: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and giving a role, by state: row (B,) codes with marks, after (B, C, 4)."""
    goes, more = (row & MUST_GO > 0)[:, None, None], (row & TRUNCATED > 0)[:, None, None] * TRUNCATED_COST
    to = KEEP[:, row & 3].T[:, None, :]
    keep = np.where((to < 0) | goes, NEVER, np.take_along_axis(after, np.broadcast_to(np.maximum(to, 0), after.shape), 2) + KEEP_COST + more)
    role = np.where(goes, NEVER, after[:, :, NEXT] + ROLE_COST + more)
    return after + DELETE_COST, keep, role


def costs(rows: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least costs to the end, (T + 1, B, C, 4), for rows (T, B) and costs of ending (B, C, 4). Turns beyond a conversation's length pass costs on."""
    out = np.empty((len(rows) + 1, *ends.shape), np.int64)
    out[-1] = ends
    for t in range(len(rows) - 1, -1, -1):
        delete, keep, role = _choices(rows[t], out[t + 1])
        here = np.minimum(with_inserts(np.minimum(np.minimum(delete, keep), role)), NEVER)
        out[t] = np.where((t < lengths)[:, None, None], here, out[t + 1])
    return out


def trace(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edits (B, L), roles given (B, L), numbers of edits, end states) of the cheapest edits, ASCII-least of equals: table is costs(...)[:, :, 0]; last marks segments that end a conversation."""
    n, width = len(state), len(rows) * 3 + 2
    edits, given, put, at = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8), np.zeros(n, np.int64), np.arange(n)
    state = state.copy()

    def do(which: np.ndarray, edit: str, to: np.ndarray) -> None:
        edits[which, put[which]], given[which, put[which]] = ord(edit), to[which]
        state[which] = to[which]
        put[which] += 1

    for t in range(len(rows)):
        delete, keep, role = (c[:, 0] for c in _choices(rows[t], table[t + 1][:, None]))
        open_ = t < lengths
        for _ in range(3):
            now = table[t, at, state]
            gone = open_ & (delete[at, state] == now)
            do(gone, "D", state)
            open_ &= ~gone
            put_in = open_ & (table[t, at, NEXT[state]] + INSERT_COST == now)
            if not put_in.any():
                break
            do(put_in, "I", NEXT[state])
        kept = open_ & (keep[at, state] == table[t, at, state])
        do(kept, "K", KEEP[state, rows[t] & 3])
        do(open_ & ~kept, "R", NEXT[state])
    for _ in range(2):
        do(last & (table[-1, at, state] > 0), "I", NEXT[state])
    return edits, given, put, state


def buckets(lengths: list[int]) -> Iterator[list[int]]:
    """Places of conversations of like length: of the same power of two."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by.setdefault(n.bit_length(), []).append(i)
    yield from by.values()


def laid_out(coded: list[bytes], which: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows' codes side by side, time-major, and their numbers."""
    lengths = np.array([len(coded[i]) for i in which])
    rows = np.full((int(lengths.max()), len(which)), 3, np.uint8)
    for j, i in enumerate(which):
        rows[: lengths[j], j] = np.frombuffer(coded[i], np.uint8)
    return rows, lengths


# --- segments --------------------------------------------------------------------------------------------------------------------

class Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv, alone: bool):
        self.conv, self.alone, self.code, self.roles, self.texts, self.chars = conv, alone, bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = 0

    def add(self, role: str, text: str, repeated: bool) -> None:
        end = text.rstrip(SPACE)
        code = CODE.get(role[:1], 3)
        if not end:
            self.blank += 1
            code |= MUST_GO
        elif repeated:
            self.duplicate += 1
            code |= MUST_GO
        elif end[-1] not in ".!?":
            self.truncated += 1
            code |= TRUNCATED
        self.code.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def illegal(self) -> int:
        code = np.frombuffer(bytes(self.code), np.uint8) & 3
        return int((~legal(code[:-1], code[1:])).sum())


def legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    """Cuts a task's sorted rows. A conversation that touches an end of the task's rows may go on in another task, so it isn't ``alone``; nor is one of several segments."""
    held, n = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if held is None or row["conv"] != held.conv or (row["conv"] is None) != (held.conv is None):
                if held is not None:
                    yield held
                held, n = Segment(row["conv"], alone=n > 0), n + 1
            for copy in range(row["n"]):
                if held.code and (len(held.code) >= SEGMENT_ROWS or held.chars + len(row["text"]) > SEGMENT_CHARS):
                    held.alone = False
                    yield held
                    held = Segment(row["conv"], alone=False)
                held.add(row["role"], row["text"], row["later"] or copy > 0)
    if held is not None:
        held.alone = False
        yield held


def edited(roles: list[str], texts: list[str], edits: np.ndarray, given: np.ndarray) -> list[dict]:
    """The edits with the rows that they leave; a deleted row is told as it was."""
    out, at = [], 0
    for edit, to in zip(edits.tobytes().decode("ascii"), given.tolist(), strict=True):
        if edit == "I":
            out.append({"edit": edit, "role": ROLE_OF[to], "text": ""})
            continue
        out.append({"edit": edit, "role": ROLE_OF[to] if edit == "R" else roles[at], "text": texts[at]})
        at += 1
    return out


def _first_pass(schema: StructType, arrow: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def solved(held: list[Segment]) -> pa.RecordBatch:
            coded, out = [bytes(s.code) for s in held], [{} for _ in held]
            for which in buckets([len(c) for c in coded]):
                for alone in (True, False):
                    part = [i for i in which if held[i].alone == alone]
                    if not part:
                        continue
                    rows, lengths = laid_out(coded, part)
                    if alone:
                        table = costs(rows, lengths, np.broadcast_to(with_inserts(ENDS), (len(part), 1, 4)))
                        edits, given, put, _ = trace(rows, lengths, table[:, :, 0], np.zeros(len(part), np.int64), np.ones(len(part), bool))
                        for j, i in enumerate(part):
                            out[i] = {"cost": int(table[0, j, 0, EMPTY]), "edits": edited(held[i].roles, held[i].texts, edits[j, : put[j]], given[j, : put[j]])}
                    else:
                        between = costs(rows, lengths, np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(part), 4, 4)))
                        for j, i in enumerate(part):
                            out[i] = {"between": between[0, j].reshape(-1).tolist(), "code": coded[i], "roles": held[i].roles, "texts": held[i].texts}
            return pa.RecordBatch.from_pylist([{"conv": s.conv, "segment": number + i, "alone": s.alone, "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated, "illegal": s.illegal(), "first": s.code[0] & 3, "last": s.code[-1] & 3} | o for i, (s, o) in enumerate(zip(held, out, strict=True))], arrow)

        held, rows, chars = [], 0, 0
        for s in segments(batches):
            held.append(s)
            rows, chars = rows + len(s.code), chars + s.chars
            if rows >= SOLVE_ROWS or chars >= SOLVE_CHARS:
                yield solved(held)
                number += len(held)
                held, rows, chars = [], 0, 0
        if held:
            yield solved(held)

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str = "conv") -> Iterator[tuple[bool, dict]]:
    """(whether a new group starts, row) of sorted rows."""
    none = object()
    now = none
    for batch in batches:
        for row in batch.to_pylist():
            yield now is none or row[key] != now, row
            now = row[key]


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _joined(parts: DataFrame, scratch: Scratch, id_type) -> DataFrame:
    """Segments of conversations in several parts, with their edits: costs are passed back along a conversation, states forward."""
    conv = StructField("conv", id_type)
    back_schema = StructType([conv, *_parse_datatype_string("segment bigint, ends array<bigint>, final boolean, cost bigint").fields])
    back_arrow = _arrow(back_schema)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a conversation's last segment to its first; the cost is told with the first, where nothing comes before it."""
        ends = pending = None
        for new, row in _groups(batches):
            if pending and new:
                yield pa.RecordBatch.from_pylist([pending | {"cost": int(ends[EMPTY])}], back_arrow)
            elif pending:
                yield pa.RecordBatch.from_pylist([pending], back_arrow)
            if new:
                ends = with_inserts(ENDS)
            pending = {"conv": row["conv"], "segment": row["segment"], "ends": ends.tolist(), "final": bool(new), "cost": 0}
            ends = np.minimum((np.array(row["between"], np.int64).reshape(4, 4) + ends[:, None]).min(0), NEVER)
        if pending:
            yield pa.RecordBatch.from_pylist([pending | {"cost": int(ends[EMPTY])}], back_arrow)

    by_conv = parts.select("conv", "segment", "between").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("segment").desc())
    ends = scratch.table(by_conv.mapInArrow(back, back_schema).drop("conv"), "ends")
    known = scratch.table(parts.drop("between", "cost", "edits").join(ends, "segment"), "known")

    reach_schema = StructType([conv, *_parse_datatype_string("segment bigint, first int, last int, to array<int>").fields])
    reach_arrow = _arrow(reach_schema)

    def traced(rows_: list[dict], starts: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        coded = [r["code"] for r in rows_]
        for which in buckets([len(c) for c in coded]):
            rows, lengths = laid_out(coded, which)
            table = costs(rows, lengths, np.array([rows_[i]["ends"] for i in which], np.int64)[:, None])[:, :, 0]
            begin = np.array([list(range(4)) if starts == 4 else [rows_[i]["start"]] for i in which])
            last = np.array([rows_[i]["final"] for i in which])
            rep = lambda x, axis: np.repeat(x, starts, axis)
            edits, given, put, to = trace(rep(rows, 1), rep(lengths, 0), rep(table, 1), begin.reshape(-1), rep(last, 0))
            for j, i in enumerate(which):
                s = slice(j * starts, (j + 1) * starts)
                yield rows_[i], edits[s], given[s], put[s], to[s]

    @tidy
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state that each start state leads to; where a start can't be, nothing depends on it."""
        for batch in batches:
            out = [{"conv": r["conv"], "segment": r["segment"], "first": r["first"], "last": r["last"], "to": to.tolist()} for r, _, _, _, to in traced(batch.to_pylist(), 4)]
            if out:
                yield pa.RecordBatch.from_pylist(out, reach_arrow)

    start_schema = _parse_datatype_string("segment bigint, start int, crossing bigint")
    start_arrow = _arrow(start_schema)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = EMPTY, None
        for new, row in _groups(batches):
            if new:
                state, last = EMPTY, None
            wrong = 0 if last is None else int(not legal(np.array(last), np.array(row["first"])))
            yield pa.RecordBatch.from_pylist([{"segment": row["segment"], "start": state, "crossing": wrong}], start_arrow)
            state, last = row["to"][state], row["last"]

    reached = known.select("conv", "segment", "first", "last", "code", "ends", "final").mapInArrow(reach, reach_schema)
    starts = scratch.table(reached.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "segment").mapInArrow(forward, start_schema), "starts")
    done_schema = StructType([conv, *_parse_datatype_string(f"segment bigint, alone boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, edits {EDITS}").fields])
    done_arrow = _arrow(done_schema)

    @tidy
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{k: r[k] for k in ("conv", "segment", "alone", "blank", "duplicate", "truncated", "cost")} | {"illegal": r["illegal"] + r["crossing"], "edits": edited(r["roles"], r["texts"], edits[0, : put[0]], given[0, : put[0]])} for r, edits, given, put, _ in traced(batch.to_pylist(), 1)]
            if out:
                yield pa.RecordBatch.from_pylist(out, done_arrow)

    return known.join(starts, "segment").mapInArrow(done, done_schema)


def runs_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (conv, turn, role, text) with equal ones counted: (conv, turn, role, text, digest, n). Counting before the shuffle keeps a hot row small."""
    clean = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = clean.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    return scratch.table(counted.withColumn("digest", F.unhex(F.sha2("text", 256))), "runs")


def repaired(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """runs_of(...) -> (conv, segment, alone, blank, duplicate, truncated, illegal, cost, edits): segments in order of ``segment``; a conversation's figures are the sums over its segments.

    edits holds each edit's initial (K, R, D, I) with the role and text that it leaves or deletes.
    """
    small_batches(runs.sparkSession)
    id_type = runs.schema["conv"].dataType
    firsts = scratch.table(runs.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("turns")).where("turns > 1").drop("turns"), "firsts")
    side = F.broadcast(firsts) if small(firsts, FIRSTS_ROWS) else firsts
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = runs.join(side, same, "left").withColumn("later", F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    given = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "n", "later")
    schema = StructType([StructField("conv", id_type), *_parse_datatype_string(f"segment bigint, alone boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first int, last int, cost bigint, edits {EDITS}, between array<bigint>, code binary, roles array<string>, texts array<string>").fields])
    found = scratch.table(given.mapInArrow(_first_pass(schema, _arrow(schema)), schema), "segments")
    names = ["conv", "segment", "alone", "blank", "duplicate", "truncated", "illegal", "cost", "edits"]
    return found.where("alone").select(*names).unionByName(_joined(found.where("not alone"), scratch, id_type).select(*names))


def repaired_rows(segments_: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, segment, place, edit, role, text), a row for each that stays or is put in."""
    return segments_.select("conv", "segment", F.posexplode("edits").alias("place", "e")).where("e.edit <> 'D'").select("conv", "segment", "place", "e.*")


def digests(segments_: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of whole conversations. Those of one segment by columns; a longer one's segments are streamed through its digest, one at a time."""
    id_type = segments_.schema["conv"].dataType
    figures = ["blank", "duplicate", "truncated", "illegal", "cost"]
    line = lambda e: F.concat(e["role"], F.lit(":"), e["text"])
    alone = segments_.where("alone").select("conv", *figures, F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"), F.sha2(F.array_join(F.transform(F.filter("edits", lambda e: e["edit"] != "D"), line), "\n"), 256).alias("repaired_sha256"))
    schema = StructType([StructField("conv", id_type), *_parse_datatype_string(", ".join(f"{f} bigint" for f in figures) + ", audit string, repaired_sha256 string").fields])
    arrow = _arrow(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv": held["conv"], "audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()} | {f: held[f] for f in figures}], arrow)

        for new, row in _groups(batches):
            if new:
                if held:
                    yield told()
                held = {"conv": row["conv"], "audit": [], "hash": hashlib.sha256(), "any": False} | dict.fromkeys(figures, 0)
            for f in figures:
                held[f] += row[f]
            held["audit"].append("".join(e["edit"] for e in row["edits"]))
            for e in row["edits"]:
                if e["edit"] != "D":
                    held["hash"].update(("\n" * held["any"] + f"{e['role']}:{e['text']}").encode("utf-8", "surrogatepass"))
                    held["any"] = True
        if held:
            yield told()

    parts = segments_.where("not alone").select("conv", "segment", *figures, "edits").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "segment")
    return alone.unionByName(parts.mapInArrow(run, schema))


# --- the query -------------------------------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with faults put in by crc32 of "conv_id:turn" mod 20."""
    space = F.lit(" ")
    fault = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        F.col("conv_id").alias("conv"), "turn", fault.alias("fault"), F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    return rows.where("fault <> 0").select("conv", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    scratch = Scratch(spark, "repair")
    runs = runs_of(damaged(given), scratch)
    report = digests(repaired(runs, scratch))
    span = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("turns")
    gaps = runs.groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("turns")).select("conv", F.when(F.col("high").isNull(), F.lit(0)).otherwise(F.least(span, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")).alias("gaps"))
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    zeros = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    nothing = [F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")]
    every = given.select(F.col("conv_id").alias("conv")).distinct().select("conv", *zeros(*figures), *nothing)
    all_ = every.unionByName(gaps.select("conv", "gaps", *zeros(*figures[1:]), *nothing)).unionByName(report.select("conv", *zeros("gaps"), *figures[1:], "audit", "repaired_sha256"))
    return all_.groupBy(F.col("conv").alias("conv_id")).agg(*[F.sum(f).alias(f) for f in figures], F.max("audit").alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same by a recursive query over rows: each state's least (cost, edits) is carried forward, which is another route than the backward recursion above.
OP13_SQL = r"""
with recursive bits as (select i::bigint as i, list_reduce(range(0, 8), lambda c, _ : case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint) as c from range(0, 256) t(i)),
crc as (select list(c order by i) as t from bits),
base as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
coded as (select *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i : ascii(substr(k, i, 1))::bigint), lambda c, b : xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 as f from base, crc),
rows_ as (select conv_id, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from coded, range(0, 2) r(copy) where f <> 0 and (copy = 0 or f = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as p, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as stem from rows_),
faulty as (select conv_id, turn, role, text, p, case when stem = '' then 'b' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'd' when right(stem, 1) not in ('.', '!', '?') then 't' else '' end as fault, substr(role, 1, 1) as i, lag(substr(role, 1, 1)) over (partition by conv_id order by p) as before from placed),
figures as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, max(p) as n from faulty group by 1),
ends as (select conv_id, n from figures),
walk(conv_id, p, st, cost, audit, body) as (
  select conv_id, 0::bigint, 'E', 0, '', '' from ends
  union all
  select conv_id, p, st, cost, audit, body from (
    select w.conv_id, w.p + 1 as p, o.st, w.cost + ins.cost + o.cost as cost, w.audit || ins.audit || o.edit as audit, w.body || ins.body || o.body as body,
      row_number() over (partition by w.conv_id, o.st order by w.cost + ins.cost + o.cost, w.audit || ins.audit || o.edit) as best
    from walk w join faulty r on r.conv_id is not distinct from w.conv_id and r.p = w.p + 1,
    lateral (select * from (values (w.st, 0, '', ''),
      (case when w.st = 'U' then 'A' else 'U' end, 3, 'I', case when w.st = 'U' then 'assistant:' else 'user:' end || chr(10)),
      (case when w.st = 'U' then 'U' else 'A' end, 6, 'II', case when w.st = 'U' then 'assistant:' || chr(10) || 'user:' || chr(10) else 'user:' || chr(10) || 'assistant:' || chr(10) end)) v(st, cost, audit, body)) ins,
    lateral (select * from (values (ins.st, 4, 'D', '', true),
      (case when r.i = 's' and ins.st = 'E' then 'S' when r.i = 'u' and ins.st <> 'U' then 'U' when r.i = 'a' and ins.st = 'U' then 'A' end, case when r.fault = 't' then 3 else 0 end, 'K', r.role || ':' || r.text || chr(10), r.fault not in ('b', 'd')),
      (case when ins.st = 'U' then 'A' else 'U' end, case when r.fault = 't' then 6 else 3 end, 'R', case when ins.st = 'U' then 'assistant:' else 'user:' end || r.text || chr(10), r.fault not in ('b', 'd'))) v(st, cost, edit, body, ok) where ok and st is not null) o)
  where best = 1),
finals as (select w.conv_id, w.cost + case w.st when 'U' then 3 when 'S' then 6 else 0 end as cost, w.audit || case w.st when 'U' then 'I' when 'S' then 'II' else '' end as audit,
    w.body || case w.st when 'U' then 'assistant:' || chr(10) when 'S' then 'user:' || chr(10) || 'assistant:' || chr(10) else '' end as body
  from walk w join ends e on e.conv_id is not distinct from w.conv_id and e.n = w.p),
chosen as (select conv_id, cost, audit, body from (select *, row_number() over (partition by conv_id order by cost, audit) as best from finals) where best = 1)
select o.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0)::bigint as blank, coalesce(f.duplicate, 0)::bigint as duplicate, coalesce(f.truncated, 0)::bigint as truncated, coalesce(f.illegal, 0)::bigint as illegal,
  coalesce(c.cost, 0)::bigint as cost, coalesce(c.audit, '') as audit, sha256(coalesce(left(c.body, greatest(length(c.body) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join figures f on f.conv_id is not distinct from o.conv_id left join chosen c on c.conv_id is not distinct from o.conv_id
"""
