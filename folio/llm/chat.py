"""Chat formatting at token level.

Each turn's text is escaped, encoded on its own, and set between reserved ids; so no text can make or break a control token, whatever
it says. The text form is escaped too: a backslash is doubled and one is put into every control string, which the reader undoes.
Token places and the loss mask come from prefix sums over the segments' lengths.

A conversation's turns are ordered by turn (nulls first), then role and text; repeated rows are turns of their own. A null text counts as empty, a null
role as the role ``""``, a null conv_id as a conversation of its own. Turns of any length are whole. Conversations are
sorted, not collected: however many turns one has, a task holds a batch of them. Only assistant texts are under the loss mask.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import vocabulary
from .scratch import Scratch
from .textbatch import steps

#: Control strings, in the order of their reserved ids, which follow the vocabulary's 50,257.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
FIRST_ID = 50257
OPEN = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
#: Any other role is named: [ROLE]name[/ROLE], then its text between the user's marks.
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


class Encoder:
    """Encodes escaped segments, one at a time: an encoding holds many times its text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids if text else []


class Decoder:
    """The bytes of the vocabulary's tokens, read from its file; no tokenizer is kept for them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        odd = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        self.bytes = [b""] * FIRST_ID
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


CONTROL_IDS = {c: FIRST_ID + i for i, c in enumerate(CONTROLS)}


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


#: Characters of text encoded, and rows read back, at once.
STEP, ROWS = 200_000, 256


SEGMENT_SCHEMA = "conv_id long, turn long, role string, text string, formatted string, input_ids array<int>, mask_start int, mask_end int"


def segments(turns: DataFrame, path: str) -> DataFrame:
    """Every turn formatted by itself: its piece of text and token ids, and the stretch of ids under the loss mask (empty for most roles)."""
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = encoder(path)
        for batch, texts in steps(batches, "text", STEP):
            roles = batch.column("role").to_pylist()
            safe = [escape(t) for t in texts]
            named = [escape(r) for r in roles]
            inner, names = map(c.encode, safe), map(c.encode, named)
            formatted, ids, start, end = [], [], [], []
            for role, body, name, x, y in zip(roles, safe, named, inner, names, strict=True):
                a, b = OPEN.get(role, OPEN["user"])
                head, head_ids = ("", []) if role in OPEN else (f"[ROLE]{name}[/ROLE]", [CONTROL_IDS["[ROLE]"], *y, CONTROL_IDS["[/ROLE]"]])
                parts = [head_ids, [CONTROL_IDS[a]], x, [CONTROL_IDS[b]]]
                places = np.cumsum([0, *map(len, parts)])
                formatted.append(f"{head}{a}{body}{b}")
                ids.append([i for p in parts for i in p])
                loss = role == "assistant"
                start.append(int(places[2]) if loss else 0)
                end.append(int(places[3]) if loss else 0)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array(formatted, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["conv_id", "turn", "role", "text", "formatted", "input_ids", "mask_start", "mask_end"])

    return given.mapInArrow(run, SEGMENT_SCHEMA)


def format_chat(turns: DataFrame, path: str) -> DataFrame:
    """(conv_id, seq, formatted, input_ids, token_start, loss_start, loss_end): segments in order, with their place in the whole conversation.

    Rows of one conversation stand together and in order in one partition: concatenating ``formatted`` and ``input_ids`` gives the sample;
    token ids in [loss_start, loss_end) are learned from. Places are running sums of the segments' lengths.
    """
    made = segments(turns, path)
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, place = object(), 0, 0
        for b in batches:
            conv = b.column("conv_id").to_pylist()
            size = np.diff(b.column("input_ids").offsets.to_numpy())
            start, seqs = np.zeros(len(conv), np.int64), np.zeros(len(conv), np.int64)
            cuts = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
            for a, z in zip(cuts, [*cuts[1:], len(conv)], strict=True):
                if conv[a] != last:
                    last, seq, place = conv[a], 0, 0
                ends = place + np.cumsum(size[a:z])
                start[a:z], seqs[a:z] = ends - size[a:z], seq + np.arange(z - a)
                seq, place = seq + z - a, int(ends[-1])
            lo, hi = start + b.column("mask_start").to_numpy(), start + b.column("mask_end").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(seqs), b.column("formatted"), b.column("input_ids"), pa.array(start), pa.array(lo), pa.array(hi)], ["conv_id", "seq", "formatted", "input_ids", "token_start", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, "conv_id long, seq long, formatted string, input_ids array<int>, token_start long, loss_start long, loss_end long")


class Reader:
    """Reads one conversation's ids back, piece by piece: turns from control ids, texts from what stands between them."""

    def __init__(self, c: Decoder):
        self.c = c
        self.ends = {CONTROL_IDS["[/INST]"]: "user", CONTROL_IDS["[/SYS]"]: "system", CONTROL_IDS["</s>"]: "assistant"}
        self.turns, self.chars, self.loss, self.sha, self.loss_sha = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        self.name: str | None = None
        self.body: list[int] = []
        self.masked: list[int] = []

    def feed(self, formatted: str, ids: list[int], start: int, lo: int, hi: int) -> None:
        self.chars += len(formatted)
        for place, i in enumerate(ids, start):
            if i < FIRST_ID:
                self.body.append(i)
                if lo <= place < hi:
                    self.masked.append(i)
            elif i == CONTROL_IDS["[/ROLE]"]:
                self.name = unescape(self.c.decode(self.body))
                self.body = []
            elif role := self.ends.get(i):
                text = unescape(self.c.decode(self.body))
                self.sha.update(f"{role if self.name is None else self.name}\n{text}\n".encode())
                if self.masked:
                    learned = unescape(self.c.decode(self.masked))
                    self.loss += len(learned)
                    self.loss_sha.update(learned.encode())
                self.turns += 1
                self.name, self.body, self.masked = None, [], []
            else:
                self.body = []

    def row(self) -> tuple:
        return self.turns, self.sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def read_chat(formatted: DataFrame, path: str) -> DataFrame:
    """What format_chat's output says, a row a conversation: turns, digests of turns and of the text under the mask, and lengths."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, reader, done = decoder(path), None, None, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            for conv, text, ids, start, lo, hi in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "input_ids", "token_start", "loss_start", "loss_end")), strict=True):
                if reader is None or conv != now:
                    if reader:
                        done.append((now, *reader.row()))
                    now, reader = conv, Reader(c)
                reader.feed(text, ids, start, lo, hi)
            if len(done) > 5000:
                yield flush()
        if reader:
            done.append((now, *reader.row()))
        if done:
            yield flush()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe(spark))
    written = Scratch(spark, "chat").table(format_chat(turns, vocabulary()), "formatted")
    return read_chat(written, vocabulary())


#: The digests straight from the table. formatted_chars follows the template: the marks of each role and the escapes of each text.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</?s>|\[/?(INST|SYS|ROLE)\]')) AS body,
         length(role) + length(regexp_replace(role, '[^\\]', '', 'g')) + len(regexp_extract_all(role, '</?s>|\[/?(INST|SYS|ROLE)\]')) AS name FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7 ELSE 13 + 13 + name END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
