"""Language identification of mixed-language texts.

Script ranges narrow the candidates of every word, a model of hashed character n-grams scores the word for each of them, and
Viterbi with a penalty for each switch labels the word sequence, so that spans of different languages come apart. A document's
language is the one with most letters; the score is that language's share of the letters.

Nulls and texts without a letter: language ``und``, score 0, no spans. Ties between languages: the one that sorts first. Repeated rows
are labelled alike. Labels that are null are not trained on; with no labelled row at all, everything is ``und``. Extra columns are
not read; a kept column named like a result is replaced by it. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import viterbi
from .textbatch import fresh, map_rows, small_batches, steps, tidy

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
_RUN = re.compile(r"[^\W\d_]+")
#: Runs of letters: word characters that are no digits and no other numbers (such as fractions, or numbers in circles) either.
WORD = re.compile(rf"[^\W\d_{''.join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())}]+")
#: Script names and ranges of code points that tell candidates apart (Unicode blocks).
SCRIPTS = (("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
_STARTS = np.array([x[1] for x in SCRIPTS])
_ENDS = np.array([x[2] for x in SCRIPTS])
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: str) -> list[str]:
    """WORD's matches. Nearly all texts have no such numbers, and for them the shorter pattern finds the same, much faster."""
    found = _RUN.findall(text)
    return found if "".join(found).isalpha() else WORD.findall(text)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams (a mark at either end), the index of each one's word, and each word's script (-1: none)."""
    text = "".join(f"^{w}$" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    which = np.repeat(np.arange(len(words)), size)
    found, owner = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h += (code[i : i + m] + np.uint64(i + 1)) * _MIX[i]
        h ^= h >> np.uint64(29)
        h *= _MIX[n - 1]
        same = which[:m] == which[n - 1 :]
        found.append((h[same] >> np.uint64(48)).astype(np.int64))
        owner.append(which[:m][same])
    first = code[starts + 1].astype(np.int64)
    slot = np.searchsorted(_STARTS, first, side="right") - 1
    script = np.where((slot >= 0) & (first <= _ENDS[np.maximum(slot, 0)]), slot, -1)
    return np.concatenate(found), np.concatenate(owner), script


@dataclass
class Model:
    """langs in code-point order; score: (BUCKETS, langs) log probabilities; scripts: (langs, scripts + 1) candidates, the last for no known script."""

    langs: list[str]
    score: np.ndarray
    scripts: np.ndarray
    penalty: float = 12.0

    def words(self, words: list[str]) -> np.ndarray:
        """A row a word: its score for every language, 0 for the best; no candidate by script: far below."""
        bucket, owner, script = grams(words)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        order = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[order], np.arange(len(words)))
        out += np.add.reduceat(self.score[bucket[order]], at, axis=0)
        out = np.where(self.scripts[:, script].T, out, out - 1e4)
        return out - out.max(1, keepdims=True)


class Labeller:
    """Scores words once and keeps up to ``keep`` of them; when full it starts anew, so memory is bounded and results don't change."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model, self.keep = model, keep
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)), np.float32)
        k = len(model.langs)
        self.trans = np.where(np.eye(k, dtype=bool), 0.0, -model.penalty)

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the labels and the letters of its words."""
        words = [words_of(t.lower()) if t else [] for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if not flat or not self.model.langs:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        if len(self.ids) > self.keep:
            self.ids, self.rows = {}, self.rows[:0]
        ids = self.ids
        new = [w for w in dict.fromkeys(flat) if w not in ids]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.rows = np.concatenate([self.rows, self.model.words(part)])
            ids.update(zip(part, range(len(ids), len(ids) + len(part)), strict=True))
        scores = self.rows[np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))]
        ends = np.cumsum(n)
        starts = (ends - n)[n > 0]
        labels = viterbi(scores, starts, self.trans, np.zeros(len(self.model.langs)))
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        return [(labels[e - m : e], letters[e - m : e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most_docs: int = 2000, most_langs: int = 256) -> Model:
    """Learns from a bounded sample: of every language the ``most_docs`` different texts of lowest hash, each whole.

    Copies count once, before anything is gathered. A language's texts are thinned by a hash threshold before the exact cut, so that no task gathers all rows of a frequent
    language. n-grams are counted on the executors; the driver gets at most BUCKETS rows a language. More than
    ``most_langs`` languages raise an error rather than being cut.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    small_batches(docs.sparkSession)
    hashed = known.withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages; raise most_langs")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, len(SCRIPTS) + 1), bool))
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * most_docs / max(n, 1)))).otherwise(share)
    different = hashed.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["h", "text", "lang"])
    sample = different.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= most_docs).select("text", "lang")
    index = {name: i for i, name in enumerate(langs)}
    width = len(SCRIPTS) + 1

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch, texts in steps(batches, "text"):
            by: dict[int, Counter] = {}
            for t, name in zip(texts, batch.column("lang").to_pylist(), strict=True):
                by.setdefault(index[name], Counter()).update(words_of(t.lower()))
            for i, words in by.items():
                if words:
                    bucket, owner, script = grams(list(words))
                    times = np.fromiter(words.values(), np.int64, len(words))
                    got = total.setdefault(i, np.zeros(BUCKETS + width, np.int64))
                    got[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
                    got[BUCKETS:] += np.bincount(np.where(script < 0, width - 1, script), times, width).astype(np.int64)
        for i, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(got[at])], ["lang", "slot", "n"])

    counts = sample.mapInArrow(count, "lang long, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    full = np.zeros((len(langs), BUCKETS + width))
    full[counts["lang"].to_numpy(), counts["slot"].to_numpy()] = counts["n"].to_numpy()
    seen = full[:, :BUCKETS] + 0.05
    score = np.log(seen / seen.sum(1, keepdims=True)).T.astype(np.float32)
    scripts = full[:, BUCKETS:] > 0.01 * np.maximum(1, full[:, BUCKETS:].sum(1, keepdims=True))
    return Model(langs, np.ascontiguousarray(score), scripts)


def spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Maximal runs of words of one language: start and end in code points, end exclusive."""
    if not len(labels):
        return []
    change = np.flatnonzero(np.diff(labels)) + 1
    at = [0, *change.tolist(), len(labels)]
    if len(at) == 2 and text:
        return [{"start": 0, "end": len(text), "lang": langs[labels[0]]}]
    pattern = _RUN if "".join(_RUN.findall(text)).isalpha() else WORD
    words = [m.span() for m in pattern.finditer(text)]
    if len(words) != len(labels):  # lower() made a letter of another number of characters: place words in the lowered text's order
        words = [m.span() for m in WORD.finditer(text.lower())]
    return [{"start": words[a][0], "end": words[b - 1][1], "lang": langs[labels[a]]} for a, b in zip(at, at[1:], strict=False)]


NAMES = ("lang_pred", "score", "lang_spans")
KINDS = ("string", "double", "array<struct<start:long,end:long,lang:string>>")


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", with_spans: bool = True, names: tuple[str, ...] = NAMES) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred, score (0 to 1) and lang_spans, or by other ``names``; one row for every row."""

    def rows(texts: list[str | None], label: Labeller) -> list:
        pred, score, runs = [], [], []
        for t, (labels, letters) in zip(texts, label.label(texts), strict=True):
            by = np.bincount(labels, letters, len(model.langs)) if len(labels) else np.zeros(0)
            best = int(by.argmax()) if by.size else None
            pred.append("und" if best is None else model.langs[best])
            score.append(0.0 if best is None else float(by[best] / by.sum()))
            runs.append(spans(t, labels, model.langs) if with_spans and by.size else [])
        return [pred, score, runs]

    return map_rows(docs, keep, text, ", ".join(f"`{n}` {k}" for n, k in zip(names, KINDS, strict=True)), rows, lambda: Labeller(model))


def with_language(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs in which a language is found, learned from docs itself; those without any letter or text go.

    Where no row is labelled, nothing can be told apart, and every row with a letter stays.
    """
    model, columns = train(docs, text, lang), docs.columns
    if not model.langs:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    names = []
    for n in NAMES:
        names.append(fresh([*columns, *names], n))
    return identify(docs, model, columns, text, with_spans=False, names=tuple(names)).where(F.col(names[0]) != "und").select(*[F.col(f"`{c}`") for c in columns])


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents; learns only from rows whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    return identify(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "lang_spans")
