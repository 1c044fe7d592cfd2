"""Scoring documents with a hidden Markov language model.

Latent states emit symbols: the end of a text, a frequent word, or a class of rarer words that end alike. Within its symbol a word has its share of the
unigram model q(w) = (c + 1) / (N + V + 1), so P(w | state) = E[state, s(w)] q(w) / Q(s(w)), with Q the sum of q over the symbol: a distribution over all
words, however many there are, of which only E (states x symbols) is held anywhere whole. Words that no training text has are one symbol; its mass is that of words seen once.
A text's log probability is then base + log P(symbols) - sum log Q(s), where P(symbols) is exact: the scaled forward recursion.

Baum-Welch: each task adds its expected counts up, which are summed by symbol. A text is cut into blocks; a block's transfer between states is a small matrix, so
the blocks of a long text are worked on side by side and chained exactly. Rounds on a bounded sample of training texts (SAMPLE) only choose where to begin; the model's
own rounds take every training text.

Counting: a task takes texts in chunks, numbers a chunk's distinct words, and keeps texts as numbers. Only a chunk's distinct words are shuffled, once to be counted and once, with counts and
symbols, back to their chunk; a word has at most one row a chunk, so no word is hot. The vocabulary is never collected.

Cases: a null or empty text is its end alone. Without training text every token is unknown, base and score are 0. Repeated rows and ids are rows of their own, a null train is false.
Texts of any length are whole. An empty table gives no rows. Only the columns named are looked at. Words are what bytes 32 and 9 to 13 part, with A-Z in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from .scratch import Scratch
from .textbatch import small_batches, tidy

#: Characters, and distinct words, of a chunk after which the next begins; numbers of documents' words in a batch.
CHUNK_CHARS, CHUNK_WORDS, BATCH_TOKENS = 16_000_000, 300_000, 200_000
#: The model: states, words with symbols of their own, classes of other words; documents that choose the start, rounds on them, rounds on all.
STATES, OWN_WORDS, CLASSES, SAMPLE, SAMPLE_ROUNDS, ROUNDS = 8, 4096, 2048, 2000, 8, 2
UNKNOWN, END, FIRST_WORD = 0, 1, 2
#: Tokens of the unigram model, and transitions, that are added to a state's counts.
PRIOR, MOVES = 100.0, 0.5
#: Tokens of a block, and blocks that are worked on at once.
BLOCK, SIDE = 64, 4096


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# --- words to symbols ------------------------------------------------------------------------------------------------------------

class _Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte place, so that the high bytes, mostly zero, compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (id, text, train) -> a table of two kinds of rows: words of chunks (chunk, number, word, n: times in training texts), and texts (chunk, id, train, numbers)."""
    small_batches(rows.sparkSession)
    given = rows.select("id", F.coalesce("train", F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([*_parse_datatype_string("chunk bigint, number int, word string, n bigint").fields, StructField("id", given.schema["id"].dataType), *_parse_datatype_string("train boolean, numbers binary").fields])
    arrow = _arrow(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, words, held, chars, seen = TaskContext.get().partitionId() << 32, _Numbers(), [], 0, []

        def batch_of(rows_: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows_, f.type) for f in arrow], schema=arrow)

        def texts() -> Iterator[pa.RecordBatch]:
            if held:
                yield batch_of(len(held), chunk=[chunk] * len(held), id=[h[0] for h in held], train=[h[1] for h in held], numbers=[h[2] for h in held])
                held.clear()

        def told() -> Iterator[pa.RecordBatch]:
            yield from texts()
            times = np.bincount(np.concatenate(seen), minlength=len(words)) if seen else np.zeros(len(words), np.int64)
            all_ = list(words)
            for at in range(0, len(all_), 50_000):
                part = all_[at : at + 50_000]
                yield batch_of(len(part), chunk=[chunk] * len(part), number=np.arange(at, at + len(part), dtype=np.int32), word=pa.array(part, pa.binary()).cast(pa.string()), n=times[at : at + len(part)])

        size = 0
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(2)[at].as_py().encode("utf-8")
                numbers = np.array([words[w] for w in data.lower().split()], np.uint32)
                train = batch.column(1)[at].as_py()
                if train and len(numbers):
                    seen.append(numbers)
                held.append((batch.column(0)[at].as_py(), train, planes(numbers)))
                chars, size = chars + len(data), size + 4 * len(numbers)
                if size > 4 << 20:
                    yield from texts()
                    size = 0
                if chars >= CHUNK_CHARS or len(words) >= CHUNK_WORDS:
                    yield from told()
                    chunk, words, chars, seen, size = chunk + 1, _Numbers(), 0, [], 0
        yield from told()

    return scratch.table(given.mapInArrow(run, schema), "numbered")


class Symbols:
    """What is known of the training tokens: their number, distinct ones, ends, and each symbol's share of the unigram model."""

    def __init__(self, tokens: int, distinct: int, ends: int, once: int, share: np.ndarray):
        self.tokens, self.distinct, self.ends, self.share = tokens, distinct, ends, share
        self.unknown = min(0.5, max(once, 1) / max(tokens, 1))


def counted(numbered_: DataFrame, scratch: Scratch, own: int = OWN_WORDS, classes: int = CLASSES) -> tuple[DataFrame, Symbols]:
    """((chunk, number, c, symbol) of every word, what is known of the tokens)."""
    by_word = Window.partitionBy("word")
    words = numbered_.where("word is not null").select("chunk", "number", "word", F.sum("n").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("lead"))
    words = scratch.table(words, "words")
    known = words.where("lead and c > 0").select("word", "c")
    n, v, once = known.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    ends = numbered_.where("train").count()
    tokens, distinct = (n or 0) + ends, v + (ends > 0)
    # A bounded list: the words with symbols of their own.
    frequent = known.orderBy(F.desc("c"), "word").limit(own)
    frequent = scratch.table(frequent.select(F.col("word").alias("frequent"), (F.row_number().over(Window.orderBy(F.desc("c"), "word")) + FIRST_WORD - 1).alias("own")), "frequent")
    class_ = F.lit(FIRST_WORD + own) + F.pmod(F.xxhash64(F.substring("word", -2, 2)), F.lit(classes))
    placed = words.join(F.broadcast(frequent), F.col("word") == F.col("frequent"), "left").select("chunk", "number", "c", "lead", F.when(F.col("c") == 0, UNKNOWN).otherwise(F.coalesce("own", class_)).cast("int").alias("symbol"))
    share = np.zeros(FIRST_WORD + own + classes)
    share[UNKNOWN], share[END] = 1, ends + 1
    for r in placed.where("lead and c > 0").groupBy("symbol").agg(F.sum(F.col("c") + 1).alias("mass")).collect():
        share[r["symbol"]] = r["mass"]
    return placed.drop("lead"), Symbols(tokens, distinct, ends, once, share / (tokens + distinct + 1))


def encoded(numbered_: DataFrame, placed: DataFrame, known: Symbols, scratch: Scratch) -> DataFrame:
    """(id, train, n_tokens, n_known, base, away, symbols): texts as symbols (two bytes each, the end included), base: log10 of the unigram model, away: the sum of log10 Q."""
    id_field = numbered_.schema["id"]
    texts = numbered_.where("numbers is not null").select("chunk", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("int").alias("symbol"), "id", "train", "numbers")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema.fields[5:]]
    words = placed.select("chunk", F.lit(0).alias("kind"), "number", "c", "symbol", *nothing)
    schema = StructType([id_field, *_parse_datatype_string("train boolean, n_tokens bigint, n_known bigint, base double, away double, symbols binary").fields])
    arrow = _arrow(schema)
    whole, ends = math.log10(known.tokens + known.distinct + 1), known.ends
    with np.errstate(divide="ignore"):
        share = np.log10(known.share)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c, symbol = None, np.zeros(0, np.int64), np.zeros(0, np.uint16)
        log = away = None
        for batch in batches:
            chunks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
            for from_, to in zip([0, *cuts], [*cuts, len(chunks)], strict=True):
                if from_ == to:
                    continue
                part = batch.slice(from_, to - from_)
                if chunks[from_] != now:
                    now, c, symbol, log = int(chunks[from_]), np.zeros(0, np.int64), np.zeros(0, np.uint16), None
                if kinds[from_] == 0:
                    number = part.column(2).to_numpy()
                    if number.max() >= len(c):
                        grown = max(int(number.max()) + 1, 2 * len(c))
                        c, symbol = np.concatenate([c, np.zeros(grown - len(c), np.int64)]), np.concatenate([symbol, np.zeros(grown - len(symbol), np.uint16)])
                    c[number], symbol[number] = part.column(3).to_numpy(), part.column(4).to_numpy()
                    continue
                if log is None:
                    log, away = np.log10(c + 1), share[symbol]
                out = []
                for id_, train, data in zip(*(part.column(i).to_pylist() for i in (5, 6, 7)), strict=True):
                    at = unplaned(data)
                    out.append({id_field.name: id_, "train": train, "n_tokens": len(at) + 1, "n_known": int((c[at] > 0).sum()) + (ends > 0), "base": float(log[at].sum()) + math.log10(ends + 1) - (len(at) + 1) * whole, "away": float(away[at].sum() + share[END]), "symbols": np.append(symbol[at], np.uint16(END)).astype("<u2").tobytes()})
                yield pa.RecordBatch.from_pylist(out, arrow)

    together = words.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return scratch.table(together.mapInArrow(run, schema), "encoded")


# --- the model -------------------------------------------------------------------------------------------------------------------

class Model:
    """Chances of first states (K,), of next states (K, K) and of symbols (K, S)."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move, self.emit = first, move, emit
        self.by_symbol = np.ascontiguousarray(emit.T)


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols (BLOCK, blocks), tokens of each block, text of each block, place of each text's first block)."""
    sizes = np.array([len(t) for t in texts])
    blocks = -(-sizes // BLOCK)
    start = np.append(0, np.cumsum(blocks))
    flat = np.zeros(int(start[-1]) * BLOCK, np.uint16)
    for i, t in enumerate(texts):
        flat[start[i] * BLOCK : start[i] * BLOCK + len(t)] = t
    length = np.full(int(start[-1]), BLOCK)
    length[start[1:] - 1] = sizes - (blocks - 1) * BLOCK
    return np.ascontiguousarray(flat.reshape(-1, BLOCK).T), length, np.repeat(np.arange(len(texts)), blocks), start


def _transfers(model: Model, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each block's matrix from the state before it to the state at its end, up to a factor."""
    out = np.empty((symbols.shape[1], len(model.first), len(model.first)))
    for s in range(0, len(out), SIDE // 4):
        part = slice(s, s + SIDE // 4)
        m = np.broadcast_to(np.eye(len(model.first)), out[part].shape).copy()
        for t in range(BLOCK):
            live = length[part] > t
            if not live.any():
                break
            step = (m @ model.move) * model.by_symbol[symbols[t, part]][:, None, :]
            if t % 8 == 7:
                step /= np.maximum(step.max((1, 2), keepdims=True), 1e-300)
            m = step if live.all() else np.where(live[:, None, None], step, m)
        out[part] = m / np.maximum(m.max((1, 2), keepdims=True), 1e-300)
    return out


def _edges(model: Model, symbols: np.ndarray, length: np.ndarray, text: np.ndarray, start: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """State chances before each block, given what came (a text's first block has none), and, backward, weights at each block's end, given what follows."""
    k = len(model.first)
    before, after = np.zeros((len(length), k)), np.ones((len(length), k))
    blocks = np.diff(start)
    many = np.flatnonzero(blocks > 1)
    if not len(many):
        return before, after
    held = np.flatnonzero(blocks[text] > 1)
    place = np.full(len(length), -1)
    place[held] = np.arange(len(held))
    matrix = _transfers(model, symbols[:, held], length[held])
    order = many[np.argsort(-blocks[many], kind="stable")]
    first = start[order]
    now, _ = _forward(model, symbols[:, first], length[first], np.zeros((len(first), k)), np.ones(len(first), bool))
    for j in range(1, int(blocks[order[0]])):
        n = int((blocks[order] > j).sum())
        now = now[:n]
        before[first[:n] + j] = now
        now = np.einsum("bi,bij->bj", now, matrix[place[first[:n] + j]])
        now /= np.maximum(now.sum(1, keepdims=True), 1e-300)
    if backward:
        for j in range(int(blocks[order[0]]) - 1, 0, -1):
            at = first[: int((blocks[order] > j).sum())] + j
            weight = np.einsum("bij,bj->bi", matrix[place[at]], after[at])
            after[at - 1] = weight / np.maximum(weight.max(1, keepdims=True), 1e-300)
    return before, after


def _forward(model: Model, symbols: np.ndarray, length: np.ndarray, before: np.ndarray, opens: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(state chances at each block's end, log10 of each block's probability given what came before)."""
    now, log = before, np.zeros(len(length))
    for t in range(int(length.max())):
        come = now @ model.move
        if t == 0:
            come = np.where(opens[:, None], model.first, come)
        step = come * model.by_symbol[symbols[t]]
        scale = np.maximum(step.sum(1), 1e-300)
        step /= scale[:, None]
        live = length > t
        log += np.where(live, np.log10(scale), 0)
        now = step if live.all() else np.where(live[:, None], step, now)
        if keep is not None:
            keep.append(now)
    return now, log


def _slices(n: int) -> Iterator[slice]:
    return (slice(s, s + SIDE) for s in range(0, n, SIDE))


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 P(symbols) of each text."""
    symbols, length, text, start = _laid_out(texts)
    before, _ = _edges(model, symbols, length, text, start, backward=False)
    opens = np.zeros(len(length), bool)
    opens[start[:-1]] = True
    out = np.zeros(len(texts))
    for part in _slices(len(length)):
        out += np.bincount(text[part], _forward(model, symbols[:, part], length[part], before[part], opens[part])[1], len(texts))
    return out


def expected(model: Model, texts: list[np.ndarray], first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
    """Adds the expected counts of first states, moves and symbols (S, K) of these texts."""
    symbols, length, text, start = _laid_out(texts)
    before, after = _edges(model, symbols, length, text, start, backward=True)
    opens = np.zeros(len(length), bool)
    opens[start[:-1]] = True
    for part in _slices(len(length)):
        sym, size, open_ = symbols[:, part], length[part], opens[part]
        chances: list[np.ndarray] = []
        _forward(model, sym, size, before[part], open_, chances)
        weight = after[part]
        states = np.zeros((len(chances), len(size), len(model.first)))
        for t in range(len(chances) - 1, -1, -1):
            live = (size > t)[:, None]
            both = chances[t] * weight
            states[t] = np.where(live, both / np.maximum(both.sum(1, keepdims=True), 1e-300), 0)
            come = chances[t - 1] if t else before[part]
            ahead = model.by_symbol[sym[t]] * weight
            back = ahead @ model.move.T
            total = np.maximum((come * back).sum(1, keepdims=True), 1e-300)
            moved = live if t else live & ~open_[:, None]
            move += (np.where(moved, come / total, 0).T @ ahead) * model.move
            back /= np.maximum(back.max(1, keepdims=True), 1e-300)
            weight = back if live.all() else np.where(live, back, weight)
        first += states[0][open_].sum(0)
        flat, used = sym[: len(chances)].ravel(), states.reshape(-1, len(model.first))
        for s in range(len(model.first)):
            emit[:, s] += np.bincount(flat, used[:, s], len(emit))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches cut so that each step has a bounded number of tokens (a longer text is a step of its own)."""
    for batch in batches:
        sizes = [len(x) // 2 for x in batch.column(column).to_pylist()]
        at = 0
        while at < len(sizes):
            end, held = at + 1, sizes[at]
            while end < len(sizes) and held + sizes[end] <= BATCH_TOKENS:
                held += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [np.frombuffer(x, "<u2") for x in part.column(column).to_pylist()]
            at = end


def counts(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all texts (symbols binary): a row a symbol from each task, summed by symbol. What comes back is as large as the model."""
    k = len(model.first)
    sent = texts.sparkSession.sparkContext.broadcast((model.first, model.move, model.emit))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*sent.value)
        first, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((held.emit.shape[1], k))
        for _, found in _texts(batches, 0):
            expected(held, found, first, move, emit)
        used = np.flatnonzero(emit.any(1))
        rows = np.concatenate([emit[used], move, first[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, -2 - np.arange(k), [-1]]).astype(np.int32)), *(pa.array(rows[:, s]) for s in range(k))], ["symbol", *(f"s{s}" for s in range(k))])

    rows = texts.select("symbols").mapInArrow(run, "symbol int, " + ", ".join(f"s{s} double" for s in range(k))).groupBy("symbol").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).collect()
    first, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, model.emit.shape[1]))
    for r in rows:
        if r[0] >= 0:
            emit[:, r[0]] = r[1:]
        elif r[0] == -1:
            first[:] = r[1:]
        else:
            move[-2 - r[0]] = r[1:]
    sent.unpersist()
    return first, move, emit


def reestimated(first: np.ndarray, move: np.ndarray, emit: np.ndarray, known: Symbols) -> Model:
    """The model of the counts, drawn towards the unigram model; unknown words have their fixed mass in every state."""
    share = known.share.copy()
    share[UNKNOWN] = 0
    share /= max(share.sum(), 1e-300)
    e = emit + PRIOR * share
    e[:, UNKNOWN] = 0
    e *= (1 - known.unknown) / e.sum(1, keepdims=True)
    e[:, UNKNOWN] = known.unknown
    f, m = first + MOVES, move + MOVES
    return Model(f / f.sum(), m / m.sum(1, keepdims=True), e)


def _begin(sample: DataFrame, known: Symbols, states: int) -> Model:
    """A start from texts that differ most: each state leans towards one of them."""
    rows = [np.frombuffer(r["symbols"], "<u2") for r in sample.orderBy(F.xxhash64("symbols"), "symbols").limit(256).collect()]
    counts_ = np.array([np.bincount(r, minlength=len(known.share)) for r in rows], np.float64).reshape(len(rows), len(known.share))
    lean = counts_ / np.sqrt(np.maximum(known.share, 1e-300))
    lean /= np.maximum(np.linalg.norm(lean, axis=1, keepdims=True), 1e-300)
    chosen = [0]
    near = lean @ lean[0] if len(rows) else np.zeros(0)
    while len(chosen) < min(states, len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, lean @ lean[chosen[-1]])
    emit = np.zeros((states, len(known.share)))
    for s in range(min(states, len(rows))):
        emit[s] = counts_[chosen[s]]
    return reestimated(np.ones(states), np.eye(states) * 10 * states + 1, emit, known)


def trained(texts: DataFrame, known: Symbols, scratch: Scratch, *, states: int = STATES, sample: int = SAMPLE, sample_rounds: int = SAMPLE_ROUNDS, rounds: int = ROUNDS) -> Model:
    """Baum-Welch on all of texts (id, n_tokens, symbols). Its start comes from rounds on a sample, chosen by hash, of at most 2 x sample texts of 20,000 tokens at most."""
    n = max(1, known.ends)
    fit = texts.where("n_tokens between 2 and 20000").where(F.pmod(F.xxhash64("id", "symbols"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    few = scratch.table(fit.select("symbols").limit(2 * sample).repartition(8), "sample")
    model = _begin(few, known, states)
    for _ in range(sample_rounds):
        model = reestimated(*counts(few, model), known)
    for _ in range(rounds):
        model = reestimated(*counts(texts, model), known)
    return model


def score_documents(rows: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """rows (id, text, train) -> (id, train, n_tokens, n_known, train_tokens, base_score, score), a row each. options are trained()'s."""
    numbers = numbered(rows, scratch)
    placed, known = counted(numbers, scratch)
    texts = encoded(numbers, placed, known, scratch)
    scratch.drop(numbers)
    same = ["id", "train", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score")]
    if not known.tokens:
        return texts.select(*same, F.col("base").alias("score"))
    model = trained(texts.where("train"), known, scratch, **options)
    sent = rows.sparkSession.sparkContext.broadcast((model.first, model.move, model.emit))
    given = texts.select(*same, "away", "symbols")
    schema = StructType([*given.schema.fields[:6], *_parse_datatype_string("score double").fields])
    arrow = _arrow(schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*sent.value)
        for part, found in _texts(batches, 7):
            score = part.column(5).to_numpy() - part.column(6).to_numpy() + log_likelihoods(held, found)
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(score)], schema=arrow)

    return given.mapInArrow(run, schema)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    scored = score_documents(docs.select(F.col("doc_id").alias("id"), "text", (~held_out).alias("train")), Scratch(spark, "lm"))
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
