import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import chat, mixing, packing
from folio.llm.scratch import Scratch

PATH = packing.vocabulary()


@pytest.fixture(scope="module")
def raw():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_stretches_encode_like_whole_texts(raw):
    tok, rng = packing.PieceTokenizer(PATH, keep=50), random.Random(3)
    bits = ["a", "the", "é", " ", "\n", ".", ",", "'s", "1", "\t", " x", " ", "日本", " ", "!", " ll", "<|endoftext|>", "\x02", "..", "x."]
    for _ in range(3000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert list(np.frombuffer(tok.encode(s), "<u4")) == raw.encode(s, add_special_tokens=False).ids, s


def test_what_is_new_in_many_texts_is_encoded_together(raw):
    rng = random.Random(4)
    bits = ["a", "the", "été", " ", "\n", ".", ",", "'s", "1", " ", " x", "日本", "Ġ", "Ċ", "x.", "\u0130", "Ĭ"]
    for keep in (0, 40, 100_000):
        tok = packing.PieceTokenizer(PATH, keep=keep)
        for _ in range(20):
            texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(50)] + [None, ""]
            assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode_all(texts)] == [raw.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(tok.known) <= keep

    class Counted:
        calls = 0

        def __getattr__(self, name):
            Counted.calls += name.startswith("encode")
            return getattr(raw, name)

    tok = packing.PieceTokenizer(PATH)
    tok.tok = Counted()
    words = [f"{a}{b}" for a in "xyz" for b in range(300)]
    texts = [" ".join(rng.sample(words, 40)) + "." for _ in range(200)]
    assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode_all(texts)] == [raw.encode(t, add_special_tokens=False).ids for t in texts]
    # One call for 2,000 stretches, none for each text.
    assert Counted.calls <= 2
    tok = packing.PieceTokenizer(PATH, room=50_000)
    for i in range(40):
        tok.encode_all([" ".join(f"w{i}x{j}" + "long" * 50 * (j % 2) for j in range(100))])
    assert 100 <= len(tok.known) < 500 and max(map(len, tok.known)) <= 64


DOCS = [(1, None, "x"), (2, "", None), (None, "two words", "x"), (2, "", None), (3, "word " * 3000, "y"), (4, "a\tb", ""), (5, "a<|endoftext|> b", "y")]


def docs(spark):
    return spark.createDataFrame([(*d, 7, "extra") for d in DOCS], "doc_id long, text string, source string, length long, sequence_id string")


def test_packing_of_odd_rows(spark, raw):
    got = packing.pack_documents(docs(spark), PATH).collect()
    expected = Counter()
    for d, text, _ in DOCS:
        ids = [*raw.encode(text or "", add_special_tokens=False).ids, 2]
        at, cut, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            expected[d, k, at, cut - at, zlib.crc32(np.array(ids[at:cut], "<u4").tobytes())] += 1
            at, cut, k = cut, cut + 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack_documents(docs(spark).limit(0), PATH).count() == 0


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            fit = capacity
        else:
            gaps.remove(fit)
        gaps.append(fit - n)
    return len(gaps)


def test_a_piece_takes_the_last_free_slot():
    rng = random.Random(1)
    for _ in range(1500):
        opens = [rng.random() < 0.5 for _ in range(rng.randrange(0, 30))]
        cuts = sorted(rng.randrange(len(opens) + 1) for _ in range(rng.randrange(0, 4)))
        free, pairs, lost = [], set(), []
        for i, x in enumerate(opens):
            if x:
                free.append(i)
            elif free:
                pairs.add((i, free.pop()))
            else:
                lost.append(i)
        item, slot, none, left = packing.stack_match(np.array(opens, bool))
        assert set(zip(item.tolist(), slot.tolist(), strict=True)) == pairs and none.tolist() == lost and left.tolist() == free
        # The same in ranges: what they leave open is matched across them.
        got, over, at = set(), [], {}
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(opens)], strict=True)):
            item, slot, none, left = packing.stack_match(np.array(opens[a:b], bool))
            got |= {(a + i, a + j) for i, j in zip(item.tolist(), slot.tolist(), strict=True)}
            over.append((k, len(none), len(left)))
            at[k] = ([a + i for i in none.tolist()], [a + i for i in left.tolist()])
        for from_, top, to, low, n in packing.across(over):
            got |= {(at[to][0][low + i], at[from_][1][top - i]) for i in range(n)}
        assert got == pairs


def test_rounds_are_close_to_sequential_best_fit(spark, monkeypatch):
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 40), 7, 20, 40]) for _ in range(700)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, item string")
    for rows in (500_000, 60):
        monkeypatch.setattr(packing, "RANGE_ROWS", rows)
        used = {}
        for r in packing.pack(df, Scratch(spark, "pack"), 40).collect():
            assert r.length == lengths[r.doc_id] and r.item == "x"
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sum(map(len, used.values())) == len(lengths)
        for parts in used.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= 40
        assert len(used) <= 1.03 * best_fit(lengths, 40), (len(used), best_fit(lengths, 40))


def test_sequences_are_within_a_hundredth_of_the_bound(spark):
    got = packing.op2_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length").toPandas()
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 1024)


def test_mixing_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "b", "b", "b", None, "d"])) for i in range(400)] + [(7, "w w", "a"), (7, "w w", "a"), (900, None, "z"), (None, "w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for r in got:
        assert r._target == pytest.approx(target[r.source]) and 0 <= r._times <= 2
        taken[r.source] += r._times * r._size
    for s in order:
        assert abs(taken[s] - target[s]) <= 40
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter((r.doc_id, r.source, r._times) for r in again) == Counter((r.doc_id, r.source, r._times) for r in got)
    assert mixing.mixed_rows(df).count() == sum(r._times for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    odd = df.withColumns({c: F.lit("x") for c in ("_size", "_source_size", "_times", "h", "found", "_copies")})
    assert Counter((r.doc_id, r.source, r._times) for r in mixing.mix(odd).collect()) == Counter((r.doc_id, r.source, r._times) for r in got)
    assert mixing.mixed_rows(odd).columns == odd.columns and mixing.mixed_rows(odd).where("_size = 'x'").count() == sum(r._times for r in got)


def test_sources_in_ranges_have_the_same_targets(spark, monkeypatch):
    df = spark.createDataFrame([(f"s{i:03d}" if i else None, i % 17 * (i % 5)) for i in range(300)], "source string, source_size long")
    run = lambda: {r.source: r.target for r in mixing.targets(df, 1.5, 2.0, (5, 2, 1), Scratch(spark, "t")).collect()}
    one = run()
    monkeypatch.setattr(mixing, "SOURCES_IN_TASK", 40)
    assert run() == pytest.approx(one)


def test_word_counts(spark):
    texts = ["", None, " a  b\n", " x  y", "one", "\t\r\n\x0b\x0c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [0, 0, 2, 2, 1, 0]


TURNS = [(1, None, None, "a\\[INST]\\\\</s>"), (1, 0, "tool]x[/ROLE]", None), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, "assistant", "\\"), (None, 1, "assistant", "\\"), (3, 1, "system", "x" * 50_000), (3, 2, "assistant", "日本 é\n")]


def test_chat_round_trip(spark):
    import hashlib

    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    made = Scratch(spark, "chat").table(chat.format_chat(df, PATH), "formatted")
    for r in made.collect():
        ids = r.input_ids
        assert all(0 <= i < chat.FIRST_ID + len(chat.CONTROLS) for i in ids)
        body = r.formatted
        assert len([i for i in ids if i >= chat.FIRST_ID]) == len(chat._CONTROL.findall(body))
    got = {r.conv_id: r for r in chat.read_chat(made, PATH).collect()}
    by = {}
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_chat(chat.format_chat(df.limit(0), PATH), PATH).count() == 0


def test_escapes_are_reversible():
    for t in ("", "\\", "\\\\</s>", "<s></s>[INST][/ROLE]", "<\\s>", "no"):
        safe = chat.escape(t)
        assert chat.unescape(safe) == t and not chat._CONTROL.search(safe)
    assert math.isfinite(len(chat.CONTROLS))


def test_slots_are_bounded_by_pieces(spark):
    """However many gaps are open, a few pieces are offered a few of them: the smallest that hold them, and enough of each smaller size."""
    gaps = spark.range(10_000).select(F.col("id").alias("seq"), F.lit(424).cast("long").alias("gap")).union(spark.range(20_000, 20_050).select("id", F.lit(900).cast("long")))
    offered, about = packing.wanted(gaps, 0, 1, 1, 10_050 * 1024)
    held = gaps.where(offered).groupBy("gap").count().collect()
    assert about <= 20 and [r["gap"] for r in held] == [424] and 1 <= held[0]["count"] < 100
    # Pieces that only the largest gaps hold find all of them.
    offered, _ = packing.wanted(gaps, 512, 1024, 100, 10_050)
    assert {r["gap"]: r["count"] for r in gaps.where(offered).groupBy("gap").count().collect()} == {900: 50}
    items = spark.range(2001).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") == 2000, 1).otherwise(600).cast("long").alias("length"))
    assert packing.pack(items, Scratch(spark, "few")).select("sequence_id").distinct().count() == 2000
