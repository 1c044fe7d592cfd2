"""The hidden Markov model against plain recursions, its counts against brute force, and hostile tables."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import lm_score as L


def model(rng, states=3, symbols=5):
    share = lambda *size: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(size) + 0.05)
    return L.Model(share(states), share(states, states), share(states, symbols))


def paths(m, text):
    """The probability of a text, and expected counts, over every path of states."""
    total, first, move, emit = 0.0, np.zeros(len(m.first)), np.zeros_like(m.move), np.zeros_like(m.emit.T)
    for path in itertools.product(range(len(m.first)), repeat=len(text)):
        p = m.first[path[0]] * np.prod([m.move[a, b] for a, b in itertools.pairwise(path)]) * np.prod([m.emit[s, o] for s, o in zip(path, text)])
        total += p
        first[path[0]] += p
        for a, b in itertools.pairwise(path):
            move[a, b] += p
        for s, o in zip(path, text):
            emit[o, s] += p
    return total, first / total, move / total, emit / total


def test_counts_over_every_path():
    rng = np.random.default_rng(0)
    m = model(rng)
    texts = [rng.integers(0, 5, n).astype("<u2") for n in (1, 2, 3, 5, 6)]
    assert np.allclose(L.log_likelihoods(m, texts), [math.log10(paths(m, t)[0]) for t in texts])
    first, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    L.expected(m, texts, first, move, emit)
    want = [sum(x) for x in zip(*(paths(m, t)[1:] for t in texts))]
    assert np.allclose(first, want[0]) and np.allclose(move, want[1]) and np.allclose(emit, want[2])


def plain(m, text):
    """Log-likelihood, states' chances and moves of one text, one token after the other."""
    a = [m.first * m.emit[:, text[0]]]
    log = math.log10(a[0].sum())
    a[0] /= a[0].sum()
    for o in text[1:]:
        x = (a[-1] @ m.move) * m.emit[:, o]
        log += math.log10(x.sum())
        a.append(x / x.sum())
    b = [np.ones(len(m.first))]
    for o in text[:0:-1]:
        x = m.move @ (m.emit[:, o] * b[0])
        b.insert(0, x / x.sum())
    gamma = np.array([x * y / (x * y).sum() for x, y in zip(a, b)])
    move = np.zeros_like(m.move)
    for t in range(1, len(text)):
        x = a[t - 1][:, None] * m.move * (m.emit[:, text[t]] * b[t])[None]
        move += x / x.sum()
    return log, gamma, move


@pytest.mark.parametrize("side", [4096, 3])
def test_long_texts_in_blocks(monkeypatch, side):
    """Texts of several blocks, at edges of blocks too, and blocks in slices."""
    monkeypatch.setattr(L, "SIDE", side * 4 if side < 8 else side)
    rng = np.random.default_rng(1)
    m = model(rng, 4, 7)
    texts = [rng.integers(0, 7, n).astype("<u2") for n in (1, 63, 64, 65, 128, 129, 1000, 3, 500, 192)]
    want = [plain(m, t) for t in texts]
    assert np.allclose(L.log_likelihoods(m, texts), [w[0] for w in want])
    first, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((7, 4))
    L.expected(m, texts, first, move, emit)
    assert np.allclose(first, sum(w[1][0] for w in want)) and np.allclose(move, sum(w[2] for w in want))
    expect = np.zeros((7, 4))
    for t, (_, gamma, _) in zip(texts, want):
        np.add.at(expect, t, gamma)
    assert np.allclose(emit, expect)


def test_each_round_is_likelier():
    """Baum-Welch never lowers the likelihood, but for the pull of its prior."""
    rng = np.random.default_rng(2)
    texts = [np.concatenate([rng.integers(2, 6, 40), rng.integers(6, 10, 40)]).astype("<u2") for _ in range(50)]
    share = np.bincount(np.concatenate(texts), minlength=10) + 1e-3
    known = L.Symbols(4000, 9, 50, 0, share / share.sum())
    m, before = L.reestimated(np.ones(2), np.array([[9.0, 1], [1, 9]]), np.stack([np.eye(10)[2] * 50, np.eye(10)[7] * 50]), known), -math.inf
    for _ in range(6):
        now = L.log_likelihoods(m, texts).sum()
        assert now > before - 0.5
        before = now
        first, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((10, 2))
        L.expected(m, texts, first, move, emit)
        m = L.reestimated(first, move, emit.T, known)
    assert m.move[0, 0] > 0.9 and m.first.max() > 0.9


def brute(rows):
    """(id, train, n_tokens, n_known, train_tokens, base) of (id, text, train) rows."""
    tokens = [(i, bool(train), [*(text or "").encode().lower().split(), None]) for i, text, train in rows]
    c = Counter(w for _, train, ws in tokens if train for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, train, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, train, ws in tokens), key=repr)


def scored(spark, rows, **options):
    given = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "id string, text string, train boolean, chunk string, number int, symbol int")
    scratch = L.Scratch(spark, "test")
    out = L.score_documents(given.repartition(3), scratch, **options).collect()
    scratch.close()
    return out


def test_hostile_rows(spark):
    rng = random.Random(4)
    words = ["the", "The", "d\u0085e", "x y", "\u001c", "été", "ÉTÉ", "a b", "1"] + [f"w{i}" for i in range(50)]
    rows = [(f"d{i}", " ".join(rng.choices(words, k=rng.randrange(0, 30))) + rng.choice(["", "\n", "\t\x0b\x0c\r "]), rng.choice([True, True, False, None])) for i in range(120)]
    rows += [("n", None, True), (None, "the", True), ("n", "", False), ("d1", "the the", True), ("d1", "the the", True), ("u", "never seen words", False), ("l", " ".join(rng.choices(words, k=20_000)), True)]
    got = scored(spark, rows, states=3, sample_rounds=1, rounds=1)
    assert sorted(((r["id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == brute(rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    same = {r["score"] for r in got if r["id"] == "d1" and r["n_tokens"] == 3}
    assert len(same) == 1


def test_no_training_text_and_no_rows(spark):
    got = scored(spark, [("a", "one two", False), ("b", None, None)])
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 2
    assert scored(spark, []) == []


def test_a_distribution_over_words(spark):
    """Over all one-word texts, known words and one unknown, chances of the word and the end sum to at most what the end leaves; texts of both tongues score above the unigram model."""
    rng = random.Random(5)
    tongues = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    make = lambda t: " ".join(rng.choices(tongues[t], k=40))
    rows = [(f"d{i}", make(i % 2), True) for i in range(200)] + [(f"h{i}", make(i % 2), False) for i in range(20)]
    every = [*tongues[0], *tongues[1], "unknown"]
    rows += [(f"one{i}", w, False) for i, w in enumerate(every)] + [("empty", "", False)]
    got = {r["id"]: r for r in scored(spark, rows, states=2)}
    assert all(got[f"h{i}"]["score"] > got[f"h{i}"]["base_score"] for i in range(20))
    short = sum(10 ** got[f"one{i}"]["score"] for i in range(len(every))) + 10 ** got["empty"]["score"]
    assert 0 < short < 1


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "en") for i in range(30)] + [(None, None, None)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = L.op11_lm_score(spark, str(tmp_path)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} and len(rows) == 31
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows if r["doc_id"] is not None)
